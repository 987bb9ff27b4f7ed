"""Input scans and vendor-shape mappings. Nothing is inferred from data: text is cast to the
contract with try_cast, so a malformed cell becomes NULL instead of failing or changing a type."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from paneloom.functions.expr import nan_to_null
from paneloom.operators.features import month_end_last
from paneloom.operators.quality import keep_last, parse_dates


def normalise_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def apply_contract(df: DataFrame, ddl: str) -> DataFrame:
    """Cast the columns the contract knows, keep the rest, turn NaN into NULL."""
    known = {f.name: f.dataType for f in T.StructType.fromDDL(ddl)}
    out = []
    for c in df.columns:
        t = known.get(c)
        if t is None:
            out.append(F.col(c))
        elif isinstance(t, T.DateType):
            out.append(F.try_to_timestamp(F.col(c).cast("string")).cast("date").alias(c))
        elif isinstance(t, T.DoubleType):
            out.append(nan_to_null(F.col(c).try_cast("double")).alias(c))
        else:
            out.append(F.col(c).cast(t).alias(c))
    return df.select(*out)


def read_table_csv(spark: SparkSession, path, ddl, seq="input_seq") -> DataFrame:
    """One CSV input: header names trimmed and lower-cased, columns in any order, typed by the
    contract, with `seq` carrying file order for keep-last."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return apply_contract(normalise_header(in_file_order(raw, seq)), ddl)


def in_file_order(df: DataFrame, seq="input_seq") -> DataFrame:
    """Adds the place of each row over all files read: file, then piece of the file, then row in it. Spark deals pieces to tasks by
    size; a piece is read by one task from its first row to its last, so the row's number in the task orders it there."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                   F.monotonically_increasing_id().alias("row")).alias(seq))


def parse_series(df: DataFrame, series, date_col, value_col, missing=".") -> DataFrame:
    """Two text columns of a series file to (series_name, date, value)."""
    v = F.nullif(F.trim(F.col(value_col)), F.lit(missing)).try_cast("double")
    name = F.lit(series) if isinstance(series, str) else series
    d = df.select(name.alias("series_name"), F.col(date_col).alias("date"), v.alias("value"))
    return parse_dates(d, "date")


def read_series_dir(spark: SparkSession, path, codes) -> DataFrame:
    """All series files of a folder in one job; the file name is the series code."""
    raw = (spark.read.schema("observation_date STRING, raw STRING").option("header", True)
           .csv(path).withColumn("code", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.csv$", 1)))
    table = spark.createDataFrame(list(codes.items()), "code STRING, series_name STRING")
    named = raw.join(F.broadcast(table), "code")
    return parse_series(named, F.col("series_name"), "observation_date", "raw")


def wide_block_to_prices(block: DataFrame, tickers, date="date", close="Close", volume="Volume",
                         sep="|") -> DataFrame:
    """Vendor block with columns '<ticker>|Close', '<ticker>|Volume' to long prices. Tickers the
    block lacks are skipped; rows missing either field are dropped. One pass over the block."""
    held = [t for t in tickers if f"{t}{sep}{close}" in block.columns and f"{t}{sep}{volume}" in block.columns]
    cell = lambda t, f: F.col(f"`{t}{sep}{f}`").cast("double")
    each = F.array(*[F.struct(F.lit(t).alias("ticker"), cell(t, close).alias("adj_close"),
                              cell(t, volume).alias("volume")) for t in held]) if held else \
        F.array().cast("array<struct<ticker:string,adj_close:double,volume:double>>")
    long = block.select(F.col(date).alias("date"), F.explode(each).alias("r"))
    return long.select("date", "r.ticker", "r.adj_close", "r.volume").dropna(subset=["adj_close", "volume"])


def map_records(df: DataFrame, json_col, fields: dict, keep=()) -> DataFrame:
    """JSON text records to canonical attributes; an absent field is NULL, never made up."""
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in fields])
    rec = F.from_json(F.col(json_col), schema)
    return df.select(*keep, rec.alias("r")).select(*keep, *[F.col(f"r.`{f}`").alias(a) for f, a in fields.items()])


def read_records(spark: SparkSession, path, fields: dict, ids=("symbol", "date")) -> DataFrame:
    schema = T.StructType([*[T.StructField(i, T.StringType()) for i in ids],
                           *[T.StructField(f, T.DoubleType()) for f in fields]])
    return spark.read.schema(schema).json(path).select(
        *ids, *[F.col(f"`{f}`").alias(a) for f, a in fields.items()])


def join_record_sets(left: DataFrame, right: DataFrame, keys, seq) -> DataFrame:
    """Left join of two vendor record sets; of repeated right keys the last one counts."""
    return left.join(keep_last(right, keys, [seq]).drop(seq), list(keys), "left")


def month_end_series(long: DataFrame) -> DataFrame:
    """(series_name, date, value) at any frequency to month ends."""
    return month_end_last(long, ["series_name"])


def align_series(long: DataFrame, names) -> DataFrame:
    """Outer-align monthly series as columns; a month nobody reports is dropped."""
    wide = long.groupBy("date").pivot("series_name", list(names)).agg(F.max("value"))
    return wide.dropna(how="all", subset=list(names))


def wide_to_long(macro: DataFrame, date="date") -> DataFrame:
    cols = [c for c in macro.columns if c != date]
    return macro.unpivot([date], cols, "series_name", "value").where("value IS NOT NULL")


def long_to_wide(store: DataFrame, names, date="observation_date") -> DataFrame:
    """Macro store to columns; several providers of one observation resolve to the newest."""
    return (store.groupBy(F.col(date).alias("date")).pivot("series_name", list(names))
            .agg(F.max_by("value", F.struct("retrieved_at", "provider"))))


def restrict_to_universe(df: DataFrame, universe: DataFrame, entity="ticker") -> DataFrame:
    return df.join(universe.select(entity).distinct(), entity, "left_semi")


def universe_from_lines(lines: DataFrame, line="value") -> DataFrame:
    t = F.trim(F.col(line))
    return lines.where((t != "") & ~t.startswith("#")).select(F.upper(t).alias("ticker"))


def read_universe(spark: SparkSession, path) -> DataFrame:
    return universe_from_lines(spark.read.text(path))
