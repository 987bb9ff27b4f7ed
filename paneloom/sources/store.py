"""Parquet store: lineage, keyed upsert, run-tagged results.

A store is a folder of generations, written once and never changed, and of manifests, each a small list that says in which
generation the rows of each month are. An upsert writes the months a delivery touches as a new generation and then one manifest;
that one file is the commit. Readers take the latest manifest, so they see all of an upsert or nothing of it.
"""

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from paneloom.functions.digest import digest_parts, digest_text
from paneloom.operators.quality import keep_last
from paneloom.session import cut_lineage
from paneloom.sources.readers import wide_to_long
from paneloom.vocab import FUNDAMENTAL_FIELDS


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, payload_hash) of a table, whatever the order of its rows."""
    one = df.agg(*[e.alias(k) for k, e in digest_parts(df.columns).items()])
    return one.select("n_rows", digest_text(F.col("n_rows"), F.col("high"), F.col("low")).alias("payload_hash"))


def _lineage(df, provider, retrieved_at, payload_hash):
    at = F.current_timestamp() if retrieved_at is None else F.lit(retrieved_at).cast("timestamp")
    return (df.withColumn("provider", F.lit(provider)).withColumn("retrieved_at", at)
            .withColumn("raw_payload_hash", F.lit(payload_hash)))


def _seq(df):
    """The order of the rows in a delivery, where it carries one."""
    return [c for c in ("input_seq",) if c in df.columns]


def price_rows(prices: DataFrame, provider, retrieved_at=None, payload_hash=None) -> DataFrame:
    rows = prices.select(*_seq(prices), "ticker", "date", F.col("adj_close").cast("double").alias("adj_close"),
                         F.col("volume").cast("double").alias("volume"))
    return _lineage(rows, provider, retrieved_at, payload_hash)


def macro_rows(macro: DataFrame, provider, retrieved_at=None, payload_hash=None) -> DataFrame:
    rows = wide_to_long(macro.drop("input_seq")).select("series_name", F.col("date").alias("observation_date"), "value")
    return _lineage(rows, provider, retrieved_at, payload_hash)


def fundamental_rows(f: DataFrame, provider, lag_days=60, retrieved_at=None, payload_hash=None) -> DataFrame:
    """Attributes the input lacks are stored as NULL; availability is period end plus the lag."""
    value = lambda c: (F.col(c).cast("double") if c in f.columns else F.lit(None).cast("double")).alias(c)
    sector = F.col("sector").cast("string") if "sector" in f.columns else F.lit(None).cast("string")
    rows = f.select(*_seq(f), "ticker", F.col("date").alias("period_end_date"),
                    F.date_add("date", lag_days).alias("availability_date"),
                    *[value(c) for c in FUNDAMENTAL_FIELDS], sector.alias("sector"))
    return _lineage(rows, provider, retrieved_at, payload_hash)


def merge_latest(existing: DataFrame, incoming: DataFrame, keys, update=None, order=("retrieved_at",)) -> DataFrame:
    """Insert or update: incoming rows win over stored ones, the last of repeated incoming keys
    wins among them. Columns outside `update` keep their stored value."""
    inc = keep_last(incoming, keys, list(order))
    if update is None:
        both = existing.withColumn("__new", F.lit(0)).unionByName(inc.withColumn("__new", F.lit(1)),
                                                                  allowMissingColumns=True)
        return keep_last(both, keys, ["__new"]).drop("__new")
    new = inc.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in inc.columns if c not in keys],
                     F.lit(True).alias("__in"))
    old = existing.withColumn("__ex", F.lit(True))
    j = old.join(new, list(keys), "full_outer")
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in inc.columns:
            out.append(F.col(c))
        elif c in update:
            out.append(F.when(F.col("__in"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("__ex"), F.col(c)).otherwise(F.col(f"__n_{c}")).alias(c))
    return j.select(*out)


def _fs(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark, path):
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _manifests(spark, path):
    """Numbers of the store's manifests."""
    fs, p = _fs(spark, f"{path}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark, path):
    """(number, {month: generation}) of the latest manifest; (0, {}) where there is no store."""
    have = _manifests(spark, path)
    if not have:
        return 0, {}
    text = spark.read.text(f"{path}/manifests/{have[-1]:09d}.json", wholetext=True).first()[0]
    return have[-1], json.loads(text)


def _commit(spark, path, number, months):
    """Write the manifest under its number: made beside, then renamed, which one of two writers of the same number fails at."""
    fs, tmp = _fs(spark, f"{path}/manifests/.{number:09d}-{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray(json.dumps(months, sort_keys=True).encode()))
    out.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{number:09d}.json")
    if fs.exists(final) or not fs.rename(tmp, final):
        fs.delete(tmp, True)
        raise RuntimeError(f"another delivery was committed to {path} meanwhile")


def read_store(spark: SparkSession, path, months=None) -> DataFrame:
    """The rows of the store as of its latest manifest, or of some of its months."""
    path = path.rstrip("/")
    _, at = _manifest(spark, path)
    at = {m: g for m, g in at.items() if months is None or m in months}
    if not at:
        raise FileNotFoundError(f"no rows in store {path}")
    out = None  # one reading for each generation: a store is made of as many as it has months, at most
    for g in sorted(set(at.values())):
        files = spark.read.parquet(*[f"{path}/data/{g}/{_folder(m)}" for m, k in sorted(at.items()) if k == g])
        out = files if out is None else out.unionByName(files, allowMissingColumns=True)
    return out


def _folder(month):
    return f"month={month}"


# among repeated keys of a delivery the newest wins, then the row that comes last in it
_ORDER = ["retrieved_at", "input_seq"]


def upsert(spark: SparkSession, path, incoming: DataFrame, keys, date, update=None, landed=False) -> None:
    """Apply `incoming` to the store at `path`, which is kept by the months of `date`, a key column. `input_seq`, where incoming
    has it, orders the rows of the delivery and is not stored. Rows of a touched month are dealt over as many tasks and files
    as their size asks for. A failed upsert leaves no trace in the store as readers see it. `landed`: incoming is read from files
    that stay, so its months are read from there and its rows need no copy of their own."""
    path = path.rstrip("/")
    if "input_seq" not in incoming.columns:
        incoming = incoming.withColumn("input_seq", F.monotonically_increasing_id())
    last = with_month(keep_last(incoming, keys, _ORDER).drop("input_seq"), date)
    if not landed:
        last = cut_lineage(last)
    found = with_month(incoming, date) if landed else last  # the same months, as `date` is a key
    touched = sorted(r[0] for r in found.select("month").distinct().collect())  # as many as the calendar has
    if not touched:
        return
    number, months = _manifest(spark, path)
    old = [m for m in touched if m in months]
    merged = last
    if old:
        merged = with_month(merge_latest(read_store(spark, path, old).select(*[c for c in last.columns if c != "month"]),
                                         last.drop("month"), keys, update), date)
    generation = f"g{number + 1:09d}-{uuid.uuid4().hex[:8]}"
    # rebalancing splits a month that is large and joins those that are small; months are the folders of a generation
    merged.hint("rebalance", "month").write.partitionBy("month").parquet(f"{path}/data/{generation}")
    _commit(spark, path, number + 1, {**months, **dict.fromkeys(touched, generation)})


def vacuum(spark: SparkSession, path, keep=2) -> None:
    """Delete the generations that none of the last `keep` manifests names, and the manifests before those."""
    path = path.rstrip("/")
    have = _manifests(spark, path)
    used = set()
    for n in have[-keep:]:
        used |= set(json.loads(spark.read.text(f"{path}/manifests/{n:09d}.json", wholetext=True).first()[0]).values())
    fs, p = _fs(spark, f"{path}/data")
    for f in list(fs.listStatus(p)) if fs.exists(p) else []:
        if f.getPath().getName() not in used:
            fs.delete(f.getPath(), True)
    for n in have[:-keep]:
        _delete(spark, f"{path}/manifests/{n:09d}.json")


def with_month(df: DataFrame, date) -> DataFrame:
    return df.withColumn("month", F.coalesce(F.date_format(F.col(date), "yyyy-MM"), F.lit("none")))


def landed(df: DataFrame):
    """(rows, n_rows, payload_hash) of a delivery, read once: it is counted and digested while it is written."""
    seen = Observation()
    fields = [c for c in df.columns if c != "input_seq"]
    if len(fields) == len(df.columns):
        df = df.withColumn("input_seq", F.monotonically_increasing_id())
    rows = cut_lineage(df.observe(seen, *[e.alias(k) for k, e in digest_parts(fields).items()]))
    got = {"n_rows": 0, "high": None, "low": None} if rows.isEmpty() else seen.get  # an empty frame observes nothing
    one = df.sparkSession.range(1).select(digest_text(F.lit(got["n_rows"]), F.lit(got["high"]), F.lit(got["low"])))
    return rows, got["n_rows"], one.first()[0]


def ingest(spark: SparkSession, path, delivery, shape, keys, date) -> DataFrame:
    """Upsert one delivery and return its log row. `delivery` is the landed table, or a function that makes it, so that whatever
    reads the input is inside the guard; `shape(rows, payload_hash)` gives the rows to store. Failure leaves the store
    unchanged and is reported in the row."""
    try:
        raw, _, digest = landed(delivery() if callable(delivery) else delivery)
        seen = Observation()
        # the first job over the rows reads their months, and counts them
        rows = shape(raw, digest).observe(seen, F.count(F.lit(1)).alias("n"))
        upsert(spark, path, rows, keys, date, landed=True)
        n, status, error = 0 if raw.isEmpty() else seen.get["n"], "succeeded", None
    except Exception as e:
        n, status, error = 0, "failed", f"{type(e).__name__}: {e}"
    return spark.createDataFrame([(path, n, status, error)],
                                 "target STRING, rows_ingested BIGINT, status STRING, error_message STRING")


def write_results(tables: dict, out, fmt="parquet") -> None:
    """One folder per result table."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w.option("header", True).csv(f"{out}/{name}") if fmt == "csv" else w.parquet(f"{out}/{name}")


def tag_run(df: DataFrame, run_id) -> DataFrame:
    return df.withColumn("run_id", F.lit(run_id))


def run_row(spark, run_id, as_of: DataFrame, config: dict, warnings=(), status="valid") -> DataFrame:
    """as_of: a one-row frame holding as_of_date."""
    return as_of.select(F.lit(run_id).alias("run_id"), "as_of_date",
                        F.lit(json.dumps(config, sort_keys=True)).alias("config_json"),
                        F.lit(json.dumps(list(warnings))).alias("warnings_json"), F.lit(status).alias("status"))


def persist_run(tables: dict, run_id, path, row: DataFrame | None = None) -> None:
    """Write the scored tables of a run, one partition per run, and then its row in `runs`, the commit: `read_runs` shows only
    runs that have one. A table that fails takes the others of its run away again."""
    path = path.rstrip("/")
    try:
        for name, df in tables.items():
            tag_run(df, run_id).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")
        if row is not None:
            tag_run(row.drop("run_id"), run_id).coalesce(1).write.mode("append").partitionBy("run_id").parquet(f"{path}/runs")
    except Exception:
        spark = next(iter(tables.values())).sparkSession
        for name in (*tables, "runs"):
            _delete(spark, f"{path}/{name}/run_id={run_id}")
        raise


def read_runs(spark: SparkSession, path, name) -> DataFrame:
    """Rows of table `name` of the runs that are committed."""
    path = path.rstrip("/")
    runs = spark.read.parquet(f"{path}/runs").select(F.col("run_id").cast("string").alias("run_id")).distinct()
    table = spark.read.parquet(f"{path}/{name}")
    return table.withColumn("run_id", F.col("run_id").cast("string")).join(runs, "run_id", "left_semi")
