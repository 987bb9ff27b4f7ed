"""Helpers the corpus operators share: tables written between steps, and connected components."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from paneloom.session import shared_folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, compression="snappy") -> DataFrame:
    """The rows, written once to the shared folder and read back: later steps neither repeat the work before nor
    depend on the executors that did it. What was shuffled for it is deleted with the end of the writing, not when the
    driver happens to collect garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames made by `stored` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links (a, b): (node, component), component being the smallest node.
    Large-star and small-star rounds; each round is a few keyed aggregations and joins over the links that are left,
    so no task holds a component. Links with a NULL end and self-links are ignored; nodes without links are not returned."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .where("a is not null and b is not null and u <> v").distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                               F.struct("u", F.col("m").alias("v")))).alias("x"))
                 .select("x.u", "x.v").where("u <> v").distinct())
        new = stored(small)
        forget(e)
        e = new
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def small_batches(batches, limit=8 << 20):
    """The same rows in pieces of about `limit` bytes, so that long texts never meet in one large batch."""
    for b in batches:
        rows = max(1, b.num_rows * limit // max(limit, b.nbytes))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def packed(batch: pa.RecordBatch) -> bytes:
    """Rows as compressed Arrow."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(table: pa.Table) -> pa.Table:
    """The rows that `dealt` packed, from the `rows` of one block."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in table.column("rows").to_pylist()])


def dealt(df: DataFrame, blocks: int) -> DataFrame:
    """The rows of df, whose last column is the number of their block, as (block, rows) with all rows of a block in one
    partition. Rows are compressed before they are moved, as whole texts are most of what a shuffle would carry."""
    def run(batches):
        for b in small_batches(batches, 32 << 20):
            place = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            order = np.argsort(place, kind="stable")
            groups = [g for g in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(g)]
            rows = b.select(range(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([pa.array([place[g[0]] for g in groups], pa.int32()),
                                              pa.array([packed(rows.take(pa.array(g))) for g in groups], pa.binary())], ["block", "rows"])

    return df.mapInArrow(run, "block int, rows binary").repartition(blocks, "block")
