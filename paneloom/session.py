"""Session helper, and where lineage may be cut."""

import uuid

from pyspark.sql import DataFrame, SparkSession

def get_session(master="local[*]", shuffle_partitions=None, **conf) -> SparkSession:
    b = (SparkSession.builder.master(master).appName("paneloom")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.ui.enabled", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark) -> str:
    """The folder the cluster names for checkpoints; where none is named, a folder of the warehouse, which
    driver and executors share as well. Never a machine-local temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back: what follows survives lost
    executors without redoing what came before, reads only the columns it needs, and starts from
    a relation of known size."""
    path = f"{shared_folder(df.sparkSession)}/paneloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
