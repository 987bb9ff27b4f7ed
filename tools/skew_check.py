"""Time the two ranking plans on a table where one date holds 40 % of the rows and a third of its
values are one number.

    python tools/skew_check.py [rows]
"""
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from paneloom.operators import ranking, scores  # noqa: E402
from paneloom.session import get_session  # noqa: E402


def main(n=12_000_000):
    spark = get_session("local[8]", 32, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    path = tempfile.mkdtemp(prefix="spark-skew-", dir="/tmp") + "/rows"
    u = F.rand(1)
    (spark.range(n).select(
        F.when(u < .4, F.lit(0)).otherwise(F.col("id") % 50 + 1).alias("date"), F.lit("f").alias("factor"),
        F.col("id").alias("ticker"),
        F.when(F.rand(2) < .33, F.lit(0.05)).otherwise(F.exp(F.randn(3))).alias("value"), F.randn(4).alias("y"))
     .write.parquet(path))
    df = spark.read.parquet(path)
    for _ in range(2):
        for name, fn in (("rank_factors", lambda: ranking.rank_factors(df)),
                         ("spearman_ic", lambda: scores.spearman_ic(df, ["date"], "value", "y"))):
            t0 = time.perf_counter()
            fn().write.format("noop").mode("overwrite").save()
            print(f"{name:13s} {time.perf_counter() - t0:6.1f}s", flush=True)


if __name__ == "__main__":
    main(*[int(a) for a in sys.argv[1:]])
