import duckdb
import pandas as pd
from pyspark.sql import functions as F

from paneloom.llm import license_scan as ls, queries

APACHE, MIT = ls.TEMPLATES[1][1], ls.TEMPLATES[3][1]
NOTICE = "\n".join("# " + " ".join(MIT.split()[i:i + 12]) for i in range(0, 60, 12))
FILES = [
    (1, "a/LICENSE", APACHE), (2, "a/b/x.py", "import os\n\nprint(1)"), (3, "a/b/c/COPYING.txt", "words " * 30 + "\nReleased under the MIT License.\n"),
    (4, "a/b/c/y.py", None), (5, "a/b/c/z.py", "# Licensed under CC BY-NC 4.0.\n" + "code alpha beta gamma\n" * 9), (6, "z.py", ""), (7, None, "free software"), (8, "q/w.c", NOTICE + "\nint main;\n" * 90),
    (9, "q/LICENSE", "see elsewhere"), (10, "a/b2/x.py", "licence of the code " * 20000), (2, "a/b/x.py", "import os\n\nprint(1)"), (None, "a/k", "x"), (11, "r/README", "x\n" * 500 + "Released under the MIT License."),
]
WANT = {1: ("Apache-2.0", "header", True, None), 2: ("Apache-2.0", "inherited", False, "a"), 3: ("MIT", "header", True, None), 4: ("MIT", "inherited", False, "a/b/c"), 5: ("CC-BY-NC-4.0", "header", False, None),
        6: (None, None, False, None), 7: (None, None, False, None), 8: ("MIT", "header", False, None), 9: (None, None, False, None), 10: ("Apache-2.0", "inherited", False, "a"), None: ("Apache-2.0", "inherited", False, "a"),
        11: ("MIT", "header", False, None)}


def test_headers_files_and_inheritance(spark):
    df = spark.createDataFrame([(*f, "clash") for f in FILES], "doc_id long, path string, text string, license string")
    got = ls.scan(df).collect()
    assert len(got) == len(FILES)
    for r in got:
        assert (r["license"], r["how"], r["licence_file"], r["from_dir"]) == WANT[r["doc_id"]], r
    assert ls.scan(df.limit(0)).count() == 0


def test_the_sql_says_the_same(spark):
    rows = [(i, t, s, lang) for i, (t, s, lang) in enumerate((f[2], s, lang) for f in FILES for s in ("s1", "s2") for lang in ("en", "de"))] + [(2500, MIT, "s1", "en"), (2501, "no", "s1", "en"), (2501, "no", "s1", "en")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source", "lang"]))
    cur = con.execute(queries.OP4_SQL)
    names = [c[0] for c in cur.description]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = ls.scan(df.withColumn("path", F.concat_ws("/", "source", "lang", (F.col("doc_id") / 1000).cast("long"), "doc_id"))).collect()
    assert sorted(str(tuple(r[n] for n in names)) for r in got) == sorted(map(str, cur.fetchall()))


def test_a_notice_beside_common_words_is_found_at_any_size(spark):
    """All words count by the files they occur in, so that common ones weigh little however many files there are."""
    for n in (200, 20000):
        common = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("p/"), F.col("id").cast("string")).alias("path"), F.lit("from the main page of this").alias("text"))
        own = spark.createDataFrame([(-1, "a/x", "the Released under the MIT License. of this page"), (-2, "b/x", ls.TEMPLATES[10][1] + "\nfrom the main page")], common.schema)
        got = {r["doc_id"]: r for r in ls.scan(common.unionByName(own)).where("license is not null").collect()}
        assert {i: r["license"] for i, r in got.items()} == {-1: "MIT", -2: ls.TEMPLATES[10][0]}
        assert got[-2]["licence_file"] and got[-1]["score"] > 0.8
