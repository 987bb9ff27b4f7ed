import os
import random
import re
import zlib

import pytest

from paneloom.llm import queries, spelling as sp

SF = "/root/testdata/sf0.001"


def near(a, b):
    """One inserted, deleted or replaced code point, by comparing from both ends."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def plain_forms(counts, times=5):
    words, out, form = sorted(counts), {}, {}
    pairs = {w: [] for w in words}
    for k, w in enumerate(words):
        for v in words[k + 1:]:
            if abs(len(v) - len(w)) < 2 and near(v, w):
                pairs[w].append(v)
                pairs[v].append(w)
    for w in words:
        best = min(pairs[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, counts[w], len(pairs[w]), counts.get(form[w]))
    return out


def test_neighbours_against_all_pairs(spark):
    rng = random.Random(2)
    words = {"", "a", "b", "ab", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaaa", "é" * 7, "é" * 6, "x" * 900, "x" * 450 + "y" + "x" * 449, "x" * 901, "\U0001f600abcdef", "abcdef"}
    for _ in range(160):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 12)))
        words.add(w)
        for _ in range(4):
            k = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:k] + rng.choice("abéz") + w[k:], w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k + 1:]]))
    got = sp.neighbours(spark.createDataFrame([(w,) for w in words], "word string").repartition(5)).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(a, b) for a in words for b in words if near(a, b)}


def test_forms_chains_and_ties(spark):
    counts = {"colour": 1000, "color": 200, "colr": 40, "colors": 6, "honour": 50, "honor": 50, "honar": 10, "honir": 10, "lonely": 7}
    got = sp.forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r["word"]: tuple(r) for r in got} == plain_forms(counts)
    assert {r["word"]: r["root"] for r in got}["colr"] == "colour"
    assert sp.forms(spark.createDataFrame([], "word string, n long")).count() == 0


def plain_vocabulary(rows):
    counts = {}
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                counts[w] = counts.get(w, 0) + 1
    return {w: n for w, n in counts.items() if n >= 5}


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    words = ["Straße", "straße", "Éclair", "éclair", "ABCDEFG", "abcdefg", "resumé", "résumé", "ÀÀÀÀÀÀ×", "zzzzzzzz"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), None) for i in range(60)]
    rows += [(None, "abcdefg " * 9, 1), (7, None, 1), (8, "", 1), (9, "1 2 3 _", 1), rows[3], (10, "abcdefh-abcdefgh9" * 30, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, word int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_spelling_forms(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r["word"]: tuple(r) for r in got.collect()} == plain_forms(plain_vocabulary([r[:2] for r in rows]))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_query_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_forms(plain_vocabulary(rows))
    got = {r["word"]: tuple(r) for r in queries.op13_spelling_forms(spark, SF).collect()}
    assert got == want and any(v[1] for v in want.values())
