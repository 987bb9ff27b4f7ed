import hashlib
import random
import zlib
from fractions import Fraction

from paneloom.llm import periodic_runs as pr, queries


def plain(w, least=6, powers=4):
    """Runs by trying every period and every maximal stretch of it."""
    best = {}
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, powers * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(7)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 400, list("ab") * 3, list("ab") * 4, list("abc") * 4 + list("ab"), list("aab") * 9 + list("ab") * 8]
    for _ in range(250):
        w = [rng.choice("ab" if rng.random() < .5 else "abcdef") for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            p = [rng.choice("abc") for _ in range(rng.randrange(1, 8))]
            k, n = rng.randrange(len(w) + 1), rng.randrange(3, 7) * len(p) + rng.randrange(len(p))
            w[k:k] = (p * 8)[:n]
        out.append(w)
    return [[x.encode() for x in w] for w in out]


def test_runs_against_all_periods():
    t = texts()
    for least, powers in ((6, 4), (4, 2), (2, 2)):
        assert pr.runs_of(t, least, powers) == [plain(w, least, powers) for w in t]


def test_long_texts_and_batches():
    rng = random.Random(1)
    long = [b"w%d" % rng.randrange(50) for _ in range(30000)]
    long[5000:5000] = [b"x", b"y", b"z"] * 3000
    (got,) = pr.runs_of([long])
    assert (5000, 9000, 3) in got
    assert pr.runs_of([long, [b"q"] * 9, long]) == [got, [(0, 9, 1)], got]


def digest(i, text):
    w = text.split(" ") if text else []
    n, h = len(w), zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs, drop = plain(w), set()
    for s, k, q in runs:
        drop.update(range(s + q, s + k))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, " ".join(x.decode() for x in w), "x") for i, w in enumerate(texts())]
    rows += [(900, None, ""), (901, "", ""), (902, " \t\n", ""), (903, "é é " * 9 + " ", ""), (904, "b " * 3000, ""), rows[40]]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    have = sorted(tuple(r)[:8] for r in got.collect())
    ascii_words = lambda t: " ".join(b.decode() for b in (t or "").encode().split())
    assert have == sorted(digest(i, ascii_words(t)) for i, t, _ in rows)
    assert {h[0]: h[1] for h in have}[903] == 1
    assert any(h[1] > 1 for h in have) and queries.op11_periodic_runs(spark, str(tmp_path)).count() == len(rows)


def test_empty_table(spark):
    assert pr.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = pr.scan(spark.createDataFrame([(None, "a a a a a a a b")], "doc_id long, text string")).collect()
    assert (r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (None, 8, [(0, 7, 1)], "a b")
