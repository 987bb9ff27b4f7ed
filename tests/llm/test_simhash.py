import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from paneloom.llm import simhash
from paneloom.llm.common import components


def plain_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_classes(fps, tau):
    """{id: smallest id reachable} by comparing all pairs."""
    ids = sorted(fps, key=lambda i: i)
    parent = {i: i for i in ids}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= tau:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_matches_the_definition(spark):
    texts = ["", None, "One", "A b C", "a b c d", "a b c d e f g a b c d", "É é\u00a0x y\tz\x0bw q", "x " * 3000]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    # the same hash as Spark's own
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_allocation_sums_and_is_cheapest():
    cost = [[0, 5, 9, 90], [0, 1, 50, 60], [0, 2, 3, 4]]
    t = simhash.allocate(cost, 2)
    from itertools import product
    best = min((sum(c[e + 1] for c, e in zip(cost, x)), x) for x in product(range(-1, 3), repeat=3) if sum(x) == 2)
    assert sum(t) == 2 and sum(c[e + 1] for c, e in zip(cost, t)) == best[0]


def test_components_of_chains_and_stars(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 201)]
    got = dict(components(spark.createDataFrame(e, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def connected(spark, fps, tau, **how):
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = simhash.links(df, tau=tau, **how).collect()
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= tau for r in got)
    parent = {simhash.signed(f): simhash.signed(f) for f in fps}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in got:
        x, y = find(r["a"]), find(r["b"])
        parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in parent}


def test_links_connect_all_near_pairs(spark):
    """Random centres with satellites, and one dense group that takes the way of warm values."""
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        c = rng.getrandbits(64)
        fps.add(c)
        for _ in range(4):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))))
    c = rng.getrandbits(64)
    fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)}
    for tau in (4, 3):
        for warm in (4, 10 ** 6):
            got = connected(spark, fps, tau, warm=warm)
            want = plain_classes({simhash.signed(f): f for f in fps}, tau)
            same = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
            assert same(got) == same(want)


def test_classes_of_documents(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = rng.choices(words, k=300)
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(300)] = "edit%d" % rng.randrange(99)
            rows.append((n, " ".join(t), "x"))
            n += 1
    rows += [(900, "", "x"), (901, None, "y"), (902, " \t", "z"), (3, rows[3][1], "again"), (None, rows[0][1], "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = plain_classes({i: plain_fingerprint(t) for i, t, _ in rows if i is not None}, 4)
    got = simhash.classes(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (0 if r["doc_id"] is None else want[r["doc_id"]])
    kept = simhash.keep_one(df).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values()))
    assert simhash.classes(df.limit(0)).count() == 0
