import os
import random

import pytest

from paneloom.llm import near_copies as nc

SF = "/root/testdata/sf0.001"


def plain_sets(rows, k=5):
    """{id: the set of its shingles} as tuples of words."""
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1)))
    return out


def plain_classes(sets):
    """{id: smallest id reachable} by comparing all pairs."""
    parent = {i: i for i in sets}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_classes_match_all_pairs(spark):
    """Groups of copies at all distances, also of one passage in common, chains, short texts and repeated rows."""
    rng = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    passage = rng.choices(words, k=60)
    rows, n = [], 0
    for size in [12, 30, 60, 120, 200] * 6:
        base = rng.choices(words, k=size) + passage * (n % 2)
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = "edit%d" % rng.randrange(99)
            rows.append((n, " ".join(t)))
            n += 1
    chain = rng.choices(words, k=200)
    for step in range(15):
        rows.append((n + step, " ".join(chain[4 * step:] + ["s%d_%d" % (step, j) for j in range(4 * step)])))
    rows += [(900, ""), (901, None), (902, " \t"), (903, "One two"), (904, "one  TWO"), (905, "a b c d e"), (906, "a b c d f"), (907, "x " * 3000), (908, "x " * 40)]
    want = plain_classes(plain_sets(rows))
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert len(sizes) < len(rows) - 60 and max(sizes.values()) >= 6
    df = spark.createDataFrame([(*r, 1) for r in [*rows, rows[3], (None, rows[0][1])]], "doc_id long, text string, set int").repartition(3)
    got = nc.classes(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert r["component_id"] == want[0 if r["doc_id"] is None else r["doc_id"]], r
    kept = nc.keep_one(df).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values()))
    assert nc.classes(df.limit(0)).count() == 0


def test_stage_removes_copies_with_edited_words(spark):
    """Two edits in a hundred words: 0.8 and more alike on five words, but more than 4 bits apart."""
    import corpus_pipeline as cp
    from paneloom.llm import simhash
    rng = random.Random(5)
    rows = []
    while len(rows) < 40:
        t = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(120)]
        u = list(t)
        u[30], u[80] = "changed", "edited"
        t, u = " ".join(t), " ".join(u)
        if bin(simhash.fingerprint(t) ^ simhash.fingerprint(u)).count("1") > 4:
            rows += [(len(rows), t, "en", "s", len(t)), (len(rows) + 1, u, "en", "s", len(u))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, df, "").collect()) == list(range(0, 40, 2))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_stage_matches_all_pairs_on_documents(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_classes(plain_sets([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, SF).collect()) == sorted(set(want.values()))


def test_simhash_finds_copies_and_the_exact_check_decides(spark, monkeypatch):
    """The stage goes by fingerprints first: what they link is verified, other pairs and chains are left to the prefixes."""
    import corpus_pipeline as cp
    from paneloom.llm import simhash
    rng = random.Random(9)
    rows = []
    for _ in range(30):
        t = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(400)]
        u = list(t)
        u[30] = "changed"
        rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join(u))]
    # a repeated sequence: equal fingerprints, as bits go by majority, but other shingles at the ends
    loop = [rng.choice("klmnop") + str(i) for i in range(9)]
    rows += [(60, " ".join(loop * 3)), (61, " ".join(loop * 3 + ["x%d" % i for i in range(8)]))]
    rows += [(62, ""), (63, None)]
    want = plain_sets(rows)
    sets = {nc.name_of(nc.shingles(t)): i for i, t in reversed(rows)}
    bodies = nc.stored(spark.createDataFrame([(s, rows[i][1]) for s, i in sets.items()], "set long, text string"))
    found = {tuple(sorted((sets[r["a"]], sets[r["b"]]))) for r in nc.by_fingerprint(bodies).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    near = {(a, b) for a in sets.values() for b in sets.values() if a < b and (prints[a] ^ prints[b]).bit_count() <= 4}
    alike = lambda a, b: 5 * len(want[a] & want[b]) >= 4 * len(want[a] | want[b])
    assert found == {p for p in near if alike(*p)} and len(found) > 5
    used = []
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: used.append(1) or real(*a, **b))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, df, "").collect()) == sorted(set(plain_classes(want).values()))
    assert used


def test_a_stored_frame_leaves_no_shuffle_behind(spark):
    """The shuffle files of each stored step go with it, so that steps of a job do not add up on disk."""
    import os
    import time
    from paneloom.llm.common import CLEANUP, stored
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {n for d in manager.localDirsString() for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}
    before, was = held(), spark.conf.get(CLEANUP, "false")
    out = stored(spark.range(20000).repartition(5, "id"))
    end = time.time() + 20
    while held() - before and time.time() < end:
        time.sleep(.2)
    assert not held() - before and out.count() == 20000 and spark.conf.get(CLEANUP, "false") == was


def edited(rng, base, edits):
    t = list(base)
    for j in rng.sample(range(len(t)), edits):
        t[j] = "edit%d" % rng.randrange(10 ** 6)
    return " ".join(t)


def test_a_large_group_of_near_copies_makes_no_pairs(spark, monkeypatch):
    """Copies of one text, most of them too far apart to be one class: what is verified pair by pair grows with their number, not with
    its square, and the classes are those of all pairs, in one block and in many."""
    rng = random.Random(21)
    base = rng.choices(["w%d" % i for i in range(300)], k=120)
    rows = [(i, edited(rng, base, 2 + i % 6)) for i in range(160)]
    rows += [(200 + i, edited(rng, base[:60] + base[:50][::-1], i % 4)) for i in range(40)]
    want = plain_classes(plain_sets(rows))
    assert 20 < len(set(want.values())) < 190
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compared, real = [], nc.verified
    monkeypatch.setattr(nc, "verified", lambda pairs, *a: compared.append(pairs.count()) or real(pairs, *a))
    assert {r["doc_id"]: r["component_id"] for r in nc.classes(df).collect()} == want
    assert sum(compared) < 10 * len(rows), compared
    monkeypatch.setattr(nc, "BLOCK", 16)
    assert {r["doc_id"]: r["component_id"] for r in nc.classes(df).collect()} == want


def test_overlaps_match_plain_sets():
    import numpy as np
    rng = np.random.default_rng(4)
    for sets, of in ((1, 5), (7, 20), (40, 60), (90, 3000)):
        grams = [np.unique(rng.integers(0, of, rng.integers(1, of))).astype(np.uint64) for _ in range(sets)]
        assert (nc.overlaps(grams) == [[len(np.intersect1d(a, b)) for b in grams] for a in grams]).all()


def test_the_sketch_counts_every_set(spark):
    import numpy as np
    texts = ["a b c d e f", "b c d e f g", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = np.zeros(1 << nc.SKETCH_BITS, int)
    for t in texts:
        np.add.at(want, nc.bucket(nc.shingles(t)), 1)
    assert (nc.sketch(df, 5) == want).all()
