import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken

from paneloom.llm import token_shards as ts
from paneloom.llm.queries import RANKS

pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")


@pytest.fixture(scope="module")
def ranks():
    return ts.ranks_of(RANKS)


def test_permutation_is_one_to_one_and_keyed():
    for size in (1, 2, 3, 5, 16, 17, 1000, 4096, 4097):
        p = ts.permuted(np.arange(size), size, 7)
        assert sorted(p) == list(range(size))
        assert ts.permuted(p, size, 7, back=True).tolist() == list(range(size))
    big = (1 << 45) + 12345
    some = np.array([0, 1, big - 1, big // 3])
    assert ts.permuted(ts.permuted(some, big, 1), big, 1, back=True).tolist() == some.tolist()
    a, b = (ts.permuted(np.arange(1000), 1000, k) for k in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


def test_words_give_the_ids_of_whole_texts(ranks):
    enc = ts.Encoder(ranks)
    rng = random.Random(1)
    texts = ["", " ", "a", " a", "a ", "a  b", "it's he'll", "x\n y", "x \ny", "\n\n  a\t b", "é b c", "<|endoftext|> a", "1 23  4,5 !? ...", "w" * 5000 + " a"]
    texts += ["".join(rng.choices("ab1,.' \n\té ", k=rng.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), np.uint16).tolist() == enc.all(t), repr(t)


def test_shards_hold_every_sequence_once(spark, ranks, tmp_path):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices(["the", "and", "shard", "slot", "x1"], k=rng.randint(0, 120))) for i in range(80)} | {80: "", 81: None, 82: "long " * 5000}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(3, texts[3], "again"), (None, "no id", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    plain = tiktoken.Encoding("plain", pat_str=ts.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    enc = ts.stored(ts.encoded(df, ranks, length=16))
    base, total = ts.numbering(enc)
    seqs = ts.stored(ts.sequences(enc, 5, base, total, length=16, stride=8))
    by = {}
    for r in seqs.collect():
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, _ in rows:
        if i == 3:
            continue
        got = [x for r in sorted(by[i], key=lambda r: r["k"]) for x in np.frombuffer(r["ids"], np.uint16).tolist()]
        ids = plain(t or "")
        assert got[:len(ids)] == ids and set(got[len(ids):]) == {ts.END} and len(got) % 16 == 0 and 0 < len(got) - len(ids) <= 16
    assert len(by[3]) % 2 == 0
    slots = {r["slot"]: np.frombuffer(r["ids"], np.uint16).tolist() for rs in by.values() for r in rs}
    assert sorted(slots) == list(range(seqs.count()))
    assert total == len(slots)
    found = ts.shards(seqs, total, stride=8, per=3)
    assert all(r["n_sequences"] == 8 for r in found.collect() if r["first_slot"] + 8 <= len(slots))
    path = str(tmp_path / "shards")
    ts.write(found, path)
    for start in (0, 21, len(slots) - 1):
        back = ts.read_from(spark, path, start, length=16, stride=8).collect()
        assert {r["slot"]: r["ids"] for r in back} == {s: v for s, v in slots.items() if s >= start}
    assert ts.materialise(df.limit(0), ranks, 1).count() == 0
    with pytest.raises(Exception, match="missing or repeated|has . sequences"):
        ts.shards(seqs.where("slot <> 19"), total, stride=8, per=3).count()


def test_order_is_that_of_the_files(spark, ranks, tmp_path):
    rng = random.Random(4)
    rows = [(i % 700, " ".join(rng.choices(["the", "and", "shard", "slot", str(i)], k=rng.randint(0, 60)))) for i in range(3000)]
    path = str(tmp_path / "docs")
    (spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.option("parquet.block.size", 8192)
     .option("parquet.page.size", 1024).option("parquet.block.size.row.check.min", 10).option("parquet.page.size.row.check.min", 10).parquet(path))
    docs = spark.read.parquet(path)
    usual, found, pieces = spark.conf.get("spark.sql.files.maxPartitionBytes"), [], []
    try:
        for size in ("128m", "9000b", "3000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            pieces.append(len(ts.numbering(ts.encoded(docs, ranks, 16, scan=True))[0]))
            out = ts.materialise(docs, ranks, 9, length=16, stride=8, per=5, scan=True)
            found.append({r["shard"]: (r["first_slot"], r["n_sequences"], bytes(r["payload"])) for r in out.collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert pieces[0] < pieces[1] and found[0] == found[1] == found[2]
    # the plain order: files by name, rows as they stand
    plain = tiktoken.Encoding("plain", pat_str=ts.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    ids = []
    for f in sorted(p for p in os.listdir(path) if p.endswith(".parquet")):
        for t in pq.read_table(f"{path}/{f}", columns=["text"]).column("text").to_pylist():
            own = plain(t) + [ts.END]
            ids += own + [ts.END] * (-len(own) % 16)
    want = np.array(ids, np.uint16).reshape(-1, 16)
    slots = ts.permuted(np.arange(len(want)), len(want), 9)
    out = np.empty_like(want)
    out[slots] = want
    assert b"".join(found[0][s][2] for s in sorted(found[0])) == out.tobytes()
