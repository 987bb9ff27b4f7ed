"""The pipeline's stages against plain versions, each on its own input."""
import os

import pytest

import corpus_pipeline as cp
import test_mixing
import test_near_copies
import test_pieces
from paneloom.llm import pieces, pii, queries, quality_lm
from paneloom.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    have = rows(docs)
    kept = stored(cp.quality(spark, docs, SF))
    got = rows(kept)
    # the model itself is held to plain dictionaries in test_quality_lm; here its decision takes effect and nothing changes
    judged = {r["doc_id"]: r["keep"] for r in quality_lm.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert got == {i: r for i, r in have.items() if judged[i]}
    clean = [r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()]
    assert sum(i in got for i in clean) >= 0.98 * len(clean)

    one = stored(cp.near_duplicates(spark, kept, SF))
    want = test_near_copies.plain_classes(test_near_copies.plain_sets([(i, r["text"]) for i, r in got.items()]))
    got2 = rows(one)
    assert got2 == {i: got[i] for i in set(want.values())}

    safe = stored(cp.personal_data(spark, one, SF))
    got3 = rows(safe)
    weights = pii.train(one.select("doc_id", "text"))
    assert set(got3) == set(got2)
    for i, r in got3.items():
        (base,), (added,) = pii.find_all(weights, [got2[i]["text"]])
        text, end = "", 0
        for a, k, b in sorted(base + added):
            if a >= end:
                text += got2[i]["text"][end:a] + "<" + pii.KINDS[k].upper() + ">"
            end = max(end, b)
        text += got2[i]["text"][end:]
        assert r["text"] == text and r["n_chars"] == len(text)

    mixed = stored(cp.mixture(spark, safe, SF))
    monkeypatch.setattr(test_mixing, "DOMAINS", queries.DOMAINS)
    monkeypatch.setattr(test_mixing, "WEIGHTS", queries.WEIGHTS)
    plain = test_mixing.plain([(i, r["text"], r["lang"], r["source"]) for i, r in got3.items()], cp.SHARE, 1, "pipeline")
    got4 = rows(mixed)
    assert got4 == {x[0]: got3[x[0]] for x in plain}

    tokens = rows(cp.tokens(spark, mixed, SF))
    v = pieces.Vocabulary.load(queries.MODEL)
    assert set(tokens) == set(got4) and all(r["round_trip"] for r in tokens.values())
    for i in sorted(tokens, key=lambda i: len(got4[i]["text"]))[:40]:
        assert tokens[i]["token_ids"] == test_pieces.plain(v, got4[i]["text"])


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "personal_data", "mixture", "tokens"]
