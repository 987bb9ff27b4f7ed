import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paneloom.llm import pieces

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def plain(v, text):
    """Viterbi over the whole text, position by position."""
    if not text:
        return []
    t = "▁" + text.replace(" ", "▁")
    table = dict(zip(v.pieces, zip(v.scores, v.ids)))
    low = min(v.scores) - 10.0
    best = [(0.0, None)] + [None] * len(t)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - v.longest), e):
            hit = table.get(t[s:e]) or ((low, -1 - ord(t[s])) if e - s == 1 else None)
            if hit and (best[e] is None or best[s][0] + hit[0] > best[e][0]):
                best[e] = (best[s][0] + hit[0], (s, hit[1]))
    out, e = [], len(t)
    while e:
        s, i = best[e][1]
        out[:0] = [i] if i >= 0 else v.unknown_ids(-1 - i)
        e = s
    return out


def small(byte_ids=True):
    table = ["<unk>", *(f"<{b}>" for b in range(256)), "▁", "▁▁", "a", "b", "c", "d", "!", "!!", "▁!", "ab", "bc", "abc", "▁a", "▁ab", "cd", "dab", "é", "aé", "#", "?!"]
    rng = random.Random(1)
    scores = [None] * 257 + [-rng.randint(1, 30) / 2 for _ in table[257:]]
    return pieces.Vocabulary([p if s is not None else "" for p, s in zip(table, scores)], scores, list(range(1, 257)) if byte_ids else None)


def test_small_vocabulary_against_plain_viterbi(spark):
    rng = random.Random(2)
    texts = ["", None, " ", "  a  b ", "abcd" * 700, "x", "\U0001F600 é!?!", "a\nb\tc", "!" * 300] + ["".join(rng.choices("abcdé !#?x", k=rng.randint(1, 40))) for _ in range(150)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "ab c", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for v in (small(), small(False)):
        assert "!" in v.cuts()
        got = pieces.decode(pieces.encode(df, v, block_chars=500), v).collect()
        assert len(got) == len(rows)
        for r in got:
            t = "ab c" if r["id"] is None else texts[r["id"]] or ""
            assert r["ids"] == plain(v, t), t
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
            if v.bytes:
                assert r["text"] == t
    assert pieces.encode(df.limit(0), small()).count() == 0


def test_pieces_across_atoms_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary(["a▁b"], [-1.0])


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_public_model(spark, tmp_path):
    """Round trip of whole documents, and words against plain Viterbi and against the library, which finds best paths
    itself when the model's kind is set to unigram (a few paths differ there; plain Viterbi decides)."""
    from sentencepiece import SentencePieceProcessor
    other = tmp_path / "unigram.model"
    other.write_bytes(open(MODEL, "rb").read() + b"\x12\x02\x18\x01")
    sp = SentencePieceProcessor(model_file=str(other))
    v = pieces.Vocabulary.load(MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["id"]] for r in pieces.decode(pieces.encode(docs, v), v).collect())
    words = sorted({w for t in texts.values() for w in t.split()})[::7]
    got = pieces.encode(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), v).collect()
    assert len(got) == len(words) > 500
    assert all(r["ids"] == plain(v, words[r["id"]]) for r in got)
    assert sum(r["ids"] == sp.encode(words[r["id"]]) for r in got) > 0.98 * len(words)


def test_paths_written_out_flat():
    """Lengths and ids of paths against lists, characters without a piece among them."""
    rng = random.Random(3)
    for v in (small(), small(False)):
        paths = [[rng.choice([258, 300, -1 - ord("x"), -1 - 0x1F600]) for _ in range(rng.randint(0, 5))] for _ in range(60)]
        want = [[i for p in path for i in ([p] if p >= 0 else v.unknown_ids(-1 - p))] for path in paths]
        n, values = pieces.flat_paths(pa.chunked_array([pa.array(paths[:20], pa.list_(pa.int32())), pa.array(paths[20:], pa.list_(pa.int32()))]), v)
        assert n.tolist() == [len(w) for w in want] and values.tolist() == sum(want, [])
        at = [5, 5, 59, 0]
        assert pieces.stretches(values, (n.cumsum() - n)[at], n[at]).tolist() == sum((want[i] for i in at), [])


def test_atoms_cut_as_the_pattern_says():
    """Distinct atoms, and their places in the texts, without a Python object an atom; and back from blocks to shards and bytes."""
    rng = random.Random(4)
    texts = ["", None, " ", "  a  b ", "a\nb\tc", "a▁b ▁", "é!?! \U0001F600#"] + ["".join(rng.choices("abcdé !#?x▁\n", k=rng.randint(1, 40))) for _ in range(500)]
    for v in (small(), small(False)):
        words, place, n = v.atoms(texts)
        pattern, at, words_ = re.compile(v.cuts(), re.S), 0, [w.decode() for w in words.to_pylist()]
        assert len(set(words_)) == len(words_) and len(n) == len(texts)
        for t, k in zip(texts, n):
            want = pattern.findall("▁" + t.replace(" ", "▁")) if t else []
            assert [words_[i].replace(" ", "▁") for i in place[at:at + k]] == want
            at += k
        shards, order, ends = pieces.by_shard(words, 2 * pieces.TOGETHER + 1, 7)
        assert sorted(order.tolist()) == list(range(len(words))) and ends[-1] == len(words) and all(14 <= s < 21 for s in shards)
        ordered = words.take(pa.array(order))
        got = [pieces.flat_words(*pieces.unpressed(pieces.pressed(np.diff(a), b))).to_pylist() for a, b in
               (pieces.flat(ordered.slice(i, j - i)) for i, j in zip([0, *ends], ends))]
        assert sum(got, []) == ordered.to_pylist()


def test_paths_of_long_and_short_atoms_in_few_bytes():
    """Atoms of all lengths against plain Viterbi; what is sent back takes less than a fifth of the ids."""
    rng = random.Random(6)
    v = small()
    words = sorted({"".join(rng.choices("abcdéx", k=k)).encode() for k in [*range(1, 60), pieces.LONG, pieces.LONG + 1, 3 * pieces.LONG + 7] for _ in range(5)})
    n, sizes = pieces.best_paths(pa.array(words, pa.binary()), v)
    assert sizes.sum() == sum(map(len, words))
    got = pieces.ids_of(n, sizes, b"".join(words), v)
    count, flat = pieces.flat_paths(pa.chunked_array([got]), v)
    at = count.cumsum() - count
    for w, i, k in zip(words, at, count):
        assert flat[i:i + k].tolist() == plain_word(v, w.decode())
    assert len(pieces.pressed(n, pieces.pressed(sizes, b""))) < 4 * len(flat) / 5


def plain_word(v, word):
    """`plain`, of a word alone."""
    table, low = dict(zip(v.pieces, zip(v.scores, v.ids))), min(v.scores) - 10.0
    best = [(0.0, [])]
    for e in range(1, len(word) + 1):
        top = None
        for s in range(max(0, e - v.longest), e):
            hit = table.get(word[s:e]) or ((low, -1 - ord(word[s])) if e - s == 1 else None)
            if hit and (top is None or best[s][0] + hit[0] > top[0]):
                top = (best[s][0] + hit[0], best[s][1] + ([hit[1]] if hit[1] >= 0 else v.unknown_ids(-1 - hit[1])))
        best.append(top)
    return best[-1][1]


def test_decoded_at_once_or_row_by_row(spark):
    """Rows with NULL ids, ids that are no text, and none that begin with a space, beside those that do."""
    v = small()
    byte = lambda *b: [1 + i for i in b]
    space, a = v.ids[v.pieces.index("▁")], v.ids[v.pieces.index("a")]
    sets = [[[space, a], [space, *byte(0xC3, 0xA9)], [], [space]], [[space, *byte(0xC3)], [*byte(0xA9), a]], [[a, a], None, [space, a]], [[space, a, space]]]
    want = [["a", "é", "", ""], ["\ufffd", "a"], ["a", None, "a"], ["a "]]
    for rows, texts in zip(sets, want):
        got = pieces.decode(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, ids array<int>").coalesce(1), v).orderBy("id").collect()
        assert [r["text"] for r in got] == texts
