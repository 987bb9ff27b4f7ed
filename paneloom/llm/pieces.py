"""SentencePiece encoding and decoding over lattices of distinct atoms.

The best segmentation of a text is that of its atoms put together, atoms being cut where no piece of the vocabulary
reaches across. Texts are dealt into blocks of bounded size; each block asks once for each of its distinct atoms. Asked
atoms meet by shard and are folded there; all their substrings that are pieces are found by walking the pieces' prefixes one
character further for all places at once, and are the edges of lattices, over which a Viterbi pass goes end by end, for all
atoms of about one length together. Answers go back to the blocks, where they are strung together.

Scores add up; equal totals go to the path whose last piece starts earlier, then so on before it. A character that no
piece covers costs the least score minus 10 and is written as its bytes, or as the unknown piece where the model has no
bytes. Spaces become U+2581, one is put before the text, and nothing else is normalised.

Defined results: NULL and empty texts have no tokens and decode to the empty text; a text with U+2581 itself decodes to
one with a space there, as in the original; repeated rows and NULL ids are encoded like any other; only the named columns
are read. No atom and no text is cut short; long atoms are walked piecewise.
"""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from paneloom.llm.common import dealt, small_batches, unpacked


SPACE = "\u2581"
SHARDS = 128             # of the atoms of one group of blocks, at most
TOGETHER = 1024          # blocks in a group
BLOCK_CHARS = 2 << 20
CELLS = 1 << 16          # characters of the lattices that are folded together
LONG = 256               # characters of atoms that are folded one by one
UNKNOWN_COST = 10.0


class Vocabulary:
    """The pieces of a model file: text and score of the ordinary ones, and the ids that stand for bytes."""

    def __init__(self, pieces, scores, byte_ids=None, unknown=0):
        self.ids, self.pieces, self.scores = [], [], []
        self.text = [p.replace(SPACE, " ").encode() for p in pieces]
        self.unknown, self.bytes = unknown, byte_ids
        for i, (p, s) in enumerate(zip(pieces, scores)):
            if s is not None:
                self.ids.append(i), self.pieces.append(p), self.scores.append(float(s))
        for b, i in enumerate(byte_ids or []):
            self.text[i] = bytes([b])
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece with a space inside words is not supported")
        self.longest = max(map(len, self.pieces))
        self.lowest = min(self.scores) - UNKNOWN_COST
        kinds = np.zeros(256, np.int8)   # of bytes: 0 holds both sides together, 1 letters and digits, 2 marks, 3 a space
        kinds[[c for c in range(128) if chr(c).isalnum()]] = 1
        kinds[[ord(c) for c in self.marks()]] = 2
        kinds[32] = 3
        self.kinds = kinds
        self.grow_prefixes()

    @classmethod
    def load(cls, path):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        ordinary = [not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)]
        own = [i for i in range(n) if sp.is_byte(i)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if len(own) == 256 else None
        return cls([p if o or sp.is_byte(i) else "" for i, (p, o) in enumerate(zip(pieces, ordinary))],
                   [sp.get_score(i) if o else None for i, o in enumerate(ordinary)], byte_ids, sp.unk_id())

    def marks(self):
        """The marks that no piece joins to letters or digits."""
        pairs = {(a, b) for p in self.pieces for a, b in zip(p, p[1:])}
        joined = {c for x in pairs if x[0] != SPACE and x[0].isalnum() != x[1].isalnum() for c in x if not c.isalnum()}
        return sorted({c for p in self.pieces for c in p if c != SPACE and c.isascii() and not c.isalnum() and c != " "} - joined)

    def cuts(self):
        """A pattern of atoms: runs of spaces and what follows, cut between letters or digits and the marks that no piece
        joins to them. Other characters hold both sides together. `atoms` cuts the same way."""
        m = "".join(re.escape(c) for c in self.marks())
        if not m:
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        run = f"(?:[a-zA-Z0-9]+|[{m}]+)"
        rest = f"[^{SPACE}a-zA-Z0-9{m}]"
        return f"{SPACE}*(?:{run}(?:{rest}+{run}?)*|(?:{rest}+{run}?)+)|{SPACE}+"

    def grow_prefixes(self):
        """Prefixes of the pieces as numbered nodes: `steps` holds node * 2^21 + character in order, `into` the node reached."""
        nodes, at = {"": 0}, []
        for p, s in zip(self.pieces, self.scores):
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
            at.append((nodes[p], s))
        usable = [(p.replace(SPACE, " ").encode(), i) for p, i in zip(self.pieces, self.ids) if " " not in p]  # texts keep no plain space
        self.value_set, self.value_ids = pa.array([p for p, _ in usable], pa.binary()), np.array([i for _, i in usable], np.int32)
        steps = np.array([(nodes[p[:-1]] << 21) + ord(p[-1]) for p in nodes if p], np.int64)
        into = np.array([n for p, n in nodes.items() if p], np.int32)
        order = np.argsort(steps)
        self.steps, self.into = steps[order], into[order]
        self.node_score = np.full(len(nodes), -np.inf)
        for n, s in reversed(at):  # the first of equal pieces counts
            self.node_score[n] = s

    def atoms(self, texts):
        """(words, place, n): the distinct atoms as UTF-8 with plain spaces, the place among them of each atom of the texts,
        one after the other, and how many atoms each text has."""
        parts = [(" " + t.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
        kind, first = self.kinds[data], (np.cumsum(sizes) - sizes)[sizes > 0]
        cut = np.zeros(len(data), bool)
        a, b = kind[:-1], kind[1:]
        cut[1:] = ((b == 3) & (a != 3)) | ((a | b) == 3) & ((a ^ b) == 3) & (a != 3) & (b != 3)
        cut[first] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts, len(data))
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        upto = np.searchsorted(starts, np.cumsum(sizes))
        return found.dictionary.cast(pa.binary()), found.indices.to_numpy(), np.diff(upto, prepend=0)

    def unknown_ids(self, code):
        return [self.bytes[b] for b in chr(code).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]


def edges(cells, v):
    """The pieces in a table of characters, one atom a column, 0 where it has ended: for each length, node[start, atom], 0 where none
    is. All starts go one character further along the prefixes at a time, until none is left."""
    rows, wide = cells.shape
    flat, out = cells.ravel(), []
    at, node = np.flatnonzero(flat), np.zeros(1, np.int64)
    for d in range(min(v.longest, rows)):
        if d:
            go = at < (rows - d) * wide
            at, node = at[go], node[go]
        key = (node << 21) + flat[at + d * wide]
        hit = np.minimum(np.searchsorted(v.steps, key), len(v.steps) - 1)
        ok = v.steps[hit] == key
        at, node = at[ok], v.into[hit[ok]].astype(np.int64)
        if not len(at):
            break
        ends, table = v.node_score[node] > -np.inf, np.zeros(rows * wide, np.int32)
        table[at[ends]] = node[ends]
        out.append(table.reshape(rows, wide))
    return out


def fold(cells, lengths, v):
    """Best paths of the atoms in the columns of `cells`: how many pieces each has, and how many characters each of them, one after the other."""
    rows, wide = cells.shape
    found = edges(cells, v) or [np.zeros(cells.shape, np.int32)]
    weight = [v.node_score[t] for t in found]
    weight[0][found[0] == 0] = v.lowest
    some = [t.any(axis=1) for t in found]
    best, back = np.full((rows + 1, wide), -np.inf), np.zeros((rows + 1, wide), np.int16)
    best[0] = 0.0
    for e in range(1, rows + 1):
        top, by = best[e], back[e]
        for d in range(min(len(found), e), 0, -1):  # longer pieces start earlier and win ties
            if d == 1 or some[d - 1][e - d]:
                x = best[e - d] + weight[d - 1][e - d]
                more = x > top
                top[more], by[more] = x[more], d
    who, at, path = np.arange(wide), lengths.copy(), []
    while len(who):
        d = back[at, who]
        at = at - d
        path.append((who, d))
        who, at = who[at > 0], at[at > 0]
    whose = np.concatenate([w for w, _ in path[::-1]])
    return np.bincount(whose, minlength=wide), np.concatenate([d for _, d in path[::-1]])[np.argsort(whose, kind="stable")]


def fold_long(codes, v):
    """The same of one long atom, its pieces being looked for LONG characters at a time."""
    best, back, kept = [0.0] * v.longest, [], []
    for base in range(0, len(codes), LONG):
        found = edges(codes[base:base + LONG + v.longest - 1, None], v) or [np.zeros((1, 1), np.int32)]
        kept.append(np.stack([np.pad(t[:LONG, 0], (0, max(0, LONG - len(t)))) for t in found]))
    nodes = [k.T.tolist() for k in kept]
    at = lambda s, d: nodes[s // LONG][s % LONG][d - 1] if d <= len(kept[s // LONG]) else 0
    scores = v.node_score.tolist()
    for e in range(1, len(codes) + 1):
        top, by = -np.inf, 0
        for d in range(min(v.longest, e), 0, -1):
            node = at(e - d, d)
            if node or d == 1:
                x = best[-d] + (scores[node] if node else v.lowest)
                if x > top:
                    top, by = x, d
        best.append(top)
        del best[0]
        back.append(by)
    path, e = [], len(codes)
    while e:
        path.append(back[e - 1])
        e -= path[-1]
    return path[::-1]


def best_paths(words, v):
    """Best paths of distinct atoms, an array of UTF-8: how many pieces each has, and how many bytes each of them, one after the other."""
    lengths = pc.utf8_length(words.cast(pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    text = flat(words)[1].decode("utf-8", "surrogatepass").replace(" ", SPACE)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
    starts, order = np.cumsum(lengths) - lengths, np.argsort(lengths, kind="stable")
    n, parts, places, i = np.zeros(len(lengths), np.int64), [np.zeros(0, np.int64)], [], 0
    while i < len(order):
        w = order[i]
        if lengths[w] > LONG:
            path = np.array(fold_long(codes[starts[w]:starts[w] + lengths[w]], v), np.int64)
            n[w], i = len(path), i + 1
            parts.append(path), places.append([w])
            continue
        some = order[i:i + CELLS // max(1, int(lengths[w]))]
        some = some[lengths[some] <= min(LONG, max(8, 2 * lengths[w]))]
        cells = np.zeros((int(lengths[some[-1]]), len(some)), np.int32)
        column = np.repeat(np.arange(len(some)), lengths[some])
        row = np.arange(len(column)) - np.repeat(np.cumsum(lengths[some]) - lengths[some], lengths[some])
        cells[row, column] = stretches(codes, starts[some], lengths[some])
        n[some], path = fold(cells, lengths[some], v)
        parts.append(path), places.append(some)
        i += len(some)
    # back into the order of the words
    placed = np.concatenate(places) if places else np.zeros(0, np.int64)
    first = np.zeros(len(n), np.int64)
    first[placed] = np.cumsum(n[placed]) - n[placed]
    ends = np.append(0, np.cumsum(stretches(np.concatenate(parts), first, n)))
    size = np.select([codes < 0x80, codes == ord(SPACE), codes < 0x800, codes < 0x10000], [1, 1, 2, 3], 4)
    return n, np.diff(np.append(0, np.cumsum(size))[ends])


def ids_of(n, sizes, body, v):
    """Paths as lists of ids, from their pieces' numbers, sizes and bytes; a character without a piece has the id -1 - its code point."""
    found = flat_words(sizes, body)
    at = pc.index_in(found, value_set=v.value_set)
    ids = v.value_ids[at.fill_null(0).to_numpy()]
    own = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
    ids[own] = [-1 - ord(c.decode("utf-8", "surrogatepass").replace(" ", SPACE)) for c in found.take(pa.array(own)).to_pylist()]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids))


def rows_of(table: pa.Table):
    """(ids, texts) of a block."""
    rows = unpacked(table)
    return rows.column("id").to_pylist(), [t or "" for t in rows.column("text").to_pylist()]


def flat(words):
    """Where the parts of an array of bytes begin and end, and the bytes."""
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    return at - at[0], words.buffers()[2][int(at[0]):int(at[-1])].to_pybytes() if len(words) else b""


def by_shard(words, block, many=SHARDS):
    """(shards, order, ends): the shards of the distinct words of a block, the places of the words by shard, and where each shard ends;
    words of a shard stand in their own order."""
    at, raw = flat(words)
    at = at.tolist()
    shard = np.array([zlib.crc32(raw[a:b]) % many for a, b in zip(at, at[1:])], np.int64)
    order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
    order = order[np.argsort(shard[order], kind="stable")]
    last = np.flatnonzero(np.diff(shard[order], append=-1))
    return (shard[order][last] + many * (block // TOGETHER)).astype(np.int32), order, last + 1


def narrow(a):
    """The bytes of whole numbers in as few bytes each as all of them need, low bytes first, and how many."""
    n = 1 if not len(a) or a.max() < 1 << 8 else 2 if a.max() < 1 << 16 else 4
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :n].T).tobytes(), n


def wide(raw, n, count):
    out = np.zeros((count, 4), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8, count * n).reshape(n, count).T
    return out.view("<u4").ravel().astype(np.int64)


def pressed(lengths, body):
    """Lengths and what is that long, the one numbers and the other bytes, compressed."""
    raw, n = narrow(lengths)
    raw = np.array([len(lengths), n], "<u4").tobytes() + raw + body
    return np.array([len(raw)], "<u8").tobytes() + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def unpressed(data):
    raw = pa.decompress(memoryview(data)[8:], int(np.frombuffer(data, "<u8", 1)[0]), codec="zstd", asbytes=True)
    count, n = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    return wide(raw[8:8 + count * n], n, count), raw[8 + count * n:]


def flat_words(lengths, body):
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.py_buffer(body)])


def flat_paths(paths, v):
    """The lengths of paths and their ids one after the other, those of a character without a piece being written out."""
    n, flat = pc.list_value_length(paths).to_numpy().astype(np.int64), pc.list_flatten(paths).to_numpy()
    own = np.flatnonzero(flat < 0)
    if not len(own):
        return n, flat
    codes, which = np.unique(flat[own], return_inverse=True)
    ids = [v.unknown_ids(-1 - int(c)) for c in codes]
    width = np.ones(len(flat), np.int64)
    width[own] = np.array([len(x) for x in ids])[which]
    start = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.int32)
    out[start] = flat
    for j in range(max(map(len, ids))):
        has = width[own] > j
        out[start[own[has]] + j] = np.array([x[j] if j < len(x) else 0 for x in ids], np.int32)[which[has]]
    return np.bincount(np.repeat(np.arange(len(n)), n), width, len(n)).astype(np.int64), out


def stretches(values, starts, n):
    """The stretches of values that begin at `starts` and are `n` long, one after the other."""
    ends = np.cumsum(n)
    return values[np.repeat(starts - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col="doc_id", text_col="text", block_chars=BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs: id, ids (array of token ids), text_sha256 of the text."""
    v = vocabulary
    blocks = 1 + (docs.agg(F.sum(F.length(text_col))).first()[0] or 0) // block_chars
    many = min(SHARDS, 4 * blocks)
    x = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    x = dealt(x.withColumn("block", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(blocks)).cast("int")), blocks)

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        words, _, _ = v.atoms(rows_of(table)[1])
        asked, order, ends = by_shard(words, block, many)
        words = words.take(pa.array(order))
        groups = [flat(words.slice(a, b - a)) for a, b in zip(np.append(0, ends), ends)]
        return pa.table({"shard": pa.array(asked), "block": pa.array(np.full(len(asked), block), pa.int32()),
                         "words": pa.array([pressed(np.diff(at), body) for at, body in groups], pa.binary())})

    asked = x.groupBy("block").applyInArrow(ask, "shard int, block int, words binary")

    def answer(asked: pa.Table) -> pa.Table:
        words = [flat_words(*unpressed(w)) for w in asked.column("words").to_pylist()]
        of = pa.concat_arrays(words).dictionary_encode()
        n, sizes = best_paths(of.dictionary, v)
        starts, place, ends = np.cumsum(n) - n, of.indices.to_numpy(), np.cumsum([len(w) for w in words])
        # sizes are a tenth of what ids would take; the block finds the ids again, as it has the words
        out = [pressed(n[at], pressed(stretches(sizes, starts[at], n[at]), b"")) for at in np.split(place, ends[:-1])]
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "paths": pa.array(out, pa.binary())})

    answers = (asked.repartition(many * (1 + (blocks - 1) // TOGETHER), "shard").groupBy("shard")
               .applyInArrow(answer, "block int, shard int, paths binary"))

    def string_together(rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = rows_of(rows)
        words, place, atoms = v.atoms(texts)
        asked, order, ends = by_shard(words, rows.column("block")[0].as_py() if rows.num_rows else 0, many)
        paths = dict(zip(answers.column("shard").to_pylist(), answers.column("paths").to_pylist()))
        if sorted(paths) != sorted(asked.tolist()):
            raise ValueError("words of a block without an answer")
        # path of a word: its length, and where it begins among the values
        n, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for shard in asked.tolist():
            lengths, body = unpressed(paths[shard])
            n.append(lengths), sizes.append(unpressed(body)[0])
        body = flat(words.take(pa.array(order)))[1]
        by, values = flat_paths(pa.chunked_array([ids_of(np.concatenate(n), np.concatenate(sizes), body, v)]), v)
        n, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        n[order], starts[order] = by, np.cumsum(by) - by
        upto = np.append(0, np.cumsum(n[place]))
        ends = upto[np.append(0, np.cumsum(atoms))]
        return pa.table({"id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(stretches(values, starts[place], n[place]))),
                         "text_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string())})

    return x.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(string_together, "id long, ids array<int>, text_sha256 string")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds `text` to rows with `ids`; NULL ids give NULL."""
    table, kept = vocabulary.text, encoded.columns
    at, column = kept.index("ids"), np.frombuffer(b"".join(table), np.uint8)
    size = np.array([len(t) for t in table], np.int64)
    start = np.cumsum(size) - size

    def at_once(lists):
        """Texts of a batch, where all of them begin with a plain space or have no ids; else None."""
        if lists.null_count:
            return None
        ids = pc.list_flatten(lists).to_numpy()
        ends = np.append(0, np.cumsum(size[ids]))[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]
        data, first = stretches(column, start[ids], size[ids]), ends[:-1][np.diff(ends) > 0]
        if (data[first] != 32).any():
            return None
        out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((ends - np.append(0, np.cumsum(np.diff(ends) > 0))).astype(np.int32)),
                                                              pa.py_buffer(np.delete(data, first))])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no text
            return None

    def run(batches):
        for b in small_batches(batches, 2 << 20):
            out = at_once(b.column(at))
            if out is None:
                out = pa.array([None if ids is None else b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:] for ids in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*kept, "text"])

    return encoded.mapInArrow(run, encoded.select("*", F.lit(None).cast("string").alias("text")).schema)
