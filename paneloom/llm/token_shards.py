"""Token ids in training order: sequences of fixed length, each at a global slot given by a keyed permutation.

Documents are encoded by a public byte-level BPE vocabulary, end with its end-of-text id and are cut into sequences of
`length` ids, the last one filled up with that id. Sequences are numbered without gaps in the order of the files: by
path, piece of the file, place within the piece, place within the document. Spark may cut files into other pieces or read
them by other tasks, the numbers stay. A keyed Feistel network with cycle-walking permutes them, and every `stride` slots
form one shard of fixed-size records: slot s is record s mod stride of shard s div stride. Ranges of shards are sorted by
slot, each in one task, and written in that order, so a reader seeks to any slot and resumes there; as slots have no gaps,
equal ranges hold equal numbers of sequences whatever the documents are.

Defined results: a NULL or empty text is one sequence of end-of-text ids; repeated rows and NULL ids are encoded like any
other; only the named columns are read; without documents there are no shards. Texts that spell a special token are
ordinary text. Documents that are not a plain scan of files are written first and numbered by the files written.
"""

import array
import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from paneloom.llm.common import forget, small_batches, stored
from paneloom.session import shared_folder

# fixed values of the public vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH = 512           # ids of a sequence
STRIDE = 256           # sequences of a shard
RANGE = 128            # shards of a range, which one task sorts and writes
RANGES = 20_000        # ranges at most; larger ones beyond that
ROUNDS = 6
MASK = (1 << 64) - 1


def ranks_of(path) -> dict:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids of whole texts, as 16-bit numbers."""

    def __init__(self, ranks):
        import tiktoken
        self.all = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text) -> bytes:
        return array.array("H", self.all(text)).tobytes()


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed mixing of 64-bit numbers."""
    x = x + np.uint64(key & MASK)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted(numbers, size: int, key: int, back=False) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1 (or its inverse): a Feistel network over the next even number of bits, whose
    values outside the range walk on along their cycle until they fall into it."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]
    out = np.array(numbers, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & low
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (mixed(left, k) & low), left
            else:
                left, right = right, left ^ (mixed(right, k) & low)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def encoded(docs: DataFrame, ranks: dict, length=LENGTH, id_col="doc_id", text_col="text", scan=False) -> DataFrame:
    """(doc_id, path, start, first, n, ids): each document's n sequences, from number `first` on of the piece of a file that
    begins at byte `start`. `scan`: docs is a scan of files, with nothing but filters and projections upon it."""
    send = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary, of fixed size
    columns = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")]
    if not scan:
        docs = stored(docs.select(columns), "zstd")
        columns = [docs["doc_id"], docs["text"]]
    file = docs.metadataColumn("_metadata")

    def run(batches):
        encoder, next_of = Encoder(send.value), {}
        for b in small_batches(batches):
            rows = []
            for t, *piece in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                ids = encoder.encode(t or "")
                n = len(ids) // 2 // length + 1
                first = next_of.get((*piece,), 0)
                next_of[(*piece,)] = first + n
                rows.append((first, n, ids + np.full(n * length - len(ids) // 2, END, np.uint16).tobytes()))
            f, n, ids = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(f, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                                             ["doc_id", "path", "start", "first", "n", "ids"])

    return (docs.select(*columns, file["file_path"].alias("path"), file["file_block_start"].alias("start"))
            .mapInArrow(run, "doc_id long, path string, start long, first long, n long, ids binary"))


def numbering(rows: DataFrame):
    """The number of each piece's first sequence, and the number of all sequences. To the driver comes one row for each
    piece of a file, which it has listed itself to plan the scan."""
    base, total = {}, 0
    for r in sorted(rows.groupBy("path", "start").agg(F.sum("n").alias("n")).collect()):
        base[r["path"], r["start"]], total = total, total + r["n"]
    return base, total


def sequences(rows: DataFrame, key: int, base: dict, total: int, length=LENGTH, stride=STRIDE) -> DataFrame:
    """(doc_id, k, slot, shard, ids) of every sequence; `rows` is a stored frame of `encoded`, base and total its `numbering`."""
    send = rows.sparkSession.sparkContext.broadcast(base)

    def run(batches):
        base = send.value
        for b in small_batches(batches):
            doc, path, start, first, n, ids = (c.to_pylist() for c in b.columns)
            number = np.concatenate([base[p, s] + f + np.arange(m) for p, s, f, m in zip(path, start, first, n)]) if doc else np.array([], np.int64)
            slot = permuted(number, total, key) if len(number) else number
            record = 2 * length
            cut = [i[j * record:(j + 1) * record] for i, m in zip(ids, n) for j in range(m)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, m in zip(doc, n) for _ in range(m)], pa.int64()), pa.array([j for m in n for j in range(m)], pa.int64()),
                 pa.array(slot, pa.int64()), pa.array(slot // stride, pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "k", "slot", "shard", "ids"])

    return rows.mapInArrow(run, "doc_id long, k long, slot long, shard long, ids binary")


SHARD = "shard long, first_slot long, n_sequences long, sha256 string, payload binary"


def shards(seqs: DataFrame, total: int, stride=STRIDE, per=RANGE) -> DataFrame:
    """One row for each shard: its records in slot order as one payload of little-endian 16-bit ids. Partitions are ranges
    of shards in order, and rows within them are in order as well."""
    n = -(-total // stride)
    per = max(per, -(-n // RANGES))

    def run(batches):
        records, slot = [], None  # of the shard at hand, and the slot that comes next

        def finish():
            first = slot - len(records)
            if first % stride or slot != min(first + stride, total):
                raise ValueError(f"shard at slot {first} has {len(records)} sequences")
            payload = b"".join(records)
            return pa.RecordBatch.from_arrays([pa.array([first // stride]), pa.array([first]), pa.array([len(records)]), pa.array([hashlib.sha256(payload).hexdigest()]),
                                               pa.array([payload], pa.binary())], ["shard", "first_slot", "n_sequences", "sha256", "payload"])

        for b in batches:
            for s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if records and s % stride == 0:
                    yield finish()
                    records = []
                elif records and s != slot:
                    raise ValueError(f"slot {slot} is missing or repeated")
                records.append(ids)
                slot = s + 1
        if records:
            yield finish()

    ranges = F.expr(f"cast(slot div {stride * per} as int)")
    return (seqs.select("slot", "ids").repartitionById(max(1, -(-n // per)), ranges).sortWithinPartitions("slot").mapInArrow(run, SHARD))


def write(found: DataFrame, path: str) -> None:
    """Writes shards as files in order of their slots, a file for each range."""
    found.write.mode("overwrite").option("compression", "zstd").parquet(path)


def materialise(docs: DataFrame, ranks: dict, key: int, path=None, length=LENGTH, stride=STRIDE, per=RANGE, **columns) -> DataFrame:
    """Writes the shards of all documents in training order to `path` (a new folder of the shared one, if none is given)
    and returns them as read back."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    rows = stored(encoded(docs, ranks, length, **columns), "zstd")
    base, total = numbering(rows)
    write(shards(sequences(rows, key, base, total, length, stride), total, stride, per), path)
    forget(rows)
    return spark.read.schema(SHARD).parquet(path)


def read_from(spark: SparkSession, path: str, slot=0, length=LENGTH, stride=STRIDE) -> DataFrame:
    """(slot, ids) of the written records from a slot on; earlier shards are skipped by their number."""
    def run(batches):
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(payload, "<u2").reshape(-1, length)
                keep = np.arange(max(0, slot - start), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(start + keep, pa.int64()), pa.array(list(ids[keep].astype(np.int32)), pa.list_(pa.int32()))], ["slot", "ids"])

    return spark.read.parquet(path).where(F.col("shard") >= slot // stride).select("first_slot", "payload").mapInArrow(run, "slot long, ids array<int>")
