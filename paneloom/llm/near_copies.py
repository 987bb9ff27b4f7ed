"""Near-duplicate classes: SimHash fingerprints find most copies, an exact Jaccard similarity of word shingles decides, and
prefix filtering finds the similar pairs whose fingerprints lie further apart.

Texts whose fingerprints are linked by simhash (4 bits or fewer) are verified on whole sets first; what is found similar
is one class from then on, of which no pair is compared again. Two sets of similarity `num / den` or more share one of the first n - ceil(n * num / den) + 1 shingles of each, in any one
order of all shingles. The order is that of a sketch of shingle counts, rare ones first, so that few shingles meet; the
sketch moves work, not results. Candidates that can still reach the similarity, by their sizes and the places of the
shingle that met, are verified on whole sets.

Sets that share a first shingle are verified against the smallest of them, their hub, first; after that only sets that are not
yet in one class are compared: pair by pair where few share the shingle. Where more than `FEW` do, all sets that met the same
hub go into blocks of bounded size, each pair of blocks is compared in memory, and only the links of a spanning forest leave
it: the copies of one text share hundreds of shingles but few hubs, so pairs are neither repeated nor made as rows.

Defined results: words are cut and put in lower case as in simhash, shingles are 64-bit hashes; a text of fewer words has
one shingle of them all, NULL and empty texts one without words; texts of one set are folded; a class is named by its
smallest non-NULL id; only the named columns are read.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom.llm import simhash
from paneloom.llm.common import components, forget, small_batches, stored

SKETCH_BITS = 22     # of the number of counters
PART = 1 << 14       # counters that are summed together
MOST = (1 << 16) - 1 # a counter stops there
FEW = 32             # sets of one first shingle that are compared pair by pair
BLOCK = 256          # sets of a block
BLOCK_GRAMS = 1 << 17
SIMILAR = (4, 5)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text, k=5) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    w = np.fromiter((digest(x, 42) for x in words), "<u8", len(words))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * MIX + w[i:len(w) - k + 1 + i]
    return np.unique((h ^ (h >> np.uint64(32))) * MIX)


def name_of(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), 7) - (1 << 63)


def bucket(grams: np.ndarray) -> np.ndarray:
    return ((grams * MIX) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sets_of(batches, k):
    """(set, shingles) of the texts in the last column of each batch, each set once a task."""
    seen = set()
    for b in small_batches(batches, 4 << 20):
        out = []
        for t in b.column(b.num_columns - 1).to_pylist():
            g = shingles(t, k)
            if (name := name_of(g)) not in seen:
                seen.add(name)
                out.append((name, g))
        if out:
            yield out


def sketch(texts: DataFrame, k: int) -> np.ndarray:
    """How many sets hold a shingle of each bucket, `MOST` at most. Counters move as compressed bytes, a part of them a row."""
    size = PART * 2
    pack = lambda n: pa.compress(np.minimum(n, MOST).astype("<u2").tobytes(), "zstd", asbytes=True)

    def run(batches):
        n = np.zeros(1 << SKETCH_BITS, np.uint32)
        for sets in sets_of(batches, k):
            np.add.at(n, bucket(np.concatenate([g for _, g in sets])), 1)
        for i in range(0, len(n), PART):
            if n[i:i + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // PART], pa.int32()), pa.array([pack(n[i:i + PART])], pa.binary())], ["part", "n"])

    def total(key, table):
        n = np.zeros(PART, np.int64)
        for b in table.column("n"):
            n += np.frombuffer(pa.decompress(b.as_py(), size, "zstd", asbytes=True), "<u2")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([pack(n)], pa.binary())})

    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    parts = texts.mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(total, "part int, n binary")
    for r in parts.collect():  # 256 rows at most
        at = r["part"] * PART
        out[at:at + PART] = np.frombuffer(pa.decompress(bytes(r["n"]), size, "zstd", asbytes=True), "<u2")
    return out


def verified(pairs: DataFrame, bodies: DataFrame, k, similar) -> DataFrame:
    """The pairs (a, b) of sets that are similar. What is moved to them is text, which a shuffle compresses well, and not
    shingles, which it cannot; sets are made again from the two texts of a pair."""
    num, den = similar
    both = pairs.join(bodies.withColumnsRenamed({"set": "a", "text": "ta"}), "a").join(bodies.withColumnsRenamed({"set": "b", "text": "tb"}), "b")

    def alike(batches):
        last, g = None, None
        for batch in batches:
            for part in small_batches([batch], 8 << 20):
                a, b, keep = part.column(0).to_pylist(), part.column(1).to_pylist(), []
                for i, (x, y) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if b[i] != last:
                        last, g = b[i], shingles(y, k)
                    h = shingles(x, k)
                    keep.append(len(np.intersect1d(g, h, True)) * (num + den) >= (len(g) + len(h)) * num)
                yield pa.RecordBatch.from_arrays([pa.array([v for v, ok in zip(c, keep) if ok], pa.int64()) for c in (a, b)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(alike, "a long, b long")


def by_fingerprint(bodies: DataFrame, k=5, similar=SIMILAR) -> DataFrame:
    """Links (a, b) between similar sets whose texts have one fingerprint or fingerprints that simhash links: each set with the
    first of its fingerprint, and the first of both of two linked fingerprints."""
    marked = stored(simhash.fingerprints(bodies, "set"))
    first = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    own = marked.join(first, "fp").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    near = simhash.links(first.select("fp"))
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_set"))
    near = near.join(end("a"), "a").join(end("b"), "b").select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b"))
    return stored(verified(stored(own.where("a <> b").unionByName(near).distinct()), bodies, k, similar))


def links(bodies: DataFrame, k=5, similar=SIMILAR, known=None) -> DataFrame:
    """Links (a, b) between the sets of `bodies`, a frame of distinct sets, each with a text of it. Every similar pair is connected by a chain of
    returned links, and no link joins sets that are not similar. `known` are such links, found before; they are returned too."""
    num, den = similar
    order = sketch(bodies.select("text"), k)

    def firsts(batches):
        for sets in sets_of(batches, k):
            key, name, size, place = [], [], [], []
            for s, g in sets:
                m = len(g) - (len(g) * num + den - 1) // den + 1
                key.append(g[np.lexsort((g, order[bucket(g)]))[:m]].view(np.int64))
                name.append(np.full(m, s, np.int64))
                size.append(np.full(m, len(g), np.int32))
                place.append(np.arange(m, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (key, name, size, place)], ["key", "set", "n", "i"])

    def possible(x, y):
        """By sizes, and by what lies before and after the shingle that met."""
        n, m, i, j = x["n"], y["n"], x["i"], y["i"]
        most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
        return (F.least(n, m) * den >= F.greatest(n, m) * num) & (most * (num + den) >= (n + m) * num)

    # `hub`: the smallest set of those that share a first shingle. Most are of one set alone, so folding before the exchange
    # would only move more; rows are moved once, 24 bytes each
    by = W.partitionBy("key")
    all_firsts = bodies.select("text").mapInArrow(firsts, "key long, set long, n int, i int").repartition("key")
    met = stored(all_firsts.withColumn("hub", F.min(F.struct("set", "n", "i")).over(by)).withColumn("many", F.count("*").over(by)).where("many > 1"))
    tested = (met.where(F.col("set") != F.col("hub.set")).where(possible({"n": F.col("n"), "i": F.col("i")}, {"n": F.col("hub.n"), "i": F.col("hub.i")}))
              .select(F.col("hub.set").alias("a"), F.col("set").alias("b")).distinct())
    if known is not None:
        of = stored(components(known))
        at = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        tested = (tested.join(at("a"), "a", "left").join(at("b"), "b", "left")
                  .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))
    tested = stored(tested)
    first = verified(tested, bodies, k, similar)
    first = stored(first if known is None else first.unionByName(known))
    label = components(first).select(F.col("node").alias("set"), "component")
    left = (met.select("key", "set", "n", "i", "many", F.col("hub.set").alias("hub")).join(label, "set", "left")
            .withColumn("component", F.coalesce("component", "set")))
    mixed = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    left = stored(left.join(mixed, "key", "left_semi"))
    forget(met)
    few = left.where(F.col("many") <= FEW)
    x, y = few.alias("x"), few.alias("y")
    at = lambda s: {c: F.col(f"{s}.{c}") for c in ("n", "i")}
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.set") < F.col("y.set")) & (F.col("x.component") != F.col("y.component")) & possible(at("x"), at("y"))
    rest = x.join(y, on).select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()
    rest = stored(rest.join(tested, ["a", "b"], "left_anti"))
    many = stored(left.where(F.col("many") > FEW).select("hub", "set", "n", "component").distinct())
    # the texts of the sets that are left, moved once
    used = rest.select(F.explode(F.array("a", "b")).alias("set")).unionByName(many.select("set")).distinct()
    bodies = stored(bodies.join(used, "set", "left_semi"), "zstd")
    found = stored(verified(rest, bodies, k, similar).unionByName(in_blocks(many, bodies, k, similar)))
    forget(left, tested, rest, many, bodies)
    return first.unionByName(found)


def in_blocks(groups: DataFrame, bodies: DataFrame, k, similar) -> DataFrame:
    """Links (a, b) between similar sets of one hub: every similar pair is connected by a chain of them and of links within a component. `groups`: hub,
    set, n, component."""
    num, den = similar
    size = groups.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).alias("blocks"))
    own = F.pmod(F.xxhash64("set"), F.col("blocks"))
    dealt = (groups.join(size, "hub").withColumn("own", own).join(bodies, "set")
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))

    def compare(table):
        row = np.unique(table.column("set").to_numpy(), return_index=True)[1]
        name, of = (table.column(c).to_numpy()[row] for c in ("set", "component"))
        grams = [shingles(t, k) for t in table.column("text").take(pa.array(row)).to_pylist()]
        n = np.array([len(g) for g in grams])
        a, b = simhash.forest(overlaps(grams) * (num + den) >= (n[:, None] + n) * num)
        new = of[a] != of[b]
        return pa.table({"a": np.minimum(name[a], name[b])[new], "b": np.maximum(name[a], name[b])[new]})

    return (dealt.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set", "component", "text")
            .groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long"))


def overlaps(grams) -> np.ndarray:
    """How many shingles each two of the sets share. Shingles of few sets are counted pair by pair, others by products of matrices."""
    m = len(grams)
    u, v = np.unique(np.concatenate(grams), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(g) for g in grams])[np.argsort(v, kind="stable")]  # by shingle
    n = np.bincount(v, minlength=len(u))
    start = np.cumsum(n) - n
    out = np.diag(np.array([len(g) for g in grams], np.float32))
    for d in range(2, 9):
        own = owner[start[n == d][:, None] + np.arange(d)]
        for i in range(0, len(own), 1 << 12):
            both = own[i:i + (1 << 12), :, None] * m + own[i:i + (1 << 12), None, :]
            out += np.bincount(both[:, ~np.eye(d, dtype=bool)].ravel(), minlength=m * m).reshape(m, m)
    wide = np.flatnonzero(n > 8)
    for i in range(0, len(wide), 1024):
        at = wide[i:i + 1024]
        held = np.zeros((len(at), m), np.float32)
        held[np.repeat(np.arange(len(at)), n[at]), owner[np.concatenate([np.arange(start[c], start[c] + n[c]) for c in at])]] = 1
        product = held.T @ held
        np.fill_diagonal(product, 0)
        out += product
    return out


def classes(docs: DataFrame, id_col="doc_id", text_col="text", k=5, similar=SIMILAR) -> DataFrame:
    """One row for each row of docs: doc_id, set, component_id (the smallest id that a chain of links reaches)."""
    def named(batches):
        for b in small_batches(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name_of(shingles(t, k)) for t in b.column(1).to_pylist()], pa.int64()), b.column(1)], ["doc_id", "set", "text"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    named_rows = stored(rows.mapInArrow(named, "doc_id long, set long, text string"), "zstd")
    marked = stored(named_rows.select("doc_id", "set"))
    distinct = stored(marked.groupBy("set").agg(F.min("doc_id").alias("first_id")))
    bodies = stored(named_rows.groupBy("set").agg(F.first("text").alias("text")), "zstd")
    forget(named_rows)
    label = components(links(bodies, k, similar, by_fingerprint(bodies, k, similar)))
    forget(bodies)
    linked = stored(distinct.join(label.select(F.col("node").alias("set"), "component"), "set"))
    name = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named_sets = linked.join(name, "component").select("set", "component_id")
    of = distinct.join(named_sets, "set", "left").select("set", F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(of, "set").select("doc_id", "set", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the smallest doc_id, once. Rows without
    an id stay."""
    return simhash.only_first(docs, classes(docs, **how))
