"""Near-duplicate classes by 64-bit SimHash fingerprints, searched by the generalised pigeonhole principle.

Two fingerprints within `tau` bits agree, in at least one of m groups of bits, within that group's threshold whenever
the thresholds sum to tau - m + 1. Correlated bits share a group; a dynamic program chooses unequal thresholds by the
estimated number of candidates; each fingerprint probes every value within the threshold and candidates are verified.

Values that many fingerprints share ("warm" values, e.g. within a large group of near copies) would make the links grow
with the square of their number. The fingerprints in or within reach of a warm value go another, exact way instead:
they are dealt into blocks of bounded size, each pair of blocks is compared in memory as whole matrices, and only the
links of a spanning forest leave it.

Defined results: NULL and empty texts have the fingerprint zero and are linked like any other; repeated rows and equal
texts share a fingerprint; a component is named by its smallest non-NULL id; only the named columns are read.
"""

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from paneloom.llm.common import components, small_batches, stored

BITS = 64
PIECE = 1 << 16      # shingles counted at once
BLOCK = 1024         # fingerprints of a block


def fingerprint(text, words_per_shingle=4) -> int:
    """Majority of the bits of all shingle hashes, repeats included, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k, joined = words_per_shingle, b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b - 1], 42) for a, b in zip(starts, starts[k:])), "<u8", len(words) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), PIECE):
        part = hashes[i:i + PIECE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", words_per_shingle=4) -> DataFrame:
    """(doc_id, fp), fp a long with the fingerprint's bits."""
    def run(batches):
        for b in small_batches(batches):
            fp = np.array([fingerprint(t, words_per_shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def flips(bits, most: int) -> list[int]:
    """Masks that change at most so many of the bits."""
    return [signed(sum(1 << b for b in c)) for n in range(most + 1) for c in combinations(bits, n)]


def bit_moments(fps: DataFrame):
    """How often each pair of bits is set together, over all fingerprints; its diagonal counts each bit."""
    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            bits = np.unpackbits(np.asarray(b.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, total)], ["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:  # 64 x 64 at most
        out[r["i"], r["j"]] = r["n"]
    return out


def group_bits(moments, n: int, groups: int) -> list[list[int]]:
    """Groups of nearly equal size; the most correlated bits go together, so that a group repeats as little of
    another group's information as possible."""
    p = np.diag(moments) / max(n, 1)
    cov = moments / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for g in range(groups):
        size = BITS // groups + (g < BITS % groups)
        got = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(got[0])
        while len(got) < size:
            got.append(best := max(free, key=lambda b: (corr[b, got].sum(), -b)))
            free.remove(best)
        out.append(sorted(got))
    return out


def within(differ) -> np.ndarray:
    """Chance that at most 0, 1, 2 ... of the bits differ, each on its own."""
    d = np.array([1.0])
    for q in differ:
        d = np.append(d, 0) * (1 - q) + np.append(0, d) * q
    return np.cumsum(d)


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds of least total cost that sum to `total`; cost[g][e + 1] is that of threshold e from -1 (group unused)."""
    best = {0: (0.0, [])}
    for row in cost:
        step = {}
        for s, (c, chosen) in best.items():
            for e in range(-1, len(row) - 1):
                if s + e not in step or c + row[e + 1] < step[s + e][0]:
                    step[s + e] = (c + row[e + 1], chosen + [e])
        best = step
    return best[total][1]


def links(fps: DataFrame, tau=4, groups=3, warm=32) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of `fps` (a stored frame of fp). Every pair within tau bits is
    connected by a chain of returned links, and no link joins fingerprints further apart. `warm` is the least number
    of fingerprints that makes a value of a group warm; at larger sizes it is eight times the mean."""
    n = fps.count()
    moments = bit_moments(fps)
    sets = group_bits(moments, n, groups)
    masks = [signed(sum(1 << b for b in s)) for s in sets]
    fp = F.col("fp")
    # the key holds the group's bits alone
    values = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(g).alias("part"), fp.bitwiseAND(F.lit(m)).alias("key"))
                                                  for g, m in enumerate(masks)))).alias("x")).select("x.part", "x.key", "fp")
    counts = values.groupBy("part", "key").agg(F.count("*").alias("n"))
    same = {r["part"]: r["c"] for r in counts.groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2).alias("c")).collect()}
    p = np.diag(moments) / max(n, 1)
    cost = []
    for g, s in enumerate(sets):
        near = within(2 * p[s] * (1 - p[s]))
        scale = max(same.get(g) or 0.0, n * n / 2 * near[0]) / max(near[0], 1e-300)
        cost.append([0.0] + [min(n * n / 2, scale * near[e]) + n * len(flips(s, e)) for e in range(min(tau, 3) + 1)])
    thresholds = allocate(cost, tau - groups + 1)
    used = [g for g in range(groups) if thresholds[g] >= 0]
    values = values.where(F.col("part").isin(used))

    def spread(key):
        """Every value within its group's threshold."""
        c = F.lit(None)
        for g in used:
            c = F.when(F.col("part") == g, F.lit(flips(sets[g], thresholds[g]))) if g == used[0] else c.when(F.col("part") == g, F.lit(flips(sets[g], thresholds[g])))
        return F.explode(F.transform(c, lambda m: key.bitwiseXOR(m)))

    limit = F.when(F.lit(False), 0)
    for g, s in enumerate(sets):
        limit = limit.when(F.col("part") == g, max(warm, 8 * n >> len(s)))
    hot = counts.where(F.col("part").isin(used) & (F.col("n") > limit)).select("part", "key")
    cool = values.join(hot, ["part", "key"], "left_anti")
    probes = cool.select("part", spread(F.col("key")).alias("key"), F.col("fp").alias("a"))
    kept = cool.select("part", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    on = (probes["part"] == kept["part"]) & (probes["key"] == kept["key"]) & (F.col("a") < F.col("b")) & near
    # probes are many times the rows they come from, which size estimates do not see: never a broadcast
    light = probes.hint("merge").join(kept, on).select("a", "b").distinct()

    reach = hot.select("part", "key", spread(F.col("key")).alias("near")).select("part", F.col("key").alias("warm"), F.col("near").alias("key"))
    dense = stored(values.join(reach, ["part", "key"]).select("part", "warm", "fp"))
    blocks = dense.groupBy("part", "warm").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = dense.join(blocks, ["part", "warm"]).select("part", "warm", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = pairs.groupBy("part", "warm", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).applyInPandas(
        lambda pdf: spanning(pdf["fp"].to_numpy(), tau), "a long, b long").distinct()
    return light.unionByName(met)


def spanning(fps, tau):
    """Links of a spanning forest of the fingerprints within tau bits of each other."""
    x = np.unique(fps).view(np.uint64)
    a, b = forest(np.bitwise_count(x[:, None] ^ x[None, :]) <= tau)
    return pd.DataFrame({"a": x[a].view(np.int64), "b": x[b].view(np.int64)})


def forest(near):
    """Links (two arrays of row numbers) of a spanning forest of a symmetric matrix of which rows are near which."""
    a, b, new = [], [], np.ones(len(near), bool)
    for start in range(len(near)):
        front = np.array([start]) if new[start] else np.array([], np.int64)
        new[start] = False
        while len(front):
            reached = np.flatnonzero(near[front].any(0) & new)
            a.append(front[near[np.ix_(front, reached)].argmax(0)])
            b.append(reached)
            new[reached] = False
            front = reached
    return (np.concatenate(v) if v else np.array([], np.int64) for v in (a, b))


def classes(docs: DataFrame, id_col="doc_id", text_col="text", words_per_shingle=4, tau=4, groups=3) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (the smallest id that a chain of links reaches)."""
    marked = stored(fingerprints(docs, id_col, text_col, words_per_shingle))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    label = components(links(distinct.select("fp"), tau, groups))
    linked = stored(distinct.join(label.select(F.col("node").alias("fp"), "component"), "fp"))
    name = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = linked.join(name, "component").select("fp", "component_id")
    of = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the smallest doc_id, once. Rows without
    an id stay."""
    return only_first(docs, classes(docs, **how))


def only_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """As keep_one, by the classes found (doc_id, component_id)."""
    found = stored(found.select("doc_id", "component_id"))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rest = docs.join(gone.unionByName(repeated), "doc_id", "left_anti")
    once = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.unionByName(once)
