"""Maximal word repetitions (runs) of whole texts, found over an enhanced suffix array by the branching-tandem test.

A batch of texts is sorted at once: a word's first rank is that of its (text, word) pair, so nothing matches across texts, and
ranks of stretches of 1, 2, 4 ... words come by doubling. Adjacent suffixes give the LCP table by descending those ranks, the
nearest smaller values give its intervals. For each interval of depth d, the suffixes i of all children but the largest are
looked up: where i + d (or i - d) lies in the interval too but in another child, the words of i .. i + 2d are a square that
does not go on to the right. Each such square is rotated to the left as far as it goes; that is its run, and of runs over
the same words the one of smallest period counts. No tree is built; all steps are array operations over the batch.

Work is n log n for n words; a text is held by one task, a batch is bounded in bytes (a longer text is a batch of its own).

Defined results: words are `[^\\x20\\x09-\\x0D]+`; NULL and empty texts have no words and no runs; repeated rows get equal results;
NULL ids stay NULL; only the named columns are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paneloom.llm.common import small_batches

BATCH = 3 << 19     # bytes of text sorted together
SCHEMA = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def words_of(text) -> list:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _ranks(first: np.ndarray, end: np.ndarray):
    """Ranks of the stretches of 1, 2, 4 ... words from each place, until no two are equal; `end` is where a place's text ends."""
    levels, width, n = [first.astype(np.int64)], 1, len(first)
    open_ = np.arange(n)
    while True:
        rank = levels[-1]
        # only places whose rank is shared can still change; a shared rank leaves room for as many new ones as share it
        order = open_[np.argsort(rank[open_], kind="stable")]
        r = rank[order]
        shared = np.zeros(len(order), bool)
        same = r[1:] == r[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        open_ = order[shared]
        if not len(open_):
            return levels
        there = open_ + width
        second = np.where(there < end[open_], rank[np.minimum(there, n - 1)], -1)
        order = np.lexsort((second, rank[open_]))
        at, lead, tail = open_[order], rank[open_][order], second[order]
        head = np.ones(len(at), bool)
        head[1:] = lead[1:] != lead[:-1]
        start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        step = head.copy()
        step[1:] |= tail[1:] != tail[:-1]
        place = np.maximum.accumulate(np.where(step, np.arange(len(at)), 0))
        new = rank.copy()
        new[at] = lead + place - start
        levels.append(new)
        width *= 2


def _nearest_below(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For the places `at`, those with a value above 0, the nearest place to the left whose value is smaller; by pointer jumps,
    which double over equal values."""
    out = np.arange(-1, len(v) - 1)
    todo = at
    while len(todo):
        j = out[todo]
        more = v[j] >= v[todo]
        todo, j = todo[more], j[more]
        out[todo] = out[j]
    return out[at]


def find_runs(symbols: np.ndarray, text: np.ndarray, least=6, powers=4):
    """(start, end, period) of the runs of at least `least` words and `powers` periods; `symbols` are word numbers, `text` the
    ascending number of the text each belongs to."""
    n = len(symbols)
    none = np.zeros((0, 3), np.int64)
    if n < 2:
        return none
    # places of a text's words: the rank of the first word leaves room for all that share it
    key = text.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order][1:] != key[order][:-1]
    first = np.empty(n, np.int64)
    first[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    end = np.searchsorted(text, text, side="right")
    begin = np.searchsorted(text, text, side="left")
    levels = _ranks(first, end)
    isa = levels[-1]
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    # LCP of neighbours in the suffix array
    i, j, lcp = sa[:-1].copy(), sa[1:].copy(), np.zeros(n, np.int64)
    live = np.flatnonzero(first[i] == first[j])
    for k in range(len(levels) - 1, -1, -1):
        a, b = i[live] + lcp[1:][live], j[live] + lcp[1:][live]
        ok = (a < end[i[live]]) & (b < end[j[live]])
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        lcp[1:][live[ok]] += 1 << k
    # intervals: [left, right] in the suffix array for each place p with a depth, `top` the first such place of its interval
    p = np.flatnonzero(lcp)
    if not len(p):
        return none
    depth = lcp[p]
    left = _nearest_below(lcp, p)                       # lcp[0] is 0
    back = np.append(lcp, 0)[::-1]
    right = n - 1 - _nearest_below(back, n - p[::-1])[::-1]
    # places of one interval have one left end and one depth; the next such place ends the child that starts at a place
    order = np.lexsort((p, depth, left))
    joined = (left[order][1:] == left[order][:-1]) & (depth[order][1:] == depth[order][:-1])
    top = np.ones(len(p), bool)
    top[order[1:][joined]] = False
    stop = right + 1
    stop[order[:-1][joined]] = p[order[1:][joined]]
    # children: from each place to the next one of no greater depth, and from the interval's left end to its first place
    c_from = np.concatenate([p, left[top]])
    c_to = np.concatenate([stop - 1, p[top] - 1])
    c_left, c_right = np.concatenate([left, left[top]]), np.concatenate([right, right[top]])
    c_depth = np.concatenate([depth, depth[top]])
    size = c_to - c_from + 1
    order = np.lexsort((c_from, -size, c_depth, c_right, c_left))
    largest = np.ones(len(order), bool)
    o_l, o_r, o_d = c_left[order], c_right[order], c_depth[order]
    largest[1:] = (o_l[1:] != o_l[:-1]) | (o_r[1:] != o_r[:-1]) | (o_d[1:] != o_d[:-1])
    small = order[~largest]
    if not len(small):
        return none
    count = size[small]
    owner = np.repeat(small, count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + c_from[owner]
    s, d = sa[at], c_depth[owner]
    found = []
    for other, square in ((s + d, s), (s - d, s - d)):
        ok = (other >= begin[s]) & (other < end[s])
        where = isa[np.where(ok, other, 0)]
        ok &= (where >= c_left[owner]) & (where <= c_right[owner]) & ((where < c_from[owner]) | (where > c_to[owner]))
        found.append(np.stack([square[ok], d[ok]], 1))
    squares = np.unique(np.concatenate(found), axis=0)
    start, d = squares[:, 0].copy(), squares[:, 1]
    stop = start + 2 * d
    # rotate to the left, the longest stretches first
    for k in range(len(levels) - 1, -1, -1):
        a = start - (1 << k)
        ok = a >= begin[start]
        ok[ok] = levels[k][a[ok]] == levels[k][a[ok] + d[ok]]
        start[ok] = a[ok]
    keep = stop - start >= np.maximum(least, powers * d)
    runs = np.stack([start, stop, d], 1)[keep]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs) > 1:
        runs = runs[np.concatenate([[True], (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])])]
    return runs


def runs_of(texts: list, least=6, powers=4) -> list:
    """Runs (start, length, period) of each list of words, by start, then period."""
    flat = [w for t in texts for w in t]
    if not flat:
        return [[] for _ in texts]
    symbols = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = [[] for _ in texts]
    for a, b, d in find_runs(symbols, text, least, powers).tolist():
        t = int(text[a])
        out[t].append((a - int(first[t]), b - a, d))
    for r in out:
        r.sort(key=lambda x: (x[0], x[2]))
    return out


def collapsed(words: list, runs: list) -> bytes:
    """The words left where of each run only the first period stays."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0))


def scan(docs: DataFrame, id_col="doc_id", text_col="text", least=6, powers=4, rewrite=None) -> DataFrame:
    """id, n_words, runs, collapsed. `rewrite(id, words)`, where given, makes the words that are looked at."""
    def run(batches):
        for b in small_batches(batches, BATCH):
            ids = b.column(0).to_pylist()
            texts = [words_of(t) for t in b.column(1).to_pylist()]
            if rewrite:
                texts = [rewrite(i, w) for i, w in zip(ids, texts)]
            found = runs_of(texts, least, powers)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found],
                         pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                pa.array([collapsed(t, f).decode("utf-8", "replace") for t, f in zip(texts, found)], pa.string())],
                ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
