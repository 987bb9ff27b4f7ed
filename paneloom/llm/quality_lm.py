"""Quality by the perplexity of a character 5-gram model with interpolated modified Kneser-Ney smoothing.

The model is trained on all trusted documents but a held-out fifth, over which each language's threshold (a quantile of
perplexity) is set. Counts, continuation counts, context totals and discounts are keyed aggregations, and the chance of
each 5-gram comes from joins of those count tables, sharded by gram or context; so long a gram knows words and how they
follow each other, and what is counted grows with the trusted text. A gram of k symbols is two numbers, `lo` with its last three and
`hi` with those before. Texts are dealt into blocks of bounded size; a block asks the joins for each of its distinct grams once
and sums them up for its documents.

Defined results: a NULL text is the empty text, whose only symbol is the end of text; a document is trusted when it has
a label and all its labels say quality 1 and not toxic (a NULL toxic says nothing); without trusted documents all
chances are equal and every document is kept; a language with fewer than FEW held-out documents has the threshold of all
languages together; a threshold lies midway (in logarithms) between the quantile and the nearest document beyond it that
is labelled junk (all its labels say quality 0 and none toxic), so that labelled junk beyond the quantile always goes; repeated rows get equal results, NULL ids included; only the named columns are read.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paneloom.llm.common import dealt, forget, stored, unpacked

ORDER = 5
SHIFT = 21                            # bits of a symbol
START, END = 0x110000, 0x110001       # beyond all code points
LOW = 3                               # symbols of `lo`
WIDE = 1 << 62                        # codes of a block stay below
BLOCK_CHARS = 8 << 20
PIECE_CHARS = 1 << 20                 # symbols of a block that are looked at together
SLICES = 4                            # runs in which the blocks get their answers, one after the other
GRAM = np.dtype([("hi", np.int64), ("lo", np.int64)])
HELD_OUT = 5                          # one trusted document in so many sets the thresholds
QUANTILE = 0.99
SLACK = 1.5                           # the threshold is at most so many times the quantile: clean text beyond it stays, unless labelled junk lies there too
FEW = 20                              # a language with fewer held-out documents goes by all languages
PRIOR = 64                            # symbols of ordinary text that each document is read with, so that short ones pass


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers, for folds."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def pieces(texts, limit):
    """Runs of whole texts of about `limit` symbols each, or one longer text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") >= limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "") + 1
    if run:
        yield run


class Piece:
    """The distinct grams of some texts in the order of their symbols, whatever order the texts come in."""

    def __init__(self, texts):
        parts, lengths = [], []
        edge = np.array([END] + [START] * (ORDER - 1), np.uint32)
        for t in texts:
            a = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            parts += [a, edge]
            lengths.append(len(a) + 1)
        self.lengths = np.array(lengths, np.int64)
        symbols = np.concatenate([edge[1:], *parts])
        at = np.flatnonzero(symbols != START)
        alphabet = np.flatnonzero(np.bincount(symbols, minlength=END + 1))
        place = np.zeros(END + 1, np.int32)
        place[alphabet] = np.arange(len(alphabet))
        place, size = place[symbols], len(alphabet)
        code, span = place[at - ORDER + 1].astype(np.int64), size
        for back in range(ORDER - 2, -1, -1):
            if span * size >= WIDE:
                seen, code = np.unique(code, return_inverse=True)
                span = len(seen)
            code = code * size + place[at - back]
            span *= size
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        self.which = which.astype(np.int32)
        number = lambda places: sum((symbols[at[first] - j].astype(np.int64) << SHIFT * i for i, j in enumerate(places)), np.zeros(len(first), np.int64))
        self.grams = np.empty(len(first), GRAM)
        self.grams["hi"], self.grams["lo"] = number(range(LOW, ORDER)), number(range(LOW))


class Block:
    """The distinct grams of a block of texts in the order of their symbols. Texts are looked at a piece at a time, so that
    what is held is the distinct grams, four bytes a symbol and what one piece takes, not sorted arrays over the whole block."""

    def __init__(self, texts):
        self.parts = [Piece(run) for run in pieces(texts, PIECE_CHARS)]
        every = np.concatenate([np.empty(0, GRAM), *(p.grams for p in self.parts)])
        order = np.lexsort((every["lo"], every["hi"]))
        first = np.append(True, every[order[1:]] != every[order[:-1]])[:len(every)]
        number = np.empty(len(every), np.int32)
        number[order] = np.cumsum(first) - 1
        self.hi, self.lo = every["hi"][order[first]], every["lo"][order[first]]
        at = 0
        for p in self.parts:
            p.which = number[at:at + len(p.grams)][p.which]
            at += len(p.grams)
            p.grams = None
        self.lengths = np.concatenate([np.empty(0, np.int64), *(p.lengths for p in self.parts)])

    def counts(self, weight):
        """How often each gram occurs in the texts of weight 1."""
        weight, n, at = np.asarray(weight, np.float64), np.zeros(len(self.hi), np.int64), 0
        for p in self.parts:
            n += np.bincount(p.which, np.repeat(weight[at:at + len(p.lengths)], p.lengths), len(n)).astype(np.int64)
            at += len(p.lengths)
        return n

    def sums(self, logp):
        """Per text, the sum of the log chances, given by gram."""
        return np.concatenate([np.empty(0), *(np.add.reduceat(logp[p.which], np.cumsum(p.lengths) - p.lengths) for p in self.parts)])


def together(docs: DataFrame, labels: DataFrame, blocks: int, mine=lambda block: F.lit(True)) -> DataFrame:
    """Documents and labels in one frame, dealt into blocks by id; those of the blocks that are `mine`."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
                    F.lit(None).cast("int").alias("good"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    n = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"),
                                                  F.coalesce(good, F.lit(False)).cast("int").alias("good"))
    block = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks)).cast("int")
    return dealt(d.unionByName(n).withColumn("block", block).where(mine(F.col("block"))), blocks)


def split(table: pa.Table):
    """The documents of a block, with columns trusted and held_out."""
    pdf = unpacked(table).to_pandas(integer_object_nulls=True)
    is_doc = pdf["good"].isna()
    votes = pdf[~is_doc].groupby("doc_id")["good"].min()
    docs = pdf[is_doc].reset_index(drop=True)
    docs["trusted"] = docs["doc_id"].map(votes).fillna(0).astype(int) == 1
    folds = mixed(np.array([0 if i is None else i for i in docs["doc_id"]], np.int64)) % np.uint64(HELD_OUT)
    docs["held_out"] = docs["trusted"] & (folds == 0)
    return docs


ASKED = "block int, place int, hi long, lo long, n long"


def count_block(table: pa.Table) -> pa.Table:
    docs = split(table)
    b = Block(docs["text"])
    n = b.counts(docs["trusted"] & ~docs["held_out"])
    return pa.table({"block": pa.array(np.full(len(n), table.column("block")[0].as_py(), np.int32)), "place": pa.array(np.arange(len(n), dtype=np.int32)),
                     "hi": pa.array(b.hi), "lo": pa.array(b.lo), "n": pa.array(n)})


def score_block(table: pa.Table, model: pa.Table) -> pa.Table:
    docs = split(table)
    sums, lengths = [], []
    if len(docs):
        b = Block(docs["text"])
        logp = np.full(len(b.hi), np.nan)
        logp[model.column("place").to_numpy()] = model.column("logp").to_numpy()
        sums, lengths = b.sums(logp), b.lengths
    return pa.table({"doc_id": pa.array(list(docs["doc_id"]), pa.int64()), "lang": pa.array(list(docs["lang"]), pa.string()), "n_symbols": pa.array(lengths, pa.int64()),
                     "log_chance": pa.array(sums, pa.float64()), "held_out": pa.array(docs["held_out"], pa.bool_())})


def discounts(n1, n2, n3, n4):
    """What is taken from counts of 1, 2 and 3 or more: i - (i + 1) Y n[i+1] / n[i], within 0 and i."""
    n = [float(x or 0) for x in (n1, n2, n3, n4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [max(0.0, min(i, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 * i for i in (1, 2, 3)]


def rest_of(k):
    """hi and lo of the last k - 1 symbols of a k-gram."""
    mask = lambda n: F.lit((1 << SHIFT * n) - 1).cast("long")
    return F.col("hi").bitwiseAND(mask(max(0, k - 1 - LOW))).alias("hi"), F.col("lo").bitwiseAND(mask(min(LOW, k - 1))).alias("lo")


def context():
    """hi and lo of all symbols but the last."""
    moved = F.shiftleft(F.col("hi").bitwiseAND(F.lit((1 << SHIFT) - 1)), SHIFT * (LOW - 1))
    return F.shiftright("hi", SHIFT).alias("c_hi"), F.shiftright("lo", SHIFT).bitwiseOR(moved).alias("c_lo")


def chances(wanted: DataFrame, counts: DataFrame, k=ORDER) -> DataFrame:
    """(hi, lo, p) of each wanted k-gram, by interpolated modified Kneser-Ney from the counted ones (hi, lo, c), stored. Lower
    orders count in how many contexts a gram occurs; their tables go once the order above is stored."""
    gram, c = ["hi", "lo"], F.col("c")
    d = discounts(*counts.agg(*(F.sum((c == i).cast("long")) for i in (1, 2, 3, 4))).first())
    seen = counts.select(*gram, "c", F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]).alias("cut"))
    contexts = seen.groupBy(*context()).agg(F.sum("c").cast("double").alias("total"), F.sum("cut").alias("spare"))
    if k == 1:
        used, lower = [], wanted.select(*gram, F.lit(1.0 / max(1, wanted.count())).alias("lower"))
    else:
        asked, shorter = stored(wanted.select(*rest_of(k)).distinct()), stored(counts.groupBy(*rest_of(k)).agg(F.count("*").alias("c")))
        found = chances(asked, shorter, k - 1)
        forget(asked, shorter)
        used, low = [found], found.withColumnsRenamed({"hi": "r_hi", "lo": "r_lo", "p": "lower"})
        r_hi, r_lo = rest_of(k)
        lower = wanted.withColumns({"r_hi": r_hi, "r_lo": r_lo}).join(low, ["r_hi", "r_lo"]).select(*gram, "lower")
    own = F.coalesce((c - F.col("cut")) / F.col("total"), F.lit(0.0))
    p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(own + F.col("spare") / F.col("total") * F.col("lower"))
    out = stored(lower.join(seen, gram, "left").select("*", *context()).join(contexts, ["c_hi", "c_lo"], "left").select(*gram, p.alias("p")))
    forget(*used)
    return out


def perplexities(docs: DataFrame, labels: DataFrame, block_chars=BLOCK_CHARS) -> DataFrame:
    """doc_id, lang, n_symbols, log_chance, perplexity, held_out for each row of docs. The blocks are scored in a few runs, so that
    the disk holds the shuffled texts, grams and answers of one run at a time."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // block_chars
    asked = stored(together(docs, labels, blocks).groupBy("block").applyInArrow(count_block, ASKED), "zstd")
    grams = stored(asked.groupBy("hi", "lo").agg(F.sum("n").alias("c")))
    model = chances(grams.select("hi", "lo"), grams.where("c > 0"))
    forget(grams)
    parts, runs = [], min(SLICES, blocks)
    for i in range(runs):
        mine = lambda block: F.pmod(block, F.lit(runs)) == i
        answers = asked.where(mine(F.col("block"))).select("block", "place", "hi", "lo").join(
            model.select("hi", "lo", F.log("p").alias("logp")), ["hi", "lo"]).select("block", "place", "logp")
        parts.append(stored(together(docs, labels, blocks, mine).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
            score_block, "doc_id long, lang string, n_symbols long, log_chance double, held_out boolean")))
    forget(asked, model)
    return reduce(DataFrame.unionByName, parts).select("doc_id", "lang", "n_symbols", "log_chance",
                                                       F.exp(-F.col("log_chance") / F.col("n_symbols")).alias("perplexity"), "held_out")


def judge(docs: DataFrame, labels: DataFrame, quantile=QUANTILE, slack=SLACK, prior=PRIOR, few=FEW, block_chars=BLOCK_CHARS) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, adjusted (with the prior), threshold, keep for each row of docs."""
    scored = stored(perplexities(docs, labels, block_chars))
    held, mean = scored.where("held_out"), F.sum("log_chance") / F.sum("n_symbols")
    usual = held.groupBy(F.col("lang").alias("of")).agg(mean.alias("mean"), F.count("*").alias("n")).where(F.col("n") >= few).drop("n")
    every = held.agg(mean).first()[0]
    beside = lambda m: F.exp(-(F.col("log_chance") + prior * m) / (F.col("n_symbols") + prior))
    own = F.col("mean").isNotNull()
    votes = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("junk_id")).agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    junk = votes.where("q = 0 and t = 0").select("junk_id")
    read = scored.join(usual, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("any", beside(F.lit(every).cast("double"))).select(
        *scored.columns, "any", own.alias("own"), F.when(own, F.col("lang")).alias("bar_lang"), F.when(own, beside(F.col("mean"))).otherwise(F.col("any")).alias("adjusted"))
    read = stored(read)
    at = lambda c: F.percentile_approx(c, quantile, 10000).alias("quantile")
    bar = read.where("held_out and own").groupBy("own", "bar_lang").agg(at("adjusted")).unionByName(
        read.where("held_out").agg(at("any")).select(F.lit(False).alias("own"), F.lit(None).cast("string").alias("bar_lang"), "quantile"))
    bar = stored(bar.select(F.col("own").alias("b_own"), F.col("bar_lang").alias("b_lang"), "quantile"))
    same = (F.col("own") == F.col("b_own")) & F.col("bar_lang").eqNullSafe(F.col("b_lang"))
    nearest = (read.join(junk, F.col("doc_id") == F.col("junk_id"), "left_semi").join(bar, same).where("adjusted > quantile")
               .groupBy(F.col("own").alias("j_own"), F.col("bar_lang").alias("j_lang")).agg(F.min("adjusted").alias("junk")))
    bar = bar.join(nearest, (F.col("b_own") == F.col("j_own")) & F.col("b_lang").eqNullSafe(F.col("j_lang")), "left").select(
        "b_own", "b_lang", F.least(slack * F.col("quantile"), F.sqrt(F.col("quantile") * F.col("junk"))).alias("threshold"))
    return read.join(stored(bar), same, "left").select(
        "doc_id", "lang", "n_symbols", "perplexity", "adjusted", "threshold",
        F.coalesce(F.col("adjusted") <= F.col("threshold"), F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept; a row without an id goes by no decision and stays."""
    gone = stored(judge(docs, labels, **how).where("not keep and doc_id is not null").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
