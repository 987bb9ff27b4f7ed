"""Words one edit apart, found by walking states (word, position, node, edits) over a distributed trie, and their spelling forms.

The trie is a table of edges (node, first character, label, child), a node being the hash of a prefix at which words part or
one ends; prefixes at which nothing parts are folded into the label of an edge. It is kept twice, of the words and of the
words reversed: an edit in the back half of a word is walked over the first, one in the front half over the second, so that a
walk starts at a node of half the word's length, where few words meet; no state ever stands at the root. Of an edit that can be
put at several places (a letter doubled or undoubled) the last one is taken, which is always a node.

The first join spends the edit: from each node of a word's back half along each edge that does not carry the word's own next
character, as a replacement, an insertion or a deletion. Further joins go on level by level along equal labels; a state that ends
with its word, at the end of another, is a neighbour. Each level is an equi-join that AQE can split, and is written out.
Hashes that collide can add pairs and never lose one; all pairs are checked by their edit distance at the end.

Defined results: NULL and empty texts have no words; words are compared by code points; a NULL id is written as the empty
string where words are changed by id; repeated rows count again; an empty table gives an empty result; only the named
columns are read.
"""

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom.llm.common import stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col="doc_id", text_col="text", least_length=6, least_count=5, change=None) -> DataFrame:
    """(word, n) of the words of enough code points that occur often enough. `change(id, word)`, where given, is put in place
    of each word before it is counted."""
    rows = docs.select(docs[id_col].alias("id"), F.explode(F.regexp_extract_all(docs[text_col].cast("string"), F.lit(RUN), 0)).alias("w"))
    word = F.translate("w", UPPER, LOWER)
    rows = rows.select("id", word.alias("w"))
    rows = rows.select((change(F.col("id"), F.col("w")) if change else F.col("w")).alias("word"))
    return rows.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _trie(words: DataFrame):
    """(places, edges). places: (s, back, p, node), the nodes within each word from half its length on; edges: (node, first,
    label, child, end), `end` being the word that ends there, and child NULL where nothing follows it."""
    both = words.select(F.explode(F.array(F.struct(F.col("word").alias("s"), F.lit(False).alias("back")),
                                          F.struct(F.reverse("word").alias("s"), F.lit(True).alias("back")))).alias("x")).select("x.*")
    m = F.char_length("s")
    steps = both.select("s", "back", F.explode(F.sequence(F.floor((m - 1) / 2).cast("int"), m)).alias("p"))
    steps = steps.withColumn("node", F.xxhash64("back", F.expr("substring(s, 1, p)"), "p"))
    following = F.expr("substring(s, p + 1, 1)")                    # '' at the end of the word
    parts = steps.groupBy("node").agg(F.min(following).alias("a"), F.max(following).alias("b")).where("a <> b").select("node")
    places = stored(steps.join(parts, "node", "left_semi"))
    after = F.lead(F.struct("p", "node")).over(W.partitionBy("back", "s").orderBy("p"))     # at most the word's length
    e = places.withColumn("next", after).withColumn("n", F.coalesce(F.col("next.p"), m)).select(
        "node", following.alias("first"), F.expr("substring(s, p + 1, n - p)").alias("label"), F.col("next.node").alias("child"),
        F.when(F.col("next").isNull(), F.col("s")).alias("end"))
    edges = e.groupBy("node", "first").agg(F.min("label").alias("label"), F.min("child").alias("child"), F.min("end").alias("end"))
    return places, stored(edges)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of the distinct `word`s that differ by one inserted, deleted or replaced code point."""
    places, edges = _trie(words)
    m, size = F.char_length("s"), F.char_length("label")
    start = F.when(F.col("back"), m - F.floor(m / 2)).otherwise(F.floor(m / 2))
    at = places.where(F.col("p") >= start).join(edges, "node").where(F.col("first") != F.expr("substring(s, p + 1, 1)"))
    rest = F.expr("substring(label, 2, char_length(label))")
    real = size > 0
    ways = F.array(
        F.when(real & (F.col("p") < m) & (F.expr("substring(s, p + 2, char_length(label) - 1)") == rest), F.col("p") + size),
        F.when(real & (F.expr("substring(s, p + 1, char_length(label) - 1)") == rest), F.col("p") + size - 1),
        F.when((F.col("p") < m) & (F.expr("substring(s, p + 2, char_length(label))") == F.col("label")), F.col("p") + 1 + size))
    states = at.select("s", "back", "child", "end", F.explode(F.array_compact(ways)).alias("p"))
    found = None
    while True:
        states = stored(states.where((F.col("end").isNotNull() & (F.col("p") == m)) | F.col("child").isNotNull()))
        done = states.where(F.col("end").isNotNull() & F.col("child").isNull() & (F.col("p") == m)).select("s", "back", "end")
        found = done if found is None else found.unionByName(done)
        live = states.where("child is not null")
        if live.isEmpty():
            break
        step = live.select("s", "back", "p", F.col("child").alias("node")).join(edges, "node")
        states = step.where((F.expr("substring(s, p + 1, 1)") == F.col("first")) & (F.expr("substring(s, p + 1, char_length(label))") == F.col("label"))) \
            .select("s", "back", "child", "end", (F.col("p") + size).alias("p"))
    turned = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    return found.select(turned("s").alias("word"), turned("end").alias("near")).distinct().where(F.levenshtein("word", "near") == 1)


def forms(vocab: DataFrame, times=5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n): the form is the most frequent neighbour, ties to the
    smaller, where it is `times` as frequent or more; the root is where the forms lead in the end."""
    vocab = stored(vocab.select("word", "n"))
    near = neighbours(vocab.select("word")).join(vocab.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("b"))
    enough = -F.col("b.m") >= times * F.col("n")
    out = stored(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.m")).alias("form_n")))
    # each form is `times` as frequent as the word before it, which bounds the length of a chain by a logarithm; doubled each round
    most = out.agg(F.max("n")).first()[0] or 1
    chain = int(math.log(most) / math.log(times)) + 1 if times > 1 else most
    root = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, chain).bit_length()):
        up = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        root = stored(root.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
