"""Mixing sources to target weights over a tree domain - language - source, in DataFrame operations only.

A token budget flows down the tree: each node shares its budget among its children by weight, no child getting more than
its subtree can give (its tokens times the most epochs). What a child cannot take goes to its siblings; only what a whole
node cannot take goes to the node's own siblings. All shares are whole numbers of tokens, rounded down.

A leaf with budget B and T tokens gives B div T whole epochs, then the longest prefix that fits of one more epoch, in the
order of md5(seed:epoch:doc_id). Prefixes are found without sorting a leaf: tokens are summed by leaf and hash bucket,
and only the one bucket where the budget ends is put in order.

Defined results: NULL language, source or domain are the empty name; names without a weight have weight 1; a NULL text
has no tokens; documents that tie (repeated ids, NULL ids) are taken together or not at all; only the named columns are
read, so further columns never clash. Weights are whole numbers of at least 1.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

LEVELS = ("domain", "lang", "source")
WIDE = "decimal(38,0)"
WORDS = r"[^\x20\x09-\x0D]+"


def named(value, table: dict, default):
    """The value's entry in a small table given as a dict."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def lite(docs: DataFrame, domains: dict) -> DataFrame:
    """doc_id, the three levels and the number of words of each document."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), named(source, domains, "other").alias("domain"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("tokens"))


def shared_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds `budget`: `total` of the parent shared by `weight`, no child above `cap`. Children that are full first have
    the least cap for their weight; each is full if a share of what those before it leave would fill it."""
    by = W.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")), *LEVELS[:len(parent) + 1])
    left = F.greatest(F.col("total").cast(WIDE) - F.coalesce(F.sum(F.col("cap").cast(WIDE)).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), F.lit(0).cast(WIDE))
    weights = F.sum(F.col("weight").cast(WIDE)).over(by.rowsBetween(0, W.unboundedFollowing))
    c = children.withColumn("_left", left.cast("long")).withColumn("_weights", weights.cast("long"))
    full = F.col("cap").cast(WIDE) * F.col("_weights") <= F.col("_left").cast(WIDE) * F.col("weight")
    c = c.withColumn("_full", full)
    # the first child that is not full sets the share of all that are not
    first = W.partitionBy(*parent)
    rest = F.min(F.when(~F.col("_full"), F.struct((-F.col("_weights")).alias("w"), "_left"))).over(first)
    share = F.expr("cast(cast(weight as decimal(18,0)) * cast(_rest._left as decimal(20,0)) div -_rest.w as bigint)")
    return c.withColumn("_rest", rest).withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.least("cap", share))).drop("_left", "_weights", "_full", "_rest")


def budgets(rows: DataFrame, weights: dict, share=(1, 2), max_epochs=2) -> DataFrame:
    """One row for each leaf: levels, leaf_tokens, budget. `weights` holds a dict for each level; `share` of the
    corpus's tokens, as a fraction, is the budget of the root."""
    leaf = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("leaf_tokens")).withColumn("cap", F.col("leaf_tokens") * max_epochs)
    node = None
    for depth, level in enumerate(LEVELS):
        keys, parent = list(LEVELS[:depth + 1]), list(LEVELS[:depth])
        children = leaf.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("leaf_tokens").alias("leaf_tokens"))
        children = children.withColumn("weight", named(F.col(level), weights.get(level, {}), 1).cast("long"))
        if node is None:
            total = F.expr(f"sum(leaf_tokens) over () * {int(share[0])} div {int(share[1])}").cast("long")
            children = children.withColumn("total", total)
        else:
            children = children.join(node.select(*parent, F.col("budget").alias("total")), parent)
        node = shared_out(children, parent)
    return node.select(*LEVELS, "leaf_tokens", "budget")


def select(docs: DataFrame, domains: dict, weights: dict, share=(1, 2), max_epochs=2, seed="mix") -> DataFrame:
    """The documents of the mixture: doc_id, domain, lang, source, tokens, copies (how many epochs read it)."""
    rows = lite(docs, domains)
    plan = budgets(rows, weights, share, max_epochs).withColumn("epochs", F.expr("coalesce(try_divide(budget - budget % nullif(leaf_tokens, 0), leaf_tokens), 0)").cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("leaf_tokens")).select(*LEVELS, "epochs", "rest")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    x = rows.join(plan, list(LEVELS)).withColumn("place", place).withColumn("bucket", F.substring("place", 1, 3))
    sums = x.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("n"), F.max("rest").alias("rest"))
    upto = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bucket"))
    sums = sums.withColumn("upto", upto).where(F.col("upto") - F.col("n") <= F.col("rest")).select(
        *LEVELS, "bucket", (F.col("upto") - F.col("n")).alias("before"), (F.col("upto") <= F.col("rest")).alias("whole"))
    y = x.join(sums, [*LEVELS, "bucket"], "left")
    sure = y.where("whole or (whole is null and epochs > 0)").select("doc_id", *LEVELS, "tokens", (F.col("epochs") + F.coalesce(F.col("whole"), F.lit(False)).cast("long")).alias("copies"))
    running = F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("place", F.col("doc_id")))
    edge = y.where("not whole").withColumn("upto", F.col("before") + running)
    edge = edge.select("doc_id", *LEVELS, "tokens", (F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("long")).alias("copies")).where("copies > 0")
    return sure.unionByName(edge)


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mixture takes at least once."""
    ids = select(docs, **how).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
