"""Exact order statistics within groups, at any group size.

Every cross-sectional operator (percentile rank, winsorising, rank correlation, quantile spread, false-discovery control)
needs, for each row, three counts inside its group: rows below it, rows tied with it, rows in total. One plan gives them at
every size, without a task that holds a group. The input is read three times:

1. cuts: quantiles of a mergeable sketch for each group, combined in the map tasks and written once, as the sketch of a group
   depends on the order in which its parts arrive, and the next two readings must see the same cuts;
2. counts: rows in each bucket between two cuts, combined in the map tasks, then summed up along the buckets of a group;
3. rows: each row takes what its group has found (one row a group), goes to its bucket by one exchange, is counted there, and
   adds the rows of the buckets below. Rows are carried through; nothing is joined back to them.

Where the cuts lie moves work, not results. A value that is a cut itself has a bucket of its own, whose counts need no
sorting, so its rows are dealt over many tasks: a value that a third of all rows share is no hot spot.
"""

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from paneloom.session import cut_lineage

BUCKETS = 64    # a power of two
SALTS = 64


def null_safe_join(left, right, keys, how="left"):
    """Equi-join on keys that may be NULL; right key columns are dropped."""
    r = right.select(*[F.col(k).alias(f"__r_{i}") for i, k in enumerate(keys)],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"__r_{i}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{i}" for i in range(len(keys))])


def _with_bucket(rows, tag, value, buckets):
    """Adds `__b_<tag>`, the value's bucket: 2 x the cuts below it, found by halving, and one more where it is a cut itself.
    NaN is above all numbers, infinities are values like any other. One projection a step, in one generated loop: nested
    terms would repeat each step within the next, and so would a filter on the bucket that is pushed below."""
    v, cuts, name = F.col(value), F.col(f"__cuts_{tag}"), f"__b_{tag}"
    b, step = F.col(name), buckets // 2
    rows = rows.withColumn(name, F.when(v.isNotNull(), 0))
    while step:
        rows, step = rows.withColumn(name, b + F.when(F.get(cuts, b + (step - 1)) < v, step).otherwise(0)), step // 2
    return rows.withColumn(name, 2 * b + F.when(F.get(cuts, b) == v, 1).otherwise(0))


def _cuts(df, keys, values, buckets):
    qs = [i / buckets for i in range(1, buckets)]
    return cut_lineage(df.groupBy(*keys).agg(*[e for t, v in values.items() for e in (
        F.percentile_approx(v, qs, 50 * buckets).alias(f"__cuts_{t}"), F.count(v).alias(f"__total_{t}"))]))


def group_table(df: DataFrame, keys, values: dict, buckets=BUCKETS) -> DataFrame:
    """One row a group: for each tag -> column of `values` its cuts, its count, and bucket -> (rows below it, rows in it).
    At most 2 x buckets entries a group, whatever the group holds."""
    keys = list(keys)
    cuts = _cuts(df, keys, values, buckets)
    rows = null_safe_join(df.select(*keys, *dict.fromkeys(values.values())), cuts, keys, "inner")
    for t, v in values.items():
        rows = _with_bucket(rows, t, v, buckets)
    if len(values) == 1:
        (t, v), = values.items()
        rows = rows.where(F.col(v).isNotNull()).select(*keys, F.lit(0).alias("__i"), F.col(f"__b_{t}").alias("__b"))
    else:
        rows = rows.select(*keys, F.posexplode(F.array(*[f"__b_{t}" for t in values])).alias("__i", "__b")).where("__b is not null")
    n = rows.groupBy(*keys, "__i", "__b").agg(F.count(F.lit(1)).alias("__n"))
    if keys:
        n = n.repartition(*keys)  # one row a bucket
    by = W.partitionBy(*keys, "__i").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("__before", F.coalesce(F.sum("__n").over(by), F.lit(0)))
    entry = F.struct("__b", F.struct(F.col("__before").alias("before"), F.col("__n").alias("n")))
    maps = n.groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("__i") == i, entry))).alias(f"__map_{t}")
                                  for i, t in enumerate(values)])
    return null_safe_join(cuts, maps, keys, "left")


def _in_buckets(df, keys, values, groups, buckets=BUCKETS):
    """Rows with what their group has found, and the bucket of each counted column."""
    rows = null_safe_join(df, groups, list(keys), "left")
    for t, v in values.items():
        rows = _with_bucket(rows, t, v, buckets)
    return rows


def _bucketed(df: DataFrame, keys, value) -> DataFrame:
    """The rows with the number of their bucket, `__b`."""
    cuts = _cuts(df, list(keys), {"v": value}, BUCKETS)
    return _in_buckets(df, keys, {"v": value}, cuts).withColumn("__b", F.col("__b_v"))


def _count(rows, columns, keys, values, keep_bucket=False):
    """The counts of rows that know their bucket. `columns`: those that stay."""
    held = [f.name for f in rows.select(*columns).schema if isinstance(f.dataType, T.AtomicType)]
    out = {}
    for t, v in values.items():
        b = F.col(f"__b_{t}")
        at = F.col(f"__map_{t}")[b]
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in held]), F.lit(SALTS)).cast("int")
        out |= {f"__before_{t}": at["before"], f"__n_{t}": at["n"], f"{t}total": F.when(b.isNotNull(), F.col(f"__total_{t}")),
                f"__salt_{t}": F.when(b % 2 == 0, -1).otherwise(spread)}
    rows = rows.withColumns(out).select(*columns, *[f"__b_{t}" for t in values], *out)
    for t, v in values.items():
        b, before = F.col(f"__b_{t}"), F.col(f"__before_{t}")
        w = W.partitionBy(*keys, b, f"__salt_{t}").orderBy(v)
        inner = b % 2 == 0
        rows = rows.withColumns({
            f"{t}below": F.when(inner, before + F.rank().over(w) - 1).otherwise(before),
            f"{t}ties": F.when(inner, F.count(F.lit(1)).over(w.rangeBetween(W.currentRow, W.currentRow))).otherwise(F.col(f"__n_{t}"))})
    scratch = [f"__before_{t}" for t in values] + [f"__n_{t}" for t in values]
    return rows.drop(*scratch, *([] if keep_bucket else [c for t in values for c in (f"__b_{t}", f"__salt_{t}")]))


def counted(df: DataFrame, keys, values: dict, groups=None, extra=(), keep_bucket=False, buckets=BUCKETS) -> DataFrame:
    """For each tag -> column of `values` add <tag>below, <tag>ties, <tag>total (NULL on rows whose value is NULL). `groups`
    is the group table, if it is made already; columns of it named in `extra` stay on the rows."""
    keys = list(keys)
    if groups is None:
        groups = group_table(df, keys, values, buckets)
    return _count(_in_buckets(df, keys, values, groups, buckets), [*df.columns, *extra], keys, values, keep_bucket)


def order_counts(df: DataFrame, keys, value, prefix="", buckets=BUCKETS) -> DataFrame:
    """Add <prefix>below, <prefix>ties, <prefix>total (NULL on rows whose value is NULL)."""
    return counted(df, keys, {prefix: value}, buckets=buckets)


def average_rank(prefix=""):
    """Rank with ties averaged, from the three counts."""
    return F.col(f"{prefix}below") + (F.col(f"{prefix}ties") + 1) / F.lit(2.0)


def quantile_parts(value, q, prefix=""):
    """Aggregates over the counted column around its q-quantile position: the values at the two
    neighbouring ranks, the weight between them, rows up to each and rows below each."""
    v, below, ties, total = (F.col(value), F.col(f"{prefix}below"), F.col(f"{prefix}ties"),
                             F.col(f"{prefix}total"))
    pos = F.lit(float(q)) * (total - 1)
    out = {}
    for tag, k in (("a", F.floor(pos)), ("b", F.ceil(pos))):
        here = (below <= k) & (k < below + ties)
        out[f"{tag}"] = F.max(F.when(here, v))
        out[f"{tag}_upto"] = F.max(F.when(here, below + ties))
        out[f"{tag}_below"] = F.max(F.when(here, below))
    out["f"] = F.max(pos - F.floor(pos))
    return out


def at_quantiles(df: DataFrame, keys, value, groups, tag, qs) -> DataFrame:
    """The rows of the few buckets in which the neighbours of the q-quantiles lie, counted: what `quantile_parts` needs."""
    keys, values = list(keys), {tag: value}
    ranks = [f(F.lit(float(q)) * (F.col(f"__total_{tag}") - 1)) for q in qs for f in (F.floor, F.ceil)]
    holds = lambda e: F.exists(F.array(*ranks), lambda k: (e["before"] <= k) & (k < e["before"] + e["n"]))
    groups = groups.withColumn("__wanted", F.map_keys(F.map_filter(f"__map_{tag}", lambda _, e: holds(e))))
    rows = _in_buckets(df.select(*dict.fromkeys([*keys, value])), keys, values, groups)
    b = F.col(f"__b_{tag}")
    rows = rows.withColumn("__one", F.explode(F.when(F.array_contains("__wanted", b), F.array(b))))  # a filter that stays here
    return _count(rows, list(dict.fromkeys([*keys, value])), keys, values)


def suffix_min(df: DataFrame, keys, order, value, out, tag="") -> DataFrame:
    """min of `value` over the rows at or after this one in `order`, ties included; for rows that `counted` has
    left with their bucket. Bucket minima are folded in the map tasks and run along the buckets of a group."""
    keys, b, salt = list(keys), f"__b_{tag}", f"__salt_{tag}"
    mins = df.where(F.col(b).isNotNull()).groupBy(*keys, b).agg(F.min(value).alias("__m"))
    mins = mins.withColumn("__after", F.min("__m").over(W.partitionBy(*keys).orderBy(b).rowsBetween(1, W.unboundedFollowing)))
    inside = F.min(value).over(W.partitionBy(*keys, b, salt).orderBy(order).rangeBetween(W.currentRow, W.unboundedFollowing))
    rows = null_safe_join(df.withColumn("__here", inside), mins, [*keys, b], "left")
    here = F.when(F.col(b) % 2 == 0, F.col("__here")).otherwise(F.col("__m"))
    return rows.withColumn(out, F.least(here, F.col("__after"))).drop("__here", "__m", "__after", b, salt)
