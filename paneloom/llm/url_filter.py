"""URL rules, and block decisions that follow redirects and canonical links, in DataFrame operations only.

A URL's own rule decides where one fits: the longest of those whose host is the URL's or a parent domain and whose path
begins the URL's; among equally long ones an allow rule, then the smaller text. Every other URL goes by its aliases:
URLs with the same canonical form (scheme, `www.` or `m.`, fragment, trailing slash and utm_ parameters left out) and
URLs joined by redirects (meta refresh) and canonical links, in both directions and over any number of steps, whether
or not they are rows themselves. If one alias is explicitly allowed the URL is allowed, else if one is blocked it is blocked, else it is allowed.

Defined results: a NULL URL or one without `://` has an empty host and path, no rule and no alias, and is allowed;
repeated rows get equal results, NULL ids included; NULL html has no links; only the named columns are read.
"""

from pyspark.sql import DataFrame, functions as F

from paneloom.llm.common import components, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?i)<(?:link|meta)\s[^>]*>"
HREF = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)"


def parts(url):
    """(host, path, query) of a URL column; empty texts where it is NULL or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
            F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1))


def canonical(host, path, query):
    """The form that aliases of one page share; NULL for an empty host."""
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)utm_[^&]*", ""), "^&", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, "^(www|m)[.]", ""), F.regexp_replace(path, "/+$", ""),
                                       F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def rule_frame(spark, rules) -> DataFrame:
    """(rule_host, rule_path, rule, verdict) from (verdict, "host/path") pairs."""
    rows = [(h, "/" + p, f"{h}/{p}", v) for v, (h, _, p) in ((v, r.partition("/")) for v, r in rules)]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, verdict string")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) for which a rule fits."""
    labels = F.split("host", "[.]")
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = urls.select("host", "path", F.explode(up).alias("rule_host"))
    fit = tried.join(rules, (tried["rule_host"] == rules["rule_host"]) & F.startswith(tried["path"], rules["rule_path"]))
    best = F.min(F.struct(-F.length("rule"), F.when(F.col("verdict") == "allow", 0).otherwise(1), "rule", "verdict"))
    return fit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def links(pages: DataFrame) -> DataFrame:
    """(a, b, host, path): canonical forms joined by a canonical link or a redirect of a page, and b's host and path."""
    tags = pages.select("key", "host", "path", F.explode(F.regexp_extract_all("html", F.lit(TAG), 0)).alias("tag"))
    low = F.lower("tag")
    to = (F.when(low.rlike(r"^<link\s") & low.rlike(r"\srel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", HREF, 1))
          .when(low.rlike(r"^<meta\s") & low.rlike(r"\shttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", TARGET, 1)))
    found = tags.withColumn("to", F.replace(to, F.lit("&amp;"), F.lit("&"))).where("to <> ''")
    whole = (F.when(F.contains("to", F.lit("://")), F.col("to")).when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), "to"))
             .when(F.startswith("to", F.lit("/")), F.concat(F.lit("http://"), "host", "to"))
             .otherwise(F.concat(F.lit("http://"), "host", F.regexp_replace(F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")), "[^/]*$", ""), "to")))
    host, path, query = parts(whole)
    return found.select(F.col("key").alias("a"), canonical(host, path, query).alias("b"), host.alias("host"), path.alias("path")).distinct()


def judge(pages: DataFrame, rules, redirects: DataFrame | None = None, id_col="page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of (the smallest form among the aliases) of each row. `redirects` may
    add links (from_url, to_url) seen elsewhere, e.g. in crawl logs."""
    host, path, query = parts(F.col("url"))
    seen = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical(host, path, query).alias("key"), "html")
    marked = stored(seen.drop("html"))
    edges = links(seen)
    if redirects is not None:
        for a, b in (("from_url", "to_url"), ("to_url", "from_url")):
            h, p, q = parts(F.col(b))
            edges = edges.unionByName(redirects.select(canonical(*parts(F.col(a))).alias("a"), canonical(h, p, q).alias("b"), h.alias("host"), p.alias("path")))
    edges = stored(edges)
    of = components(edges.select("a", "b")).withColumnsRenamed({"node": "key", "component": "alias_of"})
    # every URL named counts, also one that is only a link's target
    forms = marked.select("key", "host", "path").unionByName(edges.select(F.col("b").alias("key"), "host", "path")).where("key is not null").distinct()
    forms = stored(forms)
    own = stored(ruled(forms.select("host", "path").distinct(), rule_frame(pages.sparkSession, rules)))
    forms = forms.join(own, ["host", "path"], "left")
    by_form = forms.groupBy("key").agg(F.bool_or(F.col("verdict") == "allow").alias("allow"), F.bool_or(F.col("verdict") == "block").alias("block"))
    by_form = stored(by_form.join(of, "key", "left").withColumn("alias_of", F.coalesce("alias_of", "key")))
    by_class = by_form.groupBy("alias_of").agg(F.when(F.bool_or("allow"), "allow").when(F.bool_or("block"), "block").otherwise("allow").alias("shared"))
    shared = by_form.join(by_class, "alias_of").select("key", "alias_of", "shared")
    out = marked.join(own, ["host", "path"], "left").join(shared, "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "shared", F.lit("allow")).alias("verdict"), "alias_of")
