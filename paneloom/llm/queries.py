"""Registered queries of the corpus operators: each applies its operator to the whole of its table."""

import zlib

from pyspark.sql import functions as F

from paneloom.llm import graph_ann, html_text, license_scan, media, mixing, periodic_runs, pieces, pii, quality_lm, simhash, spelling, token_shards, url_filter

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filters(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_media_columns(spark, sf_dir):
    m = media.index(media.pack(table(spark, sf_dir, "documents")))
    last = F.element_at("keyframes", -1)
    return m.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", "codec", "timescale", "duration", "n_samples", F.size("keyframes"), F.lit("last"),
                    last["offset"], last["size"]).alias("feature"),
        F.size("keyframes").cast("long").alias("n_keyframes"))


def op3_sentencepiece(spark, sf_dir, model=MODEL):
    v = pieces.Vocabulary.load(model)
    got = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), v), v)
    return got.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.hex(F.xxhash64("ids")).alias("ids_hash"),
                      (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


def op4_license_scan(spark, sf_dir):
    """Sources are taken for repositories, their languages and thousands of ids for directories."""
    path = F.concat_ws("/", "source", "lang", (F.col("doc_id") / 1000).cast("long"), "doc_id")
    return license_scan.scan(table(spark, sf_dir, "documents").withColumn("path", path))


def op5_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.train(docs)).withColumnRenamed("id", "doc_id")


def op7_quality_classifier(spark, sf_dir):
    return quality_lm.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return graph_ann.nearest(v, v.where("vec_id % 20 = 0"), k=20)


def op9_token_shards(spark, sf_dir, ranks=RANKS):
    found = token_shards.materialise(table(spark, sf_dir, "documents"), token_shards.ranks_of(ranks), key=20240607, scan=True)
    # digests of what was written, as read back
    return found.select("shard", "first_slot", "n_sequences", F.length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("sha256"))


def planted(i, words):
    """The rewriting of one document in ten that the query is defined on."""
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op11_periodic_runs(spark, sf_dir):
    r = periodic_runs.scan(table(spark, sf_dir, "documents"), rewrite=planted)
    longer = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, x: F.when(longer(x, b), x).otherwise(b))  # they come by start, then period
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    r = r.withColumn("best", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return r.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op12_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def misspelt(i, word):
    """The deletion of one code point, in one of 199 words, that the query is defined on."""
    h = F.crc32(F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(h % 199 == 0, cut).otherwise(word)


def op13_spelling_forms(spark, sf_dir):
    return spelling.forms(spelling.vocabulary(table(spark, sf_dir, "documents"), change=misspelt))


def literal(text):
    return "'" + text.replace("'", "''") + "'"


SQL_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
OP4_SQL = f"""WITH templates(template, license, text) AS (VALUES {", ".join(f"({i}, {literal(n)}, {literal(t)})" for i, (n, t) in enumerate(license_scan.TEMPLATES))}),
lists AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({SQL_TERMS.format("text")}) AS term FROM templates) GROUP BY ALL),
files AS (SELECT doc_id, concat_ws('/', source, lang, (doc_id // 1000)::VARCHAR, doc_id::VARCHAR) AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS n FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({SQL_TERMS.format("text")})) AS term FROM files) GROUP BY term),
idf AS (SELECT term, ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT term FROM lists UNION SELECT term FROM df) LEFT JOIN df USING (term), n),
wt AS (SELECT template, license, term, tf * idf AS w, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY template)) AS len FROM lists JOIN idf USING (term)),
texts AS (SELECT DISTINCT text, string_split(text, chr(10)) AS l FROM files),
win AS (SELECT text, 0 AS lines, 0 AS i, array_to_string(l, ' ') AS piece FROM texts
  {" ".join(f"UNION ALL SELECT text, {w}, i, array_to_string(l[i + 1:i + {w}], ' ') FROM (SELECT text, l, unnest(range(0, len(l), {s})) AS i FROM texts)" for w, s in license_scan.WINDOWS)}),
tf AS (SELECT text, lines, i, term, count(*) AS tf FROM (SELECT text, lines, i, unnest({SQL_TERMS.format("piece")}) AS term FROM win) GROUP BY ALL),
val AS (SELECT text, lines, i, term, tf * idf AS x FROM tf JOIN idf USING (term)),
norm AS (SELECT text, lines, i, sqrt(sum(x * x)) AS norm FROM val GROUP BY ALL),
dot AS (SELECT text, lines, i, template, license, sum(x * w) AS dot, max(len) AS len FROM val JOIN wt USING (term) GROUP BY ALL),
near AS (SELECT *, round(dot / norm / len, 6) AS score FROM dot JOIN norm USING (text, lines, i) WHERE round(dot / norm / len, 6) >= {license_scan.LEAST}),
own AS (SELECT text, min({{'s': -score, 'l': license}}) FILTER (lines > 0) AS header, min({{'s': -score, 'l': license}}) FILTER (lines = 0) AS whole FROM near GROUP BY text),
m AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, whole, coalesce(header, whole) AS own,
  whole IS NOT NULL OR (coalesce(header, whole) IS NOT NULL AND regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(licen[cs]e|copying)([.-].*)?$')) AS licence_file FROM files LEFT JOIN own USING (text)),
granted AS (SELECT dir AS from_dir, min(coalesce(whole, own)).l AS granted FROM m WHERE licence_file GROUP BY dir),
up AS (SELECT DISTINCT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS from_dir FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM m))),
nearest AS (SELECT dir, arg_max(from_dir, length(from_dir)) AS from_dir, arg_max(granted, length(from_dir)) AS granted FROM up JOIN granted USING (from_dir) GROUP BY dir)
SELECT doc_id, path, coalesce(own.l, granted) AS license, CASE WHEN own IS NOT NULL THEN 'header' WHEN granted IS NOT NULL THEN 'inherited' END AS how, -own.s AS score,
  licence_file, CASE WHEN own IS NULL THEN from_dir END AS from_dir FROM m LEFT JOIN nearest USING (dir)"""


DOMAINS = {f"src{i}": "web" if i < 10 else "books" if i < 15 else "code" for i in range(20)}
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}


def op10_mixing(spark, sf_dir):
    return mixing.select(table(spark, sf_dir, "documents"), DOMAINS, WEIGHTS, share=(1, 2), max_epochs=2, seed="mix")


def cases(column, table, default):
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default!r} END"


def shared_sql(name, children, parent, level):
    """DuckDB form of one level of sharing: the full children are those whose share of what the fuller ones leave fills them."""
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, level])
    return f"""
{name}_a AS (SELECT *, greatest(total - coalesce(sum(cap) OVER ({part} ORDER BY cap / weight, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lft,
  sum(weight) OVER ({part} ORDER BY cap / weight, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM ({children})),
{name}_b AS (SELECT *, cap * ws <= lft * weight AS is_full FROM {name}_a),
{name} AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE least(cap, (weight * arg_max(lft, ws) FILTER (NOT is_full) OVER ({part})) // (max(ws) FILTER (NOT is_full) OVER ({part}))) END AS budget FROM {name}_b)"""


OP10_SQL = f"""WITH d AS (SELECT doc_id, {cases("source", DOMAINS, "other")} AS domain, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS t, sum(tokens)::HUGEINT * 2 AS cap FROM d GROUP BY ALL),
{shared_sql("n1", f"SELECT domain, sum(cap)::HUGEINT AS cap, ({cases('domain', WEIGHTS['domain'], 1)})::HUGEINT AS weight, (SELECT sum(t) // 2 FROM leaf)::HUGEINT AS total FROM leaf GROUP BY domain", [], "domain").strip()},
{shared_sql("n2", f"SELECT l.*, budget AS total FROM (SELECT domain, lang, sum(cap)::HUGEINT AS cap, ({cases('lang', WEIGHTS['lang'], 1)})::HUGEINT AS weight FROM leaf GROUP BY domain, lang) l JOIN n1 USING (domain)", ["domain"], "lang").strip()},
{shared_sql("n3", f"SELECT l.*, budget AS total FROM (SELECT domain, lang, source, cap, ({cases('source', WEIGHTS['source'], 1)})::HUGEINT AS weight FROM leaf) l JOIN n2 USING (domain, lang)", ["domain", "lang"], "source").strip()},
p AS (SELECT domain, lang, source, CASE WHEN t > 0 THEN budget // t ELSE 0 END AS epochs, CASE WHEN t > 0 THEN budget % t ELSE budget END AS rest FROM n3 JOIN leaf USING (domain, lang, source)),
x AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix:' || epochs || ':' || doc_id), doc_id) AS upto FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM x WHERE epochs > 0 OR upto <= rest"""


CANON = """CASE WHEN {h} <> '' THEN regexp_replace({h}, '^(www|m)[.]', '') || regexp_replace({p}, '/+$', '') ||
  CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END END"""
QUERY = "regexp_replace(regexp_replace(regexp_extract({r}, '^[^?#]*[?]([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '')"
HOST, PATH = "translate(regexp_extract({r}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "regexp_extract({r}, '^[^/?#]*([^?#]*)', 1)"
REST = "coalesce(CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) END, '')"
OP1_SQL = f"""WITH RECURSIVE r AS (SELECT page_id, {REST.format(u='url')} AS rest, html FROM pages),
s AS (SELECT page_id, {HOST.format(r='rest')} AS host, {PATH.format(r='rest')} AS path, {QUERY.format(r='rest')} AS q, html FROM r),
p AS (SELECT *, {CANON.format(h='host', p='path', q='q')} AS key FROM s),
t AS (SELECT key, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\s[^>]*>')) AS tag FROM p),
o AS (SELECT key, host, path, replace(CASE WHEN regexp_matches(tag, '(?i)^<link\\s') AND regexp_matches(tag, '(?i)\\srel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?i)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)^<meta\\s') AND regexp_matches(tag, '(?i)\\shttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?i)url\\s*=\\s*["'']?([^"''\\s>]+)', 1) END, '&amp;', '&') AS dest FROM t),
w AS (SELECT key, CASE WHEN contains(dest, '://') THEN dest WHEN starts_with(dest, '//') THEN 'http:' || dest WHEN starts_with(dest, '/') THEN 'http://' || host || dest
  ELSE 'http://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || dest END AS u FROM o WHERE dest <> ''),
x AS (SELECT key, {REST.format(u='u')} AS rest FROM w),
y AS (SELECT key AS a, {HOST.format(r='rest')} AS h, {PATH.format(r='rest')} AS p, {QUERY.format(r='rest')} AS q FROM x),
e AS (SELECT a, {CANON.format(h='h', p='p', q='q')} AS b, h AS host, p AS path FROM y),
named AS (SELECT DISTINCT key, host, path FROM p WHERE key IS NOT NULL UNION SELECT b, host, path FROM e WHERE b IS NOT NULL),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
cls AS (SELECT a AS key, min(b) AS alias_of FROM reach GROUP BY a),
rules(verdict, rh, rp, rule) AS (VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'), ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')),
own AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT host, path FROM named) d JOIN rules
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
k AS (SELECT coalesce(cls.alias_of, key) AS alias_of, verdict FROM named LEFT JOIN own USING (host, path) LEFT JOIN cls USING (key)),
m AS (SELECT p.*, own.rule, own.verdict, coalesce(cls.alias_of, p.key) AS alias_of FROM p LEFT JOIN own USING (host, path) LEFT JOIN cls USING (key)),
c AS (SELECT alias_of, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' ELSE 'allow' END AS shared FROM k GROUP BY alias_of)
SELECT page_id, host, path, rule, coalesce(verdict, shared, 'allow') AS verdict, m.alias_of FROM m LEFT JOIN c ON m.alias_of = c.alias_of"""


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_license_scan": op4_license_scan,
    "op5_pii": op5_pii,
    "op7_quality_classifier": op7_quality_classifier,
    "op6_media_columns": op6_media_columns,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_token_shards": op9_token_shards,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_html_extraction": op12_html_extraction,
    "op13_spelling_forms": op13_spelling_forms,
}
ORACLES = {"op1_url_filters": OP1_SQL, "op4_license_scan": OP4_SQL, "op10_mixing": OP10_SQL}
