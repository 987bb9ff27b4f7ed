"""Personal data: exact patterns for four kinds, and spans that a character BiLSTM-CRF adds to them.

The tagger is trained from labelled spans: windows of a bounded sample of the table (SAMPLE_DOCS documents, at most
SAMPLE_WINDOWS windows of each, labelled by the patterns) and written-out variants the patterns do not match. Texts are
read in windows that overlap by half; each window is decoded by itself, spans at an inner edge are left to the
neighbour, and one choice of spans of greatest total score is made over the whole text. A span of any kind holds a digit
or an `@`, so only windows with one are decoded.

Defined results: a NULL text is the empty text and has no spans; offsets count code points, the end exclusive; repeated
rows get equal results; only the named columns are read.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paneloom.llm import tagger
from paneloom.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)            # outside, then first and further characters of each kind
WINDOW, STRIDE = 96, 48
SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 6
BATCH = 2048                         # windows decoded at once

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# a start within a run of digits never matches where the run's start does not
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in re.findall("[0-9]+", text)]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def is_card(text: str) -> bool:
    d = NOT_DIGIT.sub("", text)
    return 12 <= len(d) <= 19 and luhn(d)


def is_phone(text: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", text)) <= 15


def emails(text):
    """Leftmost, non-overlapping: the whole run of local characters before an `@`, then a dotted domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for kind, pattern, fits in ((1, IP, is_ip), (2, CARD, is_card), (3, PHONE, is_phone)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if fits(m.group())]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def windows_of(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or an `@`."""
    at = np.flatnonzero((codes - 48 < 10) | (codes == 64))
    k = np.unique(np.concatenate([at // STRIDE, at // STRIDE - 1]))
    return k[k >= 0] * STRIDE if len(codes) > STRIDE else k[k == 0] * STRIDE


def window_symbols(codes, start):
    out = np.zeros(WINDOW, np.int16)
    part = tagger.encode(codes[start:start + WINDOW])
    out[:len(part)] = part
    return out


def gold_tags(spans, start):
    out = np.zeros(WINDOW, np.int64)
    for a, k, b in spans:
        if a < start + WINDOW and b > start:
            out[max(a - start, 0):b - start] = 2 + 2 * k
            if a >= start:
                out[a - start] = 1 + 2 * k
    return out


def written_out(seed=11, n=900):
    """Labelled windows made by rule: the four kinds in plain and in looser forms, among other digits and words."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick(*"abcdefghijklmnoprstuvwz") for _ in range(rng.integers(2, 9)))
    num = lambda k: "".join(str(rng.integers(10)) for _ in range(k))

    def card():
        d = pick("4", "5", "37") + num(13)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return pick(d, "-".join(d[i:i + 4] for i in range(0, len(d), 4)), ".".join(d[i:i + 4] for i in range(0, len(d), 4)))

    def ip():
        p = [str(rng.integers(256)) for _ in range(4)]
        return pick(".", ".", " . ", ",").join(p)

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick(f"+1 ({a}) {b}-{c}", f"+{num(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{num(2)} {a} {b} {c}")

    def email():
        return word() + pick("", ".", "_") + pick("", num(2)) + pick("@", "@", " @ ", "@ ") + word() + "." + pick("com", "org", "net", word() + ".de")

    makers = (email, ip, card, phone)
    other = lambda: pick(word(), word(), word(), word() + pick(",", ".", "!", "###", "&&&"), num(rng.integers(1, 20)), f"{num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}",
                         '"' + "".join(pick(*"0123456789abcdef") for _ in range(40)) + '"', f"@{word()}")
    symbols, tags = [], []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            kind = rng.integers(-3, 4)
            piece = makers[kind]() if kind >= 0 else other()
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(piece)))
            text += piece + " "
        codes, cut = codes_of(text), int(rng.integers(0, 20))
        symbols.append(window_symbols(codes, cut))
        tags.append(gold_tags(spans, cut))
    return symbols, tags


def labelled_windows(docs: DataFrame, sample_docs=SAMPLE_DOCS):
    """Windows of a bounded sample of the documents that hold digits or an `@`, labelled by the patterns."""
    some = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id").where("doc_id is not null").distinct()
    ids = [r["doc_id"] for r in some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]

    def cut(batches):
        for b in small_batches(batches):
            out = []
            for t in b.column(0).to_pylist():
                codes, spans = codes_of(t), base_spans(t)
                out += [(window_symbols(codes, s).tolist(), gold_tags(spans, s).tolist()) for s in windows_of(codes)[:SAMPLE_WINDOWS].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in (0, 1)], ["symbols", "tags"])

    rows = docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).select("text").mapInArrow(cut, "symbols array<long>, tags array<long>")
    got = rows.limit(sample_docs * SAMPLE_WINDOWS).collect() if ids else []
    got.sort(key=lambda r: (r["symbols"], r["tags"]))  # the order of tasks must not matter
    return [np.array(r["symbols"], np.int16) for r in got], [np.array(r["tags"]) for r in got]


def train(docs: DataFrame, sample_docs=SAMPLE_DOCS, steps=240) -> dict:
    s, t = labelled_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), sample_docs)
    s2, t2 = written_out()
    return tagger.fit(np.array(s + s2), np.array(t + t2), TAGS, steps=steps)


def window_spans(path, lead, start, length):
    """(start, kind, end, score) of a decoded window; spans that touch an edge inside the text are left out."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], path > 0, [0]]).astype(np.int8)) | np.concatenate([path % 2 == 1, [False]]))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if path[a] and (a > 0 or start == 0) and (b < WINDOW or start + b >= length):
            kinds = (path[a:b] - 1) // 2
            if (kinds == kinds[0]).all():
                yield start + a, int(kinds[0]), start + b, float(lead[a:b].mean())


def plausible(kind, text):
    if kind == 0:
        return re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text) is not None
    return re.fullmatch(r"[+(0-9][\x20(),.0-9-]*[0-9]", text) is not None and (is_ip, is_card, is_phone)[kind - 1](text)


def choose(spans):
    """The non-overlapping spans of greatest total score over a whole text; equal totals go to the earlier ends."""
    spans = sorted(set(spans), key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in spans]
    best = [(0.0, ())]
    for i, s in enumerate(spans):
        j = np.searchsorted(ends[:i], s[0], side="right")
        take = (best[j][0] + s[3], (s, best[j][1]))
        best.append(take if take[0] > best[-1][0] else best[-1])
    out, chain = [], best[-1][1]
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def find_all(weights, texts, least=2.0):
    """Per text, (base spans, added spans)."""
    base, todo, found = [base_spans(t) for t in texts], [], [[] for _ in texts]
    codes = {}
    for i, t in enumerate(texts):
        if base[i] or "@" in t or DIGIT.search(t):
            codes[i] = codes_of(t)
            todo += [(i, s) for s in windows_of(codes[i]).tolist()]
    for k in range(0, len(todo), BATCH):
        part = todo[k:k + BATCH]
        e = tagger.emissions(weights, np.array([window_symbols(codes[i], s) for i, s in part]))
        for (i, s), path, lead in zip(part, *tagger.viterbi(weights, e)):
            if path.any():
                found[i] += window_spans(path, lead, s, len(codes[i]))
    added = []
    for i, t in enumerate(texts):
        ok = [s for s in choose(found[i]) if s[3] >= least and plausible(s[1], t[s[0]:s[2]])]
        added.append([s[:3] for s in ok if not any(s[0] < b and a < s[2] for a, _, b in base[i])])
    return base, added


FOUND = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame, weights: dict, id_col="doc_id", text_col="text") -> DataFrame:
    """Counts and digest of the exact spans, and all spans, of each row."""
    def run(batches):
        for b in small_batches(batches):
            base, added = find_all(weights, [t or "" for t in b.column(1).to_pylist()])
            n = [[sum(k == kind for _, k, _ in s) for s in base] for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()),
                 pa.array([joined(s + a) for s, a in zip(base, added)], pa.string()), pa.array([len(a) for a in added], pa.int64())],
                [x.split(" ")[0] for x in FOUND.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, FOUND)


def redacted(text, spans):
    """The text with each span, overlapping ones as one, replaced by its kind."""
    out, end = [], 0
    for a, k, b in sorted(spans):
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, weights: dict) -> DataFrame:
    """The rows of docs, with personal data in `text` replaced; n_chars follows the text where it is a column."""
    at = docs.columns.index("text")

    def run(batches):
        for b in small_batches(batches):
            texts = b.column(at).to_pylist()
            base, added = find_all(weights, [t or "" for t in texts])
            new = pa.array([t if t is None else redacted(t, s + a) for t, s, a in zip(texts, base, added)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
