import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from paneloom.llm import mixing

DOMAINS = {"a": "web", "b": "web", "c": "books"}
WEIGHTS = {"domain": {"web": 3, "books": 2}, "lang": {"en": 4, "de": 1}, "source": {"a": 2}}


def fill(total, kids):
    """Budgets of {name: (weight, cap)}: whoever would overflow is filled, then the rest is shared anew."""
    out, left = {}, dict(kids)
    while left:
        w = sum(x[0] for x in left.values())
        full = [k for k, (x, cap) in left.items() if Fraction(total * x, w) >= cap]
        if not full:
            for k, (x, cap) in left.items():
                out[k] = min(cap, total * x // w)
            break
        k = min(full, key=lambda k: Fraction(left[k][1], left[k][0]))
        out[k] = left[k][1]
        total -= left.pop(k)[1]
    return out


def plain(rows, share, epochs, seed):
    name = lambda x: "" if x is None else x
    leaf = defaultdict(list)
    for i, text, lang, source in rows:
        leaf[DOMAINS.get(name(source), "other"), name(lang), name(source)].append((i, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    size = {k: sum(n for _, n in v) for k, v in leaf.items()}
    def down(total, prefix, depth):
        if depth == 3:
            return {prefix: total}
        kids = {}
        for k in size:
            if k[:depth] == prefix:
                kids[k[depth]] = kids.get(k[depth], 0) + size[k] * epochs
        weight = WEIGHTS[mixing.LEVELS[depth]]
        got = fill(total, {k: (weight.get(k, 1), cap) for k, cap in kids.items()})
        return {x: y for k, b in got.items() for x, y in down(b, (*prefix, k), depth + 1).items()}
    budget = down(sum(size.values()) * share[0] // share[1], (), 0)
    out = []
    for k, docs in leaf.items():
        whole = budget[k] // size[k] if size[k] else 0
        rest = budget[k] - whole * size[k]
        place = lambda i: (hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0)
        for i, n in docs:
            upto = sum(m for j, m in docs if place(j) <= place(i))
            c = whole + (upto <= rest)
            if c:
                out.append((i, *k, n, c))
    return sorted(out, key=str)


@pytest.mark.parametrize("share,epochs", [((1, 2), 2), ((9, 10), 1), ((3, 2), 3), ((5, 1), 2), ((0, 1), 1)])
def test_against_plain_sharing(spark, share, epochs):
    rows, n = [], 0
    for source, lang, k in (("a", "en", 60), ("b", "en", 9), ("b", "de", 3), ("c", "de", 20), ("c", None, 2), ("d", "en", 5), (None, None, 1)):
        for _ in range(k):
            rows.append((n, "w " * ((n * 7) % 40), lang, source))
            n += 1
    rows += [(4, rows[4][1], "en", "a"), (4, rows[4][1], "en", "a"), (500, None, "en", "a"), (501, "", "en", "b"), (None, "x y", "en", "a"), (None, "z", "en", "a"), (502, "long " * 30000, "de", "b")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, lang string, source string, budget long, domain int")
    got = mixing.select(df, DOMAINS, WEIGHTS, share, epochs, "s").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, share, epochs, "s")
    kept = mixing.mixed_rows(df, domains=DOMAINS, weights=WEIGHTS, share=share, max_epochs=epochs, seed="s")
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.select(df, DOMAINS, WEIGHTS).count() == 0
