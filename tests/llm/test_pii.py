import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from paneloom.llm import pii, tagger


def plain_spans(t):
    """The four patterns as they are written, tried from left to right."""
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    ip = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    card = r"[0-9]([\x20-]?[0-9])+"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"
    digits = lambda s: [c for c in s if c in "0123456789"]
    def luhn(d):
        s = 0
        for i, c in enumerate(d[::-1]):
            v = int(c) * (2 if i % 2 else 1)
            s += v // 10 + v % 10
        return s % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(email, t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(ip, t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(card, t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(phone, t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_patterns_match_their_plain_form():
    rng = random.Random(3)
    cases = ["a@b.c", "x@y@z.com.", "@a.b", "a@b", "a.b@c-d.e..f@g.h", "1.2.3.4.5.6.7.8", "999.1.1.1 256.0.0.1 0255.1.2.003", "4111 1111-1111 1111", "+1 (323) 555-9830.",
             "++12 3456 789 0", "4111111111111111 4111111111111111", "+1", "+1 2", "é@ü.com a@é.com", "１２３４"]
    cases += ["".join(rng.choices("01259.@+- ()ab%\n", k=rng.randint(0, 60))) for _ in range(3000)]
    for t in cases:
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300000, "1" * 300000, "a@" * 100000, "1." * 100000, "+1 " * 100000, "1 " * 150000, "+1" + "(" * 200000):
        pii.base_spans(t)


def test_gradient_is_that_of_the_loss():
    w = {k: v.astype(np.float64) for k, v in tagger.start_weights(3, hidden=3, width=2).items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, tagger.SYMBOLS, (2, 5)), rng.integers(0, 3, (2, 5))
    loss, g = tagger.loss_and_gradient(w, x, y)
    for k in w:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in w[k].shape)
            i = (x[1, 3], 1) if k == "embed" else i
            old = w[k][i]
            w[k][i] = old + 1e-5
            more, _ = tagger.loss_and_gradient(w, x, y)
            w[k][i] = old
            assert abs((more - loss) / 1e-5 - g[k][i]) < 1e-4, k


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    w = {"first": rng.normal(size=3), "trans": rng.normal(size=(3, 3))}
    e = rng.normal(size=(4, 5, 3))
    paths, _ = tagger.viterbi(w, e)
    for b in range(4):
        score = lambda p: w["first"][p[0]] + sum(e[b, t, p[t]] for t in range(5)) + sum(w["trans"][p[t], p[t + 1]] for t in range(4))
        assert tuple(paths[b]) == max(itertools.product(range(3), repeat=5), key=score)


@pytest.fixture(scope="module")
def weights():
    s, t = pii.written_out()
    return tagger.fit(np.array(s), np.array(t), pii.TAGS)


def test_held_out_accuracy(weights):
    s, t = map(np.array, pii.written_out(seed=99, n=200))
    path, _ = tagger.viterbi(weights, tagger.emissions(weights, s))
    assert (path == t).mean() > 0.95 and (path == t)[t > 0].mean() > 0.95


def test_spans_are_added_and_base_ones_stay(weights):
    text = "call (323) 555-9830 now or mail bob.smith @ example.org then " + "words and more " * 30 + " a.b@c.de 4111.1111.1111.1111 end"
    (base,), (added,) = pii.find_all(weights, [text])
    assert base == plain_spans(text)
    got = {(pii.KINDS[k], text[a:b]) for a, k, b in added}
    assert ("email", "bob.smith @ example.org") in got and ("card", "4111.1111.1111.1111") in got
    assert all(not (a < d and c < b) for a, _, b in added for c, _, d in base)


def test_choice_is_the_best_of_all_subsets():
    rng = random.Random(4)
    for _ in range(60):
        spans = [(a := rng.randint(0, 20), 0, a + rng.randint(1, 8), rng.random()) for _ in range(7)]
        best = max(sum(s[3] for s in c) for n in range(8) for c in itertools.combinations(spans, n)
                   if all(x[2] <= y[0] or y[2] <= x[0] for x, y in itertools.combinations(c, 2)))
        assert abs(sum(s[3] for s in pii.choose(spans)) - best) < 1e-9


def test_frames(spark, weights):
    rows = [(1, "a@b.co " * 3, "x", 5), (1, "a@b.co " * 3, "x", 5), (2, None, "x", None), (3, "", "x", 0), (None, "é +1 (323) 555-9830" + " z" * 60000, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    out = pii.scan(df, weights).collect()
    assert len(out) == 5
    for r in out:
        t = {1: rows[0][1], 2: "", 3: "", None: rows[4][1]}[r["id"]]
        s = plain_spans(t)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in s) for i in range(4)]
    clean = pii.redact(df, weights)
    assert clean.schema == df.schema
    by = {r["doc_id"]: r for r in clean.collect()}
    assert by[1]["text"] == "<EMAIL> " * 3 and by[1]["n_chars"] == 24 and by[2]["text"] is None and by[3]["text"] == ""
    assert by[None]["text"].startswith("é <PHONE> z z")
    assert pii.scan(df.limit(0), weights).count() == 0
    assert pii.train(df.limit(0), steps=2)["out"].shape[1] == pii.TAGS
    assert pii.labelled_windows(df)[0]
