"""A character-level bidirectional LSTM with a linear-chain CRF on top, trained and run in numpy."""

import numpy as np

PAD, CONTROL, LETTER, OTHER = 0, 96, 97, 98
SYMBOLS = 99


def encode(codes: np.ndarray) -> np.ndarray:
    """Code points as model symbols: printable ASCII for itself, then controls, letters beyond ASCII, the rest."""
    out = np.where(codes < 0x250, LETTER, OTHER)
    out = np.where((codes >= 32) & (codes < 127), codes - 31, out)
    return np.where(codes < 32, CONTROL, out).astype(np.int16)


def logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def start_weights(tags: int, hidden=16, width=10, seed=7) -> dict:
    rng = np.random.default_rng(seed)
    w = {"embed": rng.normal(0, .3, (SYMBOLS, width)), "out": rng.normal(0, .3, (2 * hidden, tags)), "bias": np.zeros(tags),
         "trans": np.zeros((tags, tags)), "first": np.zeros(tags)}
    for side in ("f", "b"):
        w["w" + side] = rng.normal(0, .25, (width + hidden, 4 * hidden))
        w["c" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)  # input, forget, output, new; the forget gate starts open
    return {k: v.astype(np.float32) for k, v in w.items()}


def run_lstm(x, w, c0, keep=False):
    """Hidden states of one direction; x is (time, batch, width)."""
    steps, batch, width = x.shape
    hidden = c0.shape[0] // 4
    h, c = np.zeros((batch, hidden), x.dtype), np.zeros((batch, hidden), x.dtype)
    pre = x @ w[:width] + c0
    out, tape = np.empty((steps, batch, hidden), x.dtype), []
    for t in range(steps):
        a = pre[t] + h @ w[width:]
        g = sigmoid(a[:, :3 * hidden])
        i, f, o, n = g[:, :hidden], g[:, hidden:2 * hidden], g[:, 2 * hidden:], np.tanh(a[:, 3 * hidden:])
        before, last = c, h
        c = f * c + i * n
        s = np.tanh(c)
        h = o * s
        out[t] = h
        if keep:
            tape.append((i, f, o, n, before, last, s))
    return out, tape


def back_lstm(dout, x, w, tape):
    steps, batch, width = x.shape
    hidden = dout.shape[2]
    dx, dw, dc0 = np.empty_like(x), np.zeros_like(w), np.zeros(4 * hidden, x.dtype)
    dh, dc = np.zeros((batch, hidden), x.dtype), np.zeros((batch, hidden), x.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, n, before, last, s = tape[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - s * s)
        da = np.concatenate([dc * n * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - n * n)], axis=1)
        dw[:width] += x[t].T @ da
        dw[width:] += last.T @ da
        dc0 += da.sum(0)
        dx[t], dh, dc = da @ w[:width].T, da @ w[width:].T, dc * f
    return dx, dw, dc0


def emissions(w, symbols):
    """Tag scores (batch, time, tags) of windows of symbols (batch, time)."""
    x = w["embed"][symbols.T]
    f, _ = run_lstm(x, w["wf"], w["cf"])
    b, _ = run_lstm(x[::-1], w["wb"], w["cb"])
    return (np.concatenate([f, b[::-1]], axis=2) @ w["out"] + w["bias"]).transpose(1, 0, 2)


def loss_and_gradient(w, symbols, gold):
    """Mean negative log likelihood of the gold tag paths, and its gradient."""
    batch, steps = symbols.shape
    x = w["embed"][symbols.T]
    f, tf = run_lstm(x, w["wf"], w["cf"], True)
    b, tb = run_lstm(x[::-1], w["wb"], w["cb"], True)
    h = np.concatenate([f, b[::-1]], axis=2)
    e = h @ w["out"] + w["bias"]
    y, rows = gold.T, np.arange(batch)
    alpha = [w["first"] + e[0]]
    for t in range(1, steps):
        alpha.append(logsumexp(alpha[-1][:, :, None] + w["trans"], 1) + e[t])
    total = logsumexp(alpha[-1], 1)
    beta, de, dtrans = np.zeros_like(alpha[0]), np.empty_like(e), np.zeros_like(w["trans"])
    for t in range(steps - 1, -1, -1):
        de[t] = np.exp(alpha[t] + beta - total[:, None])
        if t:
            pair = np.exp(alpha[t - 1][:, :, None] + w["trans"] + (e[t] + beta)[:, None, :] - total[:, None, None])
            dtrans += pair.sum(0)
            np.add.at(dtrans, (y[t - 1], y[t]), -1)
            beta = logsumexp(w["trans"] + (e[t] + beta)[:, None, :], 2)
    score = w["first"][y[0]] + sum(e[t, rows, y[t]] for t in range(steps)) + sum(w["trans"][y[t - 1], y[t]] for t in range(1, steps))
    de[np.arange(steps)[:, None], rows, y] -= 1
    g = {"first": de[0].sum(0), "trans": dtrans, "out": h.reshape(-1, h.shape[2]).T @ de.reshape(-1, de.shape[2]), "bias": de.sum((0, 1))}
    dh = de @ w["out"].T
    half = dh.shape[2] // 2
    dxf, g["wf"], g["cf"] = back_lstm(dh[:, :, :half], x, w["wf"], tf)
    dxb, g["wb"], g["cb"] = back_lstm(dh[::-1, :, half:], x[::-1], w["wb"], tb)
    g["embed"] = np.zeros_like(w["embed"])
    np.add.at(g["embed"], symbols.T, dxf + dxb[::-1])
    return float((total - score).mean()), {k: v / batch for k, v in g.items()}


def fit(symbols, gold, tags: int, steps=240, batch=64, rate=0.02, seed=7, **shape) -> dict:
    """Adam over shuffled batches; the same input gives the same weights."""
    w = start_weights(tags, seed=seed, **shape)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    rng = np.random.default_rng(seed)
    for t in range(1, steps + 1):
        at = rng.choice(len(symbols), min(batch, len(symbols)), replace=False)
        _, g = loss_and_gradient(w, symbols[at], gold[at])
        norm = max(1.0, float(np.sqrt(sum((x * x).sum() for x in g.values()))) / 5)
        lr = rate * min(1, 2 * (1 - (t - 1) / steps))
        for k in w:
            m[k] = .9 * m[k] + .1 * g[k] / norm
            v[k] = .99 * v[k] + .01 * (g[k] / norm) ** 2
            w[k] = (w[k] - lr * (m[k] / (1 - .9 ** t)) / (np.sqrt(v[k] / (1 - .99 ** t)) + 1e-8)).astype(np.float32)
    return w


def viterbi(w, e):
    """Best tag paths (batch, time), and at each place how far the chosen tag leads in the emissions."""
    batch, steps, tags = e.shape
    back = np.empty((steps, batch, tags), np.int8)
    s = w["first"] + e[:, 0]
    for t in range(1, steps):
        x = s[:, :, None] + w["trans"]
        back[t] = x.argmax(1)
        s = x.max(1) + e[:, t]
    path = np.empty((batch, steps), np.int8)
    path[:, -1] = s.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[t, rows, path[:, t]]
    chosen = np.take_along_axis(e, path[:, :, None].astype(np.int64), 2)[:, :, 0]
    return path, chosen - e[:, :, 0]
