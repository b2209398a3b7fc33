"""A character-level bidirectional LSTM with CRF transitions in numpy: training by Adam, emissions, Viterbi.

Arrays are time-major. `params` is a plain dict, so that a model travels with a task.
"""
from __future__ import annotations

import numpy as np


def init(n_symbols: int, n_tags: int, embed=12, hidden=16, seed=7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def small(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"E": small(n_symbols, embed) * 3, "O": small(2 * hidden, n_tags), "c": np.zeros(n_tags, np.float32),
         "T": np.zeros((n_tags, n_tags), np.float32), "S": np.zeros(n_tags, np.float32)}
    for way in "fb":
        p["W" + way] = small(embed + hidden, 4 * hidden)
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden:2 * hidden] = 1.0                       # remember by default
        p["g" + way] = bias
    return p


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _run(x, w, bias, keep):
    """Hidden states [T, B, H] of one direction; `keep` also returns what the backward pass needs."""
    steps, rows, _ = x.shape
    size = len(bias) // 4
    h, c = np.zeros((rows, size), np.float32), np.zeros((rows, size), np.float32)
    out, saved = np.empty((steps, rows, size), np.float32), []
    wx, wh = w[:-size], w[-size:]
    driven = x @ wx + bias
    for t in range(steps):
        z = driven[t] + h @ wh
        gates = _sigmoid(z[:, :3 * size])
        i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
        g = np.tanh(z[:, 3 * size:])
        before, previous = c, h
        c = f * before + i * g
        th = np.tanh(c)
        h = o * th
        out[t] = h
        if keep:
            saved.append((previous, before, i, f, o, g, th))
    return out, saved


def _back(x, w, saved, grad):
    """Gradients of one direction for the gradient of its hidden states."""
    steps, rows, embed = x.shape
    size = grad.shape[2]
    dw, dbias, dx = np.zeros_like(w), np.zeros(4 * size, np.float32), np.empty_like(x)
    dh, dc = np.zeros((rows, size), np.float32), np.zeros((rows, size), np.float32)
    for t in range(steps - 1, -1, -1):
        previous, before, i, f, o, g, th = saved[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - th * th)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o),
                             dc * i * (1 - g * g)], axis=1)
        dw[:embed] += x[t].T @ dz
        dw[embed:] += previous.T @ dz
        dbias += dz.sum(0)
        both = dz @ w.T
        dx[t], dh = both[:, :embed], both[:, embed:]
        dc = dc * f
    return dw, dbias, dx


def emissions(p, symbols) -> np.ndarray:
    """Tag scores [T, B, K] of symbol codes [T, B]."""
    x = p["E"][symbols]
    ahead, _ = _run(x, p["Wf"], p["gf"], False)
    behind, _ = _run(x[::-1], p["Wb"], p["gb"], False)
    return np.concatenate([ahead, behind[::-1]], axis=2) @ p["O"] + p["c"]


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradients(p, symbols, tags):
    """Mean negative log likelihood per sequence and its gradients; symbols and tags are [T, B]."""
    steps, rows = symbols.shape
    x = p["E"][symbols]
    ahead, saved_f = _run(x, p["Wf"], p["gf"], True)
    behind, saved_b = _run(x[::-1], p["Wb"], p["gb"], True)
    hidden = np.concatenate([ahead, behind[::-1]], axis=2)
    score = hidden @ p["O"] + p["c"]
    trans = p["T"]
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = score[0] + p["S"]
    for t in range(1, steps):
        alpha[t] = score[t] + _logsum(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(trans[None] + (score[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _logsum(alpha[-1], 1)
    marginal = np.exp(alpha + beta - log_z[None, :, None])
    dscore = marginal.copy()
    t_at, b_at = np.meshgrid(np.arange(steps), np.arange(rows), indexing="ij")
    dscore[t_at, b_at, tags] -= 1
    pairs = np.exp(alpha[:-1, :, :, None] + trans + (score[1:] + beta[1:])[:, :, None, :]
                   - log_z[None, :, None, None]).sum((0, 1))
    np.subtract.at(pairs, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    start = dscore[0].sum(0)
    gold = score[t_at, b_at, tags].sum() + trans[tags[:-1], tags[1:]].sum() + p["S"][tags[0]].sum()
    dscore /= rows
    flat = dscore.reshape(-1, dscore.shape[2])
    grad = {"O": hidden.reshape(len(flat), -1).T @ flat, "c": flat.sum(0), "T": pairs / rows, "S": start / rows}
    dhidden = dscore @ p["O"].T
    size = ahead.shape[2]
    grad["Wf"], grad["gf"], dx = _back(x, p["Wf"], saved_f, dhidden[:, :, :size])
    grad["Wb"], grad["gb"], dx_b = _back(x[::-1], p["Wb"], saved_b, dhidden[::-1, :, size:])
    dx = dx + dx_b[::-1]
    grad["E"] = np.zeros_like(p["E"])
    np.add.at(grad["E"], symbols.ravel(), dx.reshape(-1, dx.shape[2]))
    return (log_z.sum() - gold) / rows, grad


def train(p, symbols, tags, steps=260, batch=48, rate=0.02, seed=11):
    """Adam over random batches; symbols and tags are [N, T]."""
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(symbols), min(batch, len(symbols)))
        _, grad = loss_and_gradients(p, symbols[pick].T, tags[pick].T)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        now = rate * (1 - 0.9 * step / steps)
        for k in p:
            g = grad[k] * scale
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = (p[k] - now * (first[k] / (1 - 0.9 ** step))
                    / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


def viterbi(p, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags [T, B] of emissions [T, B, K]; a row is decoded up to its length."""
    steps, rows, tags = score.shape
    best = score[0] + p["S"]
    back = np.zeros((steps, rows, tags), np.int8)
    kept = np.arange(tags, dtype=np.int8)
    for t in range(1, steps):
        total = best[:, :, None] + p["T"]
        back[t] = total.argmax(1)
        new = total.max(1) + score[t]
        on = (t < lengths)[:, None]
        best = np.where(on, new, best)
        back[t] = np.where(on, back[t], kept)
    path = np.zeros((steps, rows), np.int8)
    path[-1] = best.argmax(1)
    at = np.arange(rows)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t, at, path[t]]
    return path
