"""A bidirectional LSTM that labels every element of a sequence, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """One layer each way and a linear output. Weights: w (inputs + state to the four gates), b, per direction; v, c of the output."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = {k: v.astype(np.float32) for k, v in weights.items()}
        self.hidden = len(self.p["b0"]) // 4

    @classmethod
    def fresh(cls, inputs: int, hidden: int, seed: int) -> BiLSTM:
        r = np.random.default_rng(seed)
        p = {}
        for d in "01":
            p["w" + d] = r.normal(0, 0.15, (inputs + hidden, 4 * hidden))
            p["b" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        p["v"], p["c"] = r.normal(0, 0.2, 2 * hidden), np.zeros(1)
        return cls(p)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: (steps, batch, inputs) in reading order; the state stands still where mask is 0."""
        w, b, n = self.p["w" + d], self.p["b" + d], self.hidden
        k = x.shape[2]
        steps, batch = x.shape[:2]
        given = x.reshape(-1, k) @ w[:k] + b
        given = given.reshape(steps, batch, -1)
        h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        out, memo = np.zeros((steps, batch, n), np.float32), []
        for t in range(steps):
            g = given[t] + h @ w[k:]
            i, f, o, u = _sigmoid(g[:, :n]), _sigmoid(g[:, n : 2 * n]), _sigmoid(g[:, 2 * n : 3 * n]), np.tanh(g[:, 3 * n :])
            m = mask[t][:, None]
            c1 = f * c + i * u
            tc = np.tanh(c1)
            h1 = o * tc
            if keep:
                memo.append((h, c, i, f, o, u, tc))
            h, c = m * h1 + (1 - m) * h, m * c1 + (1 - m) * c
            out[t] = h
        return out, memo

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Log odds of the positive label, (steps, batch)."""
        a, ma = self._pass(x, mask, "0", keep)
        z, mz = self._pass(x[::-1], mask[::-1], "1", keep)
        both = np.concatenate([a, z[::-1]], axis=2)
        s = both @ self.p["v"] + self.p["c"]
        return (s, both, ma, mz) if keep else s

    def _back(self, x, mask, d, memo, dout, grads) -> None:
        w, n = self.p["w" + d], self.hidden
        k = x.shape[2]
        steps, batch = x.shape[:2]
        dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        dgs = np.zeros((steps, batch, 4 * n), np.float32)
        hs = np.zeros((steps, batch, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, u, tc = memo[t]
            m = mask[t][:, None]
            dh = dh + dout[t]
            dh1, dc1 = m * dh, m * dc
            do = dh1 * tc
            dc1 = dc1 + dh1 * o * (1 - tc * tc)
            dg = np.concatenate([dc1 * u * i * (1 - i), dc1 * c * f * (1 - f), do * o * (1 - o), dc1 * i * (1 - u * u)], axis=1)
            dgs[t], hs[t] = dg, h
            dh, dc = (1 - m) * dh + dg @ w[k:].T, (1 - m) * dc + dc1 * f
        flat = dgs.reshape(-1, 4 * n)
        grads["w" + d] = np.concatenate([x.reshape(-1, k).T @ flat, hs.reshape(-1, n).T @ flat])
        grads["b" + d] = flat.sum(0)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy and its gradients."""
        s, both, ma, mz = self.scores(x, mask, keep=True)
        p = _sigmoid(s)
        total = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total
        ds = (mask * (p - y) / total).astype(np.float32)
        grads = {"v": np.einsum("tb,tbn->n", ds, both), "c": ds.sum(keepdims=True).reshape(1)}
        dboth = ds[:, :, None] * self.p["v"]
        n = self.hidden
        self._back(x, mask, "0", ma, dboth[:, :, :n], grads)
        self._back(x[::-1], mask[::-1], "1", mz, dboth[::-1, :, n:], grads)
        return float(loss), grads


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(rows)), np.float32)
    for i, r in enumerate(rows):
        x[: len(r), i], mask[: len(r), i] = r, 1
    return x, mask
