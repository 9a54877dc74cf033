"""Bidirectional gated recurrent layers in numpy, with their gradients.

Arrays are feature-major, ``(features, sequences)``, so that gates are contiguous.
An input is a column of a table ``(3 * hidden, n)``: its share of the three gates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Params = dict[str, np.ndarray]


def _gates(x: np.ndarray, gh: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    rz = x[: 2 * hidden] + gh[: 2 * hidden]
    rz *= 0.5
    np.tanh(rz, out=rz)
    rz *= 0.5
    rz += 0.5
    n = rz[:hidden] * gh[2 * hidden :]
    n += x[2 * hidden :]
    np.tanh(n, out=n)
    return rz, n


def run(table: np.ndarray, u: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, reverse: bool, keep: bool = False):
    """States ``(steps, hidden, n)`` of one direction; ``ids`` and ``mask`` are ``(steps, n)``.

    Where the mask is 0 the state passes unchanged. ``keep`` adds what ``back`` needs.
    """
    steps, n = ids.shape
    hidden = u.shape[1]
    states = np.empty((steps, hidden, n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    x = np.empty((3 * hidden, n), np.float32)
    gh = np.empty((3 * hidden, n), np.float32)
    kept = []
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        np.take(table, ids[t], axis=1, out=x, mode="clip")
        np.matmul(u, h, out=gh)
        rz, cand = _gates(x, gh, hidden)
        if keep:
            kept.append((t, h, rz, cand, gh[2 * hidden :].copy()))
        new = h - cand
        new *= rz[hidden:]
        new += cand
        if mask is not None:
            new -= h
            new *= mask[t]
            new += h
        h = new
        states[t] = h
    return (states, kept) if keep else states


def slide(x: np.ndarray, u: np.ndarray, tap: np.ndarray, steps: int, reverse: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Place and ``tap @ state`` of each step of one direction, over the windows of ``steps`` columns from each column of ``x`` on.

    The last ``steps - 1`` columns start no whole window, and what is yielded for them means nothing.
    What is yielded may be changed, and is good until the next step.
    """
    hidden, n = u.shape[1], x.shape[1]
    size = hidden * n
    # Gates by exp(-a) and candidates by exp(2 a); numpy's tanh takes twice as long as its exp.
    scale = np.repeat(np.float32([-1, -1, 2]), hidden)[:, None]
    one, two = np.array(1, np.float32), np.array(2, np.float32)
    # Row after row in one run: the windows' next columns are the same run one place on.
    run = np.zeros(3 * size + steps, np.float32)
    np.multiply(x, scale, out=run[: 3 * size].reshape(x.shape))
    both = np.concatenate([u * scale, tap])
    seen = np.zeros((len(both), n), np.float32)
    states = np.zeros((hidden, n), np.float32)
    rz, cand = np.empty(2 * size, np.float32), np.empty(size, np.float32)
    r, z, h = rz[:size], rz[size:], states.ravel()
    gates, inputs, tapped = seen.ravel()[: 2 * size], seen.ravel()[2 * size : 3 * size], seen[3 * hidden :]
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        np.add(gates, run[t : t + 2 * size], out=rz)
        np.exp(rz, out=rz)
        np.add(rz, one, out=rz)
        np.divide(inputs, r, out=cand)
        np.add(cand, run[t + 2 * size : t + 3 * size], out=cand)
        np.exp(cand, out=cand)
        np.add(cand, one, out=cand)
        np.divide(two, cand, out=cand)
        np.subtract(one, cand, out=cand)
        np.subtract(h, cand, out=h)
        np.divide(h, z, out=h)
        np.add(h, cand, out=h)
        np.matmul(both, states, out=seen)
        yield t, tapped


def back(u: np.ndarray, mask: np.ndarray | None, kept: list, d_states: np.ndarray):
    """Back through time: gradients of the inputs ``(steps, 3 * hidden, n)`` and of ``u``."""
    hidden = u.shape[1]
    d_x = np.empty((d_states.shape[0], 3 * hidden, d_states.shape[2]), np.float32)
    d_u = np.zeros_like(u)
    d_h = np.zeros(d_states.shape[1:], np.float32)
    for t, before, rz, cand, ghn in reversed(kept):
        d_h = d_h + d_states[t]
        live = d_h * mask[t] if mask is not None else d_h
        passed = d_h - live if mask is not None else 0
        r, z = rz[:hidden], rz[hidden:]
        d_n = live * (1 - z) * (1 - cand * cand)
        d_x[t, :hidden] = d_n * ghn * r * (1 - r)
        d_x[t, hidden : 2 * hidden] = live * (before - cand) * z * (1 - z)
        d_x[t, 2 * hidden :] = d_n
        d_gh = d_x[t].copy()
        d_gh[2 * hidden :] *= r
        d_u += d_gh @ before.T
        d_h = live * z + passed + u.T @ d_gh
    return d_x, d_u


def scatter(d_x: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Sum input gradients ``(steps, features, n)`` by table column."""
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    rows = d_x.transpose(0, 2, 1).reshape(flat.size, -1)[order]
    found, starts = np.unique(flat[order], return_index=True)
    out = np.zeros((size, d_x.shape[1]), np.float32)
    out[found] = np.add.reduceat(rows, starts, axis=0)
    return out.T


class Adam:
    """Step sizes by running moments; changes the parameters in place."""

    def __init__(self, params: Params, rate: float) -> None:
        self.params, self.rate, self.count = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params, scale: float = 1.0) -> None:
        self.count += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-12))
        for k, g in grads.items():
            g = g * clip
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            m, v = self.m[k] / (1 - 0.9**self.count), self.v[k] / (1 - 0.99**self.count)
            self.params[k] -= (scale * self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def init(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[-1]))).astype(np.float32)


def padded(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as ids and mask, both ``(longest, n)``."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    longest = max(int(lengths.max(initial=0)), 1)
    mask = np.arange(longest)[:, None] < lengths
    ids = np.zeros((len(items), longest), np.int64)
    ids[mask.T] = np.frombuffer(b"".join(items), np.uint8)
    return np.ascontiguousarray(ids.T), mask.astype(np.float32)
