"""Linear-chain conditional random field in numpy: forward-backward over many sequences at once, and its gradient.

Sequences are laid out step by step, longest first, so one step of all sequences that are still running is one small
matrix product. Messages are scaled to sum to 1, so long sequences neither underflow nor need logarithms.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """The order of the positions of sequences (by their lengths) in which the steps go."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        by = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.order = np.lexsort((rank[owner], step))
        active = np.bincount(step) if len(step) else np.zeros(0, np.int64)
        self.ends = np.cumsum(active).tolist()
        self.active = active.tolist()


def marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, expected: bool = False):
    """(P(label) of each position, log-likelihood's partition terms, expected transitions).

    ``emit`` (positions x labels) and ``trans`` (labels x labels) are scores. The second result is the sum of log Z; it and
    the third are None unless ``expected``.
    """
    lay = Layout(lengths)
    top = emit.max(1, keepdims=True) if len(emit) else emit[:, :1]
    e = np.exp(emit - top)[lay.order]
    t_max = trans.max()
    tr = np.exp(trans - t_max)
    a, b = np.empty_like(e), np.ones_like(e)
    log_z = 0.0
    begin = 0
    for k, (n, end) in enumerate(zip(lay.active, lay.ends, strict=True)):
        cur = e[begin:end] if k == 0 else (a[before : before + n] @ tr) * e[begin:end]
        s = cur.sum(1, keepdims=True)
        a[begin:end] = cur / s
        if expected:
            log_z += np.log(s).sum()
        before, begin = begin, end
    pairs = np.zeros_like(tr)
    for k in range(len(lay.active) - 1, 0, -1):
        end, n = lay.ends[k], lay.active[k]
        begin = end - n
        before = begin - lay.active[k - 1]
        right = e[begin:end] * b[begin:end]
        back = right @ tr.T
        if expected:
            z = (a[before : before + n] * back).sum(1, keepdims=True)
            pairs += a[before : before + n].T @ (right / z)
        b[before : before + n] = back / back.sum(1, keepdims=True)
    m = a * b
    m /= m.sum(1, keepdims=True)
    out = np.empty_like(m)
    out[lay.order] = m
    if not expected:
        return out, None, None
    return out, log_z + top.sum() + t_max * (len(emit) - len(lengths)), pairs * tr


def transitions(labels: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """How often each label follows each in the sequences."""
    if len(labels) < 2:
        return np.zeros((n, n))
    inside = np.ones(len(labels), bool)
    ends = np.cumsum(lengths)
    inside[ends[ends < len(labels)]] = False
    inside[0] = False
    at = np.flatnonzero(inside)
    return np.bincount(labels[at - 1] * n + labels[at], minlength=n * n).reshape(n, n).astype(float)
