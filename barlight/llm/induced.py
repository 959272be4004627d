"""Suffix sorting by induction, with queues that spill to disk and common prefixes carried along."""

from __future__ import annotations

import tempfile

import numpy as np

# Bytes of queued suffixes that stay in memory; more go to a temporary file of the task.
QUEUE_BYTES = 64 << 20


class BucketQueue:
    """A priority queue of ``(position, common prefix)`` by first token.

    Inside one token, order of arrival is order of suffixes, so each token's part
    is first in, first out. Parts beyond the memory bound are appended to a file
    that vanishes with the task.
    """

    def __init__(self, tokens: int, most: int = QUEUE_BYTES):
        self.parts: list[list] = [[] for _ in range(tokens)]
        self.held, self.most, self.file = 0, most, None

    def put(self, token: int, at: np.ndarray, lcp: np.ndarray) -> None:
        size = at.nbytes + lcp.nbytes
        if self.held + size > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            where = self.file.tell()
            self.file.write(at.tobytes() + lcp.tobytes())
            self.parts[token].append((where, len(at)))
        else:
            self.held += size
            self.parts[token].append((at, lcp))

    def take(self, token: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that waits at ``token``, in order; None if nothing does."""
        parts, self.parts[token] = self.parts[token], []
        if not parts:
            return None
        out = []
        for a, b in parts:
            if isinstance(a, int):
                self.file.seek(a)
                a, b = np.frombuffer(self.file.read(4 * b), np.int32), np.frombuffer(self.file.read(b), np.uint8)
            else:
                self.held -= a.nbytes + b.nbytes
            out.append((a, b))
        return (out[0] if len(out) == 1 else (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])))

    def close(self) -> None:
        if self.file:
            self.file.close()


def _next_index(hit: np.ndarray, after: int) -> np.ndarray:
    """For each place the first hit at or behind it."""
    at = np.where(hit, np.arange(len(hit), dtype=np.int32), np.int32(after))
    return np.minimum.accumulate(at[::-1])[::-1]


def _ranks(values: np.ndarray) -> np.ndarray:
    """Dense ranks of whole numbers."""
    order = np.argsort(values)
    held = values[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
    return rank


def _windows(text: np.ndarray, at: np.ndarray, skip: int) -> np.ndarray:
    """Three tokens from ``at + skip`` in one number, zero past the end. Tokens are below 2**20."""
    out = np.zeros(len(at), np.int64)
    for k in range(3):
        p = at + (skip + k)
        out = out << 21 | np.where(p < len(text), text[np.minimum(p, len(text) - 1)].astype(np.int64) + 1, 0)
    return out


def _sorted_heads(text: np.ndarray, heads: np.ndarray, cap: int) -> np.ndarray:
    """Order of the suffixes at ``heads`` (the leftmost places of rising runs), to a depth of ``cap`` tokens at least.

    The stretch from one head to the next gets a name by its rank; the string of
    names is the smaller problem. It is ranked by doubling: names of 1, 2, 4 ...
    stretches, which cover at least twice as many tokens.
    """
    if not len(heads):
        return heads
    size = np.diff(np.append(heads, len(text) - 1)) + 1
    n = len(heads)
    rank = _ranks(_windows(text, heads, 0))
    skip = 3
    while skip < cap + 3:
        live = np.flatnonzero((np.bincount(rank)[rank] > 1) & (size > skip))
        if not len(live):
            break
        step = np.zeros(n, np.int64)
        step[live] = _ranks(_windows(text, heads[live], skip)) + 1
        rank = _ranks(rank * (len(live) + 1) + step)
        skip += 3
    names, step = rank, 1
    while step <= cap and int(names.max()) < n - 1:
        later = np.concatenate([names[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
        names = _ranks(names * (n + 1) + later)
        step *= 2
    return np.argsort(names, kind="stable")


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Equal tokens from ``a`` and ``b`` on, ``cap`` at most."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero((a < len(text)) & (b < len(text)))
    for depth in range(cap):
        p, q = a[live] + depth, b[live] + depth
        inside = (p < len(text)) & (q < len(text))
        live = live[inside][text[p[inside]] == text[q[inside]]]
        if not len(live):
            break
        out[live] = depth + 1
    return out


def _push(queue: BucketQueue, least: np.ndarray, targets: np.ndarray, at: np.ndarray, lcp: np.ndarray, wanted: np.ndarray, cap: int) -> None:
    """Queue the predecessors ``at`` (where ``wanted``) by their token, each with one more than the least prefix since its token's last one.

    ``lcp`` is of each scanned suffix with the one scanned before; ``least`` holds,
    for each token, the least since something was queued at it.
    """
    low = int(lcp.min(initial=cap))
    idx = np.flatnonzero(wanted)
    order = idx[np.argsort(targets[idx], kind="stable")]
    t = targets[order]
    before = least.copy()
    np.minimum(least, low, out=least)
    if not len(t):
        return
    cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        token, here = int(t[a]), order[a:b]
        mins = np.minimum.reduceat(lcp, np.concatenate([[0], here[:-1] + 1]))
        # the last stretch runs to the end of the scan; what follows the last queued one is for later
        mins[-1] = lcp[(here[-2] + 1 if len(here) > 1 else 0):here[-1] + 1].min()
        mins[0] = min(int(mins[0]), int(before[token]))
        tail = lcp[here[-1] + 1:]
        least[token] = tail.min() if len(tail) else cap
        queue.put(token, at[here], np.minimum(mins.astype(np.int64) + 1, cap).astype(np.uint8))


def suffix_order(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """``(positions in order, equal tokens with the one before)``, both to a depth of ``cap`` (255 at most).

    Heads of rising runs are sorted first; a scan upwards then induces the falling
    suffixes from them, a scan downwards the rising ones, each through a queue.
    Every suffix brings its common prefix with its neighbour from its successor's.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    text = text.astype(np.int32)
    step = np.sign(np.diff(text))
    turn = _next_index(np.append(step != 0, True), n - 1)
    falling = np.append(step, -1)[turn] < 0  # the end counts as smallest
    run = np.minimum(turn - np.arange(n) + 1, cap)
    head = np.zeros(n, bool)
    head[1:] = ~falling[1:] & falling[:-1]
    heads = np.flatnonzero(head)
    heads = heads[_sorted_heads(2 * text + ~falling, heads, cap)]  # of equal tokens a falling one comes first
    with_prior = np.zeros(len(heads), np.uint8)
    with_prior[1:] = common_prefixes(text, heads[:-1], heads[1:], cap)
    tokens = int(text.max()) + 1
    head_cut = np.searchsorted(text[heads], np.arange(tokens + 1))

    def between(a: int, b: int) -> int:
        return int(min(run[a], run[b]))  # a falling and a rising suffix of one token part where the shorter run ends

    up, down = BucketQueue(tokens), BucketQueue(tokens)
    least = np.zeros(tokens, np.int64)
    up.put(int(text[n - 1]), np.array([n - 1], np.int32), np.zeros(1, np.uint8))
    fall: list[tuple[np.ndarray, np.ndarray] | None] = [None] * tokens
    for c in range(tokens):
        parts, last = [], None
        while (got := up.take(c)) is not None:
            at, lcp = got
            lcp = lcp.copy()
            if last is None:
                lcp[0] = 0
            parts.append((at, lcp))
            last = int(at[-1])
            prev = np.maximum(at - 1, 0)
            _push(up, least, text[prev], prev, lcp, (at > 0) & falling[prev], cap)
        if parts:
            fall[c] = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        a, b = head_cut[c], head_cut[c + 1]
        if b > a:
            at, lcp = heads[a:b].astype(np.int32), with_prior[a:b].copy()
            lcp[0] = between(last, int(at[0])) if last is not None else 0
            prev = at - 1
            _push(up, least, text[prev], prev, lcp, np.ones(len(at), bool), cap)
    up.close()
    least = np.zeros(tokens, np.int64)
    out_at, out_lcp = [], []
    for c in range(tokens - 1, -1, -1):
        parts, last = [], None
        while (got := down.take(c)) is not None:
            at, lcp = got
            lcp = lcp.copy()
            if last is None:
                lcp[0] = 0
            parts.append((at, lcp))
            last = int(at[-1])
            prev = np.maximum(at - 1, 0)
            _push(down, least, text[prev], prev, lcp, (at > 0) & ~falling[prev], cap)
        rising = (np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])) if parts else None
        if fall[c] is not None:
            at, lcp = fall[c]
            back = np.empty_like(lcp)  # scanned downwards, each with the one above it
            back[1:] = lcp[:0:-1]
            back[0] = between(int(at[-1]), last) if last is not None else 0
            at = at[::-1]
            prev = np.maximum(at - 1, 0)
            _push(down, least, text[prev], prev, back, (at > 0) & ~falling[prev], cap)
        if rising is not None:
            at, lcp = rising
            fore = np.empty_like(lcp)
            fore[1:] = lcp[:0:-1]
            fore[0] = between(int(fall[c][0][-1]), last) if fall[c] is not None else 0
            out_at.append(at[::-1])
            out_lcp.append(fore)
        if fall[c] is not None:
            out_at.append(fall[c][0])
            out_lcp.append(fall[c][1])
            fall[c] = None
    down.close()
    return np.concatenate(out_at[::-1]), np.concatenate(out_lcp[::-1])
