"""Substring de-duplication by FM-index: words under a window that occurs anywhere else are removed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from barlight.llm.repeats import Law, Shard, Tokens, cut_repeats


class WaveletTree:
    """Ranks over a sequence of whole numbers, one packed bit row per binary digit (pointerless form)."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.depth = max(1, int(values.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(self.n - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def slot(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` entries' occurrences of each symbol end in the last row; differences of slots are ranks."""
        for k in range(self.depth):
            bit = (symbols >> (self.depth - 1 - k) & 1).astype(bool)
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & mask)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Counts of a pattern in a text of whole numbers by backward search; number 0 ends a stretch and is in no pattern."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        ends = text == 0
        rank = text + int(ends.sum())
        rank[ends] = np.arange(ends.sum())  # each end is a symbol of its own, so suffixes differ soon
        step = 1
        while True:
            order = np.lexsort((np.concatenate([rank[step:], np.full(min(step, n), -1)])[:n], rank))
            a = rank[order]
            b = np.where(order + step < n, rank[np.minimum(order + step, n - 1)], -1)
            new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            step *= 2
        tree = WaveletTree(text[order - 1])
        counts = np.bincount(text, minlength=int(text.max()) + 1)
        symbols = np.arange(len(counts))
        self.tree, self.n = tree, n
        # interval of a symbol's suffixes, less the slot where its occurrences begin
        self.shift = np.cumsum(counts) - counts - tree.slot(symbols, np.zeros(len(counts), np.int64))

    def whole(self, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(lanes, np.int64), np.full(lanes, self.n, np.int64)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        both = self.tree.slot(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        s = self.shift[symbols]
        return both[:len(symbols)] + s, both[len(symbols):] + s


def repeated_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, windows: np.ndarray, width: int) -> list[np.ndarray]:
    """For each stretch ``text[begin:...]`` the offsets of its windows that occur twice or more in the index.

    All stretches are streamed side by side. From the end of a span of windows
    the search goes backward; how far it gets is the matching statistic there.
    A span that matches whole is done at once, and the next one is twice as wide.
    One that falls short at some word settles the windows behind that word and rules
    out those over it and the end; what lies left and right of them goes on as two streams.
    """
    lane, x, y = np.arange(len(begin)), np.zeros(len(begin), np.int64), windows - 1
    more, depth = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    lo, hi = index.whole(len(begin))
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(lane):
        lo, hi = index.extend(text[begin[lane] + x + more + width - 1 - depth], lo, hi)
        depth += 1
        short = hi - lo < 2
        done = ~short & (depth == width + more)
        if not (short | done).any():
            continue
        top, p = x + more, x + more + width - depth  # last window of the span; the word that failed
        deep = short & (depth > width)
        hits += [(lane[done], x[done], top[done]), (lane[deep], p[deep] + 1, top[deep])]
        # a short span leaves windows before it ends on the left, the others on the right
        left_end = np.where(deep, p, top - 1)
        right = np.where(deep, top, np.where(short, p, top)) + 1
        split = short & (left_end >= x)
        fork = split & (right <= y)
        extra = (lane[fork], right[fork], y[fork])
        y = np.where(split, left_end, y)
        x = np.where((short & ~split) | done, right, x)
        more = np.where(done, 2 * more + 1, np.where(split, more // 2, np.where(short, 0, more)))
        again = short | done
        depth = np.where(again, 0, depth)
        lo, hi = np.where(again, 0, lo), np.where(again, index.n, hi)
        live = x <= y
        n = len(extra[0])
        lane, x, y = np.append(lane[live], extra[0]), np.append(x[live], extra[1]), np.append(y[live], extra[2])
        more = np.minimum(np.append(more[live], np.zeros(n, np.int64)), y - x)
        depth, lo, hi = np.append(depth[live], np.zeros(n, np.int64)), np.append(lo[live], np.zeros(n, np.int64)), np.append(hi[live], np.full(n, index.n))
    marks: list[list[int]] = [[] for _ in begin]
    for who, a, b in hits:
        for i, p, q in zip(who.tolist(), a.tolist(), b.tolist(), strict=True):
            marks[i].extend(range(p, q + 1))
    return [np.array(sorted(m), dtype=np.int64) for m in marks]


def elsewhere(shard: Shard) -> list[np.ndarray]:
    """Windows of each distinct stretch that occur in the shard's index twice or more; stretches at two places need no search."""
    seen: dict[bytes, int] = {}
    lists = [s.split() for s in shard.segs]
    lengths = np.array([len(w) for w in lists], dtype=np.int64)
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    at = np.cumsum(lengths + 1) - lengths - 1
    body = np.ones(len(text), bool)
    body[at + lengths] = False
    text[body] = [seen.setdefault(w, len(seen) + 1) for ws in lists for w in ws]
    out = [np.zeros(0, np.int64)] * len(lists)
    single = np.flatnonzero(shard.first == shard.last)
    if len(single):
        for d, hit in zip(single.tolist(), repeated_windows(FMIndex(text), text, at[single], shard.size[single], shard.law.width), strict=True):
            out[d] = hit
    return out


def _finish(t: Tokens, keep: np.ndarray, text: bytes) -> tuple:
    return len(keep), int(len(keep) - keep.sum()), t.kept(keep).decode()


def remove_repeated(docs: DataFrame, width: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)``: words covered by a window of ``width`` words that also starts anywhere else are removed.

    Words are runs of bytes other than ASCII white space; ``kept`` joins the rest by single spaces.
    Nulls, repeated rows, repeated ids and empty tables: see :func:`barlight.llm.repeats.cut_repeats`.
    ``gram`` (a power of two, at most ``width``) is the anchor's length and changes no result.
    """
    return cut_repeats(docs, Law(width, gram, True, False), elsewhere, _finish, "n_words long, n_removed long, kept string", id_col, text_col)


def without_repeats(docs: DataFrame, width: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with what :func:`remove_repeated` keeps as text; a text without repeats stays as it is."""
    from pyspark.sql import functions as F

    def finish(t: Tokens, keep: np.ndarray, text: bytes) -> tuple:
        return (text if keep.all() else t.kept(keep)).decode(), int(len(keep) - keep.sum())

    out = cut_repeats(docs, Law(width, gram, True, False), elsewhere, finish, "kept string, n_removed long", id_col, text_col, carry=True)
    at = {c: F.col("row")[c] for c in docs.columns if c != text_col}
    return out.select(*[(F.col("kept") if c == text_col else at[c]).alias(c) for c in docs.columns])
