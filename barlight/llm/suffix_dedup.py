"""Substring de-duplication by suffix order: bytes under a long string that starts earlier are removed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from barlight.llm.induced import suffix_order
from barlight.llm.repeats import Law, Shard, Tokens, cut_repeats


def earlier(shard: Shard) -> list[np.ndarray]:
    """Windows of each distinct stretch (at its first place) that start earlier elsewhere in the shard.

    All suffixes of the shard's text are brought into order by external induced
    sorting; suffixes with ``width`` tokens in common are neighbours, and all but
    the earliest of such a group are repeats.
    """
    width = shard.law.width
    lengths = np.array([len(s) for s in shard.segs], dtype=np.int64)
    at = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()), np.int32)
    body = np.ones(len(text), bool)
    body[at + lengths] = False
    text[body] = np.frombuffer(b"".join(shard.segs), np.uint8).astype(np.int32) + 1
    of = np.repeat(np.arange(len(at)), lengths + 1)
    offset = np.arange(len(text)) - at[of]
    order, common = suffix_order(text, width)
    place = np.where(offset < shard.size[of], shard.first[of] + offset, np.int64(1 << 62))[order]
    group = np.flatnonzero(common < width)
    least = np.repeat(np.minimum.reduceat(place, group), np.diff(np.append(group, len(order)))) if len(group) else place
    hit = np.sort(order[(place > least) & (place < 1 << 62)])
    bounds = np.searchsorted(hit, np.append(at, len(text)))
    return [offset[hit[a:b]] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _finish(t: Tokens, keep: np.ndarray, text: bytes) -> tuple:
    gone = ~keep
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return len(keep), int(gone.sum()), spans, t.kept(keep)


def remove_earlier(docs: DataFrame, width: int = 100, gram: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)``: bytes covered by a ``width``-byte string that also starts earlier are removed.

    Earlier: smaller id, or the same document at a smaller start; strings are judged on the input.
    Nulls, repeated rows, repeated ids and empty tables: see :func:`barlight.llm.repeats.cut_repeats`.
    ``gram`` (a power of two, at most ``width``) is the anchor's length and changes no result.
    """
    return cut_repeats(docs, Law(width, gram, False, True), earlier, _finish, "n_bytes long, n_removed long, n_spans long, kept binary", id_col, text_col)

