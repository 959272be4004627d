"""SentencePiece encoding and decoding: best segmentation by a max-plus scan over chunks."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters of a chunk; longer texts are split, so that no task holds a path over more.
CHUNK = 32_768
# Segments that a task remembers, and texts of one result batch.
REMEMBERED, TEXTS = 200_000, 500
NEVER = -(1 << 60)
SPACE = "▁"


def ship_model(spark: SparkSession, path: str) -> str:
    """Make a model file known to all executors; returns its name."""
    spark.sparkContext.addFile(path)
    return Path(path).name


class Vocabulary:
    """Pieces and whole-number scores of a model; characters outside it fall back to byte pieces."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.text)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model needs byte pieces")
        self.score = {self.text[i]: (round(sp.get_score(i) * 64), i) for i in plain}
        self.longest = max(len(t) for t in self.score)
        # a byte costs more than any ordinary piece
        self.byte_score = min((s for s, _ in self.score.values() if s > -(1 << 32)), default=0) - 640
        if any(SPACE in t.strip(SPACE) or (t.endswith(SPACE) and t.strip(SPACE)) for t in self.score):
            raise ValueError("a piece goes over a word's start")
        self.worth = np.full(len(self.text), self.byte_score, np.int64)
        for w, i in self.score.values():
            self.worth[i] = w
        # a character of no longer piece stands alone, as a literal space mark does
        alone = [c for c in "\n" if not any(c in t and len(t) > 1 for t in self.score)]
        stop = re.escape("".join(alone) + SPACE)
        self.segments = re.compile(f" +[^ {stop}]*|[^ {stop}]+|[{stop}]")
        # pieces as a tree: by character the score and number of the piece that ends there (or None) and what follows
        self.root: dict = {}
        for t, (w, i) in sorted(self.score.items()):
            kids = self.root
            for c in t[:-1]:
                kids = kids.setdefault(c, (None, 0, {}))[2]
            kids[t[-1]] = (w, i, kids[t[-1]][2] if t[-1] in kids else {})
        self.raw = [bytes([int(t[3:5], 16)]) if i in set(self.byte.values()) else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]

    @classmethod
    def of(cls, name: str) -> Vocabulary:
        path = SparkFiles.get(name)
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def ids(self, s: str) -> list[int]:
        hit = self.score.get(s)
        return [hit[1]] if hit is not None else [self.byte[b] for b in s.encode()]

    def best(self, s: str, size: int, entry: dict[int, int]) -> tuple[list[int], list[int]]:
        """Best score to each place, over pieces that start before ``size``, from the places of ``entry`` with their scores; and the piece's start (-1: entry)."""
        score, back = [NEVER] * (size + self.longest), [-1] * (size + self.longest)
        for a, v in entry.items():
            score[a] = v
        n, root = len(s), self.root
        for p in range(size):
            v = score[p]
            if v == NEVER:
                continue
            hit = root.get(s[p])
            if hit is None or hit[0] is None:
                w = v + self.byte_score * len(s[p].encode())
                if w > score[p + 1]:
                    score[p + 1], back[p + 1] = w, p
            q = p
            while hit is not None:
                q += 1
                w, _, kids = hit
                if w is not None and v + w > score[q]:
                    score[q], back[q] = v + w, p
                if q == n:
                    break
                hit = kids.get(s[q])
        return score, back

    def whole(self, s: str) -> bytes:
        """Pieces (32-bit numbers) of the best path over all of ``s``: :meth:`best` for this most frequent case."""
        n, root = len(s), self.root
        score, back, piece = [NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0
        for p in range(n):
            v = score[p]
            hit = root.get(s[p])
            q = p + 1
            if hit is None or hit[0] is None:
                w = v + self.byte_score * len(s[p].encode())
                if w > score[q]:
                    score[q], back[q], piece[q] = w, p, -1
                if hit is None:
                    continue
            for c in s[q:]:
                w, i, kids = hit
                if w is not None and (w := v + w) > score[q]:
                    score[q], back[q], piece[q] = w, p, i
                hit = kids.get(c)
                if hit is None:
                    break
                q += 1
            else:
                w, i, kids = hit
                if w is not None and (w := v + w) > score[q]:
                    score[q], back[q], piece[q] = w, p, i
        out, q = [], n
        while q:
            p = back[q]
            if piece[q] >= 0:
                out.append(piece[q])
            else:
                out.extend(self.byte[b] for b in reversed(s[p].encode()))
            q = p
        out.reverse()
        return array("i", out).tobytes()

    def path(self, s: str, size: int, a: int, b: int) -> tuple[int, list[int]]:
        """Score and pieces of the best path from place ``a`` to place ``b``."""
        score, back = self.best(s, size, {a: 0})
        out, q = [], b
        while q > a:
            p = back[q]
            out.append(self.ids(s[p:q]))
            q = p
        return score[b], [i for part in reversed(out) for i in part]


class Encoder:
    """Segments between places that no piece goes over are solved once and remembered."""

    def __init__(self, name: str):
        self.v, self.known = Vocabulary.of(name), {}

    def segment(self, s: str) -> bytes:
        """Pieces (32-bit numbers) of a whole segment."""
        hit = self.known.get(s)
        if hit is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            hit = self.known[s] = array("i", self.v.ids("\0" + SPACE)[1:]).tobytes() if s == SPACE else self.v.whole(s.replace(" ", SPACE))
        return hit

    def parts(self, chunk: str, size: int) -> tuple[list[str], str]:
        """Segments of the chunk's own characters, and what the last one reads ahead."""
        return self.v.segments.findall(chunk[:size]), chunk[size:]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.segment, self.v.segments.findall(" " + text))) if text else b""

    def _ahead(self, last: str, rest: str) -> str:
        """What may follow ``last`` inside a piece, as far as the next place that none goes over."""
        if last == SPACE:
            return ""
        m = self.v.segments.match(last + rest)
        return (last + rest)[len(last):m.end()][:self.v.longest - 1]

    def transfer(self, chunk: str, size: int) -> np.ndarray:
        """Best scores from each entry state to each exit state; a state is how far a piece reaches over the chunk's edge."""
        m = self.v.longest
        out = np.full((m, m), NEVER, np.int64)
        parts, rest = self.parts(chunk, size)
        first, last = parts[0], parts[-1]
        ahead = self._ahead(last, rest)

        def row(s: str, more: str, a: int, target: int) -> list[int]:
            if s == SPACE:
                return [self.v.byte_score * 3 if a == 0 else 0] if a <= 1 else [NEVER]
            t = (s + more).replace(" ", SPACE)
            return self.v.best(t, len(s), {a: 0})[0][len(s):len(s) + target]

        if len(parts) == 1:
            for a in range(min(m, size + 1)):
                got = row(first, ahead, a, 1 + len(ahead))
                out[a, :len(got)] = got
            return out
        middle = int(self.v.worth[np.frombuffer(b"".join(map(self.segment, parts[1:-1])), np.int32)].sum())
        end = np.array(row(last, ahead, 0, 1 + len(ahead)), dtype=np.int64)
        for a in range(min(m, len(first) + 1)):
            head = row(first, "", a, 1)[0]
            if head > NEVER:
                out[a, :len(end)] = np.where(end > NEVER, head + middle + end, NEVER)
        return out

    def trace(self, chunk: str, size: int, a: int, b: int) -> bytes:
        """Pieces that start in the chunk, from entry state ``a`` to exit state ``b``."""
        parts, rest = self.parts(chunk, size)
        first, last = parts[0], parts[-1]

        def walk(s: str, more: str, a: int, b: int) -> bytes:
            if s == SPACE:
                return self.segment(s) if a == 0 else b""
            t = (s + more).replace(" ", SPACE)
            return array("i", self.v.path(t, len(s), a, len(s) + b)[1]).tobytes()

        if len(parts) == 1:
            return walk(first, self._ahead(last, rest), a, b)
        return b"".join([walk(first, "", a, 0), *map(self.segment, parts[1:-1]), walk(last, self._ahead(last, rest), 0, b)])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``TEXTS`` rows at most: pieces take far more room than the text."""
    for x in batches:
        for a in range(0, x.num_rows, TEXTS):
            yield x.slice(a, TEXTS)


def _lists(blobs: list[bytes]) -> pa.Array:
    """Packed 32-bit numbers as an array of lists."""
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def combined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of transfer matrices; associative."""
    out = np.full(x.shape, NEVER, np.int64)
    for k in range(x.shape[-1]):
        np.maximum(out, x[..., :, k, None] + y[..., None, k, :], out=out)
    return np.maximum(out, NEVER)


def boundary_states(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and exit state of each chunk on the best path from state 0 to state 0.

    Prefix products by doubling give every chunk's entry scores; from the end,
    each chunk then takes its best entry for its exit, the larger state at a tie.
    """
    n, m = len(t), t.shape[1]
    prefix, step = t.copy(), 1
    while step < n:
        prefix[step:] = combined(prefix[:-step].copy(), prefix[step:])
        step *= 2
    entry, exit_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = 0
    for k in range(n - 1, -1, -1):
        exit_[k] = at
        alpha = prefix[k - 1, 0] if k else np.where(np.arange(m) == 0, 0, NEVER)
        total = alpha + t[k, :, at]
        at = m - 1 - int(np.argmax(total[::-1]))
        entry[k] = at
    return entry, exit_


def _texts(raw: list[bytes], lists: pa.Array) -> list[str]:
    """The texts of lists of pieces; null lists give empty texts."""
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
    return [b"".join(map(raw.__getitem__, values[a:b].tolist())).decode()[1:] if ok else "" for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, checked: bool = False) -> DataFrame:
    """``(id, th, pieces)`` for each row: the segmentation with the greatest sum of piece scores; ``th`` is a hash of the text.

    The text is marked as the model's library marks it: a space in front, spaces
    as U+2581; a literal U+2581 and characters without a piece become byte
    pieces, so decoding is exact. At equal scores the longer last piece wins, at a
    chunk's edge the longer piece over it. Texts up to ``chunk`` characters are
    solved where they are read. Longer ones are split: every chunk gives a transfer
    matrix between its boundary states, the matrices are combined, each chunk is
    traced on its own, and the pieces meet by text. Null and empty texts have no pieces; repeated
    rows are encoded alike; null ids are kept; an empty table gives no rows. Other columns are ignored.
    With ``checked`` also ``round_trip``, whether the pieces decode to the text: texts that are solved
    where they are read are decoded there too, so a task has one Python worker, not one for either step.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    kind = src.schema["id"].dataType.simpleString()
    short, long_ = src.where(F.length("text") <= chunk), src.where(F.length("text") > chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(model)
        for x in _small(batches):
            out = _lists([e.encode(s.as_py()) for s in x.column("text")])
            made = [x.column("id"), x.column("th"), out]
            if checked:
                made.append(pa.array([s.as_py() == t for s, t in zip(x.column("text"), _texts(e.v.raw, out), strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(made, ["id", "th", "pieces", "round_trip"][:len(made)])

    reach = 64  # read ahead beyond a chunk; no piece is longer
    full = F.concat(F.lit(" "), F.col("text"))
    n = F.ceil(F.length(full) / F.lit(chunk)).cast("int")
    chunks = long_.dropDuplicates(["id", "th"]).select("id", "th", full.alias("full"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    chunks = chunks.select("id", "th", "k", F.substring("full", F.col("k") * chunk + 1, F.lit(chunk + reach)).alias("s"), F.least(F.lit(chunk), F.length("full") - F.col("k") * chunk).alias("size"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(model)
        for x in batches:
            out = [e.transfer(s, n).ravel() for s, n in zip(x.column("s").to_pylist(), x.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("th"), x.column("k"), pa.array(out, pa.list_(pa.int64()))], ["id", "th", "k", "t"])

    def scan(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        flat = t.column("t").combine_chunks().flatten().to_numpy()
        m = int(round((len(flat) / t.num_rows) ** 0.5))
        a, b = boundary_states(flat.reshape(t.num_rows, m, m))
        return pa.table({"id": t.column("id"), "th": t.column("th"), "k": t.column("k"), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())})

    steps = chunks.mapInArrow(matrices, f"id {kind}, th long, k int, t array<long>")
    states = steps.groupBy("id", "th").applyInArrow(scan, f"id {kind}, th long, k int, a int, b int").toDF("id2", "th2", "k2", "a", "b")
    both = chunks.join(states, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")) & (F.col("k") == F.col("k2")))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(model)
        for x in _small(batches):
            s, n, a, b = (x.column(c).to_pylist() for c in ("s", "size", "a", "b"))
            out = [e.trace(*r) for r in zip(s, n, a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("th"), x.column("k"), _lists(out)], ["id", "th", "k", "pieces"])

    parts = both.select("id", "th", "k", "s", "size", "a", "b").mapInArrow(traced, f"id {kind}, th long, k int, pieces array<int>")
    joined = parts.groupBy("id", "th").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "pieces"))), lambda x: x["pieces"])).alias("pieces"))
    joined = joined.toDF("id2", "th2", "pieces")
    rows = long_.select("id", "th").join(joined, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))).select("id", "th", "pieces")
    if checked:
        rows = decode(rows, model).select("id", "th", "pieces", (F.xxhash64("decoded") == F.col("th")).alias("round_trip"))
    return short.mapInArrow(whole, f"id {kind}, th long, pieces array<int>" + ", round_trip boolean" * checked).unionAll(rows)


def decode(encoded: DataFrame, model: str, pieces_col: str = "pieces") -> DataFrame:
    """The rows with ``decoded``, the text of the pieces; null pieces give an empty text."""
    at = [f.name for f in encoded.schema.fields].index(pieces_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded") + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = Vocabulary.of(model).raw
        for x in _small(batches):
            out = _texts(raw, x.column(at))
            kept = [(n, c) for n, c in zip(x.schema.names, x.columns, strict=True) if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(out, pa.string())], [*(n for n, _ in kept), "decoded"])

    return encoded.mapInArrow(run, schema)
