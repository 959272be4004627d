"""URL rules in a sorted digest array."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path
from tempfile import mkdtemp

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import ascii_lower

# Most rules an index may hold: 64 million digests are 512 MB, mapped and not read whole.
MOST_RULES = 64_000_000


def url_parts(url) -> tuple:
    """Host and path columns. Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: on to ``? #``; else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def build_index(spark: SparkSession, rules: DataFrame) -> str:
    """Files of the index for rules ``(host, path, verdict)``, shipped to every executor; returns its name.

    The table is sorted by Spark on the 64-bit XXH64 of host + path and streamed
    to the driver, which appends it to four files: digests, ends of the strings,
    strings, verdicts. Rules count as at most ``MOST_RULES``, else it raises. Null
    hosts or paths count as empty, repeated rules as one (block wins).
    """
    from xxhash import xxh64_intdigest

    rule = F.struct(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).alias("rule")
    one = rules.select(rule, (F.col("verdict") == "block").alias("block")).groupBy("rule").agg(F.max("block").alias("block"))
    one = one.select("rule.*", "block", F.xxhash64(F.concat("rule.host", "rule.path")).alias("digest"))
    if one.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    sort = F.col("digest").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    folder = Path(mkdtemp(prefix="spark-")) / f"rules-{uuid.uuid4().hex}"
    folder.mkdir()
    end, lengths = 0, set()
    with open(folder / "digests", "wb") as keys, open(folder / "ends", "wb") as ends, open(folder / "strings", "wb") as strings, open(folder / "blocks", "wb") as blocks:
        for r in one.orderBy(sort, "host", "path").toLocalIterator():
            text = r.host.encode() + b"\0" + r.path.encode()
            keys.write(np.uint64(xxh64_intdigest(r.host + r.path, 42)).tobytes())
            strings.write(text)
            end += len(text)
            ends.write(np.int64(end).tobytes())
            blocks.write(bytes([bool(r.block)]))
            lengths.add(len(r.path))
    np.array(sorted(lengths), dtype=np.int64).tofile(folder / "lengths")
    for f in list(folder.iterdir()):
        f = f.rename(folder / f"{folder.name}-{f.name}")
        spark.sparkContext.addFile(str(f))
    return folder.name


class DigestArray:
    """The mapped index in a task."""

    def __init__(self, name: str):
        def mapped(file: str, kind):
            at = Path(SparkFiles.get(f"{name}-{file}"))
            return np.memmap(at, dtype=kind, mode="r") if at.stat().st_size else np.zeros(0, kind)

        self.keys, self.ends = mapped("digests", np.uint64), mapped("ends", np.int64)
        self.strings, self.blocks = mapped("strings", np.uint8), mapped("blocks", np.uint8)
        self.lengths = mapped("lengths", np.int64).tolist()

    def find(self, digests: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Row of each probe or -1: binary search for all at once, then the stored strings decide, also among equal digests."""
        lo, hi = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        out = np.full(len(digests), -1, dtype=np.int64)
        for i in np.flatnonzero(hi > lo):
            for k in range(lo[i], hi[i]):
                if self.strings[self.ends[k - 1] if k else 0:self.ends[k]].tobytes() == texts[i]:
                    out[i] = k
        return out


def judged(urls: DataFrame, index: str, id_col: str, url_col: str, otherwise: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for each row.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest (host and path together, then host) wins; none: ``otherwise``. Null
    urls and urls without ``://`` have an empty host and path, which no rule but
    one with an empty host fits. Other columns are ignored, repeated rows judged alike.
    """
    host, path = url_parts(F.col(url_col))
    src = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        at = DigestArray(index)
        for x in batches:
            texts, digests, owner, size = [], [], [], []
            for i, (h, p) in enumerate(zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)):
                ends = [p[:n] for n in at.lengths if n <= len(p)]
                while True:
                    for e in ends:
                        texts.append(h.encode() + b"\0" + e.encode())
                        digests.append(xxh64_intdigest(h + e, 42))
                        owner.append(i)
                        size.append((len(h) + len(e)) << 20 | min(len(h), (1 << 20) - 1))
                    dot = h.find(".")
                    if dot < 0:
                        break
                    h = h[dot + 1:]
            row = at.find(np.array(digests, dtype=np.uint64), texts)
            rule, verdict, best = [None] * len(x), [otherwise] * len(x), [-1] * len(x)
            for k in np.flatnonzero(row >= 0).tolist():
                i = owner[k]
                if size[k] > best[i]:
                    best[i], rule[i] = size[k], texts[k].replace(b"\0", b"", 1).decode()
                    verdict[i] = "block" if at.blocks[row[k]] else "allow"
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
