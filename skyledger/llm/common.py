"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it; there a temporary folder serves, while a cluster without it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "skyledger-checkpoints")
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of this run's own that nothing reads any more, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: lineage is cut and a lost executor costs nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    """Number of words of a text (null: 0), counted by starts of words without materialising them."""
    t = text_of(col)
    return (F.length(F.regexp_replace(t, WORD, "x")) - F.length(F.regexp_replace(t, WORD, ""))).cast("long")


# --- vectorised words over Arrow string batches ---------------------------------------------

_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}

#: What a byte is: 0 is dropped, 1 separates words, 2 belongs to one.
RAW_BYTES = np.full(256, 2, np.uint8)
RAW_BYTES[[0x20, 9, 10, 11, 12, 13]] = 1
#: For near-duplicates ASCII punctuation is dropped as well.
PLAIN_BYTES = RAW_BYTES.copy()
PLAIN_BYTES[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0


#: Words of more bytes are hashed one by one; the mask of a chunk of so many bytes.
_LONG = 64
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        n = max(n, 1 << 20)
        for key, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[key] = np.multiply.accumulate(row)
    return _POWERS["p"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hash_words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = RAW_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 texts that lie end to end in data, and where each text's words begin. Each 8 bytes of a word are mixed in turn, so no two words collide by their pattern.

    offsets: the texts' byte bounds, relative to data; the result's second array has as many entries.
    """
    kind = kinds[data]
    keep = kind != 0
    if not keep.all():
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        data, kind = data[keep], kind[keep]
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = kind == 2
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | new[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | new[1:])) + 1
    size = ends - starts
    eight = np.ndarray((n + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))
    h = mix(size.astype(np.uint64) * np.uint64(_P))
    at = np.arange(len(starts))
    for step in range(_LONG // 8):
        if step:
            at = at[size[at] > 8 * step]
            if not len(at):
                break
        left = size[at] - 8 * step
        h[at] = mix((h[at] ^ (eight[starts[at] + 8 * step] & _MASKS[np.minimum(left, 8)])) * np.uint64(_Q))
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(_Q) + words[j : j + n]
    return mix(h)


def text_chunks(column, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, relative offsets) of an Arrow string array, of about limit bytes; a longer text stands alone. Nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, bounds, body = column.buffers()
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
