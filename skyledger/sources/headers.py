"""Sizes of images and metadata of videos from their headers: files are listed by Spark, and each task reads the few bytes that say it, never pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.names import IMAGES, VIDEOS

SCHEMA = "path string, length long, kind string, width int, height int, frames long, duration_s double, fps double, reason string"


class Unreadable(ValueError):
    """Why a header tells nothing."""


def _take(f: BinaryIO, n: int) -> bytes:
    found = f.read(n)
    if len(found) < n:
        raise Unreadable("cut short")
    return found


def _numbers(f: BinaryIO, form: str) -> tuple:
    return struct.unpack(form, _take(f, struct.calcsize(form)))


# --- images -----------------------------------------------------------------------------------


def _jpeg(f: BinaryIO) -> tuple[int, int]:
    """Segments up to the start of a frame; all of these markers but those for tables and arithmetic settings are one."""
    while True:
        byte = _take(f, 1)[0]
        if byte != 0xFF:
            raise Unreadable("no marker where one should be")
        while byte == 0xFF:  # markers may be filled up
            byte = _take(f, 1)[0]
        if byte == 0xD9 or byte == 0xDA:
            raise Unreadable("no frame before the data")
        if 0xD0 <= byte <= 0xD8 or byte == 0x01:
            continue
        (size,) = _numbers(f, ">H")
        if 0xC0 <= byte <= 0xCF and byte not in (0xC4, 0xC8, 0xCC):
            _, height, width = _numbers(f, ">BHH")
            return width, height
        f.seek(size - 2, 1)


def _webp(f: BinaryIO) -> tuple[int, int]:
    f.seek(12)
    chunk = _take(f, 4)
    f.seek(20)
    if chunk == b"VP8X":
        _take(f, 4)
        w, h = (int.from_bytes(_take(f, 3), "little") + 1 for _ in range(2))
        return w, h
    if chunk == b"VP8L":
        if _take(f, 1) != b"\x2f":
            raise Unreadable("no lossless signature")
        (bits,) = _numbers(f, "<I")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if chunk == b"VP8 ":
        if _take(f, 6)[3:] != b"\x9d\x01\x2a":
            raise Unreadable("no key frame")
        w, h = _numbers(f, "<HH")
        return w & 0x3FFF, h & 0x3FFF
    raise Unreadable("unknown chunk")


def _tiff(f: BinaryIO, order: str) -> tuple[int, int]:
    (at,) = _numbers(f, order + "I")
    f.seek(at)
    found = {}
    for _ in range(_numbers(f, order + "H")[0]):
        tag, kind, _count, raw = _numbers(f, order + "HHI4s")
        if tag in (256, 257):
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), raw[:2] if kind == 3 else raw)[0]
    if len(found) < 2:
        raise Unreadable("no size in the first directory")
    return found[256], found[257]


def image_size(f: BinaryIO) -> tuple[str, int, int]:
    """(kind, width, height) of an open image."""
    head = _take(f, 8)
    if head == b"\x89PNG\r\n\x1a\n":
        length, name, w, h = _numbers(f, ">I4sII")
        if name != b"IHDR":
            raise Unreadable("no header chunk")
        return "png", w, h
    if head[:2] == b"\xff\xd8":
        f.seek(2)
        return "jpeg", *_jpeg(f)
    if head[:2] == b"BM":
        f.seek(14)
        (size,) = _numbers(f, "<I")
        w, h = _numbers(f, "<HH") if size == 12 else _numbers(f, "<ii")
        return "bmp", w, abs(h)
    if head[:4] == b"RIFF" and f.read(4) == b"WEBP":
        return "webp", *_webp(f)
    if head[:4] in (b"II*\0", b"MM\0*"):
        f.seek(4)
        return "tiff", *_tiff(f, "<" if head[:1] == b"I" else ">")
    raise Unreadable("unknown image")


# --- videos -----------------------------------------------------------------------------------

#: Boxes that hold boxes which matter here.
_HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")


def _boxes(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the boxes between two places; only their heads are read."""
    while at + 8 <= end:
        f.seek(at)
        size, name = _numbers(f, ">I4s")
        head = 8
        if size == 1:
            (size,), head = _numbers(f, ">Q"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Unreadable(f"box {name.decode('latin-1')} leaves its holder")
        yield name, at + head, at + size
        at += size


def _clock(f: BinaryIO, begin: int) -> tuple[int, int]:
    """(ticks a second, ticks) of a movie's or track's header."""
    f.seek(begin)
    if _take(f, 4)[0] == 1:
        _, _, scale, ticks = _numbers(f, ">QQIQ")
        return scale, ticks if ticks != 0xFFFFFFFFFFFFFFFF else 0
    _, _, scale, ticks = _numbers(f, ">IIII")
    return scale, ticks if ticks != 0xFFFFFFFF else 0


def _track(f: BinaryIO, begin: int, end: int, track: dict) -> dict:
    for name, b, e in _boxes(f, begin, end):
        if name in _HOLDERS:
            _track(f, b, e, track)
        elif name == b"tkhd":
            # the last eight bytes are the size in 16.16
            f.seek(e - 8)
            track["size"] = tuple(v >> 16 for v in _numbers(f, ">II"))
        elif name == b"mdhd":
            track["scale"], track["ticks"] = _clock(f, b)
        elif name == b"hdlr":
            f.seek(b + 8)
            track["video"] = _take(f, 4) == b"vide"
        elif name == b"stts":
            f.seek(b + 4)
            (entries,) = _numbers(f, ">I")
            if 8 * entries > e - b - 8:
                raise Unreadable("table of times leaves its box")
            frames = 0
            while entries:
                part = min(entries, 8192)
                frames += sum(struct.unpack(f">{2 * part}I", _take(f, 8 * part))[::2])
                entries -= part
            track["frames"] = frames
    return track


def _movie(f: BinaryIO, length: int) -> tuple:
    for name, begin, end in _boxes(f, 0, length):
        if name != b"moov":
            continue
        for inner, b, e in _boxes(f, begin, end):
            if inner != b"trak":
                continue
            t = _track(f, b, e, {})
            if t.get("video"):
                seconds = t["ticks"] / t["scale"] if t.get("scale") else 0.0
                frames = t.get("frames", 0)
                return "mp4", *t.get("size", (None, None)), frames, seconds, frames / seconds if seconds > 0 else None
        raise Unreadable("no video track")
    raise Unreadable("no movie box")


def _avi(f: BinaryIO) -> tuple:
    f.seek(12)
    name, _, kind, inner, size = _numbers(f, "<4sI4s4sI")
    if (name, kind, inner) != (b"LIST", b"hdrl", b"avih") or size < 40:
        raise Unreadable("no main header")
    micros, _, _, _, frames, _, _, _, w, h = _numbers(f, "<10I")
    return "avi", w, h, frames, frames * micros / 1e6, 1e6 / micros if micros else None


def video_metadata(f: BinaryIO, length: int) -> tuple:
    """(kind, width, height, frames, seconds, frames a second) of an open video."""
    head = _take(f, 12)
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
        return _movie(f, length)
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return _avi(f)
    raise Unreadable("unknown container")


# --- tables -----------------------------------------------------------------------------------


def media_headers(spark: SparkSession, root: str, files_per_task: int = 512) -> DataFrame:
    """A row per image or video below root (see SCHEMA), by suffix, in any case: its size, for videos frames, seconds and rate too. A file whose header can't be read has a reason and nulls, and stops nothing.

    Spark lists the files, without empty ones, and passes no content; tasks open them where they lie and read heads and the
    boxes on the way to what is asked, some kilobytes each.
    """
    suffix = rf"(?i)\.({'|'.join((*IMAGES, *VIDEOS))})$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length").where(F.col("path").rlike(suffix))
    moving = tuple("." + v for v in VIDEOS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for path, length in zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True):
                kind = w = h = frames = seconds = rate = reason = None
                try:
                    system, inner = fs.FileSystem.from_uri(path)
                    with system.open_input_file(inner) as f:
                        if path.lower().endswith(moving):
                            kind, w, h, frames, seconds, rate = video_metadata(f, length)
                        else:
                            kind, w, h = image_size(f)
                except Unreadable as e:
                    kind = w = h = frames = seconds = rate = None
                    reason = str(e)
                out.append((path, length, kind, w, h, frames, seconds, rate, reason))
            columns = list(zip(*out, strict=True)) or [()] * 9
            types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    # a listing is small beside what is opened, so it is dealt out evenly
    tasks = max(1, min(10_000, -(-files.count() // files_per_task)))
    return files.repartition(max(tasks, 1)).mapInArrow(run, SCHEMA)
