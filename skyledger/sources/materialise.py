"""Builds on disk: images under their global names, tiles cut from them, labels beside them. Files are a data sink of their own, format("files"), which a job either fills whole or leaves as it was."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from skyledger.operators.shapes import with_tiles

_STAGING = "_staging"


# --- the sink ---------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """What a task says of its work: its own folder, and how many files and bytes lie in it."""

    folder: str
    files: int
    bytes: int


def _safe(name: str) -> str:
    parts = name.split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in parts) or parts[0].startswith("_"):
        raise ValueError(f"no name below the folder: {name!r}")
    return name


class FileWriter(DataSourceWriter):
    """Tasks write into a folder of their own; only the job's commit moves files to their names, so a task that fails or runs twice leaves nothing, and a job that fails leaves all as it was. Names that are there already are replaced."""

    def __init__(self, options):
        self.root, self.job = options["path"], uuid.uuid4().hex

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def write(self, rows: Iterator[Row]) -> Written:
        system, base = self._system()
        folder, files, size, made = f"{_STAGING}/{self.job}/{uuid.uuid4().hex}", 0, 0, set()
        system.create_dir(f"{base}/{folder}", recursive=True)
        for row in rows:
            name = _safe(row.name)
            above = name.rpartition("/")[0]
            if above not in made:
                system.create_dir(f"{base}/{folder}/{above}", recursive=True)
                made.add(above)
            with system.open_output_stream(f"{base}/{folder}/{name}") as f:
                f.write(row.content or b"")
            files, size = files + 1, size + len(row.content or b"")
        return Written(folder, files, size)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, base = self._system()
        for m in messages:
            if m is None or not m.files:
                continue
            own = f"{base}/{m.folder}"
            for f in system.get_file_info(fs.FileSelector(own, recursive=True)):
                if f.is_file:
                    # one move of a name each; no content passes the driver
                    to = f"{base}/{f.path[f.path.index(m.folder) + len(m.folder) + 1 :]}"
                    system.create_dir(to.rpartition("/")[0], recursive=True)
                    system.move(f.path, to)
        self._clear()
        with system.open_output_stream(f"{base}/_SUCCESS") as f:
            f.write(f"{sum(m.files for m in messages if m)} files, {sum(m.bytes for m in messages if m)} bytes\n".encode())

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, base = self._system()
        if system.get_file_info(f"{base}/{_STAGING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{_STAGING}/{self.job}")


class FileSink(DataSource):
    """Option: path, a folder or a file system's URI of one. Rows are (name, content); names lie below the path."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return FileWriter(self.options)


def write_files(files: DataFrame, root: str) -> None:
    """files (name, content) below root. Of rows of one name one is written."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", "content").dropDuplicates(["name"]).write.format("files").mode("append").save(root)


# --- images and tiles -------------------------------------------------------------------------


def png(image: np.ndarray) -> bytes:
    """BGR, BGRA or grey pixels as a PNG."""
    h, w, c = image.shape
    order = image[..., {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[c]]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(order).reshape(h, w * c)], axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def tile_name(stem, tile):
    return F.format_string("%s_t%03d", stem, tile.cast("int"))


def tile_files(images: DataFrame, size: int = 640, overlap: float = 0.25) -> DataFrame:
    """images (stem, data, width, height, nChannels: decoded, as Spark's image source gives them) -> files (name, content): a PNG per window, images/<stem>_t<tile>.png. An image's pixels go to one task once, whatever the number of its windows."""
    windows = with_tiles(images.select("stem", "width", "height"), size, overlap).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("tile", "tx", "ty", "tw", "th"))).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
                names = [f"images/{row['stem']}_t{w['tile']:03d}.png" for w in row["windows"]]
                cut = [png(image[w["ty"] : w["ty"] + w["th"], w["tx"] : w["tx"] + w["tw"]]) for w in row["windows"]]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cut, pa.binary())], names=["name", "content"])

    return images.join(windows, "stem").select("stem", "data", "width", "height", "nChannels", "windows").mapInArrow(run, "name string, content binary")


def tile_label_files(images: DataFrame, boxes: DataFrame, size: int = 640, overlap: float = 0.25, visible: float = 0.35) -> DataFrame:
    """images (stem, width, height) and boxes (stem, class_id, x1, y1, x2, y2 in pixels) -> files: the labels of every window, labels/<stem>_t<tile>.txt, of the boxes that keep a share of `visible` of their area in it, cut to it. A window without one has an empty file, as its image has one."""
    windows = with_tiles(images.select("stem", "width", "height"), size, overlap)
    w = F.least(F.col("x2"), F.col("tx") + F.col("tw")) - F.greatest(F.col("x1"), F.col("tx"))
    h = F.least(F.col("y2"), F.col("ty") + F.col("th")) - F.greatest(F.col("y1"), F.col("ty"))
    cut = windows.join(boxes, "stem").withColumns({"vw": w, "vh": h}).where((F.col("vw") > 0) & (F.col("vh") > 0) & (F.col("vw") * F.col("vh") >= visible * (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))))
    share = lambda low, v, at, side: ((F.greatest(F.col(low), F.col(at)) - F.col(at)) + F.col(v) / 2) / F.col(side)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", share("x1", "vw", "tx", "tw"), share("y1", "vh", "ty", "th"), F.col("vw") / F.col("tw"), F.col("vh") / F.col("th"))
    lines = cut.groupBy("stem", "tile").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    named = windows.select("stem", "tile").join(lines, ["stem", "tile"], "left")
    return named.select(F.concat(F.lit("labels/"), tile_name(F.col("stem"), F.col("tile")), F.lit(".txt")).alias("name"), F.coalesce(F.concat("text", F.lit("\n")), F.lit("")).cast("binary").alias("content"))


def image_files(spark: SparkSession, names: DataFrame) -> DataFrame:
    """names (path, stem) -> files: the images as they are, under images/<stem> with their own suffix. Contents go from the file system to the sink and aren't decoded."""
    folder = names.select(F.regexp_replace("path", r"/[^/]+$", "").alias("folder")).distinct()
    paths = [r.folder for r in folder.collect()]
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.join(names, "path").select(F.concat(F.lit("images/"), "stem", suffix).alias("name"), "content")
