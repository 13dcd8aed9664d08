"""Annotation text as a data source of its own: spark.read.format("annotations"), in batch and over folders that grow. Malformed rows come out with a reason, so that they can be counted, or stop the read where it is strict."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith

#: Rows of the two kinds of text; `line` counts from 1, reason is null for a sound row.
SCHEMAS = {
    "tracking": "file string, line int, frame int, id int, x1 double, y1 double, w double, h double, conf double, class int, visibility double, reason string",
    "labels": "file string, line int, class_id int, cx double, cy double, bw double, bh double, clamped boolean, reason string",
}
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_CUT = re.compile(r"[,\s]+")


def _number(text: str) -> float | None:
    try:
        v = float(text)
    except ValueError:
        return None
    return v if v == v and abs(v) != float("inf") else None


def tracking_row(line: str) -> tuple:
    """frame, id, box, conf, class, visibility and reason of a line of tracking text; what is missing after the box is 1."""
    values = [_number(f) for f in _CUT.split(line.strip())]
    if len(values) < 6 or any(v is None for v in values[:6]):
        return (None,) * 9 + ("short" if len(values) < 6 else "no number",)
    conf, kind, seen = (v if v is not None else 1.0 for v in [*values[6:9], None, None, None][:3])
    return int(values[0]), int(values[1]), *values[2:6], conf, int(kind), seen, None


def label_row(line: str) -> tuple:
    """class, box clamped to the image, whether it was clamped, and reason of a line of label text."""
    fields = _CUT.split(line.strip())
    values = [_number(f) for f in fields[1:5]]
    if len(values) < 4 or any(v is None for v in values) or min(values[2:]) <= 0:
        return (None,) * 6 + ("degenerate",)
    if not re.fullmatch(r"[+-]?\d+", fields[0]):
        return (None, *values, False, "unknown")
    cx, cy, bw, bh = values
    if not (0 <= cx <= 1 and 0 <= cy <= 1):
        return (int(fields[0]), *values, False, "out_of_frame")
    x1, x2, y1, y2 = max(cx - bw / 2, 0.0), min(cx + bw / 2, 1.0), max(cy - bh / 2, 0.0), min(cy + bh / 2, 1.0)
    return int(fields[0]), (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1, cx - bw / 2 < 0 or cx + bw / 2 > 1 or cy - bh / 2 < 0 or cy + bh / 2 > 1, None


def kind_of(options) -> str:
    kind = options.get("kind", "tracking")
    if kind not in SCHEMAS:
        raise ValueError(f"kind is one of {', '.join(SCHEMAS)}")
    return kind


@dataclass
class Files(InputPartition):
    """Files of one task: (path below the root, bytes, time of change in nanoseconds)."""

    files: list


class _Text:
    """What batch and stream readers share: listing, dealing out by bytes, parsing."""

    def __init__(self, options):
        self.root, self.kind = options["path"], kind_of(options)
        self.strict = options.get("strict", "false").lower() == "true"
        self.task_bytes = int(options.get("taskBytes", 64 << 20))
        self.suffix = options.get("suffix", ".txt")
        self.wanted: list = []

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def listed(self) -> list[tuple[str, int, int]]:
        from pyarrow import fs

        system, base = self._system()
        found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        names = ((f.path[len(base) :].lstrip("/"), f.size, f.mtime_ns or 0) for f in found if f.is_file and f.path.endswith(self.suffix))
        return sorted(x for x in names if all(ok(x[0]) for ok in self.wanted))

    def dealt(self, files: list) -> list[Files]:
        """Files in order, as many to a task as taskBytes hold; a larger file has a task of its own."""
        out, held = [], 0
        for f in files:
            if not out or held + f[1] > self.task_bytes:
                out.append(Files([]))
                held = 0
            out[-1].files.append(f)
            held += f[1]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, base = self._system()
        parse = tracking_row if self.kind == "tracking" else label_row
        types = [f.split() for f in SCHEMAS[self.kind].split(", ")]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), types, strict=True)], names=[n for n, _ in types])
            rows.clear()
            return made

        for name, _, _ in partition.files:
            with system.open_input_stream(f"{base}/{name}") as raw:
                rest, number = b"", 0
                while True:
                    block = raw.read(1 << 20)
                    lines = (rest + block).split(b"\n")
                    rest = b"" if not block else lines.pop()
                    for line in lines:
                        number += 1
                        text = line.decode("utf-8", "replace").strip()
                        if not text or text[0] == "#":
                            continue
                        row = parse(text)
                        if self.strict and row[-1] is not None:
                            raise ValueError(f"{name}, line {number}: {row[-1]}")
                        rows.append((name, number, *row))
                        if len(rows) >= 10_000:
                            yield batch()
                    if not block:
                        break
        if rows:
            yield batch()


class AnnotationReader(_Text, DataSourceReader):
    """Filters on `file` (equal, one of, begins with) choose files before any is opened."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("file",):
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append(lambda n, v=f.value: n == v)
            elif isinstance(f, In):
                self.wanted.append(lambda n, v=frozenset(f.value): n in v)
            elif isinstance(f, StringStartsWith):
                self.wanted.append(lambda n, v=f.value: n.startswith(v))
            else:
                yield f

    def partitions(self):
        return self.dealt(self.listed())


class AnnotationStream(_Text, DataSourceStreamReader):
    """Files by time of change, then name; an offset is the last one taken. A file that changes later comes again, as a whole."""

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def _ordered(self) -> list:
        return sorted(((t, n, size) for n, size, t in self.listed()), key=lambda x: (x[0], x[1]))

    def latestOffset(self) -> dict:
        found = self._ordered()
        return {"time": found[-1][0], "name": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["time"], o["name"]) for o in (start, end))
        return self.dealt([(n, size, t) for t, n, size in self._ordered() if low < (t, n) <= high])

    def commit(self, end: dict) -> None:
        pass


class AnnotationSource(DataSource):
    """Options: path (a folder, or a file system's URI of one), kind (tracking or labels), strict (true: the first malformed row is an error), taskBytes, suffix."""

    @classmethod
    def name(cls) -> str:
        return "annotations"

    def schema(self) -> str:
        return SCHEMAS[kind_of(self.options)]

    def reader(self, schema):
        return AnnotationReader(self.options)

    def streamReader(self, schema):
        return AnnotationStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes format("annotations") known to the session; filters reach it as well."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnnotationSource)


def tally(rows: DataFrame) -> DataFrame:
    """Per file: rows, sound ones, clamped but kept ones (labels), and malformed ones by reason as a map."""
    clamped = F.count_if(F.col("reason").isNull() & F.col("clamped")) if "clamped" in rows.columns else F.lit(0).cast("long")
    per = rows.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"), clamped.alias("c"))
    bad = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    return per.groupBy("file").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("sound"), F.sum("c").alias("clamped"), bad.alias("malformed"))
