"""Sequences as paths tell them: one rule for each kind of source, over path columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of images and of videos.
IMAGES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
VIDEOS = ("mp4", "avi", "mov", "mkv", "m4v", "wmv", "mpg", "mpeg")
#: Fixed value: a number of three to six digits that stands apart in a file's stem.
NUMBER = r"(?:^|[_-])(\d{3,6})(?=[_.-]|$)"
#: Directories that only part or wrap a source.
WRAPPERS = (
    "images", "labels", "image", "label", "annotations", "dataset", "data", "train", "val", "valid", "validation", "test", "testing",
    "all", "raw", "rgb", "drone", "drones", "bird", "birds",
)


@dataclass(frozen=True)
class NameRule:
    """tokens: what a directory that is a sequence has in its name; skips: whether wrapping directories are passed over; number, parent and orphan: what goes before a number, a parent directory and a stem (parent None: parents tell nothing); owned: whether a number carries its directory."""

    tokens: tuple[str, ...]
    number: str
    parent: str | None
    orphan: str
    skips: bool = False
    owned: bool = False


#: Videos taken apart into frames, pairs of images and labels, and one flat folder of stills.
RULES = {
    "frames": NameRule(("video", "vid", "seq", "clip", "scene", "track"), "vid_", "dir_", "orphan_"),
    "pairs": NameRule(("video", "vid", "seq", "clip", "scene", "track", "source", "sample"), "clip_", "", "frame_", skips=True),
    "flat": NameRule(("video", "seq", "clip", "scene"), "vid_", None, "orphan_", owned=True),
}


def stem_of(path: Column) -> Column:
    """A file's name without its last suffix; a name that only begins with a dot has none."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def sequence_of(path: Column, rule: str = "frames") -> Column:
    """struct (sequence, how) of a path below the source's root: the first directory whose name holds one of the rule's tokens ("layout"), else the number in the file's stem ("filename"), else the parent directory ("parent"), else the file alone ("orphan"). A null path has nulls."""
    r = RULES[rule]
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    wraps = lambda x: F.lower(x).isin(*WRAPPERS) | x.startswith(".")
    named = F.filter(folders, lambda x: ~wraps(x)) if r.skips else folders
    folder = F.get(F.filter(named, lambda x: F.lower(x).rlike("|".join(r.tokens))), F.lit(0))
    stem = stem_of(path)
    digits = F.regexp_extract(stem, NUMBER, 1)
    parent = F.when(F.size(named) > 0, F.element_at(named, -1))
    above = F.when(F.size(folders) > 0, F.concat(F.element_at(folders, -1), F.lit("_"))).otherwise("") if r.owned else F.lit("")
    name, how = F.when(folder.isNotNull(), folder), F.when(folder.isNotNull(), "layout")
    name, how = name.when(digits != "", F.concat(F.lit(r.number), above, digits)), how.when(digits != "", "filename")
    if r.parent is not None:
        name, how = name.when(parent.isNotNull(), F.concat(F.lit(r.parent), parent)), how.when(parent.isNotNull(), "parent")
    return F.struct(name.otherwise(F.concat(F.lit(r.orphan), stem)).alias("sequence"), how.when(path.isNotNull(), "orphan").alias("how"))
