"""Benchmark decontamination by template canonicalisation: numbers, names and units become typed slots; template windows are hash-joined and their slots checked for consistency."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import PLAIN_BYTES, RAW_BYTES, fresh, mix, power_tables, read, settle, text_chunks, window_hashes

NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
UNITS = frozenset("mm cm m km inch inches foot feet ft yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit kph mph km/h m/s hz khz mhz ghz w kw v volt volts j joule joules n newton newtons pa".split())
LITERAL, NUM, NAME, UNIT = 0, 1, 2, 3
_SLOT = np.array([0, 0xA1C7_0001, 0xA1C7_0002, 0xA1C7_0003], np.uint64)


@dataclass(frozen=True)
class TemplateParams:
    """Tokens of a window, and how many of them must be literal to match as a template; windows with fewer literals match by their exact words. Items of fewer tokens are one window. block_chars bounds the benchmark text that is broadcast at once; a larger benchmark takes several passes. whole_runs: two values for one slot void the entire run of windows, else only the windows that hold both."""

    window: int = 8
    literals: int = 4
    block_chars: int = 4_000_000
    whole_runs: bool = False


#: The default: a changed number or name hides no window but those that hold the conflict.
EACH_WINDOW = TemplateParams()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:"]] = True
_QUOTES = np.zeros(256, bool)
_QUOTES[[ord(c) for c in "\"')]*"]] = True


@dataclass
class Templates:
    """Tokens of texts that lie end to end: byte bounds, template codes, slot kinds, where each text's tokens begin, and the codes of their words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    slots: np.ndarray
    begins: np.ndarray
    plain: np.ndarray

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace").strip(".,;:!?\"'()").lower()


def plain_hash(word: str) -> int:
    return int(templates(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), False).codes[0])


_SETS: dict[str, np.ndarray] = {}


def _words(name: str) -> np.ndarray:
    if name not in _SETS:
        _SETS[name] = np.sort(np.array([plain_hash(w) for w in (UNITS if name == "units" else NUMBER_WORDS)], np.uint64))
    return _SETS[name]


def templates(data: np.ndarray, offsets: np.ndarray, typed: bool = True) -> Templates:
    """Tokens are words in lower case without ASCII punctuation; those of punctuation alone are passed over. A number is a token of digits or a number word, a unit a unit word after a number, a name a token with one capital at its start that does not begin a line or sentence."""
    n = len(data)
    none = np.empty(0, np.int64)
    if not n:
        return Templates(data, none, none, np.empty(0, np.uint64), none, np.zeros(len(offsets), np.int64), np.empty(0, np.uint64))
    low = _LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    low[second] += 0x20
    inside = RAW_BYTES[data] == 2
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | new[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | new[1:])) + 1
    kept = PLAIN_BYTES[data] == 2
    place = np.zeros(n + 1, np.int64)
    np.cumsum(kept, out=place[1:])
    power, inverse = power_tables(int(place[-1]) + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(np.where(kept, (low.astype(np.uint64) + np.uint64(1)) * power[place[:-1]], np.uint64(0)), out=total[1:])
    size = place[ends] - place[starts]
    full = size > 0
    before = np.concatenate(([0], ends[:-1]))
    # the last byte of each token that is no quote or bracket
    last = ends - 1
    for _ in range(2):
        last = np.where(_QUOTES[data[last]] & (last > starts), last - 1, last)
    lines = np.zeros(n + 1, np.int32)
    np.cumsum(data == 10, out=lines[1:])
    first = new[starts] | (lines[starts] > lines[before]) | np.concatenate(([True], _ENDS[data[last[:-1]]]))
    digits = np.zeros(n + 1, np.int32)
    np.cumsum(_IS_DIGIT[data], out=digits[1:])
    codes = mix((total[ends] - total[starts]) * inverse[place[starts]] + size.astype(np.uint64))
    numeric = (digits[ends] - digits[starts] == size) & full
    upper = low != data
    capital = np.zeros(n + 1, np.int32)
    np.cumsum(upper, out=capital[1:])
    head = np.minimum(starts + 3, ends)
    starts, ends, codes, first, numeric = starts[full], ends[full], codes[full], first[full], numeric[full]
    slots, plain = np.zeros(len(starts), np.int64), codes
    if typed:
        head = head[full]
        name = (capital[head] - capital[starts] == 1) & (capital[ends] - capital[starts] == 1) & ~first & (ends - starts > 1)
        numeric |= np.isin(codes, _words("numbers"))
        unit = np.isin(codes, _words("units")) & np.concatenate(([False], numeric[:-1]))
        slots = np.where(numeric, NUM, np.where(unit, UNIT, np.where(name, NAME, LITERAL)))
        codes = np.where(slots > 0, _SLOT[slots], codes)
    return Templates(data, starts, ends, codes, slots, np.searchsorted(starts, offsets), plain)


def windows(codes: np.ndarray, slots: np.ndarray, k: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of k tokens that have enough literals."""
    h = window_hashes(codes, k)
    if not len(h):
        return np.empty(0, np.int64), h
    sums = np.concatenate(([0], np.cumsum(slots == LITERAL)))
    at = np.flatnonzero(sums[k:] - sums[:-k] >= literals)
    return at, h[at]


class Index:
    """Template windows of a bounded part of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], p: TemplateParams):
        self.ids = [i for i, _ in items]
        texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in items]
        self.all = t = templates(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64))
        rows: dict[tuple[int, bool], list] = defaultdict(list)
        for i in range(len(items)):
            a, b = t.begins[i], t.begins[i + 1]
            if not (k := min(p.window, int(b - a))):
                continue
            at, h = windows(t.codes[a:b], t.slots[a:b], k, p.literals)
            rows[k, False] += [(int(x), i, int(j)) for j, x in zip(at, h, strict=True)]
            exact = window_hashes(t.plain[a:b], k)
            rows[k, True] += [(int(exact[j]), i, int(j)) for j in np.setdiff1d(np.arange(len(exact)), at)]
        #: (tokens, by exact words) -> sorted hashes and their (item, place)
        self.by_length = {}
        for key, found in rows.items():
            if not found:
                continue
            found.sort()
            self.by_length[key] = np.array([x for x, _, _ in found], np.uint64), np.array([(i, j) for _, i, j in found], np.int64).reshape(-1, 2)

    def leaks(self, column, p: TemplateParams) -> list[tuple[int, int, int, int, bool]]:
        """(row, item, windows, slots, exact) of the items with windows in the row's text whose slots are consistent."""
        out = []
        for row, _, data, offsets in text_chunks(column):
            t = templates(data, offsets)
            runs: dict[tuple[int, int, int], dict[int, int]] = defaultdict(dict)
            for (k, exact), (keys, places) in self.by_length.items():
                if exact:
                    h = window_hashes(t.plain, k)
                    at = np.arange(len(h))
                else:
                    at, h = windows(t.codes, t.slots, k, p.literals)
                lo = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[lo] == h)
                doc = np.searchsorted(t.begins, at[hit], "right") - 1
                for x, d in zip(hit, doc, strict=True):
                    if at[x] + k > t.begins[d + 1]:
                        continue
                    r = int(lo[x])
                    while r < len(keys) and keys[r] == h[x]:
                        i, j = (int(v) for v in places[r])
                        runs[int(d), i, int(at[x]) - j][j] = k
                        r += 1
            found: dict[tuple[int, int], list[int]] = {}
            for (d, i, shift), starts in sorted(runs.items()):
                if (got := self._consistent(t, i, shift, starts, p.whole_runs))[0]:
                    sums = found.setdefault((d, i), [0, 0, 1])
                    sums[0] += got[0]
                    sums[1] += got[1]
                    sums[2] &= got[2]
            out += [(row + d, self.ids[i], w, n, bool(same)) for (d, i), (w, n, same) in sorted(found.items())]
        return out

    def _consistent(self, t: Templates, i: int, shift: int, starts: dict[int, int], whole: bool) -> tuple[int, int, bool]:
        """Number of windows (of a whole run, or each by itself) in which no value stands for two, their slots, and whether all of these have the item's values."""
        count, places = 0, {}
        for part in [starts] if whole else [{j: k} for j, k in starts.items()]:
            if (got := self._slots(t, i, shift, part)) is not None:
                count += len(part)
                places |= got
        return count, len(places), all(places.values())

    def _slots(self, t: Templates, i: int, shift: int, starts: dict[int, int]) -> dict[int, bool] | None:
        """Places of the windows' slots and whether they have the item's value, or None if a value stands for two."""
        its, base = self.all, int(self.all.begins[i])
        to, back, same = {}, {}, {}
        for q in sorted({q for j, k in starts.items() for q in range(j, j + k)}):
            alike = its.codes[base + q] == t.codes[shift + q]
            # a word may be a name in one place and begin a sentence in the other
            if not alike and its.plain[base + q] != t.plain[shift + q]:
                return None
            if kind := int(its.slots[base + q]):
                a = its.word(base + q)
                b = t.word(shift + q) if alike else a
                same[q] = a == b
                if to.setdefault((kind, a), b) != b or kind != NUM and back.setdefault((kind, b), a) != a:
                    return None
        return same


def _blocks(benchmark: DataFrame, p: TemplateParams, item_col: str, text_col: str) -> tuple[int, Iterator[Index]]:
    """How many blocks the benchmark makes, and their indexes one after another; the driver has one at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = size // p.block_chars + 1

    def made():
        for b in range(n):
            part = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b) if n > 1 else items
            yield Index(sorted({(r.i, r.t) for r in part.collect()}, key=lambda x: (x[0] is None, x[0] or 0, x[1])), p)

    return n, made()


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: TemplateParams = TemplateParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row per document and benchmark item whose template windows it holds: id_col, item_col, windows, slots, exact.

    exact: all slot values equal; else the question was re-parameterised: each value of the item stands
    for one value in the document (names and units one to one), over a run of windows or within each
    window, as p.whole_runs says (each window by default). An empty table leaks nothing; other columns of docs,
    whatever their names, are left out. Null and empty texts leak nothing;
    repeated rows each give theirs; no match, no row. Windows short of literals, and short items, count
    only by their exact words, apart from case and punctuation. Whole texts are read, in one pass for each
    block_chars of benchmark, without a shuffle of the documents. Of several blocks each one's leaks are
    settled before the next is made, and its index is given up, so memory is that of one.
    """
    out, (n, indexes) = None, _blocks(benchmark, p, item_col, "text")
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            import pyarrow as pa

            index = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], *r) for i, *r in index.leaks(batch.column(1), p)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["doc_id", "item_id", "windows", "slots", "exact"])

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, item_id long, windows long, slots long, exact boolean")
        if n > 1:
            part = settle(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: TemplateParams = TemplateParams(), text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark (see find_leaks). With several blocks of benchmark only the digests of leaking texts are settled in each pass, and the rows go once, at the end."""
    n, indexes = _blocks(benchmark, p, item_col, "text")
    leaking, digest = None, fresh(docs, "leaking_text")
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared, keep=n == 1, name=text_col):
            import pyarrow as pa

            index = shared.value
            for batch in batches:
                clean = np.full(batch.num_rows, keep)
                clean[[i for i, *_ in index.leaks(batch.column(batch.schema.get_field_index(name)), p)]] = not keep
                yield batch.filter(pa.array(clean))

        if n == 1:
            return docs.mapInArrow(run, docs.schema)
        texts = docs.select(text_col)
        found = settle(texts.mapInArrow(run, texts.schema).select(F.md5(F.col(text_col).cast("binary")).alias(digest)).distinct())
        shared.destroy()
        leaking = found if leaking is None else leaking.unionByName(found)
    return docs.join(leaking.distinct(), F.md5(docs[text_col].cast("binary")) == F.col(digest), "left_anti")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds windows of a benchmark item, with the item; no row for clean, null and empty texts."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
