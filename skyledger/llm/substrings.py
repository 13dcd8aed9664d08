"""Substring dedup: broadcast suffix automata of reference shards, past which documents stream for their matching statistics; what no bounded shard can hold of a corpus against itself meets by anchored windows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import WORD, hash_words, mix, read, settle, text_chunks, text_of, window_hashes

_WORDS = re.compile(WORD)


class SuffixAutomaton:
    """Suffix automaton over the words of several texts; a text's end breaks every match."""

    def __init__(self, texts: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in texts:
            last = 0
            for w in words:
                last = self._add(last, w)

    def _state(self, length: int, moves: dict[str, int], link: int) -> int:
        self.next.append(moves), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def _add(self, last: int, w: str) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: str, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def statistics(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest match that ends with it."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (to := self.next[state].get(w)) is not None:
                state, n = to, n + 1
            out.append(n)
        return out


def remove_reference_spans(docs: DataFrame, reference: DataFrame, least: int = 13, shard_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, n_words, n_removed): docs without the words of maximal spans of `least` words or more that stand in a text of reference.

    The reference is cut into shards of about shard_words words, whose automata (some 66 MB each, measured, at
    that size) are broadcast one after another; documents stream past each, and of several shards each
    one's finds are settled and its automaton is given up before the next is made. The passes over docs grow
    with the reference, so this is for one that is small beside the corpus: a benchmark, a licence or
    boilerplate collection. Spans are judged on the input. Null text is empty; kept words are joined by a space.
    """
    spark = docs.sparkSession
    done = []
    sized = reference.select(text_of(text_col).alias("t")).where("t <> ''").distinct()
    total = sized.agg(F.sum(F.length("t"))).first()[0] or 0
    n = total // (6 * shard_words) + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    if n > 1:
        # numbered once, so that what each pass finds goes back to its row
        rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    key = "row" if n > 1 else "doc_id"
    out = rows.select(key, "text")
    for i in range(n):
        part = [_WORDS.findall(r.t) for r in sized.where(F.pmod(F.xxhash64("t"), F.lit(n)) == i).collect()]
        shared = spark.sparkContext.broadcast(SuffixAutomaton(part))

        def run(batches, shared=shared, whole=n == 1):
            import pyarrow as pa

            for batch in batches:
                gone = []
                for t in batch.column(1).to_pylist():
                    hit = set()
                    for at, size in enumerate(shared.value.statistics(_WORDS.findall(t))):
                        if size >= least:
                            hit.update(range(at - size + 1, at + 1))
                    gone.append(sorted(hit))
                kept = [batch.column(0), *([batch.column(1)] if whole else []), pa.array(gone, pa.list_(pa.int32()))]
                made = pa.RecordBatch.from_arrays(kept, [batch.schema.names[0], *(["text"] if whole else []), "gone"])
                yield made if whole else made.filter(pa.array([bool(g) for g in gone], pa.bool_()))

        kind = out.schema[key].dataType.simpleString()
        if n == 1:
            out = out.mapInArrow(run, f"doc_id {kind}, text string, gone array<int>")
        else:
            done.append(settle(out.mapInArrow(run, f"row {kind}, gone array<int>")))
            shared.destroy()
    if n > 1:
        found = done[0]
        for more in done[1:]:
            found = found.unionByName(more)
        found = found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
        out = rows.join(found, "row", "left").withColumn("gone", F.coalesce("gone", F.expr("cast(array() as array<int>)")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    kept = F.expr("if(size(w) = 0, w, transform(array_except(sequence(0, size(w) - 1), gone), i -> w[i]))")
    return out.withColumn("w", words).select(F.col("doc_id").alias(id_col), F.array_join(kept, " ").alias("text"), F.size("w").cast("long").alias("n_words"), F.size("gone").cast("long").alias("n_removed"))


# --- a corpus against itself -----------------------------------------------------------------


class Passages:
    """A reference shard for windows of one length: the suffix automaton of some passages, and the hashes of their windows, which tell what words to send through it at all."""

    def __init__(self, texts: list[list[str]], window: int):
        self.window, self.automaton = window, SuffixAutomaton(texts)
        link, length = self.automaton.link, self.automaton.length
        #: state -> the state whose strings include the last `window` words
        self.home = np.full(len(link), -1, np.int64)
        for state in sorted(range(len(link)), key=length.__getitem__):
            if length[state] >= window:
                self.home[state] = self.home[link[state]] if length[link[state]] >= window else state
        body = [" ".join(t).encode("utf-8", "surrogatepass") for t in texts]
        words, begins = hash_words(np.frombuffer(b"".join(body), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in body]))).astype(np.int64))
        whole = window_hashes(words, window)
        ends = np.concatenate([np.arange(begins[i], max(begins[i], begins[i + 1] - window + 1)) for i in range(len(texts))] or [np.empty(0, np.int64)])
        self.keys = np.unique(whole[ends.astype(np.int64)])
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def likely(self, whole: np.ndarray) -> np.ndarray:
        """Which window hashes are those of a window of the passages."""
        out = np.zeros(len(whole), bool)
        at = np.flatnonzero(self.some[(whole >> np.uint64(44)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, whole[at]), len(self.keys) - 1)
            out[at] = self.keys[place] == whole[at]
        return out

    def windows(self, text: str, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, states) of the text's windows whose words the automaton holds: those at whose last word the matching statistic is `window` or more. Only the likely windows' words are walked."""
        at = np.flatnonzero(likely)
        if not len(at):
            return at, at
        words, k = _WORDS.findall(text), self.window
        moves, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        starts, states = [], []
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        for lo, hi in zip(at[np.concatenate(([0], cuts))].tolist(), at[np.concatenate((cuts - 1, [len(at) - 1]))].tolist(), strict=True):
            state = n = 0
            for i in range(lo, hi + k):
                w = words[i]
                while state and w not in moves[state]:
                    state = link[state]
                    n = length[state]
                if (to := moves[state].get(w)) is not None:
                    state, n = to, n + 1
                if n >= k:
                    starts.append(i - k + 1), states.append(state)
        return np.array(starts, np.int64), self.home[np.array(states, np.int64)]


_BUILT: dict[str, Passages] = {}


def _passages(shared) -> Passages:
    """The automaton of a broadcast (name, texts, window, ...), built once in a Python worker."""
    name, texts, window = shared.value[:3]
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Passages(texts, window)
    return _BUILT[name]


def frequent_passages(docs: DataFrame, window: int, gram: int, most: int = 4096, sample: int = 16, longest: int = 4096) -> list[list[str]]:
    """The words of passages around the anchors that most documents share, as counted in one of `sample` documents: at most `most` runs of windows, each of at most `longest` bytes, so it is bounded at any input size. Which passages these are decides only what is dealt with by automaton; all else is found by anchored_windows."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(sample)) == 0)

    def runs(batches, wanted=None):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in text_chunks(batch.column(1)):
                words, begins = hash_words(data, offsets)
                grams = window_hashes(words, gram)
                rows = []
                for i in range(b - a):
                    s, e = int(begins[i]), int(begins[i + 1])
                    if e - s < window:
                        continue
                    at = _anchors(grams, s, e, window, gram)
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
                    keys = grams[s + at[cut]].view(np.int64)
                    if wanted is None:
                        rows += [(int(k), ids[a + i], 0, None) for k in np.unique(keys)]
                    elif (hit := np.flatnonzero(np.isin(keys, wanted))).size:
                        text, ends = _WORDS.findall(batch.column(1)[a + i].as_py()), np.append(cut[1:], len(at))
                        rows += [(int(keys[j]), ids[a + i], int(cut[j]), run) for j in hit if len(run := " ".join(text[cut[j] : ends[j] + window - 1])) <= longest]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["anchor", "doc_id", "first", "words"])

    schema = "anchor long, doc_id long, first int, words string"
    counts = some.mapInArrow(runs, schema).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    # at most `most` rows
    top = np.array(sorted(r.anchor for r in counts.orderBy(F.desc("n"), "anchor").limit(most).collect()), np.int64)
    if not len(top):
        return []
    found = some.mapInArrow(lambda batches: runs(batches, top), schema).groupBy("anchor").agg(F.min_by(F.struct("doc_id", "first", "words"), F.struct("doc_id", "first")).alias("r")).select("r.*").collect()
    out, last = [], (None, 0)
    for doc, first, words in sorted((r.doc_id, r.first, r.words.split(" ")) for r in found):
        if last[0] == doc and first <= last[1]:
            out[-1] += words[last[1] - first :]
        else:
            out.append(words)
        last = (doc, max(first + len(words), last[1] if last[0] == doc else 0))
    return out


def with_first_documents(docs: DataFrame, texts: list[list[str]], window: int):
    """Broadcast (name, texts, window, first): the smallest doc_id of all docs that holds each window of the passages, by state of their automaton. One pass over docs, whose tasks each give one row per window."""
    sc = docs.sparkSession.sparkContext
    name = uuid.uuid4().hex
    shared = sc.broadcast((name, texts, window))

    def run(batches):
        import pyarrow as pa

        held = _passages(shared)
        first = np.full(len(held.home), _NEVER, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch.column(1)):
                words, begins = hash_words(data, offsets)
                likely = held.likely(window_hashes(words, window))
                for i in range(b - a):
                    some = likely[begins[i] : max(begins[i], begins[i + 1] - window + 1)]
                    if some.any():
                        _, states = held.windows(batch.column(1)[a + i].as_py(), some)
                        np.minimum.at(first, states, ids[a + i])
        at = np.flatnonzero(first != _NEVER)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(first[at])], ["state", "doc_id"])

    rows = docs.mapInArrow(run, "state long, doc_id long").groupBy("state").agg(F.min("doc_id").alias("first")).collect()
    first = np.full(2 * sum(map(len, texts)) + 2, _NEVER, np.int64)
    for r in rows:
        first[r.state] = r.first
    return sc.broadcast((name, texts, window, first))


#: No document holds it.
_NEVER = np.iinfo(np.int64).max

#: Bytes of a window's hash, all kept, beside the 8 of its anchor's.
_KEPT = 8
#: The bits of a run's first word below its text's version.
_PLACE = (1 << 32) - 1
#: Slots that anchors are counted in, and the share of documents (one in so many) that is counted.
_SLOTS, _SAMPLE = 1 << 16, 8


def _anchors(grams: np.ndarray, s: int, e: int, window: int, gram: int) -> np.ndarray:
    """Places, from s, of the anchors of the windows of words s to e."""
    n = e - s - window + 1
    return np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams[s : e - gram + 1], window - gram + 1).argmin(axis=1)


def hot_anchors(docs: DataFrame, window: int, gram: int, most: int, sample: int = _SAMPLE) -> dict[int, int]:
    """Slot of anchors -> parts, for slots with more than `most` windows (or four times the mean, where that is more), estimated from one in `sample` documents. It sets only how the work is dealt, not what is found."""

    def run(batches):
        import pyarrow as pa

        sums = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(0)):
                words, begins = hash_words(data, offsets)
                grams = window_hashes(words, gram)
                for i in range(b - a):
                    s, e = begins[i], begins[i + 1]
                    if e - s >= window:
                        at = s + _anchors(grams, s, e, window, gram)
                        np.add.at(sums, (grams[at] % np.uint64(_SLOTS)).astype(np.int64), 1)
        slots = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sums[slots])], ["slot", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).select("text")
    # at most _SLOTS rows
    counts = some.mapInArrow(run, "slot long, n long").groupBy("slot").agg((F.sum("n") * sample).alias("n")).collect()
    most = max(most, 4 * sum(r.n for r in counts) // _SLOTS)
    return {r.slot: -(-r.n // most) for r in counts if r.n > most}


def version() -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("version")


class _Runs:
    """Cuts texts into runs of windows that share their anchor, the gram of the smallest hash within the window. The windows of an anchor in a slot of `hot` are dealt to its parts by their own hash, each with a key of its own in place of the anchor; windows that the automaton of `shared` holds are left out."""

    def __init__(self, window: int, gram: int, hot: dict[int, int] | None, shared):
        self.window, self.gram, self.held = window, gram, _passages(shared) if shared else None
        self.parts = np.ones(_SLOTS, np.uint64)
        for slot, n in (hot or {}).items():
            self.parts[slot] = n

    def of(self, column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, anchors, keys, first words, sizes, hashes of all windows) of each text with any."""
        k = self.window
        for a, b, data, offsets in text_chunks(column):
            words, begins = hash_words(data, offsets)
            grams, whole = window_hashes(words, self.gram), window_hashes(words, k)
            likely = self.held.likely(whole) if self.held else None
            for i in range(b - a):
                s, e = begins[i], begins[i + 1]
                n = e - s - k + 1
                if n <= 0:
                    continue
                at = _anchors(grams, s, e, k, self.gram)
                raw, ends = grams[s + at], np.diff(at) != 0
                keys, of = raw, self.parts[(raw % np.uint64(_SLOTS)).astype(np.int64)]
                if (of > 1).any():
                    part = np.where(of > 1, whole[s : s + n] % of, np.uint64(0))
                    ends |= np.diff(part) != 0
                    keys = np.where(part > 0, mix(raw + part), raw)
                sent = np.ones(n, bool)
                if self.held and likely[s : s + n].any():
                    sent[self.held.windows(column[a + i].as_py(), likely[s : s + n])[0]] = False
                    ends |= np.diff(sent)
                cut = np.concatenate(([0], np.flatnonzero(ends) + 1))
                size, keep = np.diff(np.append(cut, n)), sent[cut]
                if keep.any():
                    yield a + i, raw[cut[keep]], keys[cut[keep]], cut[keep], size[keep], whole[s : s + n][sent]

    def is_hot(self, raw: np.ndarray) -> np.ndarray:
        return self.parts[(raw % np.uint64(_SLOTS)).astype(np.int64)] > 1


_RUN_SCHEMA = "anchor long, doc_id long, first long, hashes binary"


def _run_batch(rows: list[tuple]):
    """Arrow rows of _RUN_SCHEMA from (doc_id, version, keys, first, sizes, hashes)."""
    import pyarrow as pa

    sizes = np.concatenate([r[4] for r in rows]) if rows else np.empty(0, np.int64)
    joined = lambda k, t: np.concatenate([np.asarray(r[k]) for r in rows]).astype(t) if rows else np.empty(0, t)
    firsts = np.concatenate([r[3] + (int(r[1]) << 32) for r in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
    docs = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[3]) for r in rows])
    bounds = np.concatenate(([0], np.cumsum(sizes) * _KEPT)).astype(np.int32)
    hashes = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(joined(5, np.uint64).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(joined(2, np.uint64).view(np.int64)), pa.array(docs), pa.array(firsts), hashes], ["anchor", "doc_id", "first", "hashes"])


def anchored_windows(docs: DataFrame, window: int, gram: int, hot: dict[int, int] | None = None, shared=None) -> DataFrame:
    """(anchor, doc_id, first, hashes) of all runs of docs (see _Runs): first is the run's place, above it the 31 bits of its text's version. Equal windows have equal anchors, so only what shares an anchor need meet."""

    def run(batches):
        cut = _Runs(window, gram, hot, shared)
        for batch in batches:
            ids, versions = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            yield _run_batch([(ids[i], versions[i], keys, first, sizes, hashes) for i, _, keys, first, sizes, hashes in cut.of(batch.column(1)) if ids[i] is not None])

    return docs.select("doc_id", "text", version()).mapInArrow(run, _RUN_SCHEMA)


def in_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (doc_id, text) as (bucket, doc_id, version, text). Rows without id take no part in what follows and are spread evenly."""
    return docs.select(_bucket(buckets), "doc_id", version(), "text")


def _bucket(buckets: int) -> Column:
    anywhere = F.pmod(F.monotonically_increasing_id(), F.lit(buckets))
    return F.when(F.col("doc_id").isNull(), anywhere).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(buckets))).cast("int").alias("bucket")


def _code(raw: np.ndarray, slices: int) -> np.ndarray:
    return ((raw % np.uint64(slices)) << np.uint64(32)) | (raw >> np.uint64(32))


def shared_anchors(docs: DataFrame, window: int, gram: int, buckets: int, hot: dict[int, int] | None = None, shared=None, most: int = 1 << 20) -> DataFrame:
    """docs (bucket, doc_id, version, text) -> (bucket, slice, anchors): for each bucket, those of its anchors that more than one document has. Only the texts at such anchors need be looked at again.

    Anchors go out in slices by hash, 32 bits of each, packed by bucket for up to `most` of them; a slice
    keeps those that come from two documents, or by chance seem to, which costs work but changes nothing.
    Anchors in hot slots are not asked about: they always count as shared.
    """

    def send(batches):
        import pyarrow as pa

        cut, held, n = _Runs(window, gram, hot, shared), [], 0

        def flush():
            bucket, code = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((code, bucket, code >> np.uint64(32)))
            bucket, code = bucket[order], code[order]
            new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])))
            at = np.flatnonzero(new)
            twice = np.diff(np.append(at, len(code))) > 1
            bucket, code = bucket[at], code[at]
            part = code >> np.uint64(32)
            head = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]))))
            ends = np.append(head[1:], len(code))
            low = code.astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(part[head].astype(np.int32)), pa.array(bucket[head].astype(np.int32)), pa.array([low[i:j].tobytes() for i, j in zip(head, ends, strict=True)], pa.binary()), pa.array([low[i:j][twice[i:j]].tobytes() for i, j in zip(head, ends, strict=True)], pa.binary())], ["slice", "bucket", "anchors", "twice"])

        for batch in batches:
            of, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, raw, *_ in cut.of(batch.column(3)):
                if ids[i] is None:
                    continue
                raw = np.unique(raw[~cut.is_hot(raw)])
                held.append((np.full(len(raw), of[i], np.int64), _code(raw, buckets)))
                n += len(raw)
                if n >= most:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def answer(batches):
        import pyarrow as pa

        def said(rows):
            keys = np.concatenate([np.frombuffer(k, np.uint32) for _, k, _ in rows])
            found, n = np.unique(keys, return_counts=True)
            common = np.union1d(found[n > 1], np.concatenate([np.frombuffer(k, np.uint32) for _, _, k in rows]))
            of = np.repeat(np.array([b for b, _, _ in rows]), [len(k) // 4 for _, k, _ in rows])
            hit = np.isin(keys, common)
            # a bucket's answer is one row, however many tasks asked for it
            both = np.unique(of[hit].astype(np.uint64) << np.uint64(32) | keys[hit].astype(np.uint64))
            bucket, low = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
            cut = np.flatnonzero(np.diff(bucket)) + 1
            return [(int(bucket[i]), here, low[i:j].tobytes()) for i, j in zip([0, *cut], [*cut, len(both)], strict=True)] if len(both) else []

        here, rows = None, []
        for batch in batches:
            out = []
            for part, bucket, keys, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != here and rows:
                    out += said(rows)
                    rows = []
                here = part
                rows.append((bucket, keys, twice))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "slice", "anchors"])
        if rows:
            out = said(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "slice", "anchors"])

    sent = docs.mapInArrow(send, "slice int, bucket int, anchors binary, twice binary")
    return sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(answer, "bucket int, slice int, anchors binary")


def shared_windows(docs: DataFrame, window: int, gram: int, buckets: int, hot: dict[int, int] | None = None, shared=None) -> DataFrame:
    """anchored_windows of docs (bucket, doc_id, version, text) without the runs of anchors that no other document has. A bucket of documents meets its shared anchors in one task."""

    def run(texts, anchors):
        import pyarrow as pa

        known = np.concatenate([np.frombuffer(k.as_py(), np.uint32).astype(np.uint64) | (np.uint64(t.as_py()) << np.uint64(32)) for t, k in zip(anchors.column("slice"), anchors.column("anchors"), strict=True)] or [np.empty(0, np.uint64)])
        known.sort()
        cut, out = _Runs(window, gram, hot, shared), []
        for batch in texts.to_batches():
            ids, versions = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "version"))
            for i, raw, keys, first, sizes, hashes in cut.of(batch.column(batch.schema.get_field_index("text"))):
                if ids[i] is None:
                    continue
                keep = cut.is_hot(raw)
                if len(known):
                    code = _code(raw, buckets)
                    keep |= known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
                if keep.any():
                    out.append((ids[i], versions[i], keys[keep], first[keep], sizes[keep], hashes[np.repeat(keep, sizes)]))
        return pa.Table.from_batches([_run_batch(out)])

    asked = shared_anchors(docs, window, gram, buckets, hot, shared)
    return docs.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, _RUN_SCHEMA)


def repeated_spans(docs: DataFrame, window: int = 13, gram: int = 4, most: int = 1 << 17, sample: int = _SAMPLE, shared=None, buckets: int = 8) -> DataFrame:
    """(doc_id, version, a, b): word spans [a, b) of docs (doc_id, text) that windows cover which also start in a document with a smaller doc_id.

    Runs whose anchor another document has too come together by anchor and ascending doc_id; of them,
    only the first document of each different window is held. An anchor of more than about `most`
    windows is split by the windows' hashes (see hot_anchors). Windows that the automaton of `shared`
    holds are left out.
    """

    def run(batches):
        import pyarrow as pa

        key, seen = None, {}
        for batch in batches:
            anchors, docs_, firsts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            n = len(anchors)
            if not n:
                continue
            start = np.concatenate(([True], anchors[1:] != anchors[:-1]))
            group = np.cumsum(start) - 1
            heads = np.flatnonzero(start)
            tails = np.append(heads[1:], n) - 1
            loop = docs_[heads] != docs_[tails]
            loop[0] = loop[-1] = True  # they may go on in another batch
            out = []
            for i in np.flatnonzero(loop[group]):
                if anchors[i] != key:
                    key, seen = anchors[i], {}
                doc, first, body = int(docs_[i]), int(firsts[i]), batch.column(3)[i].as_py()
                begin = -1
                for j in range(0, len(body), _KEPT):
                    if seen.setdefault(body[j : j + _KEPT], doc) < doc:
                        if begin < 0:
                            begin = j // _KEPT
                    elif begin >= 0:
                        out.append((doc, first + begin, first + j // _KEPT - 1 + window))
                        begin = -1
                if begin >= 0:
                    out.append((doc, first + begin, first + len(body) // _KEPT - 1 + window))
            if out:
                doc, a, b = (np.array(c, np.int64) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array((a >> 32).astype(np.int32)), pa.array((a & _PLACE).astype(np.int32)), pa.array((b & _PLACE).astype(np.int32))], ["doc_id", "version", "a", "b"])

    hot = hot_anchors(docs.where("doc_id is not null").select("doc_id", "text"), window, gram, most, sample)
    bucketed = docs if "bucket" in docs.columns else in_buckets(docs, buckets)
    runs = shared_windows(bucketed, window, gram, buckets, hot, shared)
    return runs.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(run, "doc_id long, version int, a int, b int")


def _held_starts(batch, held: Passages, first: np.ndarray, window: int) -> dict[int, np.ndarray]:
    """Row of a batch (doc_id, text, ...) -> starts of its windows that the automaton holds and a document with a smaller id has too."""
    out = {}
    ids = batch.column(0).to_pylist()
    for a, b, data, offsets in text_chunks(batch.column(1)):
        words, begins = hash_words(data, offsets)
        likely = held.likely(window_hashes(words, window))
        for i in range(b - a):
            some = likely[begins[i] : max(begins[i], begins[i + 1] - window + 1)]
            if ids[a + i] is not None and some.any():
                starts, states = held.windows(batch.column(1)[a + i].as_py(), some)
                if len(starts := starts[first[states] < ids[a + i]]):
                    out[a + i] = starts
    return out


def remove_repeats(docs: DataFrame, window: int = 13, passages: int = 4096, sample: int = 16, bucket_bytes: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, n_words, n_removed, kept (the words left, joined by a space).

    A word goes if a window of `window` words of its document covers it whose words also start in a
    document with a smaller id. Null text has no words; texts shorter than a window, and rows without
    id, lose none and take none; rows of one id do not take words from each other, each loses its own. An empty table gives no
    rows; other columns, whatever their names, are left out.

    The most frequent passages make a reference shard of bounded size (see frequent_passages), whose suffix
    automaton is broadcast: documents stream past it, once for the smallest doc_id of each of its windows,
    then to leave those windows out of the exchange, and at last to remove their spans. Of all other
    windows, those whose anchor a second document has are exchanged by it. Texts are exchanged once, by
    buckets of about bucket_bytes. Either way a window is found exactly once, whatever the shard holds.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    known = d.where("doc_id is not null")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a bucket is what one task holds of the texts at once
    buckets = max(32, size // bucket_bytes)
    bucketed = in_buckets(d, buckets)
    shared = with_first_documents(known, texts, window) if (texts := frequent_passages(known, window, 4, passages, sample)) else None
    gone = repeated_spans(bucketed, window, shared=shared, buckets=buckets).select(_bucket(buckets), "doc_id", "version", "a", "b")

    def run(texts, gone):
        import pyarrow as pa

        held, first = (_passages(shared), shared.value[3]) if shared else (None, None)
        # spans of a document lie side by side after the sort
        who = np.stack([gone.column(c).to_numpy() for c in ("doc_id", "version")], axis=1).astype(np.int64).reshape(-1, 2)
        order = np.lexsort((who[:, 1], who[:, 0]))
        who, a, b = who[order], gone.column("a").to_numpy()[order], gone.column("b").to_numpy()[order]
        heads = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]).any(axis=1)))) if len(who) else np.empty(0, np.int64)
        span_of = {(int(who[h, 0]), int(who[h, 1])): (h, t) for h, t in zip(heads, np.append(heads, len(who))[1:], strict=True)}
        out = []
        for batch in texts.select(["doc_id", "text", "version"]).to_batches():
            total, removed, kept = [], [], []
            here = _held_starts(batch, held, first, window) if held else {}
            for i, (doc, t, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True)):
                words = _WORDS.findall(t.as_py())
                total.append(len(words))
                spans = span_of.get((doc, v))
                if spans or i in here:
                    edge = np.zeros(len(words) + 1, np.int64)
                    if spans:
                        np.add.at(edge, a[slice(*spans)], 1)
                        np.add.at(edge, b[slice(*spans)], -1)
                    if i in here:
                        np.add.at(edge, here[i], 1)
                        np.add.at(edge, here[i] + window, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stay)]
                removed.append(total[-1] - len(words))
                kept.append(" ".join(words))
            out.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return bucketed.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("doc_id", id_col)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 13 words that a document with a smaller doc_id has too; a row per row of documents, null and empty texts without words."""
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle(window: int = 13) -> str:
    """DuckDB SQL of op10: the words of every window, and the smallest doc_id in which each starts."""
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM win JOIN firsts USING (s) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
