"""Near-duplicates by consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import PLAIN_BYTES, hash_words, mix, read, settle, text_chunks, text_of, window_hashes
from skyledger.llm.components import components


@dataclass(frozen=True)
class NearParams:
    """shingle words; least similarity; bands of rows each: a pair of similarity s shares a band with 1 - (1 - s**rows)**bands (0.997 at 0.8).
    Of a document's samples the first bands * rows make up its bands. Pairs that no leader has settled are
    compared only if a share `agree` of all samples is equal: at a similarity of 0.8, one pair in ten
    thousand has fewer; at 0.35, as common passages give, almost none has as many. They are compared in
    blocks of about block_bytes of text.

    The document frequencies are counted in idf_slots hashed slots (4 bytes each), as in hashed TF-IDF: a
    bounded table at any input size, whose error is a fixed share of the documents. The idf is
    ln(N / df) / ln(rare), kept within [idf_floor, 1]: what is in fewer than one of `rare` documents
    weighs 1, and what a large group of copies shares still weighs idf_floor, so that a large group's
    links don't fall below the threshold merely because it is large.
    """

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 8
    rows: int = 3
    samples: int = 64
    agree: float = 0.625
    block_bytes: int = 1 << 20
    idf_slots: int = 1 << 20
    idf_floor: float = 0.75
    rare: float = 1000.0
    seed: int = 1


_SLICE = 1 << 12
_TABLE = 1 << 16


def shingles(column, p: NearParams):
    """For each text of an Arrow string array the distinct shingle hashes and their counts. Words are lower-cased and bare of ASCII punctuation; a text of fewer words than a shingle is one shingle, a text without words has none."""
    import pyarrow.compute as pc

    low = pc.utf8_lower(column)
    for a, b, data, offsets in text_chunks(low):
        words, begins = hash_words(data, offsets, PLAIN_BYTES)
        grams = window_hashes(words, p.shingle)
        for i in range(b - a):
            s, e = begins[i], begins[i + 1]
            if e - s >= p.shingle:
                yield np.unique(grams[s : e - p.shingle + 1], return_counts=True)
            elif e > s:
                yield mix(np.array([int(words[s:e].sum()) ^ (int(e - s) << 1)], np.uint64)), np.ones(1, np.int64)
            else:
                yield np.empty(0, np.uint64), np.empty(0, np.int64)


def document_frequencies(docs: DataFrame, p: NearParams) -> np.ndarray:
    """idf per slot, as float32. Each task adds up its own slots; slices of them are then summed by slice, and only the finished table (4 bytes a slot) reaches the driver."""
    slices = p.idf_slots // _SLICE

    def count(batches):
        import pyarrow as pa

        table, n = np.zeros(p.idf_slots, np.int32), 0
        for batch in batches:
            n += batch.num_rows
            for h, _ in shingles(batch.column(0), p):
                table[(h & np.uint64(p.idf_slots - 1)).astype(np.int64)] += 1
        if n:
            rows = table.reshape(slices, _SLICE)
            some = np.flatnonzero(rows.any(axis=1))
            packed = [(np.flatnonzero(r := rows[i]).astype(np.int32).tobytes(), r[r > 0].tobytes()) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array([x for x, _ in packed] + [b""], pa.binary()), pa.array([x for _, x in packed] + [np.int64(n).tobytes()], pa.binary())], ["slice", "at", "n"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for i, at, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if i < 0:
                    n += int(np.frombuffer(c, np.int64)[0])
                else:
                    sums.setdefault(i, np.zeros(_SLICE, np.int64))[np.frombuffer(at, np.int32)] += np.frombuffer(c, np.int32)
        if n:
            sums[-1] = np.array([n], np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "n"])

    spread = docs.select(text_of()).mapInArrow(count, "slice int, at binary, n binary").repartition("slice")
    table, n = np.zeros((slices, _SLICE), np.int64), 0
    for r in spread.mapInArrow(add, "slice int, n binary").collect():
        if r["slice"] < 0:
            n += int(np.frombuffer(r["n"], np.int64)[0])
        else:
            table[r["slice"]] = np.frombuffer(r["n"], np.int64)
    return np.clip(np.log(max(n, 1) / np.maximum(table.ravel(), 1)) / np.log(p.rare), p.idf_floor, 1).astype(np.float32)


def _sampler(p: NearParams):
    """Random tables of consistent weighted sampling: r and c of Gamma(2, 1), beta uniform, drawn by an element's hash and the sample's number."""
    rng = np.random.default_rng(p.seed)
    k = p.samples
    r = rng.gamma(2.0, 1.0, _TABLE).astype(np.float32) + np.float32(1e-6)
    return r, np.log(rng.gamma(2.0, 1.0, _TABLE) + 1e-12).astype(np.float32), rng.random(_TABLE).astype(np.float32), (rng.integers(1, 1 << 62, k, np.uint64) << np.uint64(1)) | np.uint64(1)


def signature(h: np.ndarray, weight: np.ndarray, tables, block: int = 1 << 13) -> np.ndarray:
    """One 64-bit sample per number: equal for two weighted sets with the probability of their weighted Jaccard similarity."""
    r_of, c_of, beta_of, odd = tables
    best, out = np.full(len(odd), np.inf, np.float32), np.zeros(len(odd), np.uint64)
    for at in range(0, len(h), block):
        x, s = h[at : at + block], np.log(weight[at : at + block])
        slot = ((x[None, :] * odd[:, None]) >> np.uint64(48)).astype(np.int32)
        r, beta = r_of[slot], beta_of[slot]
        t = np.floor(s[None, :] / r + beta)
        # ln a = ln c - ln y - r with ln y = r (t - beta)
        a = c_of[(slot * 40503 + 12345) & (_TABLE - 1)] - r * (t - beta + 1)
        i = a.argmin(axis=1)
        row = np.arange(len(odd))
        low = a[row, i]
        new = low < best
        best = np.where(new, low, best)
        out = np.where(new, mix(x[i] ^ (t[row, i].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), out)
    return out


def signatures(docs: DataFrame, idf, p: NearParams) -> DataFrame:
    """docs (doc_id, text) -> doc_id, digest (of the text), bands (hashes), sample (8 bits of each sample, packed into longs). Texts without words have null bands."""
    rows = p.rows

    def run(batches):
        import pyarrow as pa

        tables, weights = _sampler(p), idf.value
        for batch in batches:
            bands, samples = [], []
            for h, n in shingles(batch.column(2), p):
                if not len(h):
                    bands.append(None), samples.append(None)
                    continue
                sig = signature(h, n * weights[(h & np.uint64(len(weights) - 1)).astype(np.int64)], tables)
                band = np.zeros(p.bands, np.uint64)
                for j in range(rows):
                    band = mix(band * np.uint64(31) + sig[j : p.bands * rows : rows])
                bands.append(band.astype(np.int64))
                samples.append((sig & np.uint64(255)).astype(np.uint8).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64())), pa.array(samples, pa.list_(pa.int64()))], ["doc_id", "digest", "bands", "sample"])

    return docs.select(F.col("doc_id").cast("long"), F.md5(text_of().cast("binary")).alias("digest"), text_of()).mapInArrow(run, "doc_id long, digest string, bands array<long>, sample array<long>")


def texts_of(docs: DataFrame, ids: DataFrame, most: int = 500_000) -> DataFrame:
    """Rows of docs whose doc_id is in ids (w): by broadcast while that is at most 8 bytes for each of `most` ids, else by a shuffled join."""
    side = F.broadcast(ids) if ids.count() <= most else ids.hint("shuffle_hash")
    return docs.join(side, docs.doc_id == F.col("w"), "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, idf, p: NearParams, lot: int = 512) -> DataFrame:
    """pairs (a, b) -> (a, b, similarity), the exact weighted Jaccard similarity of the whole texts.

    Each text goes to the partitions of the a's it is compared with. A hot a is copied to one place for
    every `lot` partners; there only a's shingles are held, and the partners pass by.
    """
    spread = settle(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(lot)).cast("int").alias("lots")))
    to_b = pairs.join(spread, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"), F.lit(1).alias("role"))
    to_a = spread.select(F.col("a").alias("id"), "a", F.explode(F.expr("sequence(0, lots - 1)")).alias("lot"), F.lit(0).alias("role"))
    sent = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).join(to_a.unionByName(to_b).hint("shuffle_hash"), "id")
    # by the text's hash too: of several texts of one id the same one is held in every run
    near = sent.select("a", "lot", "role", "id", "text", F.xxhash64("text").alias("h")).repartition("a", "lot").sortWithinPartitions("a", "lot", "role", "id", "h")

    def run(batches):
        import pyarrow as pa

        weights, key, h0, w0, t0 = idf.value, None, None, None, 0.0
        for batch in batches:
            a, lots, role, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out_a, out_b, out_s = [], [], []
            for i, (h, n) in enumerate(shingles(batch.column(4), p)):
                w = n * weights[(h & np.uint64(len(weights) - 1)).astype(np.int64)].astype(np.float64)
                if role[i] == 0:
                    key, h0, w0, t0 = (a[i], lots[i]), h, w, w.sum()
                    continue
                if key != (a[i], lots[i]):
                    continue
                at = np.searchsorted(h0, h)
                at[at == len(h0)] = 0
                same = h0[at] == h if len(h0) else np.zeros(len(h), bool)
                both = np.minimum(w0[at[same]], w[same]).sum() if len(h0) else 0.0
                out_a.append(a[i]), out_b.append(ids[i]), out_s.append(both / max(1e-12, t0 + w.sum() - both))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_s, pa.float64())], ["a", "b", "similarity"])

    return near.mapInArrow(run, "a long, b long, similarity double")


class _Held:
    """The texts of one block, with their samples; finds the links of a further text to them that join two classes."""

    def __init__(self, p: NearParams):
        self.p, self.n, self.merged = p, 0, {}
        self.h: list[np.ndarray] = []
        self.w: list[np.ndarray] = []
        self.id, self.cls = (np.zeros(64, np.int64) for _ in range(2))
        self.low, self.high, self.total = (np.zeros(64) for _ in range(3))
        self.bands, self.sample = np.zeros((64, p.bands), np.int64), np.zeros((64, p.samples), np.uint8)

    def class_of(self, c: int) -> int:
        while c in self.merged:
            c = self.merged[c]
        return c

    def add(self, row, h, w) -> None:
        if self.n == len(self.id):
            for k in ("id", "cls", "low", "high", "total", "bands", "sample"):
                x = getattr(self, k)
                setattr(self, k, np.concatenate([x, np.zeros_like(x)]))
        i = self.n
        self.id[i], self.cls[i], self.low[i], self.high[i], self.bands[i], self.sample[i] = row["id"], self.class_of(row["class_id"]), row["low"], row["high"], row["bands"], row["sample"]
        self.total[i] = w.sum()
        self.h.append(h), self.w.append(w)
        self.n += 1

    def links(self, row, h, w):
        p, n, c, t = self.p, self.n, self.class_of(row["class_id"]), w.sum()
        apart = np.maximum(self.low[:n] - row["high"], row["low"] - self.high[:n]) > 1 - p.similarity + 1e-9
        size = np.minimum(self.total[:n], t) < (p.similarity - 1e-9) * np.maximum(self.total[:n], t)
        at = np.flatnonzero((self.cls[:n] != c) & ~apart & ~size)
        common = self.bands[at] == row["bands"]
        # a pair counts in its first common band: in the group of another leader it is seen elsewhere
        at = at[common.any(axis=1) & ((row["mask"] >> common.argmax(axis=1)) & 1 == 1)]
        agree = (self.sample[at] == row["sample"]).sum(axis=1)
        enough = agree >= p.agree * p.samples
        at = at[enough][np.argsort(-agree[enough], kind="stable")]
        for s in range(0, len(at), 64):
            part = at[s : s + 64]
            part = part[self.cls[part] != c]
            if not len(part):
                continue
            owner = np.repeat(np.arange(len(part)), [len(self.h[i]) for i in part])
            hs, ws = np.concatenate([self.h[i] for i in part]), np.concatenate([self.w[i] for i in part])
            pos = np.searchsorted(h, hs)
            pos[pos == len(h)] = 0
            same = h[pos] == hs
            both = np.bincount(owner[same], np.minimum(w[pos[same]], ws[same]), len(part))
            for i in part[both / np.maximum(1e-12, self.total[part] + t - both) >= p.similarity]:
                if self.cls[i] != c:
                    yield int(self.id[i])
                    old = int(self.cls[i])
                    self.merged[old] = c
                    self.cls[:n][self.cls[:n] == old] = c


def links_within(rest: DataFrame, texts: DataFrame, idf, p: NearParams) -> DataFrame:
    """rest (leader, id, class_id, low, high, mask), texts (id, text, bands, sample) -> links (a, b), enough to join all classes that pairs of one leader's group join.

    low and high bound the similarity to the leader; mask has a bit for each band in which it leads. A group
    is dealt to blocks by hash, so that a block has about p.block_bytes of text, and each two blocks meet in
    one place: there one block is held and the other passes by. Pairs are never rows: what leaves a place is
    fewer links than it has texts. Each text is copied once for each block of its group.
    """
    sizes = rest.select("leader", "id").join(texts.select("id", F.octet_length("text").alias("bytes")), "id")
    blocks = settle(sizes.groupBy("leader").agg(F.ceil(F.sum("bytes") / F.lit(p.block_bytes)).cast("int").alias("blocks")))
    own = rest.join(blocks, "leader").withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.greatest("blocks", F.lit(1))).cast("int"))
    sent = own.withColumn("other", F.explode(F.expr("sequence(0, greatest(blocks, 1) - 1)"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    sent = sent.withColumn("role", (F.col("own") > F.col("other")).cast("int")).drop("own", "other", "blocks")
    columns = ("leader", "i", "j", "role", "id", "class_id", "low", "high", "mask", "bands", "sample", "text")
    met = texts.join(sent.hint("shuffle_hash"), "id").select(*columns).repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "role", "id")

    def run(batches):
        import pyarrow as pa

        weights, key, held = idf.value, None, None
        for batch in batches:
            flat = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns[:9])}
            flat["bands"] = batch.column(9).flatten().to_numpy().reshape(-1, p.bands)
            flat["sample"] = np.ascontiguousarray(batch.column(10).flatten().to_numpy()).view(np.uint8).reshape(-1, p.samples)
            out_a, out_b = [], []
            for k, (h, n) in enumerate(shingles(batch.column(11), p)):
                row = {c: v[k] if c in ("bands", "sample") else v[k].item() for c, v in flat.items()}
                if key != (row["leader"], row["i"], row["j"]):
                    key, held = (row["leader"], row["i"], row["j"]), _Held(p)
                w = n * weights[(h & np.uint64(len(weights) - 1)).astype(np.int64)].astype(np.float64)
                if held.n and (row["role"] or row["i"] == row["j"]):
                    for other in held.links(row, h, w):
                        out_a.append(min(other, row["id"])), out_b.append(max(other, row["id"]))
                if not row["role"]:
                    held.add(row, h, w)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, p: NearParams = NearParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, class_id (smallest doc_id of its class; itself if alone), copy_of (smallest doc_id of equal text), class_size.

    Two documents are linked if the weighted Jaccard similarity of their shingles is p.similarity or
    more; classes are what links connect. Equal texts are one node, whatever their number. In a band's
    bucket all are compared with the smallest id, the leader, not with each other. As 1 - similarity is
    a metric, a and b can be linked only if their distances from the leader differ by at most
    1 - p.similarity; such pairs in different classes are then compared too, in blocks, unless their samples
    exclude it (see NearParams.agree). So no bucket is capped, no pairs of a bucket are written as rows,
    and no link between classes is lost.

    Null text is the empty text; texts without words match only by equality. Null ids are alone, with
    null class_id. Rows with one id are one document: all of them are returned, and their texts linked.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    idf = spark.sparkContext.broadcast(document_frequencies(d, p))
    sigs = settle(signatures(d, idf, p))
    classes = settle(sigs.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sample").alias("sample")))
    members = classes.where("id is not null and bands is not null").select("id", F.posexplode("bands").alias("band", "h"))
    buckets = settle(members.groupBy("band", "h").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    inside = settle(members.join(buckets, ["band", "h"]).select("id", "leader", "band", "h"))
    stars = settle(inside.where("id <> leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.lit(1).alias("one")).select("a", "b"))
    compared = settle(verify(stars, d, idf, p))
    links = compared.where(F.col("similarity") >= p.similarity).select("a", "b")
    found = components(links)
    # pairs that no leader has shown to be linked or apart
    known = compared.select(F.col("a").alias("leader"), F.col("b").alias("id"), "similarity")
    placed = inside.join(known, ["leader", "id"], "left").withColumn("similarity", F.when(F.col("id") == F.col("leader"), 1.0).otherwise(F.col("similarity")))
    placed = settle(placed.join(found, "id", "left").withColumn("class_id", F.coalesce("class_id", "id")))
    mixed = settle(placed.groupBy("band", "h").agg(F.min("class_id").alias("c0"), F.max("class_id").alias("c1"), F.count(F.lit(1)).alias("m")).where("c0 <> c1 and m > 2").select("band", "h"))
    rest = placed.where(F.col("id") != F.col("leader")).join(mixed, ["band", "h"], "left_semi")
    rest = settle(rest.groupBy("leader", "id").agg(F.first("class_id").alias("class_id"), F.min("similarity").alias("low"), F.max("similarity").alias("high"), F.expr("bit_or(shiftleft(1L, band))").alias("mask")))
    wanted = settle(rest.select(F.col("id").alias("w")).distinct())
    if wanted.limit(1).count():
        texts = texts_of(d, wanted).select("doc_id", text_of().alias("text"), F.md5(text_of().cast("binary")).alias("digest"))
        texts = settle(texts.join(classes.where("bands is not null").join(wanted, F.col("id") == F.col("w"), "left_semi"), "digest").where("doc_id = id").select("id", "text", "bands", "sample"))
        links = settle(links.unionByName(links_within(rest, texts, idf, p)))
        found = components(links)
    whole = sigs.join(classes.select("digest", "id"), "digest").join(found, "id", "left")
    whole = settle(whole.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("copy_of")))
    sizes = whole.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return whole.join(sizes, "class_id", "left").select(F.col("doc_id").alias(id_col), "class_id", "copy_of", F.coalesce("class_size", F.lit(1)).alias("class_size"))


def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document; a row per row of documents. Null and empty texts are one class; other columns are left out."""
    return near_duplicates(read(spark, sf_dir, "documents"))
