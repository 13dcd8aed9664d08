"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until the splitters fit, then one exchange."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import read, settle, text_of

#: Key: 39 bits of the text's digest, then 24 of the document's. Boundaries above the low bits never part equal texts.
KEY_BITS, LOW_BITS = 63, 24
#: Bits by which a round refines the intervals that hold a splitter.
FIRST_BITS, STEP_BITS = 12, 9


def sort_key(text: Column, doc: Column) -> Column:
    part = lambda c, digits: F.conv(F.substring(F.md5(c.cast("binary")), 1, digits), 16, 10).cast("long")
    hi = F.shiftleft(F.shiftright(part(text, 10), 1), LOW_BITS)
    return hi.bitwiseOR(part(F.concat(F.lit("doc"), F.coalesce(doc, F.lit(""))), 6))


def find_splitters(keyed: DataFrame, cuts: int, every: int, tolerance: float = 0.002, group_tolerance: float = 0.05) -> dict[int, int]:
    """Cut -> key: the cuts - 1 keys that part `keyed` (skey, size) into ranges of near equal bytes.

    Each round counts the exact bytes of sub-intervals of the intervals which still hold a wanted
    position (at most cuts - 1 of them, so what reaches the driver is bounded by cuts * 2**STEP_BITS
    counts at any input size; the steps are smaller where there are many cuts). Every every-th cut is a
    shard's bound: it goes to the boundary between texts that is nearest to its position, or, if that is
    off by more than group_tolerance of a shard, to the nearest one between documents. The cuts within
    a shard only deal out the work: they are settled once within tolerance of a shard, and may part
    equal texts.
    """
    step_bits = max(3, STEP_BITS - max(0, cuts // 512).bit_length())
    old, width = KEY_BITS, KEY_BITS - FIRST_BITS
    inside, total, shard = {j: 0 for j in range(1, cuts)}, 0, 1.0
    active, below, found = keyed, {0: 0}, {}
    while inside:
        counts = active.groupBy(F.shiftright("skey", width).alias("b")).agg(F.sum("size").alias("s")).collect()
        of: dict[int, tuple[list[int], list[int]]] = {}  # interval -> boundaries with bytes, exact bytes below each and the end
        for b, s in sorted(counts):
            keys, under = of.setdefault(b >> (old - width), ([], [below[b >> (old - width)]]))
            keys.append(b)
            under.append(under[-1] + s)
        if old == KEY_BITS:
            total = of[0][1][-1] if of else 0
            shard = max(1.0, total * every / cuts)
        if not of:
            return {}
        wanted, below_next = inside, {}
        inside = {}
        for j, p in wanted.items():
            goal = total * j / cuts
            keys, under = of[p]
            at = min(max(0, bisect_right(under, goal) - 1), len(keys) - 1)
            lo, hi, b = under[at], under[at + 1], keys[at]
            allowed = tolerance if j % every else group_tolerance if width <= LOW_BITS else 0.0
            if width == 0 or min(goal - lo, hi - goal) <= allowed * shard:
                found[j] = (b if goal - lo <= hi - goal else b + 1) << width
            else:
                inside[j], below_next[b] = b, lo
        old, width, below = width, max(width - step_bits, LOW_BITS if width > LOW_BITS else 0), below_next
        if inside:
            some = keyed.sparkSession.createDataFrame([(p,) for p in below], "p long")
            active = keyed.join(F.broadcast(some), F.shiftright("skey", old) == F.col("p"), "left_semi")
    return found


def range_of(key: str, splitters: list[int]) -> Column:
    """How many splitters are at or below the key. Its first bits leave only a few to compare with."""
    if not splitters:
        return F.lit(0)
    shift = KEY_BITS - FIRST_BITS
    bounds = [bisect_left(splitters, p << shift) for p in range((1 << FIRST_BITS) + 1)]
    at = f"cast(shiftright({key}, {shift}) as int)"
    many = "array(" + ",".join(map(str, bounds)) + ")"
    all_of = "array(" + ",".join(f"{c}L" for c in splitters) + ")"
    lo, hi = f"element_at({many}, {at} + 1)", f"element_at({many}, {at} + 2)"
    return F.expr(f"{lo} + if({lo} = {hi}, 0, size(filter(slice({all_of}, {lo} + 1, {hi} - {lo}), c -> c <= {key})))")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int | None = None, tolerance: float = 0.002) -> DataFrame:
    """Every row of docs once: id_col, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 8 (null text: 8). Rows are put in the order of a key of
    text hash and document hash and cut into `shards` ranges of near equal bytes (law "bytes"), equal
    texts side by side. slot numbers a shard's rows from 0 without gaps, in key order; ties are
    ordered by the id (null first), then crc. grown_shard is null under this law. Repeated rows each
    get a slot. An empty table gives no rows. Other columns are ignored.

    The order is made in shards * ranges_per_shard ranges, so that no task sorts a whole shard.
    """
    spark = docs.sparkSession
    t = text_of(text_col)
    thin = settle(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + F.lit(8)).cast("long").alias("size"), F.crc32(t.cast("binary")).cast("long").alias("text_crc32"), sort_key(t, F.col(id_col).cast("string")).alias("skey")))
    if ranges_per_shard is None:
        ranges_per_shard = min(256, max(8, thin.count() // (shards * 200_000)))
    found = find_splitters(thin, shards * ranges_per_shard, ranges_per_shard, tolerance)
    splitters, bounds = sorted(set(found.values())), sorted(k for j, k in found.items() if j % ranges_per_shard == 0)
    shard_of = F.expr("array(" + ",".join(map(str, [0, *(bisect_right(bounds, k) for k in splitters)])) + ")")
    ranged = thin.withColumn("range", range_of("skey", splitters))
    order = Window.partitionBy("range").orderBy("skey", F.col("doc_id").asc_nulls_first(), "text_crc32")
    shard = F.element_at(shard_of, F.col("range") + 1).cast("int")
    # a row per range
    counts = ranged.groupBy("range").count().withColumn("shard", shard)
    begins = counts.select("range", "shard", (F.sum("count").over(Window.partitionBy("shard").orderBy("range")) - F.col("count")).alias("begin"))
    placed = ranged.withColumn("at", F.row_number().over(order) - F.lit(1))
    return placed.join(F.broadcast(begins), "range").select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op1_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of all documents under the law of near equal bytes; a row per row of documents."""
    return shard_documents(read(spark, sf_dir, "documents"))


def oracle(shards: int = 24, group_tolerance: float = 0.05) -> str:
    """DuckDB SQL of op1: the same keys in one order, each bound at the nearest boundary of texts, or of documents; checksums byte by byte."""
    return f"""WITH tab AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
raw AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
crc AS (SELECT x, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(x)), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc FROM (SELECT DISTINCT x, hex(encode(x)) AS h FROM raw), tab),
d AS MATERIALIZED (SELECT doc_id, strlen(x)::BIGINT + 8 AS size, crc, ('0x' || substr(md5(x), 1, 10))::BIGINT >> 1 AS hi, ('0x' || substr(md5('doc' || coalesce(doc_id::VARCHAR, '')), 1, 6))::BIGINT AS lo FROM raw JOIN crc USING (x)),
k AS MATERIALIZED (SELECT *, (hi << {LOW_BITS}) | lo AS skey FROM d),
total AS (SELECT sum(size) AS total FROM d), cuts AS (SELECT j, total * j / {float(shards)}::DOUBLE AS goal, total / {float(shards)}::DOUBLE AS shard FROM total, range(1, {shards}) r(j)),
tg AS (SELECT hi, sum(s) OVER (ORDER BY hi) - s AS below, s FROM (SELECT hi, sum(size) AS s FROM k GROUP BY 1)),
dg AS (SELECT skey, sum(s) OVER (ORDER BY skey) - s AS below, s FROM (SELECT skey, sum(size) AS s FROM k GROUP BY 1)),
c AS (SELECT j, CASE WHEN least(goal - tg.below, tg.below + tg.s - goal) <= {group_tolerance} * shard THEN CASE WHEN goal - tg.below <= tg.below + tg.s - goal THEN hi ELSE hi + 1 END << {LOW_BITS}
  ELSE CASE WHEN goal - dg.below <= dg.below + dg.s - goal THEN skey ELSE skey + 1 END END AS cut FROM cuts JOIN tg ON goal >= tg.below AND goal < tg.below + tg.s JOIN dg ON goal >= dg.below AND goal < dg.below + dg.s),
p AS (SELECT k.*, (SELECT count(*) FROM c WHERE cut <= k.skey)::INT AS shard FROM k)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY skey, doc_id NULLS FIRST, crc) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p"""
