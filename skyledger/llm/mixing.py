"""Mixing sources to target weights: Sainte-Lague apportionment of near equal blocks of words, then a seeded choice of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import read, settle, text_of, word_count

#: Weights of the sources by code point, repeating; null comes last.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: (source, source_size, ...), a row per source. Adds weight and target.

    The targets are proportional to the weights and sum to share of all sizes, but stop at most times
    the source's size, the excess being shared again by weight. That level is found in one pass: in
    order of most * size / weight, sources are full until the level of the rest is below theirs.
    The windows run over one row per source.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(everything) - 1) % len(weights) + 1).cast("double")
    out = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    out = out.withColumn("goal", F.sum("source_size").over(all_rows) * F.lit(float(min(share, most))))
    out = out.withColumn("full_before", F.coalesce(F.sum("limit").over(upto), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    level = (F.col("goal") - F.col("full_before")) / F.col("weight_left")
    # the first source that its level does not fill sets the level of all after it
    free = F.when(level * F.col("weight") <= F.col("limit"), level)
    out = out.withColumn("level", F.first(free, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("target", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("limit")), F.col("limit"))).drop("goal", "full_before", "weight_left", "level", "limit")


#: Most words of a block; smaller sources have blocks of a fourth of it, and so on down to one word.
BLOCK_WORDS = 1024
#: Documents of a source's lot on average.
LOT_DOCS = 4096
#: More sources than this are joined by a shuffle instead of a broadcast.
FEW_SOURCES = 100_000


def source_key(source: str) -> Column:
    """A text that is never null and differs for different sources, null among them."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))


def block_quotas(targets: DataFrame, block_words: int | None = None, most: float = 2.0, shards: int = 8) -> DataFrame:
    """Adds block (words of a block), blocks (near equal blocks of the source), quota (block copies it gets), first_seat and shard_quotas.

    A source's block is the largest of 1024, 256, ... 1 words that gives it a hundred blocks, so a small
    source makes no small blocks for the others. The sources of one block size share its seats, which are
    their targets over block: they go to the highest quotients target / (2k + 1), ties by code point of
    the source. All but those near the natural divisor are certain, so about three rows per source are
    ranked, not one per block. Seats are dealt round the mix's shards in turn, which gives each shard an
    integer quota of each source. A source gets at most `most` copies of each of its blocks. The windows
    run over one row per source.
    """
    alike = Window.partitionBy("block")
    if block_words is None:
        sizes = [BLOCK_WORDS // 4**i for i in range(10) if 4**i < BLOCK_WORDS]
        block = F.coalesce(*[F.when(F.col("source_size") >= 100 * b, F.lit(b)) for b in sizes], F.lit(1))
    else:
        block = F.lit(block_words)
    t = targets.withColumn("block", block.cast("long"))
    t = t.withColumn("blocks", F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / F.col("block")))).otherwise(0).cast("long"))
    t = t.withColumn("cap", (F.col("blocks") * F.lit(int(most))).cast("long"))
    t = t.withColumn("goal", F.sum("target").over(alike)).withColumn("seats", F.least(F.round(F.col("goal") / F.col("block")).cast("long"), F.sum("cap").over(alike)))
    t = t.withColumn("natural", F.when(F.col("goal") > 0, F.col("target") * F.col("seats") / F.col("goal")).otherwise(F.lit(0.0)))
    slack = F.ceil(F.col("natural") / F.greatest(F.col("seats"), F.lit(1)) * F.count(F.lit(1)).over(alike)) + 2
    t = t.withColumn("sure", F.least(F.col("cap"), F.greatest(F.lit(0), F.floor("natural") - slack))).withColumn("upto", F.least(F.col("cap"), F.floor("natural") + slack + 2))
    t = settle(t.withColumn("key", source_key("source")).withColumn("open", F.col("seats") - F.sum("sure").over(alike)))
    open_seats = t.where("upto > sure").select("key", "source", "block", "open", "target", F.explode(F.expr("sequence(sure, upto - 1)")).alias("k"))
    rank = F.row_number().over(alike.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), "k"))
    won = open_seats.withColumn("rank", rank).where("rank <= open").groupBy("key").agg(F.count(F.lit(1)).alias("more"))
    t = t.join(won, "key", "left").withColumn("quota", (F.col("sure") + F.coalesce("more", F.lit(0))).cast("long"))
    t = t.withColumn("first_seat", (F.sum("quota").over(Window.orderBy(F.col("source").asc_nulls_last())) - F.col("quota")) % shards)
    counts = F.expr(f"transform(sequence(0, {shards - 1}), h -> cast(floor((quota + pmod(first_seat - h - 1, {shards})) / {shards}) as long))")
    return t.withColumn("shard_quotas", counts).select("key", "source", "source_size", "weight", "target", "block", "blocks", "quota", "first_seat", "shard_quotas")


def picked_words(shards: int, most: float) -> str:
    """SQL: array (words, seat) of a document's words [begin, begin + size) of its source's run in blocks that hold a seat.

    The first source_size mod blocks of the blocks are one word longer than the rest. Places are never
    multiplied by numbers of blocks, so nothing overflows at any size of a source; a block's number is
    multiplied by the permutation's factor as decimal.
    """
    long, short = "(source_size % blocks)", "(source_size div blocks)"
    of = lambda w: f"if({w} < {long} * ({short} + 1), ({w}) div ({short} + 1), {long} + (({w}) - {long} * ({short} + 1)) div greatest({short}, 1L))"
    at = lambda i: f"(({i}) * {short} + least({i}, {long}))"
    words = f"least(begin + size, {at('i + 1')}) - greatest(begin, {at('i')})"
    seat = "cast((cast(i as decimal(19, 0)) * cast(a as decimal(19, 0)) + b) % blocks as long)"
    each = f"transform(sequence(0L, {int(most) - 1}L), c -> named_struct('words', {words}, 'seat', {seat} + c * blocks))"
    spans = f"if(size > 0, sequence({of('begin')}, {of('begin + size - 1')}), cast(array() as array<bigint>))"
    return f"filter(flatten(transform({spans}, i -> {each})), x -> x.seat < quota)"


def _placed(docs: DataFrame, share: float, most: float, weights: tuple[int, ...], block_words: int | None, shards: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """mix_sources with source, lot and place."""
    # rows without id have their place by the text, or they would all lie in one
    place = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), F.lit("no id"), text_of(text_col))).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))
    d = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(source_col).alias("key"), word_count(text_col).alias("size"), place.alias("place")))
    plan = settle(d.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    few = F.broadcast if plan.count() <= FEW_SOURCES else lambda df: df
    cells = plan.select("key", (F.floor(F.col("docs") / LOT_DOCS) + 1).cast("long").alias("lots"))
    # A source's run of words is laid over lots of documents, so that no task orders a whole source.
    d = d.join(few(cells), "key").withColumn("lot", F.pmod(F.col("place"), F.col("lots"))).drop("lots")
    sums = settle(d.groupBy("key", "lot").agg(F.sum("size").alias("lot_size")))
    before = F.sum("lot_size").over(Window.partitionBy("key").orderBy("lot")) - F.col("lot_size")
    quotas = block_quotas(source_targets(plan.select("source", "source_size"), share, most, weights), block_words, most, shards)
    # odd multiplier made prime to the number of blocks: a large prime that does not divide it
    primes = (2_147_483_647, 1_000_000_007, 998_244_353)
    a = F.coalesce(*[F.when(F.col("blocks") % p != 0, F.lit(p)) for p in primes], F.lit(1)).cast("long")
    shift = F.pmod(F.xxhash64(F.lit(seed), F.lit("shift"), F.col("source")), F.greatest(F.col("blocks"), F.lit(1)))
    quotas = settle(quotas.withColumn("a", F.when(F.col("blocks") > 0, a % F.col("blocks")).otherwise(F.lit(1)).cast("long")).withColumn("b", shift).drop("source"))
    order = Window.partitionBy("key", "lot").orderBy("place", F.col("doc_id").asc_nulls_first(), "size")
    d = d.withColumn("in_lot", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # the rows already lie by key and lot: only the sums move
    d = d.join(sums.select("key", "lot", before.alias("lot_begin")), ["key", "lot"]).join(few(quotas), "key").withColumn("begin", F.col("lot_begin") + F.col("in_lot"))
    d = d.withColumn("picked", F.expr(picked_words(shards, most)))
    taken = F.expr("aggregate(picked, 0L, (n, x) -> n + x.words)")
    by_shard = F.expr(f"transform(sequence(0, {shards - 1}), h -> aggregate(filter(picked, x -> pmod(x.seat + first_seat, {shards}) = h), 0L, (n, x) -> n + x.words))")
    return d.select("doc_id", "source", "lot", "place", "size", "source_size", "target", taken.alias("taken"), by_shard.alias("shard_words"))


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block_words: int | None = None, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of docs once: id_col, size, source_size, target, taken, shard_words.

    size: words of the text (null: 0). A source's documents, in seeded order, form one run of words,
    cut into blocks; a seeded permutation i -> (i * a + b) mod blocks picks exactly the quota of
    them, each at most `most` times. taken: words of the document in picked blocks, repeats counted;
    shard_words: those words by shard of the mix. A null source is a source, after all others.
    Equal (id, source) rows are told apart by their size and otherwise share one place in the order:
    each counts. Rows without id are ordered by their text. Empty texts have no word and take none;
    other columns, whatever their names, are left out. Same rows and seed, same result. An empty table gives no rows.
    """
    d = _placed(docs, share, most, weights, block_words, shards, seed, id_col, text_col, source_col)
    return d.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken", "shard_words")


def whole_copies(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block_words: int | None = None, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source_col, copies): how often each document is written whole, so that a source's written words follow those that mix_sources takes of it.

    What rounding to whole copies leaves of the taken words is carried to the next document of the
    source's lot: long ones first, by powers of two of the size, then in seeded order, so that what a
    long one leaves goes to shorter ones. A document gets at most `most` copies; one without words gets
    one. Rows of one id and source have their copies in common; those without id stand once in the
    result for each source, with one copy, which the others of the lot make up for.
    """
    d = _placed(docs, share, most, weights, block_words, shards, seed, id_col, text_col, source_col)
    d = d.groupBy("source", "lot", "place", "doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    longest_first = F.when(F.col("doc_id").isNull(), F.lit(-64)).otherwise(-F.floor(F.log2(F.col("size") + 1))).cast("int")
    # a lot is bounded (see LOT_DOCS), so its rows may be folded as one array
    lots = d.groupBy("source", "lot").agg(F.array_sort(F.collect_list(F.struct(longest_first.alias("class"), "place", "doc_id", "size", "taken"))).alias("rows"))
    n = f"if(x.doc_id is null or x.size = 0, 1, cast(least({int(most)}L, greatest(0L, (2 * l + x.size) div (2 * x.size))) as int))"
    step = f"transform(array(s.left + x.taken), l -> transform(array({n}), n -> named_struct('left', l - n * x.size, 'copies', concat(s.copies, array(n))))[0])[0]"
    folded = F.expr(f"aggregate(rows, named_struct('left', 0L, 'copies', cast(array() as array<int>)), (s, x) -> {step}, s -> s.copies)")
    out = lots.select("source", F.explode(F.arrays_zip(F.col("rows.doc_id").alias("doc_id"), folded.alias("copies"))).alias("r"))
    return out.select(F.col("r.doc_id").alias(id_col), F.col("source").alias(source_col), F.col("r.copies").alias("copies"))


def op3_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; a row per row of documents, null and empty texts with none."""
    return mix_sources(read(spark, sf_dir, "documents"))
