"""Document fingerprints as invertible Bloom lookup sketches: cells of hashed paragraphs subtract, and peeling recovers the digests that differ, with larger sketches where it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import parts, read, text_of

#: Cells: TABLES tables of SIZE; a digest lies in one cell of each. A digest is 42 bits of hash, then 20 check bits.
TABLES, SIZE, CHECK = 3, 8, 20
CELLS = TABLES * SIZE
#: Digests of both sides per sketch on average when sketches are made larger.
LOAD = 6
#: Code points of a paragraph; a longer line is cut.
LONGEST = 128
#: Bytes of a lot of the order, and how many lots there are at most; beyond that lots grow.
LOT_BYTES, MOST_LOTS = 1 << 26, 1 << 14
#: Factors of the check bits.
_A, _B = 0x9E3779B97F | 1, 0x85EBCA6B5D | 1


def check_bits(k: str) -> str:
    """SQL: 20 bits of the products of a hash's halves; products carry, so the check of two digests' exclusive or is not that of either."""
    return f"(shiftright((shiftright({k}, 21) * {_A}L) ^ (({k} & 2097151L) * {_B}L), 18) & {(1 << CHECK) - 1}L)"


def digests(text: str) -> str:
    """SQL: the distinct digests of a text's paragraphs. A paragraph is a line; a longer one is cut every LONGEST code points, empty ones don't count."""
    key = f"transform(array(shiftright(cast(conv(substr(md5(cast(p as binary)), 1, 11), 16, 10) as bigint), 2)), k -> shiftleft(k, {CHECK}) | {check_bits('k')})[0]"
    return f"array_distinct(transform(regexp_extract_all({text}, '[^\\\\n]{{1,{LONGEST}}}', 0), p -> {key}))"


def lying(keys: str, table: int) -> str:
    """SQL: those of an array of digests that lie in cell j of a table."""
    return f"filter({keys}, x -> (shiftright(x, {CHECK + 3 * table}) & {SIZE - 1}) = j)"


def _per_cell(keys: str, f: str) -> str:
    return "concat(" + ", ".join(f"transform(sequence(0L, {SIZE - 1}L), j -> {f.format(lying(keys, t))})" for t in range(TABLES)) + ")"


def sketch(keys: str) -> str:
    """SQL: the cells (n, x) of an array of digests: their number and exclusive or."""
    return _per_cell(keys, "transform(array({}), f -> named_struct('n', size(f), 'x', aggregate(f, 0L, (a, x) -> a ^ x)))[0]")


def xors(keys: str) -> str:
    """SQL: a sketch without the numbers."""
    return _per_cell(keys, "aggregate({}, 0L, (a, x) -> a ^ x)")


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> p ^ q)"


def peel(cells: str) -> str:
    """SQL: struct (keys, ok): the digests that the two sides of a difference don't share, and whether all came out.

    A cell with one digest left is known by its check bits. Each round takes all such digests out of their cells.
    """
    pure = f"array_distinct(filter(s.c, x -> x <> 0L and (x & {(1 << CHECK) - 1}L) = {check_bits(f'shiftright(x, {CHECK})')}))"
    at = ", ".join(f"'p{t}', {t * SIZE} + cast(shiftright(k, {CHECK + 3 * t}) & {SIZE - 1} as int)" for t in range(TABLES))
    hit = " or ".join(f"i = q.p{t}" for t in range(TABLES))
    taken = f"aggregate(f, s.c, (z, k) -> transform(array(named_struct({at})), q -> transform(z, (x, i) -> if({hit}, x ^ k, x)))[0])"
    step = f"if(s.done, s, transform(array({pure}), f -> if(size(f) = 0, named_struct('c', s.c, 'k', s.k, 'done', true), named_struct('c', {taken}, 'k', concat(s.k, f), 'done', false)))[0])"
    start = f"named_struct('c', {cells}, 'k', cast(array() as array<bigint>), 'done', false)"
    return f"aggregate(sequence(1, {CELLS}), {start}, (s, n) -> {step}, s -> named_struct('keys', s.k, 'ok', not exists(s.c, x -> x <> 0L) and size(array_distinct(s.k)) = size(s.k)))"


def differing(a: str, b: str, cells: str, larger: str) -> str:
    """SQL: the digests peeled from the difference `cells` of the sketches of a and b, or `larger` where their number can't be right or some did not come out."""
    right = f"r.ok and size(r.keys) % 2 = (size({a}) + size({b})) % 2 and size(r.keys) >= abs(size({a}) - size({b}))"
    return f"transform(array({peel(cells)}), r -> if({right}, r.keys, {larger}))[0]"


def peel_larger(a: str, b: str) -> str:
    """SQL: the digests that a and b don't share, by larger sketches: one of CELLS cells for each LOAD digests, by hash, of either side.

    Digests are dealt to their sketches in two steps, so that the work grows nearly in proportion to their
    number. A part that still fails has its sketches made 8 times larger; digests that share all their
    cells even there are compared themselves.
    """
    side = f"cast(ceil(sqrt((size({a}) + size({b})) / {float(LOAD)})) as int)"
    deal = lambda keys, shift, n: f"transform(sequence(0L, {n} - 1L), d -> filter({keys}, x -> pmod(shiftright(x, {shift}) & 4095L, {n}) = d))"
    met = lambda x, y, larger: differing(x, y, subtract(xors(x), xors(y)), larger)
    plain = "concat(array_except(x3, y3), array_except(y3, x3))"
    third = f"flatten(zip_with({deal('x2', CHECK + 33, '8L')}, {deal('y2', CHECK + 33, '8L')}, (x3, y3) -> {met('x3', 'y3', plain)}))"
    second = f"flatten(zip_with({deal('x1', CHECK + 21, 'g')}, {deal('y1', CHECK + 21, 'g')}, (x2, y2) -> if(size(x2) + size(y2) = 0, cast(array() as array<bigint>), {met('x2', 'y2', third)})))"
    return f"transform(array({side}), g -> flatten(zip_with({deal(a, CHECK + 9, 'g')}, {deal(b, CHECK + 9, 'g')}, (x1, y1) -> {second})))[0]"


def with_difference(df: DataFrame, out: str, a: str, b: str, cells_a: str, cells_b: str) -> DataFrame:
    """Adds out, the digests of the one or the other side alone, peeled from the difference of their sketches."""
    return df.withColumn(out, F.expr(differing(a, b, subtract(cells_a, cells_b), peel_larger(a, b))))


def likeness(a: str, b: str, differ: str) -> Column:
    """The share of digests that both have, of all that either has (1 if neither has any)."""
    n = F.size(a) + F.size(b)
    return F.when(n > 0, (n - F.size(differ)) / (n + F.size(differ))).otherwise(1.0)


def text_form(cells: str) -> str:
    """SQL: a sketch as a string of number:digests for each cell."""
    return f"array_join(transform({cells}, c -> concat(hex(c.n), ':', hex(c.x))), '.')"


def _lot_of(bounds: list[int]) -> Column:
    """How many bounds are below doc_id, by blocks of 128 of them."""
    if not bounds:
        return F.lit(0)
    longs = lambda some: "array(" + ",".join(f"{b}L" for b in some) + ")"
    if len(bounds) <= 128:
        return F.expr(f"size(filter({longs(bounds)}, b -> b < doc_id))")
    first = f"size(filter({longs(bounds[127::128])}, b -> b < doc_id))"
    return F.expr(f"transform(array({first}), g -> g * 128 + size(filter(slice({longs(bounds)}, g * 128 + 1, 128), b -> b < doc_id)))[0]")


def with_next(docs: DataFrame, lots: int | None = None) -> DataFrame:
    """docs (doc_id, text) with `own`, the digests of the text, and `next`, text and digests of the next row by descending doc_id (nulls last, ties by the text's hash); the last one's is the first's.

    Rows are dealt to lots by quantiles of doc_id, as many as the texts' bytes ask for; a lot's first text
    is the next of the lot above it, so no task orders more than a lot.
    """
    if lots is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        lots = min(MOST_LOTS, max(2 * parts(docs.sparkSession), size // LOT_BYTES))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / lots for i in range(1, lots)], max(10_000, 20 * lots))).first()[0] or []
    d = docs.withColumn("own", F.expr(digests("text"))).withColumn("lot", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_lot_of(sorted(set(bounds))))).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lot").orderBy(F.col("doc_id").desc_nulls_last(), "h")
    first = d.groupBy("lot").agg(F.max_by("text", F.struct(F.coalesce("doc_id", F.lit(0)), F.bitwise_not("h"))).alias("text"))
    # at most lots + 1 rows
    below = Window.orderBy("lot")
    edges = first.select((F.coalesce(F.lead("lot").over(below), F.min("lot").over(Window.partitionBy()))).alias("edge_of"), F.struct("text", F.expr(digests("text")).alias("own")).alias("edge"))
    d = d.withColumn("next", F.lead(F.struct("text", "own")).over(order))
    return d.join(edges.hint("shuffle_hash"), F.col("lot") == F.col("edge_of"), "left").withColumn("next", F.coalesce("next", "edge")).drop("edge", "edge_of", "h", "lot")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_differs.

    Null text is the empty text, which has no paragraph. A fingerprint has one size for all texts, and
    equal texts have equal ones; likeness comes from subtracting two of them and peeling, with larger
    sketches of the same texts where that fails. edited_differs: the paragraph digests, so recovered, that
    the text or its edited text has alone. Rows of one id each have their place in the order; an empty
    table gives no rows; other columns, whatever their names, are left out.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    d = with_next(d)
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next.text", F.lit(1), half)))
    d = d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", F.col("next.own").alias("after"), F.expr(digests("edited")).alias("edit"))
    d = d.withColumn("own_cells", F.expr(sketch("own"))).withColumn("edit_cells", F.expr(sketch("edit")))
    d = with_difference(d, "edited_differs", "own", "edit", "own_cells.x", "edit_cells.x")
    d = with_difference(d, "next_differs", "own", "after", "own_cells.x", xors("after"))
    return d.select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", F.expr(text_form("own_cells")).alias("fingerprint"), F.expr(text_form("edit_cells")).alias("edited_fingerprint"),
        likeness("own", "edit", "edited_differs").alias("near_edited"), likeness("own", "after", "next_differs").alias("near_next"), "edited_differs",
    )


def op5_invertible_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; n_differ counts the digests that peeling recovers between the two. Null and empty texts have no digest."""
    return fingerprints(read(spark, sf_dir, "documents")).withColumn("n_differ", F.size("edited_differs").cast("long")).drop("edited_differs")


def oracle() -> str:
    """DuckDB SQL of op5: digests as sets, cells by grouping, likeness by counting what both sides have."""
    check = f"(xor((h >> 21) * {_A}, (h & 2097151) * {_B}) >> 18) & {(1 << CHECK) - 1}"
    keys = f"SELECT DISTINCT doc_id, v, ((h << {CHECK}) | ({check})) AS k FROM (SELECT doc_id, v, CAST('0x' || substr(md5(p), 1, 11) AS BIGINT) >> 2 AS h FROM (SELECT doc_id, v, unnest(regexp_extract_all(t, '[^\n]{{1,{LONGEST}}}')) AS p FROM sides))"
    cell = " UNION ALL ".join(f"SELECT doc_id, v, {t * SIZE} + ((k >> {CHECK + 3 * t}) & {SIZE - 1}) AS c, k FROM keys" for t in range(TABLES))
    like = lambda b: f"CASE WHEN own.n + {b}.n > 0 THEN m{b} / (own.n + {b}.n - m{b}) ELSE 1.0 END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS u,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM documents),
e AS (SELECT doc_id, next_id, t, substr(t, 1, length(t) - length(t) // 2) || substr(u, 1, length(t) // 2) AS x FROM d),
sides AS (SELECT doc_id, 'own' AS v, t FROM e UNION ALL SELECT doc_id, 'edit', x FROM e),
keys AS MATERIALIZED ({keys}),
cells AS (SELECT doc_id, v, c, count(*) AS n, bit_xor(k) AS x FROM ({cell}) GROUP BY ALL),
grid AS (SELECT doc_id, v, c FROM sides, range({CELLS}) g(c)),
prints AS (SELECT doc_id, v, string_agg(printf('%X:%X', coalesce(n, 0), coalesce(x, 0)), '.' ORDER BY c) AS f FROM grid LEFT JOIN cells USING (doc_id, v, c) GROUP BY ALL),
sizes AS (SELECT doc_id, v, count(k) AS n FROM sides LEFT JOIN keys USING (doc_id, v) GROUP BY ALL),
m AS (SELECT e.doc_id, (SELECT count(*) FROM keys a JOIN keys b ON a.k = b.k WHERE a.doc_id = e.doc_id AND b.doc_id = e.doc_id AND a.v = 'own' AND b.v = 'edit') AS medit,
  (SELECT count(*) FROM keys a JOIN keys b ON a.k = b.k WHERE a.doc_id = e.doc_id AND b.doc_id = e.next_id AND a.v = 'own' AND b.v = 'own') AS mafter FROM e)
SELECT e.doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(x) AS edited_sha256, p.f AS fingerprint, q.f AS edited_fingerprint,
  {like('edit')} AS near_edited, {like('after')} AS near_next, CAST(own.n + edit.n - 2 * medit AS BIGINT) AS n_differ
FROM e JOIN m ON m.doc_id = e.doc_id JOIN prints p ON p.doc_id = e.doc_id AND p.v = 'own' JOIN prints q ON q.doc_id = e.doc_id AND q.v = 'edit'
JOIN sizes own ON own.doc_id = e.doc_id AND own.v = 'own' JOIN sizes edit ON edit.doc_id = e.doc_id AND edit.v = 'edit' JOIN sizes after ON after.doc_id = e.next_id AND after.v = 'own'"""
