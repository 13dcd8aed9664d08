"""Box forms, image scaling, tiles' costs and vector similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.operators.shapes import HEIGHT, WIDTH
from skyledger.sources import views

#: Side of the square image that a detector sees.
NET = 640


def box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box as corners, as corner and size, as centre and size relative to the image, and back; cut at all four sides of the image (a box outside stays as a line), with whether it holds a point, its area after the cut and its height."""
    b = views.boxes(spark, sf_dir).select("l_orderkey", "box_ord", (F.col("x1") - 100).cast("double").alias("x1"), (F.col("y1") - 100).cast("double").alias("y1"), "w", "h")
    b = b.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("h"))
    b = b.withColumn("cx", (F.col("x1") + F.col("x2")) / 2 / WIDTH).withColumn("cy", (F.col("y1") + F.col("y2")) / 2 / HEIGHT).withColumn("rw", (F.col("x2") - F.col("x1")) / WIDTH).withColumn("rh", (F.col("y2") - F.col("y1")) / HEIGHT)
    back = F.round((F.col("cx") - F.col("rw") / 2) * WIDTH, 6)
    clamp = lambda c, most: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col(c)))
    b = b.withColumn("kx1", clamp("x1", WIDTH)).withColumn("ky1", clamp("y1", HEIGHT))
    b = b.withColumn("kx2", F.greatest("kx1", clamp("x2", WIDTH))).withColumn("ky2", F.greatest("ky1", clamp("y2", HEIGHT)))
    holds = (F.lit(400.0) >= F.col("x1")) & (F.lit(400.0) <= F.col("x2")) & (F.lit(300.0) >= F.col("y1")) & (F.lit(300.0) <= F.col("y2"))
    r = lambda c: F.round(c, 9).alias(c)
    return b.select("l_orderkey", "box_ord", "x2", "y2", r("cx"), r("cy"), r("rw"), r("rh"), back.alias("back_x1"), "kx1", "ky1", "kx2", "ky2", ((F.col("kx2") - F.col("kx1")) * (F.col("ky2") - F.col("ky1"))).alias("cut_area"), holds.alias("holds_point"))


def letterboxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in a square image with the frame's scale and borders, mapped back and cut to the frame, and scaled to a smaller frame; frame sizes follow the order."""
    b = views.boxes(spark, sf_dir).select("l_orderkey", "box_ord", "x1", "y1", "w", "h", (F.col("l_orderkey") % 5 * 320 + 640).alias("fw"), (F.col("l_orderkey") % 3 * 360 + 480).alias("fh"))
    scale = F.least(F.lit(float(NET)) / F.col("fw"), F.lit(float(NET)) / F.col("fh"))
    b = b.withColumn("scale", scale).withColumn("pad_x", (NET - F.bround(F.col("fw") * F.col("scale"))) / 2).withColumn("pad_y", (NET - F.bround(F.col("fh") * F.col("scale"))) / 2)
    b = b.withColumn("nx", F.col("x1") * F.col("scale") + F.col("pad_x")).withColumn("ny", (F.col("y1") + F.col("h")) * F.col("scale") + F.col("pad_y"))
    back = lambda c, p, most: F.least(F.col(most).cast("double"), F.greatest(F.lit(0.0), (F.col(c) - F.col(p)) / F.col("scale")))
    r = lambda c, n: F.round(c, 6).alias(n)
    return b.select("l_orderkey", "box_ord", r("scale", "scale"), "pad_x", "pad_y", r("nx", "nx"), r("ny", "ny"), r(back("nx", "pad_x", "fw"), "back_x1"), r(back("ny", "pad_y", "fh"), "back_y2"), r(F.col("x1") * (320.0 / F.col("fw")), "small_x1"), r(F.col("w") * (320.0 / F.col("fw")), "small_w"))


def expected_boxes(spark: SparkSession, sf_dir: str, damping: float = 0.8) -> DataFrame:
    """Each sighting's box foreseen from the two before it, velocity damped and freed of the camera's shift; its distance 1 - overlap to what was seen, and the speed and time the track has had so far."""
    o = views.observations(spark, sf_dir).select("event_id", "global_id", "camera_id", "frame_index", (F.col("frame_index") * 4 % 900 + F.col("event_id") % 3).cast("double").alias("x1"), (F.col("frame_index") * 2 % 700 + F.col("event_id") % 5).cast("double").alias("y1"))
    w = Window.partitionBy("global_id").orderBy("frame_index")
    lag = lambda c, n=1: F.lag(c, n).over(w)
    shift = F.when(F.col("frame_index") % 10 == 0, 1.5).otherwise(0.0)
    o = o.withColumn("px", lag("x1") + damping * (lag("x1") - lag("x1", 2) - shift)).withColumn("py", lag("y1") + damping * (lag("y1") - lag("y1", 2))).withColumn("moved", F.sqrt(F.pow(F.col("x1") - lag("x1"), 2) + F.pow(F.col("y1") - lag("y1"), 2)))
    side, high = 48.0, 36.0
    both = F.greatest(F.lit(0.0), side - F.abs(F.col("px") - F.col("x1"))) * F.greatest(F.lit(0.0), high - F.abs(F.col("py") - F.col("y1")))
    first = F.min("frame_index").over(Window.partitionBy("global_id"))
    return o.withColumn("first", first).where("px is not null").select("event_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), F.round(1 - both / (2 * side * high - both), 6).alias("distance"), F.round("moved", 6).alias("moved"), F.round((F.col("frame_index") - F.col("first")) / 30.0, 6).alias("seconds"))


def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a frame that share more than half of the smaller box with a box of the frame take its number: for each prediction the lowest such box, joined within the frame."""
    b = views.boxes(spark, sf_dir).select("l_orderkey", F.col("box_ord").alias("track"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "w", "h")])
    p = views.predictions(spark, sf_dir).select("l_orderkey", "box_ord", "x1", "y1", "w", "h")
    w = F.least(F.col("x1") + F.col("w"), F.col("b_x1") + F.col("b_w")) - F.greatest("x1", "b_x1")
    h = F.least(F.col("y1") + F.col("h"), F.col("b_y1") + F.col("b_h")) - F.greatest("y1", "b_y1")
    both = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    smaller = F.least(F.col("w") * F.col("h"), F.col("b_w") * F.col("b_h"))
    return p.join(b, "l_orderkey").where((both > 0) & (smaller > 0) & (both / smaller > 0.5)).groupBy("l_orderkey", "box_ord").agg(F.min("track").alias("track"), F.count(F.lit(1)).alias("candidates"))


def tile_starts(extent: str, size: int, stride: int) -> str:
    """SQL: starts of tiles along an extent: every stride, the last at the far edge, and one start less where the two last are nearer than an eighth of a tile."""
    steps = f"filter(sequence(0, greatest(0, cast(({extent} - {size}) as int)), {stride}), s -> s <= greatest(0, {extent} - {size}))"
    tail = f"greatest(0, cast(({extent} - {size}) as int))"
    return f"transform(array({steps}), a -> if(element_at(a, -1) = {tail}, a, concat(filter(a, s -> s = 0 or {tail} - s >= {size // 8}), array({tail}))))[0]"


def tile_costs(spark: SparkSession, sf_dir: str, size: int = 640, overlap: float = 0.25) -> DataFrame:
    """Tiles of each frame size, how much area they add, their mean area, and the tile side that shows a target of the part's size 32 pixels tall."""
    p = views.read(spark, sf_dir, "part").select("p_size", (F.col("p_size") * 40 + 300).alias("fw"), (F.col("p_size") * 24 + 200).alias("fh")).distinct()
    stride = max(round(size * (1 - overlap)), 1)
    count = lambda c: F.size(F.expr(tile_starts(c, size, stride)))
    side = lambda c: F.least(F.lit(size), F.col(c))
    n = p.withColumn("tiles", (count("fw") * count("fh")).cast("long")).withColumn("tile_px", (side("fw") * side("fh")).cast("long"))
    ideal = F.greatest(F.lit(512), F.least(F.lit(1280), F.bround(F.least("fw", "fh") / F.greatest(F.lit(1.0), 32.0 / F.col("p_size"))).cast("int")))
    return n.select("p_size", "tiles", F.round(F.col("tiles") * F.col("tile_px") / (F.col("fw") * F.col("fh")), 6).alias("expansion"), "tile_px", ideal.alias("ideal"))


def _dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)")


def neighbour_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with that of the next id: 1 where either is missing, 0 for a zero vector; and the vector's length after it was made one, which short vectors aren't."""
    e = views.read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 11 != 0, F.expr("transform(embedding, x -> if(vec_id % 17 = 0, 0D, cast(x as double)))")).alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("n"))
    j = e.join(n, "vec_id", "left").withColumn("a", F.sqrt(_dot("v", "v"))).withColumn("b", F.sqrt(_dot("n", "n")))
    cosine = F.when(F.col("v").isNull() | F.col("n").isNull(), 1.0).when((F.col("a") < 1e-8) | (F.col("b") < 1e-8), 0.0).otherwise(_dot("v", "n") / (F.col("a") * F.col("b")))
    unit = F.when(F.col("a") < 1e-8, F.col("a")).otherwise(F.sqrt(F.expr("aggregate(transform(v, x -> x / a), 0D, (s, x) -> s + x * x)")))
    return j.select("vec_id", F.round(cosine, 6).alias("cosine"), F.round(unit, 6).alias("length"), F.round(0.75 * 0.4 + 0.25 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - cosine) / 2)), 6).alias("fused"))


def gallery_best(spark: SparkSession, sf_dir: str, block: int = 1024) -> DataFrame:
    """The highest cosine of each vector whose id divides by 20 over all other vectors, 0 at least, and whose it is (the lowest id of equals to six digits).

    Queries and gallery are packed into blocks of vectors, each two blocks meet in one task as a matrix
    product, and only the best of a query in a block comes out.
    """
    e = views.read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.expr("transform(embedding, x -> cast(x as double))").alias("v"))
    n = max(1, e.count() // block)
    pack = lambda df, name, parts: df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias(name)).agg(F.collect_list(F.struct("vec_id", "v")).alias(f"{name}_rows"))
    q, g = pack(e.where("vec_id % 20 = 0"), "q", max(1, n // 20)), pack(e, "g", n)

    def run(batches):
        import pyarrow as pa

        def matrix(rows):
            ids = rows.field("vec_id").to_numpy()
            m = rows.field("v").flatten().to_numpy().reshape(len(ids), -1)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            return ids, np.where(size >= 1e-8, m / np.maximum(size, 1e-8), 0.0)

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                (a, x), (b, y) = (matrix(batch.column(c)[i].values) for c in ("q_rows", "g_rows"))
                s = np.round(x @ y.T, 6)
                s[a[:, None] == b[None, :]] = -1
                order = np.lexsort((np.broadcast_to(b, s.shape), -s), axis=1)[:, 0]
                out += [(int(a[k]), float(s[k, j]), int(b[j])) for k, j in enumerate(order)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.float64(), pa.int64()), strict=True)], ["vec_id", "s", "other"])

    met = q.crossJoin(g).select("q_rows", "g_rows").repartition(n).mapInArrow(run, "vec_id long, s double, other long")
    best = met.groupBy("vec_id").agg(F.max("s").alias("s"), F.max_by("other", F.struct("s", -F.col("other"))).alias("other"))
    return best.select("vec_id", F.greatest(F.col("s"), F.lit(0.0)).alias("cosine"), "other")


def dense_suppression(spark: SparkSession, sf_dir: str, threshold: float = 0.7, most: int = 3) -> DataFrame:
    """Detections of crowded frames left by descending confidence, each suppressing those it overlaps by more than the threshold, then the `most` surest of them; and how many were suppressed."""
    row = F.struct((-F.col("confidence")).alias("k"), F.col("detection").alias("id"), "x1", "y1", "x2", "y2")
    both = "greatest(least(x.x2, r.x2) - greatest(x.x1, r.x1), 0D) * greatest(least(x.y2, r.y2) - greatest(x.y1, r.y1), 0D)"
    area = lambda v: f"({v}.x2 - {v}.x1) * ({v}.y2 - {v}.y1)"
    over = f"transform(array({both}), i -> i > {threshold}D * ({area('x')} + {area('r')} - i))[0]"
    kind = "array<struct<k:double,id:bigint,x1:double,y1:double,x2:double,y2:double>>"
    f = views.detections(spark, sf_dir).groupBy("stream", "frame").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    f = f.withColumn("kept", F.expr(f"aggregate(rows, cast(array() as {kind}), (s, r) -> if(exists(s, x -> {over}), s, concat(s, array(r))))"))
    return f.select("stream", "frame", (F.size("rows") - F.size("kept")).alias("suppressed"), F.array_join(F.transform(F.slice("kept", 1, most), lambda x: x["id"]), ",").alias("survivors"))


QUERIES = (dense_suppression, box_forms, letterboxed, expected_boxes, track_labels, tile_costs, neighbour_cosines, gallery_best)


def oracles(views: str) -> dict[str, str]:
    end = "zz AS (SELECT 1)\n"
    stride = 480
    starts = lambda e: f"(SELECT count(DISTINCT s) FROM (SELECT s FROM range(0, greatest(0, {e} - 640) + 1, {stride}) r(s) WHERE s = 0 OR s = greatest(0, {e} - 640) OR greatest(0, {e} - 640) - s >= 80 UNION ALL SELECT greatest(0, {e} - 640)))"
    return {
        "dense_suppression": """WITH d AS (SELECT event_id AS id, user_id % 8 AS stream, event_id // 200 AS frame, (event_id % 4 * 260 + event_id // 200 * 5 % 900 + event_id % 3)::DOUBLE AS x1, (event_id % 4 * 150 + event_id // 200 * 3 % 400 + event_id % 5)::DOUBLE AS y1, (event_id * 13 % 100) / 100.0::DOUBLE AS confidence FROM events WHERE event_id % 200 < 64),
r AS (SELECT stream, frame, count(*) AS n, list(struct_pack(k := -confidence, id := id, x1 := x1, y1 := y1) ORDER BY -confidence, id) AS r FROM d GROUP BY 1, 2),
k AS (SELECT stream, frame, n, list_reduce(list_prepend(CAST([] AS STRUCT(k DOUBLE, id BIGINT, x1 DOUBLE, y1 DOUBLE)[]), list_transform(r, lambda x: [x])), lambda s, x: CASE WHEN len(list_filter(s, lambda y: greatest(48 - abs(y.x1 - x[1].x1), 0) * greatest(36 - abs(y.y1 - x[1].y1), 0) > 0.7::DOUBLE * (2 * 48 * 36 - greatest(48 - abs(y.x1 - x[1].x1), 0) * greatest(36 - abs(y.y1 - x[1].y1), 0)))) > 0 THEN s ELSE list_concat(s, x) END) AS kept FROM r)
SELECT stream, frame, (n - len(kept))::INT AS suppressed, array_to_string(list_transform(kept[1:3], lambda x: x.id), ',') AS survivors FROM k""",
        "box_forms": views + f"""c AS (SELECT l_orderkey, box_ord, x1 - 100.0::DOUBLE AS x1, y1 - 100.0::DOUBLE AS y1, x1 - 100 + w::DOUBLE AS x2, y1 - 100 + h::DOUBLE AS y2 FROM b),
k AS (SELECT *, least({WIDTH}, greatest(0, x1)) AS kx1, least({HEIGHT}, greatest(0, y1)) AS ky1, greatest(least({WIDTH}, greatest(0, x1)), least({WIDTH}, greatest(0, x2))) AS kx2, greatest(least({HEIGHT}, greatest(0, y1)), least({HEIGHT}, greatest(0, y2))) AS ky2 FROM c)
SELECT l_orderkey, box_ord, x2, y2, round((x1 + x2) / 2 / {WIDTH}, 9) AS cx, round((y1 + y2) / 2 / {HEIGHT}, 9) AS cy, round((x2 - x1) / {WIDTH}, 9) AS rw, round((y2 - y1) / {HEIGHT}, 9) AS rh, round(x1, 6) AS back_x1, kx1, ky1, kx2, ky2, (kx2 - kx1) * (ky2 - ky1) AS cut_area, 400 BETWEEN x1 AND x2 AND 300 BETWEEN y1 AND y2 AS holds_point FROM k""",
        "letterboxed": views + f"""c AS (SELECT *, l_orderkey % 5 * 320 + 640 AS fw, l_orderkey % 3 * 360 + 480 AS fh FROM b), s AS (SELECT *, least({NET}.0::DOUBLE / fw, {NET}.0::DOUBLE / fh) AS scale FROM c), d AS (SELECT *, ({NET} - round_even(fw * scale, 0)) / 2 AS pad_x, ({NET} - round_even(fh * scale, 0)) / 2 AS pad_y FROM s),
n AS (SELECT *, x1 * scale + pad_x AS nx, (y1 + h) * scale + pad_y AS ny FROM d)
SELECT l_orderkey, box_ord, round(scale, 6) AS scale, pad_x, pad_y, round(nx, 6) AS nx, round(ny, 6) AS ny, round(least(fw, greatest(0, (nx - pad_x) / scale)), 6) AS back_x1, round(least(fh, greatest(0, (ny - pad_y) / scale)), 6) AS back_y2, round(x1 * (320.0::DOUBLE / fw), 6) AS small_x1, round(w * (320.0::DOUBLE / fw), 6) AS small_w FROM n""",
        "expected_boxes": views + """c AS (SELECT event_id, global_id, frame_index, (frame_index * 4 % 900 + event_id % 3)::DOUBLE AS x1, (frame_index * 2 % 700 + event_id % 5)::DOUBLE AS y1 FROM o),
pq AS (SELECT *, lag(x1) OVER w + 0.8::DOUBLE * (lag(x1) OVER w - lag(x1, 2) OVER w - CASE WHEN frame_index % 10 = 0 THEN 1.5 ELSE 0 END) AS px, lag(y1) OVER w + 0.8::DOUBLE * (lag(y1) OVER w - lag(y1, 2) OVER w) AS py, sqrt(pow(x1 - lag(x1) OVER w, 2) + pow(y1 - lag(y1) OVER w, 2)) AS moved, min(frame_index) OVER (PARTITION BY global_id) AS first FROM c WINDOW w AS (PARTITION BY global_id ORDER BY frame_index)),
i AS (SELECT *, greatest(0, 48.0 - abs(px - x1)) * greatest(0, 36.0 - abs(py - y1)) AS b FROM pq WHERE px IS NOT NULL)
SELECT event_id, round(px, 6) AS px, round(py, 6) AS py, round(1 - b / (2 * 48.0 * 36.0 - b), 6) AS distance, round(moved, 6) AS moved, round((frame_index - first) / 30.0::DOUBLE, 6) AS seconds FROM i""",
        "track_labels": views + "j AS (SELECT p.l_orderkey, p.box_ord, b.box_ord AS track, greatest(0, least(p.x1 + p.w, b.x1 + b.w) - greatest(p.x1, b.x1)) * greatest(0, least(p.y1 + p.h, b.y1 + b.h) - greatest(p.y1, b.y1)) AS i, least(p.w * p.h, b.w * b.h) AS s FROM p JOIN b USING (l_orderkey)) SELECT l_orderkey, box_ord, min(track) AS track, count(*) AS candidates FROM j WHERE i > 0 AND i / s > 0.5 GROUP BY 1, 2",
        "tile_costs": f"""WITH p AS (SELECT DISTINCT p_size, p_size * 40 + 300 AS fw, p_size * 24 + 200 AS fh FROM part), t AS (SELECT *, {starts('fw')} * {starts('fh')} AS tiles, least(640, fw) * least(640, fh)::BIGINT AS tile_px FROM p)
SELECT p_size, tiles, round(tiles * tile_px / (fw * fh), 6) AS expansion, tile_px, greatest(512, least(1280, round_even(least(fw, fh) / greatest(1.0::DOUBLE, 32.0::DOUBLE / p_size), 0)::INT)) AS ideal FROM t""",
        "neighbour_cosines": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN list_transform(embedding, lambda x: CASE WHEN vec_id % 17 = 0 THEN 0 ELSE x::DOUBLE END) END AS v FROM embeddings),
j AS (SELECT a.vec_id, a.v, b.v AS n, sqrt(list_dot_product(a.v, a.v)) AS la, sqrt(list_dot_product(b.v, b.v)) AS lb FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id + 1),
c AS (SELECT *, CASE WHEN v IS NULL OR n IS NULL THEN 1.0 WHEN la < 1e-8 OR lb < 1e-8 THEN 0.0 ELSE list_dot_product(v, n) / (la * lb) END AS c FROM j)
SELECT vec_id, round(c, 6) AS cosine, CASE WHEN la < 1e-8 THEN round(la, 6) WHEN la IS NOT NULL THEN 1.0 END AS length, round(0.75 * 0.4::DOUBLE + 0.25 * least(1, greatest(0, (1 - c) / 2)), 6) AS fused FROM c""",
        "gallery_best": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT q.vec_id, g.vec_id AS other, round(list_dot_product(q.v, g.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(g.v, g.v)), 6) AS s FROM e q JOIN e g ON q.vec_id % 20 = 0 AND g.vec_id <> q.vec_id) SELECT vec_id, greatest(s, 0) AS cosine, other FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) = 1",
    }
