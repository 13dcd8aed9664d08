"""Oracle SQL of shapes, scores and matching; each repeats its query's definition for DuckDB on the raw tables."""

from __future__ import annotations

from skyledger.functions.boxes import OVERLAP_BY_SIDE
from skyledger.operators.shapes import CAMERAS, FENCES, HEIGHT, MOTION, WIDTH


def _case(rows: list[tuple[str, str]], end: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rows) + f" ELSE {end} END"


def _in_fence(polygon) -> str:
    edges = zip(polygon, [*polygon[1:], polygon[0]], strict=True)
    hits = [f"CASE WHEN ({float(ay)} > y) <> ({float(by)} > y) AND x < (y - {float(ay)}) * {float(bx - ax)}::DOUBLE / {float(by - ay)}::DOUBLE + {float(ax)}::DOUBLE THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in edges if ay != by]
    return f"({' + '.join(hits)}) % 2 = 1"


def _corner(k: int, x: str, y: str) -> str:
    top, low = (f"({float(a)}::DOUBLE * {x} + {float(b)}::DOUBLE * {y} + {float(c)}::DOUBLE)" for a, b, c in (MOTION[k], MOTION[2]))
    return f"{top} / {low}"


def build(views: str) -> dict[str, str]:
    """views: the shared WITH clause, ending in a comma."""
    end = "zz AS (SELECT 1)\n"
    corners = [(x, y) for x in ("x1", "(x1 + w)") for y in ("y1", "(y1 + h)")]
    xs, ys = (", ".join(_corner(k, x, y) for x, y in corners) for k in (0, 1))
    fence = [(_in_fence(p), n, a) for n, a, p in FENCES]
    cams = ", ".join(f"({c}, {x}, {y})" for c, x, y, _ in CAMERAS)
    areas = ", ".join(f"('{n}', '{a}', {abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(c, [*c[1:], c[0]], strict=True))) / 2}::DOUBLE)" for n, a, c in FENCES)
    scale = f"sqrt((w * h)::DOUBLE) / sqrt({float(WIDTH * HEIGHT)}::DOUBLE)"
    greedy = views + """rows_ AS (SELECT l_orderkey, list(struct_pack(k := -(i / (areas - i)), g := gt_id, p := pred_id) ORDER BY -(i / (areas - i)), gt_id, pred_id) AS r FROM pairs WHERE i / (areas - i) >= 0.5 GROUP BY 1),
took AS (SELECT l_orderkey, unnest(list_reduce(r, lambda s, x: CASE WHEN len(list_filter(s, lambda y: y.g = x.g OR y.p = x.p)) > 0 THEN s ELSE list_append(s, x) END, CAST([] AS STRUCT(k DOUBLE, g INTEGER, p INTEGER)[]))) AS m FROM rows_),
match AS (SELECT l_orderkey, m.g AS gt_id, m.p AS pred_id, -m.k AS iou FROM took),
fr AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, modality ORDER BY l_orderkey) - 1 AS frame_index FROM f),
"""
    tracked = greedy + """ev AS (SELECT fr.sequence_id, fr.modality, b.box_ord AS gt_id, pred_id, lag(pred_id) OVER (PARTITION BY fr.sequence_id, fr.modality, b.box_ord ORDER BY frame_index) AS was FROM b JOIN fr USING (l_orderkey) LEFT JOIN match ON match.l_orderkey = b.l_orderkey AND match.gt_id = b.box_ord),
pn AS (SELECT sequence_id, modality, count(*) AS pred FROM p JOIN fr USING (l_orderkey) GROUP BY 1, 2),
cs AS (SELECT sequence_id, modality, count(*) AS gt, count(pred_id) AS tp, count(*) FILTER (WHERE pred_id <> was) AS idsw, count(*) FILTER (WHERE pred_id IS NULL AND was IS NOT NULL) AS fragments, count(DISTINCT pred_id) AS ids FROM ev GROUP BY 1, 2),
sc AS (SELECT sequence_id, modality, gt, coalesce(pred, 0) AS pred, tp, coalesce(pred, 0) - tp AS fp, gt - tp AS fn, idsw, fragments, 1 - (gt - tp + coalesce(pred, 0) - tp + idsw) / gt AS mota, 2 * tp / (gt + coalesce(pred, 0)) AS idf1, CASE WHEN ids > 0 THEN tp / ids ELSE 0 END AS track_length FROM cs LEFT JOIN pn USING (sequence_id, modality))
"""
    split = """g AS (SELECT dataset, modality, sequence_id, count(*) AS frames FROM f GROUP BY ALL),
l AS (SELECT *, frames >= 8 OR max(frames) OVER (PARTITION BY dataset, modality) < 8 AS long FROM g),
n AS (SELECT *, count(*) FILTER (WHERE long) OVER (PARTITION BY dataset, modality) AS n, row_number() OVER (PARTITION BY dataset, modality, long ORDER BY md5(sequence_id || '/' || modality)) AS r FROM l),
s AS (SELECT dataset, modality, sequence_id, frames, CASE WHEN long AND r <= CASE WHEN n >= 3 THEN greatest(CAST(round_even(n * 0.15, 0) AS INT), least(2, n // 2)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM n),
"""
    dup = "c AS (SELECT min(doc_id) AS first, count(*) AS members, min(source) <> max(source) AS cross_source FROM documents GROUP BY md5(text) HAVING count(*) > 1)"
    hota = greedy + """th AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS threshold),
mt AS (SELECT sequence_id, modality, threshold, gt_id, pred_id, frame_index FROM match JOIN fr USING (l_orderkey) JOIN th ON iou >= threshold),
sw AS (SELECT *, lag(frame_index) OVER w = frame_index - 1 AND lag(pred_id) OVER w <> pred_id AS sw FROM mt WINDOW w AS (PARTITION BY sequence_id, modality, threshold, gt_id ORDER BY frame_index)),
ct AS (SELECT sequence_id, modality, threshold, count(*) AS tp, count(*) FILTER (WHERE sw) AS idsw FROM sw GROUP BY ALL),
gn AS (SELECT sequence_id, modality, count(*) AS gt FROM b JOIN fr USING (l_orderkey) GROUP BY ALL),
pn AS (SELECT sequence_id, modality, count(*) AS pred FROM p JOIN fr USING (l_orderkey) GROUP BY ALL),
al AS (SELECT gn.sequence_id, gn.modality, th.threshold, gt, coalesce(pred, 0) AS pred, coalesce(tp, 0) AS tp, coalesce(idsw, 0) AS idsw FROM gn CROSS JOIN th LEFT JOIN pn USING (sequence_id, modality) LEFT JOIN ct ON ct.sequence_id = gn.sequence_id AND ct.modality = gn.modality AND ct.threshold = th.threshold)
"""
    return {
        "stream_window_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, max(value) AS most FROM events GROUP BY 1, 2",
        "greedy_match": greedy + end + "SELECT * FROM match",
        "detection_counts": greedy + "c AS (SELECT sequence_id, sum((SELECT count(*) FROM b WHERE b.l_orderkey = f.l_orderkey)) AS gt, sum((SELECT count(*) FROM p WHERE p.l_orderkey = f.l_orderkey)) AS pred, sum((SELECT count(*) FROM match WHERE match.l_orderkey = f.l_orderkey)) AS tp FROM f GROUP BY 1) SELECT sequence_id, tp::BIGINT AS tp, (pred - tp)::BIGINT AS fp, (gt - tp)::BIGINT AS fn, tp / pred AS precision, tp / gt AS recall FROM c",
        "tracking_scores": tracked + "SELECT * FROM sc",
        "corpus_scores": tracked + "SELECT *, 1 - (fn + fp + idsw) / gt AS mota, 2 * tp / (2 * tp + fp + fn) AS idf1, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM (SELECT sum(gt)::BIGINT AS gt, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(idsw)::BIGINT AS idsw, sum(fragments)::BIGINT AS fragments, round(avg(idf1), 9) AS idf1_mean FROM sc)",
        "hota": hota + """SELECT sequence_id, modality, threshold, tp, pred - tp AS fp, gt - tp AS fn, idsw, tp / greatest(gt + pred - tp, 1) AS det_a, tp / greatest(gt + idsw, 1) AS ass_a, sqrt((tp / greatest(gt + pred - tp, 1)) * (tp / greatest(gt + idsw, 1))) AS score FROM al""",
        "hota_overall": hota + """, sx AS (SELECT sequence_id || '/' || modality AS g, avg(sqrt((tp / greatest(gt + pred - tp, 1)) * (tp / greatest(gt + idsw, 1)))) AS m FROM al GROUP BY 1) SELECT coalesce(g, 'ALL') AS "group", round(avg(m), 9) AS hota, count(*) AS sequences FROM sx GROUP BY ROLLUP (g)""",
        "visible_accuracy": views + """sn AS (SELECT * FROM b WHERE (box_ord + l_orderkey) % 7 <> 0 AND l_orderkey % 5 <> 0), pv AS (SELECT * FROM p WHERE l_orderkey % 4 <> 0),
io AS (SELECT l_orderkey, max(i / (a - i)) AS best FROM (SELECT l_orderkey, x.w * x.h + y.w * y.h AS a, greatest(least(x.x1 + x.w, y.x1 + y.w) - greatest(x.x1, y.x1), 0) * greatest(least(x.y1 + x.h, y.y1 + y.h) - greatest(x.y1, y.y1), 0) AS i FROM sn x JOIN pv y USING (l_orderkey)) GROUP BY 1),
fs AS (SELECT f.*, (SELECT count(*) FROM sn WHERE sn.l_orderkey = f.l_orderkey) AS n, (SELECT count(*) FROM pv WHERE pv.l_orderkey = f.l_orderkey) AS m FROM f)
SELECT sequence_id, modality, round(CASE WHEN max(n) > 0 THEN avg(CASE WHEN n > 0 THEN coalesce(best, 0) WHEN m = 0 THEN 1 ELSE 0 END) END, 9) AS accuracy FROM fs LEFT JOIN io USING (l_orderkey) GROUP BY 1, 2""",
        "box_scalars": views + end + f"SELECT l_orderkey, box_ord, x1 + w / 2 AS cx, y1 + h / 2 AS cy, w * h AS area, w / h AS aspect, least(x1 + w, {WIDTH}) AS x2, least(y1 + h, {HEIGHT}) AS y2, round({scale}, 9) AS scale, CASE WHEN {scale} < 0.33 THEN 'small' WHEN {scale} < 0.66 THEN 'medium' ELSE 'large' END AS band, ({_case([(f'w * h >= {a * a}', str(t)) for a, t in OVERLAP_BY_SIDE[:-1]], str(OVERLAP_BY_SIDE[-1][1]))})::DOUBLE AS overlap FROM b",
        "yolo_rows": views + f"e AS (SELECT *, least(x1 + w, {WIDTH}) AS x2, least(y1 + h, {HEIGHT}) AS y2 FROM b) SELECT l_orderkey, box_ord, class_id, (x1 + x2) / {2 * WIDTH} AS cx, (y1 + y2) / {2 * HEIGHT} AS cy, (x2 - x1) / {WIDTH} AS bw, (y2 - y1) / {HEIGHT} AS bh FROM e WHERE x2 - x1 >= 2 AND y2 - y1 >= 2",
        "giou_pairs": views + "e AS (SELECT b.l_orderkey, b.box_ord, b.w * b.h + p.w * p.h AS areas, greatest(least(b.x1 + b.w, p.x1 + p.w) - greatest(b.x1, p.x1), 0) * greatest(least(b.y1 + b.h, p.y1 + p.h) - greatest(b.y1, p.y1), 0) AS i, (greatest(b.x1 + b.w, p.x1 + p.w) - least(b.x1, p.x1)) * (greatest(b.y1 + b.h, p.y1 + p.h) - least(b.y1, p.y1)) AS enc FROM b JOIN p USING (l_orderkey, box_ord)) SELECT l_orderkey, box_ord, i / (areas - i) - (enc - (areas - i)) / enc AS giou FROM e",
        "nms_survivors": views + """c AS (SELECT b.*, (x.l_partkey % 100) / 100.0::DOUBLE AS confidence FROM b JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem) x ON x.l_orderkey = b.l_orderkey AND x.o = b.box_ord),
rows_ AS (SELECT l_orderkey, class_id, list(struct_pack(k := -confidence, id := box_ord, x1 := x1::DOUBLE, y1 := y1::DOUBLE, w := w::DOUBLE, h := h::DOUBLE) ORDER BY -confidence, box_ord) AS r FROM c GROUP BY ALL),
kept AS (SELECT l_orderkey, class_id, unnest(list_reduce(r, lambda s, x: CASE WHEN len(list_filter(s, lambda y: greatest(least(y.x1 + y.w, x.x1 + x.w) - greatest(y.x1, x.x1), 0) * greatest(least(y.y1 + y.h, x.y1 + x.h) - greatest(y.y1, x.y1), 0) > 0.7::DOUBLE * (y.w * y.h + x.w * x.h - greatest(least(y.x1 + y.w, x.x1 + x.w) - greatest(y.x1, x.x1), 0) * greatest(least(y.y1 + y.h, x.y1 + x.h) - greatest(y.y1, x.y1), 0)))) > 0 THEN s ELSE list_append(s, x) END, CAST([] AS STRUCT(k DOUBLE, id INTEGER, x1 DOUBLE, y1 DOUBLE, w DOUBLE, h DOUBLE)[]))) AS m FROM rows_)
SELECT l_orderkey, class_id, m.id AS box_ord, -m.k AS confidence FROM kept""",
        "tile_grid": """WITH d AS (SELECT DISTINCT p_size, p_size * 40 + 5 AS width, p_size * 24 + 3 AS height FROM part),
a AS (SELECT p_size, width, height, CASE WHEN width <= 640 THEN [0] ELSE list_append(list_filter(range(0, width - 639, 480), lambda s: s + 80 <= width - 640), width - 640) END AS xs, CASE WHEN height <= 640 THEN [0] ELSE list_append(list_filter(range(0, height - 639, 480), lambda s: s + 80 <= height - 640), height - 640) END AS ys FROM d),
t AS (SELECT p_size, width, height, ty, unnest(xs) AS tx FROM (SELECT *, unnest(ys) AS ty FROM a)),
k AS (SELECT *, least(640, width - tx) AS tw, least(640, height - ty) AS th FROM t)
SELECT p_size, width, height, CAST(row_number() OVER (PARTITION BY p_size ORDER BY ty, tx) - 1 AS INT) AS tile, tx::INT AS tx, ty::INT AS ty, tw::INT AS tw, th::INT AS th FROM k WHERE tw >= 8 AND th >= 8""",
        "tile_boxes": views + """gr AS (SELECT (row_number() OVER (ORDER BY ty, tx) - 1)::INT AS tile, tx, ty FROM (SELECT unnest([0, 480, 960, 1280]) AS tx), (SELECT unnest([0, 440]) AS ty)),
e AS (SELECT *, least(x1 + w, tx + 640) - greatest(x1, tx) AS vw, least(y1 + h, ty + 640) - greatest(y1, ty) AS vh FROM b, gr)
SELECT l_orderkey, box_ord, tile, greatest(x1 - tx, 0) AS bx, greatest(y1 - ty, 0) AS by, vw AS bw, vh AS bh FROM e WHERE vw > 0 AND vh > 0 AND vw * vh >= 0.35 * w * h""",
        "motion_compensated": views + end + f"SELECT l_orderkey, box_ord, least({xs}) AS left, least({ys}) AS top, greatest({xs}) AS right, greatest({ys}) AS bottom FROM b",
        "geofence_hits": views + f"e AS (SELECT event_id, {_case([(c, repr(n)) for c, n, _ in fence], 'NULL')} AS fence, {_case([(c, repr(a)) for c, _, a in fence], 'NULL')} AS action FROM o) SELECT * FROM e WHERE fence IS NOT NULL",
        "fence_areas": views + f"e AS (SELECT {_case([(c, repr(n)) for c, n, _ in fence], 'NULL')} AS fence FROM o) SELECT t.fence, t.action, t.area, count(e.fence) AS held FROM (VALUES {areas}) t(fence, action, area) LEFT JOIN e ON e.fence = t.fence GROUP BY 1, 2, 3",
        "handoff_candidates": views + f"c AS (SELECT * FROM (VALUES {cams}) t(camera, cx, cy)), d AS (SELECT event_id, camera, sqrt(((x - cx) * (x - cx) + (y - cy) * (y - cy))::DOUBLE) AS m FROM o, c WHERE camera <> camera_id), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY m, camera) - 1 AS rank FROM d WHERE m <= 400) SELECT event_id, rank::INT AS rank, camera, round(m, 6) AS metres FROM r WHERE rank < 3",
        "rule_verdicts": views + """rc AS (SELECT a.event_id, count(DISTINCT c.camera_id) AS recent FROM o a JOIN o c ON a.global_id = c.global_id AND c.frame_index BETWEEN a.frame_index - 75 AND a.frame_index GROUP BY 1),
t AS (SELECT global_id, camera_id, max(confidence) AS best, count(*) AS hits, max(frame_index) - min(frame_index) AS span, max(recent) AS recent FROM o JOIN rc USING (event_id) GROUP BY 1, 2),
v AS (SELECT t.*, n, CASE WHEN best >= 0.6 THEN 'pass' ELSE 'fail' END AS c1, CASE WHEN hits >= 12 AND span >= 25 THEN 'pass' ELSE 'fail' END AS c2, CASE WHEN recent >= 2 THEN 'pass' ELSE 'fail' END AS c3 FROM t JOIN (SELECT global_id, count(DISTINCT camera_id) AS n FROM o GROUP BY 1) USING (global_id))
SELECT global_id, camera_id, c1 AS confidence, c2 AS persistence, 'skipped' AS kinematics, 'skipped' AS spatial, c3 AS "cross", CASE WHEN n >= 4 THEN 'critical' WHEN n >= 2 THEN 'warn' ELSE 'info' END AS severity, CASE WHEN c1 = 'fail' THEN 'confidence' WHEN c2 = 'fail' THEN 'persistence' WHEN c3 = 'fail' THEN 'cross' END AS first_failure, NOT (c1 = 'fail' OR c2 = 'fail' OR c3 = 'fail') AS alert FROM v""",
        "confidence_bands": "SELECT CASE WHEN l_partkey % 100 >= 60 THEN 'high' WHEN l_partkey % 100 >= 10 THEN 'low' ELSE 'dropped' END AS band, count(*) AS boxes FROM lineitem GROUP BY 1",
        "predicted_positions": views + end + "SELECT event_id, x + 0.5::DOUBLE * coalesce(x - lag(x) OVER w, 0) AS next_x, y + 0.5::DOUBLE * coalesce(y - lag(y) OVER w, 0) AS next_y FROM o WINDOW w AS (PARTITION BY global_id, camera_id ORDER BY frame_index)",
        "hover_spans": views + end + "SELECT event_id, CASE WHEN count(*) OVER w >= 2 AND max(frame_index) OVER w - min(frame_index) OVER w >= 40 THEN max(y) OVER w - min(y) OVER w END AS spread FROM o WINDOW w AS (PARTITION BY global_id ORDER BY frame_index RANGE BETWEEN 50 PRECEDING AND CURRENT ROW)",
        "side_percentiles": views + end + "SELECT class_id, " + ", ".join(f"round(quantile_cont(sqrt((w * h)::DOUBLE), {q / 100}), 6) AS p{q:02d}" for q in (5, 25, 50, 75, 95)) + " FROM b GROUP BY 1",
        "sanity_checks": views + split + """a AS (SELECT count(*) AS groups, count(*) FILTER (WHERE split = 'val') AS vg, sum(frames) FILTER (WHERE split = 'val') AS vf, sum(frames) AS fs FROM s), e AS (SELECT count(*) FILTER (WHERE class_id = 1) AS birds, avg(CASE WHEN w * h < 64 THEN 1 ELSE 0 END) AS small FROM b)
SELECT 'sequences_populated' AS name, groups::DOUBLE AS value, CASE WHEN groups < 10 THEN 'fail' ELSE 'ok' END AS outcome FROM a UNION ALL SELECT 'split_coverage', vg, CASE WHEN vg = 0 THEN 'fail' WHEN vg < 5 THEN 'warn' ELSE 'ok' END FROM a UNION ALL SELECT 'split_share', round(vf / fs, 9), CASE WHEN vf / fs < 0.05 OR vf / fs > 0.4 THEN 'warn' ELSE 'ok' END FROM a UNION ALL SELECT 'split_leakage', (SELECT count(*) FROM (SELECT 1 FROM s GROUP BY dataset, sequence_id, modality HAVING count(DISTINCT split) > 1)), 'ok' UNION ALL SELECT 'bird_negatives', birds, CASE WHEN birds = 0 THEN 'fail' ELSE 'ok' END FROM e UNION ALL SELECT 'class_range', (SELECT count(*) FROM b WHERE class_id NOT IN (0, 1)), 'ok' UNION ALL SELECT 'target_size', round(small, 9), CASE WHEN small > 0.5 THEN 'warn' ELSE 'ok' END FROM e""",
        "val_fraction_needed": views + "g AS (SELECT dataset, count(DISTINCT (sequence_id, modality)) AS groups FROM f GROUP BY 1) SELECT dataset, groups, least(greatest(20 / groups, 0.05::DOUBLE), 0.5::DOUBLE) AS fraction FROM g",
        "holdout_split": views + end + "SELECT dataset, CASE WHEN dataset IN ('src2', 'src5') THEN 'test' WHEN sequence_id LIKE 'seq_1%' AND sequence_id[4] = '_' THEN 'val' ELSE 'train' END AS split, count(*) AS frames FROM f GROUP BY 1, 2",
        "largest_clusters": f"WITH {dup} SELECT first, members FROM c ORDER BY members DESC, first LIMIT 5",
        "cluster_sources": f"WITH {dup} SELECT count(*) AS clusters, sum(members - 1)::BIGINT AS surplus, count(*) FILTER (WHERE cross_source) AS cross_source FROM c",
        "hamming_pairs": """WITH e AS (SELECT vec_id AS id, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END), lambda s, v: s | v) AS h FROM embeddings), al AS (SELECT id, h FROM e UNION ALL SELECT id + 10000000, xor(h, ((1::UBIGINT << ((id // 20) % 7)) - 1)::UBIGINT) FROM e WHERE id % 20 = 0), n AS (SELECT h, min(id) AS id FROM al GROUP BY 1)
SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM n x JOIN n y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 4""",
    }
