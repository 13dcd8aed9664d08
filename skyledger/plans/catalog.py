"""Registered queries and their oracle SQL."""

from __future__ import annotations

from skyledger.operators import alerts, clusters, conversions, coordination, coverage, curation, evaluations, experiments, frames, fusion, leaders, lenses, scores, shapes, sightings, sites, trackers, tracks
from skyledger.plans import oracles
from skyledger.sources.views import sources_sql
from skyledger.streaming import edge

QUERIES = {f.__name__: f for f in (frames.frame_profile, frames.size_histogram, frames.class_distribution, frames.empty_frames, frames.stratified_split, frames.split_summary, frames.exact_duplicates, frames.label_harmonize, frames.tiling_plan, frames.trackable_targets, tracks.iou_pairs, tracks.greedy_match, tracks.detection_counts, tracks.cross_camera, tracks.velocities, tracks.track_fragments, tracks.persistence_gate, tracks.gallery_similarity, tracks.ground_positions)}
QUERIES |= {f.__name__: f for f in (shapes.box_scalars, shapes.yolo_rows, shapes.giou_pairs, shapes.nms_survivors, shapes.tile_grid, shapes.tile_boxes, shapes.motion_compensated, shapes.geofence_hits, shapes.fence_areas, shapes.handoff_candidates, scores.tracking_scores, scores.corpus_scores, scores.hota, scores.hota_overall, scores.visible_accuracy, scores.rule_verdicts, scores.confidence_bands, scores.predicted_positions, scores.hover_spans, scores.side_percentiles, scores.sanity_checks, scores.val_fraction_needed, scores.holdout_split, scores.largest_clusters, scores.hamming_pairs, scores.cluster_sources, edge.stream_window_counts, edge.stream_edge_gate)}

_VIEWS = """WITH b AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS box_ord,
  l_partkey % 1800 AS x1, l_suppkey * 7 % 1000 AS y1, CAST(floor(l_quantity) AS BIGINT) + 4 AS w, CAST(l_linenumber * 5 + 3 AS BIGINT) AS h, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS class_id FROM lineitem),
p AS (SELECT * REPLACE (x1 + box_ord % 3 AS x1) FROM b WHERE (l_orderkey + box_ord) % 11 <> 0),
f AS (SELECT l_orderkey, 'seq_' || (l_orderkey % 97) AS sequence_id, CASE WHEN l_orderkey % 3 = 0 THEN 'ir' ELSE 'rgb' END AS modality, 'src' || (l_orderkey % 97 % 8) AS dataset FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
o AS (SELECT event_id, user_id % 40 AS global_id, (event_id * 7 + user_id * 3) % 10 AS camera_id, CAST(row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) - 1 AS INT) AS frame_index, event_id * 37 % 1000 AS x, event_id * 53 % 1000 AS y, (event_id % 100) / 100.0 AS confidence FROM events),
pairs AS (SELECT l_orderkey, b.box_ord AS gt_id, p.box_ord AS pred_id, b.w * b.h + p.w * p.h AS areas,
  greatest(least(b.x1 + b.w, p.x1 + p.w) - greatest(b.x1, p.x1), 0) * greatest(least(b.y1 + b.h, p.y1 + p.h) - greatest(b.y1, p.y1), 0) AS i FROM b JOIN p USING (l_orderkey)),
"""
_STRATA = """g AS (SELECT dataset, modality, sequence_id, count(*) AS frames FROM f GROUP BY ALL),
l AS (SELECT *, frames >= 8 OR max(frames) OVER (PARTITION BY dataset, modality) < 8 AS long FROM g),
n AS (SELECT *, count(*) FILTER (WHERE long) OVER (PARTITION BY dataset, modality) AS n, row_number() OVER (PARTITION BY dataset, modality, long ORDER BY md5(sequence_id || '/' || modality)) AS r FROM l),
s AS (SELECT dataset, modality, sequence_id, frames, CASE WHEN long AND r <= CASE WHEN n >= 3 THEN greatest(CAST(round_even(n * 0.15, 0) AS INT), least(2, n // 2)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM n)
"""
_END = "z AS (SELECT 1)\n"

ORACLES = {
    "ground_positions": _VIEWS + """d AS (SELECT event_id, camera_id, (x - 500) / 900.0::DOUBLE AS r, (y - 500) / 900.0::DOUBLE AS w, radians(camera_id * 36.0::DOUBLE) AS a, radians(-20.0::DOUBLE) AS p FROM o),
e AS (SELECT *, cos(p) + sin(p) * w AS ahead, sin(p) - cos(p) * w AS up FROM d),
t AS (SELECT *, CASE WHEN abs(up) > 1e-9 AND -20 / up > 0 THEN -20 / up END AS t FROM e),
g AS (SELECT event_id, camera_id, round(camera_id * 100 + t * (cos(a) * r + sin(a) * ahead), 4) AS gx, round(t * (cos(a) * ahead - sin(a) * r), 4) AS gy FROM t)
SELECT *, round((degrees(atan2(gx - camera_id * 100, gy)) + 540) % 360 - 180, 4) AS bearing FROM g""",
    "frame_profile": _VIEWS + "n AS (SELECT l_orderkey, count(*) AS n, max(class_id) AS bird FROM b GROUP BY 1) SELECT dataset, count(*) AS frames, CAST(sum(n) AS BIGINT) AS boxes, CAST(sum(bird) AS BIGINT) AS bird_frames, count(DISTINCT (sequence_id, modality)) AS groups, sum(n) / count(*) AS boxes_per_frame FROM f JOIN n USING (l_orderkey) GROUP BY 1",
    "size_histogram": _VIEWS + "t AS (SELECT class_id, CASE WHEN w * h >= 65536 THEN 256 WHEN w * h >= 16384 THEN 128 WHEN w * h >= 4096 THEN 64 WHEN w * h >= 1024 THEN 32 WHEN w * h >= 256 THEN 16 WHEN w * h >= 64 THEN 8 ELSE 0 END AS bin, count(*) AS c FROM b GROUP BY ALL), k AS (SELECT * FROM (VALUES (0), (1)) x(class_id), (VALUES (0), (8), (16), (32), (64), (128), (256)) y(bin)) SELECT class_id, bin, coalesce(c, 0) AS boxes FROM k LEFT JOIN t USING (class_id, bin)",
    "class_distribution": _VIEWS + _END + "SELECT CASE class_id WHEN 0 THEN 'drone' WHEN 1 THEN 'bird' ELSE '__invalid_' || class_id END AS class_name, count(*) AS boxes FROM b GROUP BY 1",
    "empty_frames": "SELECT o_orderstatus, count(*) AS frames FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
    "stratified_split": _VIEWS + _STRATA + "SELECT * FROM s",
    "split_summary": _VIEWS + _STRATA + "SELECT dataset, split, count(*) AS groups, CAST(sum(frames) AS BIGINT) AS frames FROM s GROUP BY ALL",
    "exact_duplicates": "SELECT md5(text) AS digest, min(doc_id) AS first, count(*) AS members, min(source) <> max(source) AS cross_source FROM documents GROUP BY 1 HAVING count(*) > 1",
    "label_harmonize": "SELECT regexp_replace(lower(trim(p_type)), '[- ]', '_', 'g') AS label, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 60), '_+$', ''), ''), 'unnamed') AS slug, count(*) AS rows FROM part GROUP BY 1, 2",
    "tiling_plan": f"WITH {sources_sql()} SELECT source, median_px, coalesce(median_px <= 40, false) AS tiled, concat_ws(',', CASE WHEN bird_negatives THEN 'bird_negatives' END, CASE WHEN track_ids THEN 'track_ids' END, CASE WHEN visibility THEN 'visibility' END) AS claims FROM src",
    "trackable_targets": _VIEWS + _END + "SELECT class_id, count(*) AS boxes, count(*) FILTER (h >= 15) AS trackable FROM b GROUP BY 1",
    "iou_pairs": _VIEWS + _END + "SELECT l_orderkey, gt_id, pred_id, i / (areas - i) AS iou FROM pairs WHERE i / (areas - i) >= 0.5",
    "cross_camera": _VIEWS + _END + "SELECT a.event_id, a.global_id, CAST(count(DISTINCT c.camera_id) AS INT) AS cameras, CASE WHEN count(DISTINCT c.camera_id) >= 2 THEN 'pass' ELSE 'fail' END AS outcome FROM o a JOIN o c ON a.global_id = c.global_id AND c.frame_index BETWEEN a.frame_index - 75 AND a.frame_index GROUP BY 1, 2",
    "velocities": _VIEWS + _END + "SELECT event_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, frame_index - lag(frame_index) OVER w AS gap FROM o WINDOW w AS (PARTITION BY global_id, camera_id ORDER BY frame_index)",
    "track_fragments": _VIEWS + "m AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER w <= 5 THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY global_id, camera_id ORDER BY frame_index)), q AS (SELECT *, CAST(sum(new) OVER (PARTITION BY global_id, camera_id ORDER BY frame_index) AS BIGINT) AS fragment FROM m) SELECT global_id, camera_id, fragment, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS hits FROM q GROUP BY 1, 2, 3",
    "persistence_gate": _VIEWS + _END + "SELECT global_id, camera_id, CASE WHEN count(*) >= 12 THEN 'pass' ELSE 'fail' END AS persistence, CASE WHEN max(confidence) IS NULL THEN 'skipped' WHEN max(confidence) >= 0.6 THEN 'pass' ELSE 'fail' END AS confidence FROM o GROUP BY 1, 2",
}
ORACLES["gallery_similarity"] = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2)
SELECT vec_id, label, round(sum(v * m) / sqrt(sum(v * v) * sum(m * m)), 6) AS cosine FROM e JOIN m USING (label, i) WHERE vec_id % 20 = 0 GROUP BY 1, 2"""
#: The gate sighting by sighting: hits, whether it has alerted, and the last frame.
ORACLES["stream_edge_gate"] = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id, object_id ORDER BY frame, event_id) AS n FROM (SELECT (event_id * 7 + user_id * 3) % 10 AS source_id, user_id % 40 AS object_id, event_id, event_id // 400 AS frame, (event_id % 100) / 100.0::DOUBLE AS confidence FROM events)),
g AS (SELECT source_id, object_id, 0::BIGINT AS n, 0::BIGINT AS event_id, 0::BIGINT AS hits, false AS alerted, -1::BIGINT AS last, '' AS decision FROM (SELECT DISTINCT source_id, object_id FROM s)
  UNION ALL SELECT source_id, object_id, n, event_id, h, CASE WHEN a THEN confidence >= {edge.DROP} ELSE confidence >= {edge.PROMOTE} AND h >= {edge.HITS} END, frame,
    CASE WHEN a THEN CASE WHEN confidence >= {edge.DROP} THEN 'keep' ELSE 'drop' END WHEN confidence >= {edge.PROMOTE} AND h >= {edge.HITS} THEN 'promote' ELSE 'hold' END
  FROM (SELECT s.*, CASE WHEN g.last >= 0 AND s.frame - g.last > {edge.MISSED} THEN 1 ELSE g.hits + 1 END AS h, g.alerted AND NOT (g.last >= 0 AND s.frame - g.last > {edge.MISSED}) AS a FROM g JOIN s ON s.source_id = g.source_id AND s.object_id = g.object_id AND s.n = g.n + 1) x)
SELECT source_id, object_id, event_id, decision FROM g WHERE decision IN ('promote', 'drop')"""
ORACLES |= oracles.build(_VIEWS)

#: Modules that hold their queries' oracle SQL themselves, where they have any.
MODULES = (trackers, fusion, experiments, curation, coverage, alerts, conversions, clusters, coordination, sightings, lenses, evaluations, sites, leaders)
for module in MODULES:
    QUERIES |= {f.__name__: f for f in module.QUERIES}
    if hasattr(module, "oracles"):
        ORACLES |= module.oracles(_VIEWS)
