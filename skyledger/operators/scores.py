"""Tracking scores, verdicts of the rule gates, and quality checks of a dataset."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.operators import frames as of
from skyledger.operators import tracks
from skyledger.sources import views

#: The overlap thresholds of the higher-order score.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def _id_events(d: DataFrame, *more: str) -> DataFrame:
    """d: ground-truth rows with pred_id or null -> switches and fragments. A miss between two matches makes no switch."""
    w = Window.partitionBy("sequence_id", "modality", "gt_id", *more).orderBy("frame_index")
    before = F.lag("pred_id").over(w)
    return d.withColumn("switch", (F.col("pred_id").isNotNull() & before.isNotNull() & (F.col("pred_id") != before)).cast("int")).withColumn("fragment", (F.col("pred_id").isNull() & before.isNotNull()).cast("int"))


def tracking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sequence and modality: matches, misses, false alarms, identity switches, fragmentations, MOTA, detection F1, mean track length."""
    f = views.key_columns(tracks.matched_frames(views.frame_boxes(spark, sf_dir).where("l_orderkey is not null")))
    # every frame has a box, and its first one brings the number of predictions; within a sequence, frames are in the order of their key
    own = F.expr("transform(gt, (a, i) -> named_struct('gt_id', a.box_ord, 'pred_id', try_element_at(filter(pairs, x -> x.g = a.box_ord), 1).p, 'n_pred', if(i = 0, size(pred), 0)))")
    m = f.select("sequence_id", "modality", F.col("l_orderkey").alias("frame_index"), F.explode(own).alias("m")).select("sequence_id", "modality", "frame_index", "m.*")
    s = _id_events(m).groupBy("sequence_id", "modality").agg(F.count(F.lit(1)).alias("gt"), F.count("pred_id").alias("tp"), F.sum("switch").alias("idsw"), F.sum("fragment").alias("fragments"), F.countDistinct("pred_id").alias("ids"), F.sum("n_pred").alias("pred"))
    gt_n, fp = F.col("gt"), F.col("pred") - F.col("tp")
    return s.select("sequence_id", "modality", "gt", "pred", "tp", fp.alias("fp"), (gt_n - F.col("tp")).alias("fn"), "idsw", "fragments", (1 - (gt_n - F.col("tp") + fp + F.col("idsw")) / gt_n).alias("mota"), (2 * F.col("tp") / (gt_n + F.col("pred"))).alias("idf1"), F.when(F.col("ids") > 0, F.col("tp") / F.col("ids")).otherwise(0.0).alias("track_length"))


def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus ratios from summed counts, and the sequences' mean F1."""
    s = tracking_scores(spark, sf_dir)
    t = s.groupBy().agg(*[F.sum(c).alias(c) for c in ("gt", "tp", "fp", "fn", "idsw", "fragments")], F.round(F.avg("idf1"), 9).alias("idf1_mean"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.withColumns({"mota": 1 - (fn + fp + F.col("idsw")) / F.col("gt"), "idf1": 2 * tp / (2 * tp + fp + fn), "precision": tp / (tp + fp), "recall": tp / (tp + fn)})


def hota_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the higher-order score over its ten thresholds for each sequence and modality, and over all of them."""
    per = hota(spark, sf_dir).groupBy("sequence_id", "modality").agg(F.avg("score").alias("m"))
    return per.rollup(F.concat_ws("/", "sequence_id", "modality").alias("g")).agg(F.round(F.avg("m"), 9).alias("hota"), F.count(F.lit(1)).alias("sequences")).withColumn("group", F.coalesce("g", F.lit("ALL"))).drop("g")


def visible_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each sequence by visibility: a frame with a visible target counts its best overlap with any prediction (0 without one), a frame without counts 1 if nothing was predicted, else 0. Null for sequences that never show a target. Every seventh box is hidden."""
    f = views.key_columns(views.frame_boxes(spark, sf_dir)).withColumn("seen", F.expr("filter(gt, a -> (a.box_ord + l_orderkey) % 7 <> 0 and l_orderkey % 5 <> 0)")).withColumn("pred", F.when(F.col("l_orderkey") % 4 != 0, F.col("pred")).otherwise(F.expr("slice(pred, 1, 0)")))
    both = "greatest(least(a.x1 + a.w, b.x1 + b.w) - greatest(a.x1, b.x1), 0) * greatest(least(a.y1 + a.h, b.y1 + b.h) - greatest(a.y1, b.y1), 0)"
    best = F.expr(f"array_max(flatten(transform(seen, a -> transform(pred, b -> transform(array({both}), i -> i / (a.w * a.h + b.w * b.h - i))[0]))))")
    score = F.when(F.size("seen") > 0, F.coalesce(best, F.lit(0.0))).otherwise(F.when(F.size("pred") == 0, 1.0).otherwise(0.0))
    s = f.groupBy("sequence_id", "modality").agg(F.avg(score).alias("a"), F.max(F.size("seen")).alias("most"))
    return s.select("sequence_id", "modality", F.round(F.when(F.col("most") > 0, F.col("a")), 9).alias("accuracy"))


def threshold_counts(matches: DataFrame) -> DataFrame:
    """matches (sequence_id, modality, frame_index, gt_id, pred_id, iou), of a frame at most one per gt_id -> per sequence, modality and threshold that any reaches: tp and idsw.

    A ground truth's match in the frame before, if there is one, is the row before, whatever the
    threshold; it counts where both reach it. So each match is ordered once, not once a threshold.
    """
    w = Window.partitionBy("sequence_id", "modality", "gt_id").orderBy("frame_index")
    switch = (F.lag("frame_index").over(w) == F.col("frame_index") - 1) & (F.lag("pred_id").over(w) != F.col("pred_id"))
    m = matches.select("sequence_id", "modality", "iou", F.when(switch, F.least("iou", F.lag("iou").over(w))).alias("both"))
    n = m.groupBy("sequence_id", "modality").agg(*[F.count_if(F.col("iou") >= x).alias(f"tp_{i}") for i, x in enumerate(THRESHOLDS)], *[F.count_if(F.col("both") >= x).alias(f"idsw_{i}") for i, x in enumerate(THRESHOLDS)])
    each = F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"tp_{i}").alias("tp"), F.col(f"idsw_{i}").alias("idsw")) for i, x in enumerate(THRESHOLDS)])
    return n.select("sequence_id", "modality", F.explode(each).alias("c")).select("sequence_id", "modality", "c.*").where("tp > 0")


def hota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sequence and threshold from .50 to .95: TP, FP, FN, switches, DetA, AssA and the square root of their product.

    Pairs are taken by descending overlap, so the matching at a higher threshold is the part of the
    lowest one's that reaches it: one walk of a frame serves all ten. A switch is counted against the
    ground truth's own match in the frame before, where frames without ground truth are passed over; a
    frame without predictions breaks the chain. One scan and exchange of boxes serve matches and totals.
    """
    f = views.key_columns(tracks.matched_frames(views.frame_boxes(spark, sf_dir)))
    t = F.explode(F.array(*[F.lit(x) for x in THRESHOLDS])).alias("threshold")
    totals = f.groupBy("sequence_id", "modality").agg(F.sum(F.size("gt")).alias("gt"), F.sum(F.size("pred")).alias("pred"))
    order = Window.partitionBy("sequence_id", "modality").orderBy("l_orderkey")
    shown = f.where(F.size("gt") > 0).withColumn("frame_index", F.row_number().over(order) - 1)
    m = shown.select("sequence_id", "modality", "frame_index", F.explode("pairs").alias("m")).select("sequence_id", "modality", "frame_index", F.col("m.g").alias("gt_id"), F.col("m.p").alias("pred_id"), (-F.col("m.k")).alias("iou"))
    c = threshold_counts(m)
    d = totals.select("*", t).join(c, ["sequence_id", "modality", "threshold"], "left").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("idsw", F.coalesce("idsw", F.lit(0)))
    d = d.withColumn("fp", F.col("pred") - F.col("tp")).withColumn("fn", F.col("gt") - F.col("tp"))
    det, ass = F.col("tp") / F.greatest(F.col("gt") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("gt") + F.col("idsw"), F.lit(1))
    return d.select("sequence_id", "modality", "threshold", "tp", "fp", "fn", "idsw", det.alias("det_a"), ass.alias("ass_a"), F.sqrt(det * ass).alias("score"))


def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of each identity and camera over its observations and their conjunction; without a ground plane or horizon the kinematic and spatial gates are skipped.

    Confidence: best of .60 or more. Persistence: 12 hits over a second of the 25 Hz clock. Cross-camera:
    at some time two cameras saw the identity within three seconds. Severity: by the cameras that ever saw it.
    """
    o = views.observations(spark, sf_dir)
    seen = tracks.cross_camera(spark, sf_dir).select("event_id", F.col("cameras").alias("recent"))
    t = o.join(seen, "event_id").groupBy("global_id", "camera_id").agg(F.max("confidence").alias("best"), F.count(F.lit(1)).alias("hits"), (F.max("frame_index") - F.min("frame_index")).alias("span"), F.max("recent").alias("recent"))
    spread = o.groupBy("global_id").agg(F.countDistinct("camera_id").alias("all_cameras"))
    gate = lambda c: F.when(c, "pass").otherwise("fail")
    t = t.join(spread, "global_id").select("global_id", "camera_id", gate(F.col("best") >= 0.6).alias("confidence"), gate((F.col("hits") >= 12) & (F.col("span") >= 25)).alias("persistence"), F.lit("skipped").alias("kinematics"), F.lit("skipped").alias("spatial"), gate(F.col("recent") >= 2).alias("cross"), F.when(F.col("all_cameras") >= 4, "critical").when(F.col("all_cameras") >= 2, "warn").otherwise("info").alias("severity"))
    names = ("confidence", "persistence", "kinematics", "spatial", "cross")
    first = F.coalesce(*[F.when(F.col(n) == "fail", n) for n in names])
    return t.withColumn("first_failure", first).withColumn("alert", first.isNull())


def confidence_bands(spark: SparkSession, sf_dir: str, high: float = 0.6, low: float = 0.1) -> DataFrame:
    band = F.when(F.col("confidence") >= high, "high").when(F.col("confidence") >= low, "low").otherwise("dropped")
    return views.boxes(spark, sf_dir).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("boxes"))


def predicted_positions(spark: SparkSession, sf_dir: str, damping: float = 0.5) -> DataFrame:
    """Where an identity would be next at constant, damped velocity."""
    w = Window.partitionBy("global_id", "camera_id").orderBy("frame_index")
    o = views.observations(spark, sf_dir)
    step = lambda c: (F.col(c) + F.lit(damping) * F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0))).alias(f"next_{c}")
    return o.select("event_id", step("x"), step("y"))


def hover_spans(spark: SparkSession, sf_dir: str, frames: int = 50, share: float = 0.8) -> DataFrame:
    """Spread of the last two seconds' heights of an identity; null unless two samples cover 80 % of the time."""
    w = Window.partitionBy("global_id").orderBy("frame_index").rangeBetween(-frames, 0)
    o = views.observations(spark, sf_dir).select("event_id", (F.max("y").over(w) - F.min("y").over(w)).alias("spread"), F.count(F.lit(1)).over(w).alias("n"), (F.max("frame_index").over(w) - F.min("frame_index").over(w)).alias("covered"))
    return o.select("event_id", F.when((F.col("n") >= 2) & (F.col("covered") >= share * frames), F.col("spread")).alias("spread"))


def side_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the boxes' sides per class, exact over all boxes."""
    side = F.sqrt((F.col("w") * F.col("h")).cast("double"))
    q = [(5, "p05"), (25, "p25"), (50, "p50"), (75, "p75"), (95, "p95")]
    return views.boxes(spark, sf_dir).withColumn("side", side).groupBy("class_id").agg(*[F.round(F.percentile("side", k / 100), 6).alias(n) for k, n in q])


def sanity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset's checks with value and outcome: groups, split coverage, leaks, negatives, class range, target size, empty frames. One pass over groups and one over boxes."""
    g = of.stratified_split(spark, sf_dir)
    key = F.concat_ws("/", "dataset", "sequence_id", "modality")
    a = g.groupBy().agg(F.countDistinct(key).alias("groups"), F.sum(F.when(F.col("split") == "val", 1).otherwise(0)).alias("val_groups"), F.sum(F.when(F.col("split") == "val", F.col("frames")).otherwise(0)).alias("val_frames"), F.sum("frames").alias("frames"))
    leaks = g.groupBy("dataset", "sequence_id", "modality").agg(F.countDistinct("split").alias("s")).groupBy().agg(F.count_if(F.col("s") > 1).alias("leaks"))
    b = views.boxes(spark, sf_dir).groupBy().agg(F.count_if(F.col("class_id") == 1).alias("birds"), F.count_if(~F.col("class_id").isin(0, 1)).alias("outside"), F.avg((F.col("w") * F.col("h") < 64).cast("int")).alias("small"))
    # rows of one each
    one = a.select("*", F.lit(1).alias("k")).join(leaks.select("*", F.lit(1).alias("k")), "k").join(b.select("*", F.lit(1).alias("k")), "k")
    share = F.col("val_frames") / F.col("frames")
    checks = [
        ("sequences_populated", F.col("groups").cast("double"), F.when(F.col("groups") < 10, "fail").otherwise("ok")),
        ("split_coverage", F.col("val_groups").cast("double"), F.when(F.col("val_groups") == 0, "fail").when(F.col("val_groups") < 5, "warn").otherwise("ok")),
        ("split_share", F.round(share, 9), F.when((share < 0.05) | (share > 0.4), "warn").otherwise("ok")),
        ("split_leakage", F.col("leaks").cast("double"), F.when(F.col("leaks") > 0, "fail").otherwise("ok")),
        ("bird_negatives", F.col("birds").cast("double"), F.when(F.col("birds") == 0, "fail").otherwise("ok")),
        ("class_range", F.col("outside").cast("double"), F.when(F.col("outside") > 0, "fail").otherwise("ok")),
        ("target_size", F.round("small", 9), F.when(F.col("small") > 0.5, "warn").otherwise("ok")),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), o.alias("outcome")) for n, v, o in checks])).alias("c")).select("c.*")


def val_fraction_needed(spark: SparkSession, sf_dir: str, target: int = 20) -> DataFrame:
    g = views.frame_keys(spark, sf_dir).groupBy("dataset").agg(F.countDistinct("sequence_id", "modality").alias("groups"))
    return g.select("dataset", "groups", F.when(F.col("groups") > 0, F.least(F.greatest(F.lit(target) / F.col("groups"), F.lit(0.05)), F.lit(0.5))).otherwise(0.15).alias("fraction"))


def holdout_split(spark: SparkSession, sf_dir: str, held: tuple[str, ...] = ("src2", "src5"), pattern: str = "^seq_1") -> DataFrame:
    """Frames per source when some sources are held out for test and sequences of a pattern for val."""
    split = F.when(F.col("dataset").isin(*held), "test").when(F.col("sequence_id").rlike(pattern), "val").otherwise("train")
    return views.frame_keys(spark, sf_dir).groupBy("dataset", split.alias("split")).agg(F.count(F.lit(1)).alias("frames"))


def largest_clusters(spark: SparkSession, sf_dir: str, top: int = 5) -> DataFrame:
    """The report's five largest duplicate clusters."""
    return of.exact_duplicates(spark, sf_dir).orderBy(F.desc("members"), "first").limit(top).select("first", "members")


def near_hashes(nodes: DataFrame, most: int = 4) -> DataFrame:
    """nodes (id, hash), a row per hash -> (a, b, distance), a < b: pairs that differ in `most` bits or fewer, four at the most. Of six bands of bits at least two are equal in such a pair, so only rows that share two bands, some 21 bits, meet; a pair counts in its first two."""
    if most > 4:
        raise ValueError("six bands show pairs of up to four bits")
    cut = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
    band = lambda c, k: F.shiftright(c, cut[k][0]).bitwiseAND((1 << cut[k][1]) - 1)
    twos = list(combinations(range(len(cut)), 2))
    parts = F.array(*[F.shiftleft(band("hash", i), 11).bitwiseOR(band("hash", j)) for i, j in twos])
    d = nodes.select("id", "hash", F.posexplode(parts).alias("two", "part"))
    o = d.select(F.col("id").alias("other"), F.col("hash").alias("o_hash"), "two", "part")
    x = F.col("hash").bitwiseXOR(F.col("o_hash"))
    earlier = F.coalesce(*[F.when((band(x, i) == 0) & (band(x, j) == 0), F.lit(k)) for k, (i, j) in enumerate(twos)])
    near = d.join(o, ["two", "part"]).where((F.col("id") < F.col("other")) & (F.bit_count(x) <= most) & (earlier == F.col("two")))
    return near.select(F.col("id").alias("a"), F.col("other").alias("b"), F.bit_count(x).alias("distance"))


def hamming_pairs(spark: SparkSession, sf_dir: str, most: int = 4) -> DataFrame:
    """Pairs of 64-bit sign hashes that differ in at most four bits; equal hashes are one node."""
    return near_hashes(views.hashes(spark, sf_dir).groupBy("hash").agg(F.min("id").alias("id")), most)


def cluster_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over clusters of equal content: clusters, surplus rows, clusters across sources."""
    c = of.exact_duplicates(spark, sf_dir)
    return c.groupBy().agg(F.count(F.lit(1)).alias("clusters"), F.sum(F.col("members") - 1).alias("surplus"), F.count_if("cross_source").alias("cross_source"))
