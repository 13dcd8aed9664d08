"""Curation of a frame index: names and paths, samples, splits, constraint checks, build totals and set operations over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.functions.labels import slug
from skyledger.functions.names import RULES, WRAPPERS, sequence_of, stem_of
from skyledger.operators.frames import stratified_split
from skyledger.sources import views
from skyledger.sources.views import read


def padded(number: Column, digits: int = 6) -> Column:
    """A frame's stem: at least so many digits; more are kept."""
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def human_bytes(n: Column) -> Column:
    """A size with one decimal in the largest unit below it. The decimal is that nearest to the exact value, the even one of two as near, as printf gives it; format_string would round those up."""
    units = ("B", "KB", "MB", "GB", "TB")
    n = n.cast("long")

    def shown(i: int) -> Column:
        unit = F.lit(1024**i)
        whole = lambda a, b: F.call_function("div", a, b)
        rest = n % unit * 10
        tenths, over = whole(rest, unit), rest % unit * 2
        tenths = tenths + F.when((over > unit) | ((over == unit) & (tenths % 2 == 1)), 1).otherwise(0)
        return F.concat((whole(n, unit) + whole(tenths, F.lit(10))).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {units[i]}"))

    out = shown(len(units) - 1)
    for i in reversed(range(len(units) - 1)):
        out = F.when(n < 1024 ** (i + 1), shown(i)).otherwise(out)
    return out


def whole_or(text: Column, default: Column) -> Column:
    """The number that text is, else that of its digits alone, else the default."""
    return F.coalesce(text.try_cast("long"), F.regexp_replace(text, "[^0-9]", "").try_cast("long"), default)


#: Directories and names that paths are made of: each kind of sequence, wrapper and number.
FOLDERS = ("seq_12/img/", "train/clip7/", "images/", "", "Scene01/rgb/", "train/", "birds/Track_3/", "vid7/", "data/samples_b/", "night/", ".cache/video.tmp/", "test/images/park/")
NAMES = ("frame_{}", "abc{}", "img-{}.v2", "{}", "bird_image_{}_x", "x{}y", "view.{}")


def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence of an image path and how it was told, by each of the rules for sources; with the frame's stem, the label file to look for first, and the tolerant number of the name."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    digits = F.when(k % 4 == 3, (k % 100).cast("string")).otherwise(F.concat(F.lit("00"), (k % 10_000).cast("string")))
    path = F.concat(pick(FOLDERS, k), F.concat(F.regexp_replace(pick(NAMES, k + F.floor(k / 12)), r"\{\}", digits), F.lit(".jpg")))
    p = read(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    stem = stem_of(F.col("path"))
    told = [sequence_of(F.col("path"), rule)[c].alias(f"{rule}_{c}") for rule in RULES for c in ("sequence", "how")]
    label = F.regexp_replace(F.regexp_replace("path", "(^|/)(images|img)/", "$1labels/"), r"\.[^.]+$", ".txt")
    return p.select("p_partkey", *told, padded(k).alias("frame_stem"), whole_or(stem, F.lit(-1)).alias("number"), slug(stem).alias("slug"), label.alias("label"))


def sizes_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of pages as people read them, for each page and each host's total."""
    p = read(spark, sf_dir, "pages").select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes"))
    return p.select("page_id", "bytes", human_bytes(F.col("bytes") * 1000).alias("shown"))


def short_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists of each nation's suppliers: items trimmed, empty ones dropped, long lists cut after three with their number."""
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit(" s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.when(F.col("s_suppkey") % 5 == 0, ", ").otherwise("")))), ",").alias("cell"))
    items = F.filter(F.transform(F.split("cell", ","), lambda x: F.trim(x)), lambda x: x != "")
    return s.withColumn("items", items).select("s_nationkey", F.size("items").alias("n"), F.when(F.size("items") <= 3, F.array_join("items", ",")).otherwise(F.concat(F.array_join(F.slice("items", 1, 3), ","), F.lit(" +"), (F.size("items") - 3).cast("string"))).alias("shown"))


def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of frames by sequence and modality; the stratum is that of the first frame; sources of a group, and a key that has the source too."""
    f = views.frame_keys(spark, sf_dir)
    g = f.groupBy(F.concat_ws("/", "sequence_id", "modality").alias("group_key")).agg(F.min_by(F.struct("dataset", "modality"), "frame_index").alias("s"), F.count(F.lit(1)).alias("frames"), F.countDistinct("dataset").alias("datasets"))
    return g.select("group_key", F.col("s.dataset").alias("stratum_dataset"), F.col("s.modality").alias("stratum_modality"), "frames", (F.col("datasets") > 1).alias("crosses_datasets"), F.concat_ws("/", "s.dataset", "group_key").alias("dataset_key"))


def seeded_sample(spark: SparkSession, sf_dir: str, n: int = 500, seed: int = 7) -> DataFrame:
    """n frames at random, the same for a seed, in the index's order: the least hashes of seed and key, kept as a bounded top of each task."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("frames"), F.col("l_orderkey").cast("string")).cast("binary"))
    f = read(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return f.orderBy(order, "l_orderkey").limit(n).orderBy("l_orderkey")


def systematic_sample(spark: SparkSession, sf_dir: str, most: int = 3000, least_px: float = 8.0) -> DataFrame:
    """Targets below least_px among every k-th box, k = boxes div most: their share and the median side, with the outcome."""
    b = views.boxes(spark, sf_dir).withColumn("side", F.sqrt((F.col("w") * F.col("h")).cast("double")))
    k = max(1, b.count() // most)
    # every k-th by a numbering within hash buckets, so that no task orders all boxes
    w = Window.partitionBy(F.col("l_orderkey") % 64).orderBy("l_orderkey", "box_ord")
    some = b.withColumn("n", F.row_number().over(w) - 1).where(F.col("n") % k == 0)
    a = some.agg(F.count(F.lit(1)).alias("sampled"), F.avg((F.col("side") < least_px).cast("int")).alias("share"), F.round(F.percentile("side", 0.5), 6).alias("median"))
    return a.withColumn("outcome", F.when(F.col("share") > 0.5, "warn").otherwise("ok"))


def present_and_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations over sources: those expected but absent, those present but not expected, those in both, and all."""
    want = spark.createDataFrame([(f"src{i}",) for i in (0, 2, 4, 6, 8, 9)], "dataset string")
    have = views.frame_keys(spark, sf_dir).select("dataset").distinct()
    tag = lambda df, t: df.select(F.lit(t).alias("op"), "dataset")
    parts = (tag(want.subtract(have), "missing"), tag(have.subtract(want), "unexpected"), tag(want.intersect(have), "both"), tag(want.union(have).distinct(), "any"))
    counts = want.unionByName(have).groupBy("dataset").count().where("count > 1").select(F.lit("twice").alias("op"), "dataset")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(counts)


def build_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in and out of a build by source with a total line: a frame of a tiled source becomes its tiles, its boxes count once; sources without frames are listed as skipped."""
    per = views.boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("boxes"), F.sum("class_id").alias("birds"))
    f = views.frame_keys(spark, sf_dir).select("l_orderkey", "dataset", "sequence_id", "modality").join(per, "l_orderkey")
    split = stratified_split(spark, sf_dir).select("dataset", "sequence_id", "modality", "split")
    tiles = F.when(F.col("dataset").isin("src0", "src3"), 6).otherwise(1)
    rows = f.join(split, ["dataset", "sequence_id", "modality"]).withColumn("out", tiles)
    one = [F.count(F.lit(1)).alias("frames_in"), F.sum("out").alias("frames_out"), F.sum("boxes").alias("boxes"), F.sum("birds").cast("long").alias("birds"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val")]
    got = rows.rollup("dataset").agg(*one).withColumn("source", F.coalesce("dataset", F.lit("TOTAL"))).drop("dataset")
    wanted = spark.createDataFrame([(f"src{i}",) for i in range(10)] + [("TOTAL",)], "source string")
    zero = {c: 0 for c in ("frames_in", "frames_out", "boxes", "birds", "train", "val")}
    return wanted.join(got, "source", "left").withColumn("state", F.when(F.col("frames_in").isNull(), "skipped").otherwise("built")).na.fill(zero)


def dataset_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to be told of each source: few groups, single frames, no negatives, one class only, small targets, no empty frames, uneven boxes; and the estimate of disk for its tiles."""
    per = views.boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("class_id").alias("bird"), F.min("class_id").alias("drone"), F.avg(F.sqrt((F.col("w") * F.col("h")).cast("double"))).alias("side"))
    g = views.frame_keys(spark, sf_dir).join(per, "l_orderkey")
    groups = g.groupBy("dataset", "sequence_id", "modality").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("boxes"), F.max("bird").alias("bird"), F.min("drone").alias("drone"), F.sum(F.col("side")).alias("side"), F.max("n").alias("most"))
    d = groups.groupBy("dataset").agg(F.count(F.lit(1)).alias("groups"), F.sum("frames").alias("frames"), F.sum("boxes").alias("boxes"), F.max("bird").alias("bird"), F.min("drone").alias("drone"), (F.sum("side") / F.sum("frames")).alias("side"), F.avg((F.col("frames") == 1).cast("int")).alias("single"), F.max("most").alias("most"))
    said = [("few groups", "groups < 20"), ("single frames", "single > 0.5"), ("no negatives", "bird = 0"), ("negatives only", "drone = 1"), ("small targets", "side < 30"), ("crowded frames", "most > 2 * boxes / frames"), ("many boxes a frame", "boxes / frames > 4")]
    return d.select("dataset", F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(m)) for m, c in said])), "; ").alias("warnings"), F.round(F.col("frames") * 90_000 * (1 + 1 / 0.25), 0).cast("long").alias("disk_bytes"))


def split_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups under three strategies: names that match a pattern from their start are held out; whole sources are; a share of sequences is, one at least and never all. Per strategy and split: groups and frames."""
    g = stratified_split(spark, sf_dir).select("dataset", "modality", "sequence_id", "frames", "split")
    pattern = F.when(F.col("sequence_id").rlike("^(?:seq_[13])"), "val").otherwise("train")
    source = F.when(F.col("dataset").isin("src1", "src5"), "test").otherwise(F.col("split"))
    w = Window.partitionBy("dataset").orderBy(F.md5(F.concat_ws("/", "sequence_id", "modality").cast("binary")))
    n = F.count(F.lit(1)).over(Window.partitionBy("dataset"))
    val = F.when(n > 1, F.least(n - 1, F.greatest(F.lit(1), F.bround(n * 0.2).cast("long")))).otherwise(0)
    share = F.when(F.row_number().over(w) <= val, "val").otherwise("train")
    out = g.withColumn("s", F.explode(F.array(F.struct(F.lit("pattern").alias("strategy"), pattern.alias("to")), F.struct(F.lit("source").alias("strategy"), source.alias("to"))))).select("s.*", "frames")
    seq = g.withColumn("to", share).select(F.lit("sequence").alias("strategy"), "to", "frames")
    return out.unionByName(seq).groupBy("strategy", "to").agg(F.count(F.lit(1)).alias("groups"), F.sum("frames").alias("frames"))


def identity_crops(spark: SparkSession, sf_dir: str, most: int = 40) -> DataFrame:
    """Crops for an identity model: identities numbered densely in order of their first frame in a sequence; frames are taken while fewer than `most` crops were taken before them, so the last frame may go beyond."""
    b = views.boxes(spark, sf_dir).select("l_orderkey", "box_ord").join(views.frame_keys(spark, sf_dir).select("l_orderkey", "sequence_id", "modality", "frame_index"), "l_orderkey")
    key = ["sequence_id", "modality"]
    first = b.groupBy(*key, "box_ord").agg(F.min("frame_index").alias("first"))
    label = first.withColumn("label", F.dense_rank().over(Window.partitionBy(*key).orderBy("first", "box_ord")) - 1)
    per = b.groupBy(*key, "frame_index").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = per.withColumn("before", before).where(F.col("before") < most).select(*key, "frame_index")
    out = b.join(taken, [*key, "frame_index"]).join(label, [*key, "box_ord"])
    return out.groupBy(*key).agg(F.count(F.lit(1)).alias("crops"), F.countDistinct("label").alias("identities"), F.max("label").alias("last_label"), F.max("frame_index").alias("last_frame"))


def resampled_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a sequence renumbered by rank, cut at the number of predicted frames, then joined in full with the predictions' frames: how many are in both, in one only, and seen but empty. Gaps so close up, as a replay does it."""
    key = ["sequence_id", "modality"]
    f = views.frame_keys(spark, sf_dir).withColumn("source_frame", F.floor(F.col("l_orderkey") / 8))
    truth = f.groupBy(*key, "source_frame").agg(F.count(F.lit(1)).alias("boxes")).withColumn("frame", F.dense_rank().over(Window.partitionBy(*key).orderBy("source_frame")) - 1)
    seen = views.predictions(spark, sf_dir).select("l_orderkey").distinct().join(f, "l_orderkey").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    cut = truth.join(seen, key).where("frame < n").select(*key, "frame", "boxes")
    numbered = seen.select(*key, F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("frame")).where("frame % 5 <> 4")
    both = cut.join(numbered.withColumn("p", F.lit(1)), [*key, "frame"], "full_outer")
    return both.groupBy(*key).agg(F.count_if(F.col("boxes").isNotNull() & F.col("p").isNotNull()).alias("both"), F.count_if(F.col("p").isNull()).alias("truth_only"), F.count_if(F.col("boxes").isNull()).alias("predicted_only"))


def visibility_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth rows zipped with visibilities where both lists are as long and the frame has an identity; visible ones per frame, non-positive visibilities taken as 0."""
    b = views.boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("box_ord", "w", "h"))).alias("boxes"))
    v = b.withColumn("visibility", F.when(F.col("l_orderkey") % 6 == 0, F.expr("slice(transform(boxes, x -> 1.0D), 1, size(boxes) - 1)")).otherwise(F.expr("transform(boxes, x -> (x.box_ord * 37 + l_orderkey) % 11 / 10.0D - 0.2D)"))).withColumn("track_id", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_orderkey") % 50))
    rows = v.where("size(boxes) = size(visibility) and track_id is not null").select("l_orderkey", F.explode(F.arrays_zip("boxes", "visibility")).alias("z"))
    rows = rows.select("l_orderkey", F.greatest(F.col("z.visibility"), F.lit(0.0)).alias("visibility"))
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("visibility") > 0).alias("visible"), F.round(F.max("visibility"), 6).alias("best"))


def mean_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the values of each event type that are numbers, 0 where there are none; the mean point of its sightings, (0, 0) for none."""
    e = read(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("event_id") % 10 / 10.0).alias("v"), (F.col("event_id") * 37 % 1000).alias("x"), (F.col("event_id") * 53 % 1000).alias("y"))
    types = e.select("event_type").distinct().unionByName(spark.createDataFrame([("none",)], "event_type string"))
    got = e.groupBy("event_type").agg(F.avg(F.nanvl("v", F.lit(None).cast("double"))).alias("m"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    zero = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(n)
    return types.join(got, "event_type", "left").select("event_type", zero("m", "mean"), zero("mx", "x"), zero("my", "y"))


def frame_size_top(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The k most frequent frame sizes of each brand, ties by the size."""
    p = read(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 8 * 160 + 320).alias("width"), (F.col("p_size") % 8 * 90 + 180).alias("height"))
    n = p.groupBy("p_brand", "width", "height").agg(F.count(F.lit(1)).alias("frames"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("frames"), "width", "height"))).where(F.col("r") <= k)


def best_detections(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """Detections of each frame with sides above half a pixel, by class name or number, the `most` surest: kinds apart, those without track dropped."""
    b = views.boxes(spark, sf_dir).withColumn("track_id", F.when(F.col("l_orderkey") % 4 != 0, F.col("box_ord"))).withColumn("class_name", F.when(F.col("class_id") == 0, "drone").otherwise("bird"))
    b = b.where((F.col("w") > 0.5) & (F.col("h") > 0.5) & F.col("track_id").isNotNull())
    w = Window.partitionBy("l_orderkey", "class_name").orderBy(F.desc("confidence"), "box_ord")
    return b.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("l_orderkey", "class_name", "r", "box_ord", "confidence", (F.col("w") * F.col("h")).alias("area"), F.col("h").alias("height"))


def ordered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of a modality, distinct and in order, numbers first; the first of a listing that exist."""
    f = views.frame_keys(spark, sf_dir).where("modality = 'rgb'").select("sequence_id").distinct()
    number = F.coalesce(F.expr("try_cast(regexp_replace(sequence_id, '^seq_', '') as int)"), F.lit(1 << 30))
    return f.withColumn("number", number).orderBy("number", "sequence_id").limit(20)


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks over frames and labels with severity and outcome: rows at all, frames without a label file, labels out of the image, malformed labels, rows of one key, share of empty frames; then failures and warnings counted, and whether all is well."""
    frames = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    labels = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", ((F.col("l_partkey") % 1800) / 1700.0).alias("cx"))
    missing = frames.join(labels.select("k").distinct(), "k", "left_anti").agg(F.count(F.lit(1)).alias("v")).select(F.lit("label files exist").alias("check"), "v")
    totals = labels.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("cx") > 1).alias("outside"), F.count_if(F.col("cx").isNull()).alias("malformed"))
    twice = labels.groupBy("k", "l_linenumber").count().where("count > 1").agg(F.count(F.lit(1)).alias("v")).select(F.lit("keys are unique").alias("check"), "v")
    t = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(c).alias("v")) for n, c in (("not empty", "rows"), ("labels inside", "outside"), ("labels well formed", "malformed"))])).alias("x")).select("x.*")
    checks = t.unionByName(missing).unionByName(twice)
    fails = F.when(F.col("check") == "not empty", F.col("v") == 0).otherwise(F.col("v") > 0)
    severity = F.when(~fails, "ok").when(F.col("check").isin("labels well formed"), "warn").otherwise("fail")
    c = checks.withColumn("severity", severity)
    total = c.agg(F.count_if(F.col("severity") == "fail").alias("v"), F.max(F.when(F.col("severity") == "fail", "fail").otherwise("ok")).alias("s")).select(F.lit("exit code").alias("check"), (F.col("v") > 0).cast("long").alias("v"), F.when(F.col("v") > 0, "fail").otherwise("ok").alias("severity"))
    return c.unionByName(total)


QUERIES = (path_tokens, sizes_in_words, short_lists, group_keys, seeded_sample, systematic_sample, present_and_expected, build_totals, dataset_warnings, split_strategies, identity_crops, resampled_truth, visibility_rows, mean_or_zero, frame_size_top, best_detections, ordered_listing, integrity)


def _path_sql() -> str:
    """The rules for sequences in SQL: directories as lists, numbers by their neighbours."""
    listed = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    wraps = f"(list_contains({listed(WRAPPERS)}, lower(x)) OR x[1:1] = '.')"
    columns = []
    for name, r in RULES.items():
        named = f"list_filter(folders, lambda x: NOT {wraps})" if r.skips else "folders"
        folder = f"list_filter({named}, lambda x: regexp_matches(lower(x), '{'|'.join(r.tokens)}'))[1]"
        number = f"'{r.number}' || {'CASE WHEN len(folders) > 0 THEN folders[-1] || chr(95) ELSE chr(32)[2:] END || ' if r.owned else ''}digits"
        parent = f"WHEN len({named}) > 0 THEN {{}}" if r.parent is not None else ""
        end = f"({named})[-1]"
        columns.append(f"CASE WHEN {folder} IS NOT NULL THEN {folder} WHEN digits <> '' THEN {number} {parent.format(f'{chr(39)}{r.parent}{chr(39)} || {end}')} ELSE '{r.orphan}' || stem END AS {name}_sequence")
        columns.append(f"CASE WHEN {folder} IS NOT NULL THEN 'layout' WHEN digits <> '' THEN 'filename' {parent.format(chr(39) + 'parent' + chr(39))} ELSE 'orphan' END AS {name}_how")
    return f"""WITH p AS (SELECT p_partkey, {listed(FOLDERS)}[(p_partkey % {len(FOLDERS)} + 1)::INT] || replace({listed(NAMES)}[((p_partkey + p_partkey // 12) % {len(NAMES)} + 1)::INT], '{{}}', CASE WHEN p_partkey % 4 = 3 THEN (p_partkey % 100)::VARCHAR ELSE '00' || (p_partkey % 10000) END) || '.jpg' AS path FROM part),
q AS (SELECT *, string_split(path, '/')[:-2] AS folders, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM p),
d AS (SELECT *, regexp_extract(stem, '(?:^|[_-])(\\d{{3,6}})(?:[_.-]|$)', 1) AS digits FROM q)
SELECT p_partkey, {', '.join(columns)}, CASE WHEN length(p_partkey::VARCHAR) >= 6 THEN p_partkey::VARCHAR ELSE lpad(p_partkey::VARCHAR, 6, '0') END AS frame_stem,
  coalesce(TRY_CAST(stem AS BIGINT), TRY_CAST(regexp_replace(stem, '[^0-9]', '', 'g') AS BIGINT), -1) AS number, regexp_replace(regexp_replace(lower(stem), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  regexp_replace(regexp_replace(path, '(^|/)(images|img)/', '\\1labels/', 'g'), '\\.[^.]+$', '.txt') AS label FROM d"""


def oracles(views: str) -> dict[str, str]:
    end = "zz AS (SELECT 1)\n"
    keyed = views + "fr AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, modality ORDER BY l_orderkey) - 1 AS frame_index FROM f),\n"
    strata = """g AS (SELECT dataset, modality, sequence_id, count(*) AS frames FROM f GROUP BY ALL),
l AS (SELECT *, frames >= 8 OR max(frames) OVER (PARTITION BY dataset, modality) < 8 AS long FROM g),
n AS (SELECT *, count(*) FILTER (WHERE long) OVER (PARTITION BY dataset, modality) AS n, row_number() OVER (PARTITION BY dataset, modality, long ORDER BY md5(sequence_id || '/' || modality)) AS r FROM l),
s AS (SELECT dataset, modality, sequence_id, frames, CASE WHEN long AND r <= CASE WHEN n >= 3 THEN greatest(CAST(round_even(n * 0.15, 0) AS INT), least(2, n // 2)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM n),
"""
    said = [("few groups", "groups < 20"), ("single frames", "single > 0.5"), ("no negatives", "bird = 0"), ("negatives only", "drone = 1"), ("small targets", "side < 30"), ("crowded frames", "most > 2 * boxes / frames"), ("many boxes a frame", "boxes / frames > 4")]
    listed = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for m, c in said)
    units = ("B", "KB", "MB", "GB", "TB")
    human = "CASE " + " ".join(f"WHEN n < {1024 ** (i + 1)}::BIGINT THEN printf('%.1f {u}', n / {1024.0**i}::DOUBLE)" for i, u in enumerate(units[:-1])) + f" ELSE printf('%.1f TB', n / {1024.0**4}::DOUBLE) END"
    return {
        "path_tokens": _path_sql(),
        "sizes_in_words": f"WITH p AS (SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS bytes FROM pages) SELECT page_id, bytes, {human.replace('n <', 'bytes * 1000 <').replace(', n /', ', bytes * 1000 /')} AS shown FROM p",
        "short_lists": "WITH s AS (SELECT s_nationkey, list('s' || lpad(s_suppkey::VARCHAR, 6, '0') ORDER BY s_suppkey) AS items FROM supplier GROUP BY 1) SELECT s_nationkey, len(items)::INT AS n, CASE WHEN len(items) <= 3 THEN array_to_string(items, ',') ELSE array_to_string(items[1:3], ',') || ' +' || (len(items) - 3) END AS shown FROM s",
        "group_keys": keyed + end + "SELECT sequence_id || '/' || modality AS group_key, arg_min(dataset, frame_index) AS stratum_dataset, any_value(modality) AS stratum_modality, count(*) AS frames, count(DISTINCT dataset) > 1 AS crosses_datasets, arg_min(dataset, frame_index) || '/' || sequence_id || '/' || modality AS dataset_key FROM fr GROUP BY sequence_id, modality",
        "seeded_sample": "SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY md5('7|frames|' || l_orderkey), l_orderkey LIMIT 500",
        "systematic_sample": views + "n AS (SELECT sqrt((w * h)::DOUBLE) AS side, row_number() OVER (PARTITION BY l_orderkey % 64 ORDER BY l_orderkey, box_ord) - 1 AS n FROM b), k AS (SELECT greatest(1, count(*) // 3000) AS k FROM b), a AS (SELECT count(*) AS sampled, avg((side < 8)::INT) AS share, round(quantile_cont(side, 0.5), 6) AS median FROM n, k WHERE n % k = 0) SELECT *, CASE WHEN share > 0.5 THEN 'warn' ELSE 'ok' END AS outcome FROM a",
        "present_and_expected": views + "w AS (SELECT 'src' || unnest([0, 2, 4, 6, 8, 9]) AS dataset), h AS (SELECT DISTINCT dataset FROM f) SELECT 'missing' AS op, dataset FROM (FROM w EXCEPT FROM h) UNION ALL SELECT 'unexpected', dataset FROM (FROM h EXCEPT FROM w) UNION ALL SELECT 'both', dataset FROM (FROM w INTERSECT FROM h) UNION ALL SELECT 'any', dataset FROM (FROM w UNION FROM h) UNION ALL SELECT 'twice', dataset FROM (FROM w INTERSECT FROM h)",
        "build_totals": views + strata + """pf AS (SELECT l_orderkey, count(*) AS boxes, sum(class_id) AS birds FROM b GROUP BY 1),
r AS (SELECT f.dataset, CASE WHEN f.dataset IN ('src0', 'src3') THEN 6 ELSE 1 END AS o, boxes, birds, split FROM f JOIN pf USING (l_orderkey) JOIN s USING (dataset, sequence_id, modality)),
t AS (SELECT coalesce(dataset, 'TOTAL') AS source, count(*) AS frames_in, sum(o)::BIGINT AS frames_out, sum(boxes)::BIGINT AS boxes, sum(birds)::BIGINT AS birds, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val FROM r GROUP BY ROLLUP (dataset)),
w AS (SELECT 'src' || unnest(range(10)) AS source UNION ALL SELECT 'TOTAL')
SELECT source, coalesce(frames_in, 0) AS frames_in, coalesce(frames_out, 0) AS frames_out, coalesce(boxes, 0) AS boxes, coalesce(birds, 0) AS birds, coalesce(train, 0) AS train, coalesce(val, 0) AS val, CASE WHEN frames_in IS NULL THEN 'skipped' ELSE 'built' END AS state FROM w LEFT JOIN t USING (source)""",
        "dataset_warnings": views + f"""pf AS (SELECT l_orderkey, count(*) AS n, max(class_id) AS bird, min(class_id) AS drone, avg(sqrt((w * h)::DOUBLE)) AS side FROM b GROUP BY 1),
g AS (SELECT dataset, sequence_id, modality, count(*) AS frames, sum(n) AS boxes, max(bird) AS bird, min(drone) AS drone, sum(side) AS side, max(n) AS most FROM f JOIN pf USING (l_orderkey) GROUP BY 1, 2, 3),
d AS (SELECT dataset, count(*) AS groups, sum(frames) AS frames, sum(boxes) AS boxes, max(bird) AS bird, min(drone) AS drone, sum(side) / sum(frames) AS side, avg((frames = 1)::INT) AS single, max(most) AS most FROM g GROUP BY 1)
SELECT dataset, array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), '; ') AS warnings, (frames * 90000 * 5)::BIGINT AS disk_bytes FROM d""",
        "split_strategies": views + strata + """q AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS m, row_number() OVER (PARTITION BY dataset ORDER BY md5(sequence_id || '/' || modality)) AS o FROM s),
t AS (SELECT 'pattern' AS strategy, CASE WHEN regexp_matches(sequence_id, '^(?:seq_[13])') THEN 'val' ELSE 'train' END AS "to", frames FROM s
UNION ALL SELECT 'source', CASE WHEN dataset IN ('src1', 'src5') THEN 'test' ELSE split END, frames FROM s
UNION ALL SELECT 'sequence', CASE WHEN o <= CASE WHEN m > 1 THEN least(m - 1, greatest(1, round_even(m * 0.2, 0)::BIGINT)) ELSE 0 END THEN 'val' ELSE 'train' END, frames FROM q)
SELECT strategy, "to", count(*) AS groups, sum(frames)::BIGINT AS frames FROM t GROUP BY 1, 2""",
        "identity_crops": keyed + """bb AS (SELECT sequence_id, modality, frame_index, box_ord FROM b JOIN fr USING (l_orderkey)),
l AS (SELECT *, dense_rank() OVER (PARTITION BY sequence_id, modality ORDER BY first, box_ord) - 1 AS label FROM (SELECT sequence_id, modality, box_ord, min(frame_index) AS first FROM bb GROUP BY ALL)),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY sequence_id, modality ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT sequence_id, modality, frame_index, count(*) AS n FROM bb GROUP BY ALL))
SELECT bb.sequence_id, bb.modality, count(*) AS crops, count(DISTINCT label) AS identities, max(label)::INT AS last_label, max(bb.frame_index)::INT AS last_frame FROM bb JOIN c USING (sequence_id, modality, frame_index) JOIN l USING (sequence_id, modality, box_ord) WHERE before < 40 GROUP BY 1, 2""",
        "resampled_truth": views + """t AS (SELECT *, dense_rank() OVER (PARTITION BY sequence_id, modality ORDER BY sf) - 1 AS frame FROM (SELECT sequence_id, modality, l_orderkey // 8 AS sf, count(*) AS boxes FROM f GROUP BY ALL)),
sn AS (SELECT sequence_id, modality, count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM p) JOIN f USING (l_orderkey) GROUP BY ALL),
c AS (SELECT t.* FROM t JOIN sn USING (sequence_id, modality) WHERE frame < n),
m AS (SELECT sequence_id, modality, frame FROM (SELECT sequence_id, modality, unnest(range(n)) AS frame FROM sn) WHERE frame % 5 <> 4)
SELECT sequence_id, modality, count(*) FILTER (WHERE c.frame IS NOT NULL AND m.frame IS NOT NULL) AS "both", count(*) FILTER (WHERE m.frame IS NULL) AS truth_only, count(*) FILTER (WHERE c.frame IS NULL) AS predicted_only FROM c FULL JOIN m USING (sequence_id, modality, frame) GROUP BY 1, 2""",
        "visibility_rows": views + "n AS (SELECT l_orderkey, box_ord, greatest((box_ord * 37 + l_orderkey) % 11 / 10.0::DOUBLE - 0.2::DOUBLE, 0.0) AS v FROM b WHERE l_orderkey % 6 <> 0 AND l_orderkey % 9 <> 0) SELECT l_orderkey, count(*) AS rows, count(*) FILTER (WHERE v > 0) AS visible, round(max(v), 6) AS best FROM n GROUP BY 1",
        "mean_or_zero": "WITH e AS (SELECT event_type, CASE WHEN event_id % 3 <> 0 THEN (event_id % 10) / 10.0::DOUBLE END AS v, event_id * 37 % 1000 AS x, event_id * 53 % 1000 AS y FROM events) SELECT event_type, round(coalesce(avg(v), 0), 9) AS mean, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM e GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 0",
        "frame_size_top": "WITH n AS (SELECT p_brand, p_size % 8 * 160 + 320 AS width, p_size % 8 * 90 + 180 AS height, count(*) AS frames FROM part GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY frames DESC, width, height)::INT AS r FROM n QUALIFY r <= 5",
        "best_detections": views + "c AS (SELECT b.*, CASE WHEN class_id = 0 THEN 'drone' ELSE 'bird' END AS class_name, (l_partkey % 100) / 100.0::DOUBLE AS confidence FROM b JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem) x ON x.l_orderkey = b.l_orderkey AND x.o = b.box_ord WHERE b.l_orderkey % 4 <> 0) SELECT l_orderkey, class_name, row_number() OVER (PARTITION BY l_orderkey, class_name ORDER BY confidence DESC, box_ord)::INT AS r, box_ord, confidence, w * h AS area, h AS height FROM c QUALIFY r <= 3",
        "ordered_listing": views + end + "SELECT DISTINCT sequence_id, regexp_replace(sequence_id, '^seq_', '')::INT AS number FROM f WHERE modality = 'rgb' ORDER BY number, sequence_id LIMIT 20",
        "integrity": """WITH l AS (SELECT l_orderkey AS k, l_linenumber, (l_partkey % 1800) / 1700.0::DOUBLE AS cx FROM lineitem),
c AS (SELECT 'not empty' AS "check", count(*) AS v FROM l UNION ALL SELECT 'labels inside', count(*) FILTER (WHERE cx > 1) FROM l UNION ALL SELECT 'labels well formed', count(*) FILTER (WHERE cx IS NULL) FROM l
UNION ALL SELECT 'label files exist', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM l) UNION ALL SELECT 'keys are unique', count(*) FROM (SELECT 1 FROM l GROUP BY k, l_linenumber HAVING count(*) > 1)),
s AS (SELECT *, CASE WHEN CASE WHEN "check" = 'not empty' THEN v <> 0 ELSE v = 0 END THEN 'ok' WHEN "check" = 'labels well formed' THEN 'warn' ELSE 'fail' END AS severity FROM c)
FROM s UNION ALL SELECT 'exit code', (count(*) FILTER (WHERE severity = 'fail') > 0)::BIGINT, CASE WHEN count(*) FILTER (WHERE severity = 'fail') > 0 THEN 'fail' ELSE 'ok' END FROM s""",
    }
