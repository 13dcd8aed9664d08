"""Sources, combinations of them, and training runs: claims, plans and result tables, by joins of small dimensions with the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.sources.views import SOURCES, read, sources, sources_sql

_NAMES = [s[0] for s in SOURCES]
_BIRDS = [s[0] for s in SOURCES if s[2]]
#: Combinations of sources, their members, and whether tiles are forced on or off (null: as the source has it).
COMBOS = [(n, [n], n in ("dvb", "mmuav")) for n in _NAMES] + [
    ("dvb+mavvid", ["dvb", "mavvid"], None),
    ("birds3", _BIRDS, None),
    ("dvb+mavvid+antiuav", ["dvb", "mavvid", "antiuav"], None),
    ("birds3+antiuav", [*_BIRDS, "antiuav"], None),
    ("all4", _NAMES[:4], None),
    ("all8", _NAMES, None),
]
MODELS = ("yolo", "rtdetr", "dino")
#: Widest median target, in pixels, that is tiled by default.
TILE_BELOW = 40
CLAIMS = ("bird_negatives", "track_ids", "visibility")
#: Names under which a metric may be reported, the preferred first.
ALIASES = ("map50_95", "map5095", "map", "map50")


def combos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, m, f) for i, (n, m, f) in enumerate(COMBOS)], "combo_ord int, combo string, members array<string>, force boolean")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training runs, a row per supplier: model, combination, time and two metrics, of which every seventh is missing."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    return s.select(k.alias("run_id"), pick(MODELS, k % 3).alias("model"), pick([c[0] for c in COMBOS], k % 14).alias("combo"), (k * 7919 % 100_000).alias("trained_at"), F.when(k % 7 != 0, k * 37 % 1000 / 1000.0).alias("map50"), F.when(k % 5 != 0, k * 91 % 1000 / 1000.0).alias("recall"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = combos(spark).select("combo_ord", "combo", "force", F.explode("members").alias("source"))
    return m.join(F.broadcast(sources(spark, sf_dir)), "source").withColumn("tiled", F.coalesce("force", F.col("median_px") <= TILE_BELOW, F.lit(False))).withColumn("own_tiled", F.coalesce(F.col("median_px") <= TILE_BELOW, F.lit(False)))


def combo_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each combination: the sources behind each claim, tiled sources, claims that no source backs, whether all members tile alike by their own measure, and what is to be said of false positives."""
    m = _members(spark, sf_dir)
    said = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "source")))), lambda s: s["source"]), ",")
    out = m.groupBy("combo_ord", "combo").agg(*[said(F.col(c)).alias(c) for c in CLAIMS], said(F.col("tiled")).alias("tiled_sources"), (F.countDistinct("own_tiled") <= 1).alias("uniform_tiling"))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in CLAIMS])), ",")
    return out.withColumn("warnings", missing).withColumn("fp_claim", F.when(F.col("bird_negatives") != "", "falsifiable").otherwise("not falsifiable"))


def matrix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model with every combination: its latest run, or why it is skipped (no frames of a member), in the plan's order: combination, then the first model, then the others by name."""
    m = spark.createDataFrame([(i, x) for i, x in enumerate(MODELS)], "model_ord int, model string")
    frames = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97 % 8).cast("int").alias("ord")).distinct()
    ready = _members(spark, sf_dir).join(F.broadcast(frames.withColumn("has", F.lit(True))), "ord", "left").groupBy("combo").agg(F.count_if(F.col("has").isNull()).alias("absent"))
    latest = runs(spark, sf_dir).groupBy("model", "combo").agg(F.max_by(F.struct("run_id", "map50"), F.struct("trained_at", "run_id")).alias("r"), F.count(F.lit(1)).alias("runs"))
    grid = combos(spark).select("combo_ord", "combo").crossJoin(F.broadcast(m)).join(F.broadcast(ready), "combo")
    out = grid.join(latest, ["model", "combo"], "left")
    state = F.when(F.col("absent") > 0, "skipped: no frames").when(F.col("r").isNull(), "planned").otherwise("done")
    return out.select("combo", "model", state.alias("state"), F.coalesce("runs", F.lit(0)).alias("runs"), F.col("r.run_id").alias("run_id"), F.col("r.map50").alias("map50"), "combo_ord", F.when(F.col("model_ord") == 0, 0).otherwise(1).alias("model_rank")).orderBy("combo_ord", "model_rank", "model")


def run_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, latest first, with derived flags, the primary metric by its aliases, and cells that print a dash for a missing metric, never a zero."""
    r = runs(spark, sf_dir)
    cell = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.4f", F.col(c)))
    metrics = F.map_filter(F.create_map(F.lit("mAP50"), F.col("map50"), F.lit("Recall"), F.col("recall")), lambda _, v: v.isNotNull())
    named = F.filter(F.map_entries(metrics), lambda e: F.lower(e["key"]).isin(*ALIASES))
    return r.select("run_id", "model", "combo", "trained_at", F.col("map50").isNotNull().alias("evaluated"), F.get(F.transform(named, lambda e: e["value"]), 0).alias("primary"), cell("map50").alias("map50_cell"), cell("recall").alias("recall_cell")).orderBy(F.desc("trained_at"), "run_id")


def cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best metric of each model on each source, over the runs whose combination holds it: null where there is none, and beside it the summary's figure, which is 0 there."""
    held = _members(spark, sf_dir).select("combo", "source")
    best = runs(spark, sf_dir).join(F.broadcast(held), "combo").groupBy("model", "source").agg(F.max("map50").alias("map50"))
    grid = spark.createDataFrame([(m,) for m in MODELS], "model string").crossJoin(sources(spark, sf_dir).select("source"))
    return grid.join(best, ["model", "source"], "left").withColumn("shown", F.coalesce("map50", F.lit(0.0)))


def training_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run, from its epochs (a row per order): epochs, the first epoch of the best metric, the best metric and the least loss."""
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("run_id"), F.col("o_orderkey").alias("epoch"), (F.col("o_orderkey") * 31 % 997 / 997.0).alias("metric"), (F.col("o_orderkey") * 17 % 499 / 100.0).alias("loss"))
    return o.groupBy("run_id").agg(F.count(F.lit(1)).alias("epochs"), F.max_by("epoch", F.struct("metric", -F.col("epoch"))).alias("best_epoch"), F.max("metric").alias("best_metric"), F.min("loss").alias("least_loss"))


def resolved_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image size, batch and tile of each model on each combination: the override, else the combination's, else the model's recipe."""
    recipe = spark.createDataFrame([("yolo", 960, 16), ("rtdetr", 640, 8), ("dino", 800, 2)], "model string, recipe_size int, recipe_batch int")
    sized = _members(spark, sf_dir).groupBy("combo_ord", "combo").agg(F.min("median_px").alias("least"), F.max(F.col("tiled").cast("int")).alias("tiled"))
    own = F.when(F.col("least") < 16, 1280).when(F.col("least") < 32, 960)
    override = F.when((F.col("combo") == "all8") & (F.col("model") == "yolo"), 1024)
    batch = F.when(F.col("imgsz") > F.col("recipe_size"), F.greatest(F.lit(1), F.floor(F.col("recipe_batch") * F.col("recipe_size") * F.col("recipe_size") / (F.col("imgsz") * F.col("imgsz"))))).otherwise(F.col("recipe_batch"))
    return sized.crossJoin(F.broadcast(recipe)).withColumn("imgsz", F.coalesce(override, own, "recipe_size")).select("combo", "model", "imgsz", batch.cast("long").alias("batch"), F.when(F.col("tiled") == 1, 640).alias("tile"))


def run_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stored run may prove, by the claims of its combination; nulls for a run whose metadata names none that is known."""
    known = combo_claims(spark, sf_dir).select("combo", *CLAIMS, "uniform_tiling", "fp_claim")
    r = runs(spark, sf_dir).select("run_id", F.when(F.col("run_id") % 9 == 0, F.concat("combo", F.lit("-old"))).when(F.col("run_id") % 13 != 0, F.col("combo")).alias("combo"))
    return r.join(F.broadcast(known), "combo", "left").select("run_id", "combo", *CLAIMS, "uniform_tiling", "fp_claim")


def source_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be said of each run's figures on each source: held in training or not, whether false positives can show, whether tiles differ from the source's own."""
    m = _members(spark, sf_dir).select("combo", "source", "tiled", F.lit(True).alias("held"))
    pairs = runs(spark, sf_dir).select("run_id", "combo").join(F.broadcast(sources(spark, sf_dir)), F.lit(True)).join(F.broadcast(m), ["combo", "source"], "left")
    own = F.coalesce(F.col("median_px") <= TILE_BELOW, F.lit(False))
    notes = (F.when(F.col("held"), "seen in training").otherwise("not seen in training"), F.when(~F.col("bird_negatives"), "few birds: false positives hardly show"), F.when(F.col("held") & (F.col("tiled") != own), "tiled otherwise than by its own targets"))
    return pairs.select("run_id", "source", F.array_join(F.array_compact(F.array(*notes)), "; ").alias("notes"))


#: Fixed values of the alert rules.
RULES = {"min_hits": 12, "alert_min_hits": 12, "max_gap": 5, "target_age": 4, "verify_frames": 3, "verify_s": 0.5, "recovery_s": 2.5, "lead_s": 2.0, "window_s": 3.0, "duration_s": 1.0}
_PROBLEMS = (("alerts before confirmation", "alert_min_hits < min_hits"), ("ended while still tracked", "max_gap < target_age"), ("hand-off can't be verified in time", "verify_frames * 0.033 > verify_s"), ("recovery gives up before a hand-off", "recovery_s < lead_s"), ("no time for a second view", "window_s < duration_s"))


def rule_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule sets that contradict themselves, with what is wrong: the fixed set, and variants of it, one per nation."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("variant"))
    for name, value in RULES.items():
        shift = {"alert_min_hits": -(F.col("variant") % 3), "max_gap": -(F.col("variant") % 4), "verify_frames": F.col("variant") % 20, "recovery_s": -(F.col("variant") % 2), "window_s": -(F.col("variant") % 5) / 2.0}.get(name, F.lit(0))
        n = n.withColumn(name, F.lit(value) + shift)
    return n.select("variant", F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(m)) for m, c in _PROBLEMS])), "; ").alias("problems"))


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered domain of severities, without the empty one, with the identities that reach each."""
    from skyledger.operators.alerts import alert_verdicts

    names = ("none", "info", "warn", "critical")
    domain = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "rank int, severity string").where("severity <> 'none'")
    per = alert_verdicts(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("identities"))
    return domain.join(F.broadcast(per), "severity", "left").select("rank", "severity", F.coalesce("identities", F.lit(0)).alias("identities"))


QUERIES = (combo_claims, matrix_plan, run_catalog, cross_table, training_curves, resolved_plans, rule_problems, severities, run_claims, source_notes)


def oracles(views: str) -> dict[str, str]:
    from skyledger.operators.alerts import oracles as verdict_sql

    mem = ", ".join(f"({i}, '{n}', '{s}', {'NULL' if f is None else f})" for i, (n, ms, f) in enumerate(COMBOS) for s in ms)
    pick = lambda values, c: f"list_extract({list(values)!r}, CAST({c} AS INT) + 1)"
    head = f"""WITH {sources_sql()},
mem AS (SELECT c.*, s.* EXCLUDE source, coalesce(CAST(force AS BOOLEAN), median_px <= {TILE_BELOW}, false) AS tiled, coalesce(median_px <= {TILE_BELOW}, false) AS own_tiled FROM (VALUES {mem}) c(combo_ord, combo, source, force) JOIN src s USING (source)),
models(model_ord, model) AS (VALUES (0, 'yolo'), (1, 'rtdetr'), (2, 'dino')),
runs AS (SELECT s_suppkey AS run_id, {pick(MODELS, 's_suppkey % 3')} AS model, {pick([c[0] for c in COMBOS], 's_suppkey % 14')} AS combo, s_suppkey * 7919 % 100000 AS trained_at, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey * 37 % 1000) / 1000.0::DOUBLE END AS map50, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * 91 % 1000) / 1000.0::DOUBLE END AS recall FROM supplier)
"""
    said = lambda c: f"coalesce(string_agg(source, ',' ORDER BY ord) FILTER (WHERE {c}), '')"
    rules = {n: str(v) for n, v in RULES.items()} | {"alert_min_hits": "12 - n_nationkey % 3", "max_gap": "5 - n_nationkey % 4", "verify_frames": "3 + n_nationkey % 20", "recovery_s": "2.5 - n_nationkey % 2", "window_s": "3.0 - (n_nationkey % 5) / 2.0"}
    listed = ", ".join(f"CASE WHEN {c} THEN '{m.replace(chr(39), chr(39) * 2)}' END" for m, c in _PROBLEMS)
    return {
        "combo_claims": head + f"SELECT *, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} = {chr(39) * 2} THEN {chr(39)}{c}{chr(39)} END' for c in CLAIMS)}], lambda x: x IS NOT NULL), ',') AS warnings, CASE WHEN bird_negatives <> '' THEN 'falsifiable' ELSE 'not falsifiable' END AS fp_claim FROM (SELECT combo_ord, combo, {', '.join(f'{said(c)} AS {c}' for c in CLAIMS)}, {said('tiled')} AS tiled_sources, count(DISTINCT own_tiled) <= 1 AS uniform_tiling FROM mem GROUP BY 1, 2)",
        "run_claims": head + ", known AS (" + f"SELECT *, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} = {chr(39) * 2} THEN {chr(39)}{c}{chr(39)} END' for c in CLAIMS)}], lambda x: x IS NOT NULL), ',') AS warnings, CASE WHEN bird_negatives <> '' THEN 'falsifiable' ELSE 'not falsifiable' END AS fp_claim FROM (SELECT combo_ord, combo, {', '.join(f'{said(c)} AS {c}' for c in CLAIMS)}, {said('tiled')} AS tiled_sources, count(DISTINCT own_tiled) <= 1 AS uniform_tiling FROM mem GROUP BY 1, 2)" + "), r AS (SELECT run_id, CASE WHEN run_id % 9 = 0 THEN combo || '-old' WHEN run_id % 13 <> 0 THEN combo END AS combo FROM runs) SELECT run_id, r.combo, {}, uniform_tiling, fp_claim FROM r LEFT JOIN known ON known.combo = r.combo".format(", ".join(CLAIMS)),
        "source_notes": head + f", k AS (SELECT run_id, s.source, bird_negatives, coalesce(median_px <= {TILE_BELOW}, false) AS own, m.tiled FROM runs CROSS JOIN src s LEFT JOIN (SELECT combo, source, tiled FROM mem) m ON m.combo = runs.combo AND m.source = s.source) SELECT run_id, source, concat_ws('; ', CASE WHEN tiled IS NULL THEN 'not seen in training' ELSE 'seen in training' END, CASE WHEN NOT bird_negatives THEN 'few birds: false positives hardly show' END, CASE WHEN tiled <> own THEN 'tiled otherwise than by its own targets' END) AS notes FROM k",
        "matrix_plan": head + ", have AS (SELECT DISTINCT l_orderkey % 97 % 8 AS ord FROM lineitem), ready AS (SELECT combo, count(*) FILTER (WHERE ord NOT IN (SELECT ord FROM have)) AS absent FROM mem GROUP BY 1), last AS (SELECT model, combo, count(*) AS runs, arg_max(run_id, trained_at * 1000000 + run_id) AS run_id FROM runs GROUP BY ALL), g AS (SELECT DISTINCT combo_ord, combo FROM mem) SELECT g.combo, m.model, CASE WHEN absent > 0 THEN 'skipped: no frames' WHEN last.run_id IS NULL THEN 'planned' ELSE 'done' END AS state, coalesce(runs, 0) AS runs, last.run_id, map50, combo_ord, CASE WHEN model_ord = 0 THEN 0 ELSE 1 END AS model_rank FROM g CROSS JOIN models m JOIN ready USING (combo) LEFT JOIN last ON last.model = m.model AND last.combo = g.combo LEFT JOIN runs r ON r.run_id = last.run_id",
        "run_catalog": head + "SELECT run_id, model, combo, trained_at, map50 IS NOT NULL AS evaluated, map50 AS primary, CASE WHEN map50 IS NULL THEN '-' ELSE printf('%.4f', map50) END AS map50_cell, CASE WHEN recall IS NULL THEN '-' ELSE printf('%.4f', recall) END AS recall_cell FROM runs".replace("AS primary", 'AS "primary"'),
        "cross_table": head + ", best AS (SELECT model, source, max(map50) AS map50 FROM runs JOIN mem USING (combo) GROUP BY ALL) SELECT m.model, s.source, map50, coalesce(map50, 0.0) AS shown FROM models m CROSS JOIN src s LEFT JOIN best ON best.model = m.model AND best.source = s.source",
        "training_curves": "WITH e AS (SELECT o_custkey % 20 AS run_id, o_orderkey AS epoch, (o_orderkey * 31 % 997) / 997.0::DOUBLE AS metric, (o_orderkey * 17 % 499) / 100.0::DOUBLE AS loss FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY metric DESC, epoch) AS n FROM e) SELECT run_id, count(*) AS epochs, max(epoch) FILTER (WHERE n = 1) AS best_epoch, max(metric) AS best_metric, min(loss) AS least_loss FROM r GROUP BY 1",
        "resolved_plans": head + ", sized AS (SELECT combo, min(median_px) AS least, max(CAST(tiled AS INT)) AS tiled FROM mem GROUP BY 1), rec(model, size, batch) AS (VALUES ('yolo', 960, 16), ('rtdetr', 640, 8), ('dino', 800, 2)), p AS (SELECT combo, model, size, rec.batch AS b, tiled, coalesce(CASE WHEN combo = 'all8' AND model = 'yolo' THEN 1024 END, CASE WHEN least < 16 THEN 1280 WHEN least < 32 THEN 960 END, size) AS imgsz FROM sized CROSS JOIN rec) SELECT combo, model, imgsz, CAST(CASE WHEN imgsz > size THEN greatest(1, b * size * size // (imgsz * imgsz)) ELSE b END AS BIGINT) AS batch, CASE WHEN tiled = 1 THEN 640 END AS tile FROM p",
        "rule_problems": f"WITH r AS (SELECT n_nationkey AS variant, {', '.join(f'{v} AS {n}' for n, v in rules.items())} FROM nation) SELECT variant, array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), '; ') AS problems FROM r",
        "severities": f"SELECT rank, severity, count(v.gid) AS identities FROM (VALUES (1, 'info'), (2, 'warn'), (3, 'critical')) t(rank, severity) LEFT JOIN ({verdict_sql(views)['alert_verdicts']}) v USING (severity) GROUP BY 1, 2",
    }
