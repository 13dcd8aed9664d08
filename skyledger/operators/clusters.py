"""Clusters of near-equal images by their hashes: links by Hamming distance, connected components, and first-fit clusters in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.scores import hamming_pairs
from skyledger.sources import views
from skyledger.sources.sinks import scratch

#: Fixed value: most bits that differ between two hashes of one cluster.
MOST = 4


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that lineage ends there and a lost executor repeats nothing before it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, root): root is the least id that links lead to.

    Each round every id takes the least root among its neighbours' and then that root's own root, so the
    rounds follow the logarithm of the longest chain, and nothing is gathered on the driver.
    """
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots = settled(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        seen = both.join(roots.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = roots.join(seen, "id").select("id", "root", F.least("root", "near").alias("new"))
        # the old root follows the least root that any of its ids has seen
        pulled = step.where("new < root").groupBy(F.col("root").alias("p")).agg(F.min("new").alias("pull"))
        step = settled(step.join(pulled, F.col("new") == F.col("p"), "left").select("id", "root", F.coalesce("pull", "new").alias("new")))
        jump = step.select(F.col("id").alias("j"), F.col("new").alias("to"))
        step = settled(step.join(jump, step.new == F.col("j"), "left").select("id", F.col("root").alias("old"), F.least("new", F.coalesce("to", "new")).alias("root")))
        roots = step.select("id", "root")
        if not step.where("old <> root").limit(1).count():
            return roots


def first_fit(hashes: DataFrame, links: DataFrame, most: int = MOST) -> DataFrame:
    """hashes (id, hash) -> (id, cluster): in order of id, each joins the first cluster that has any hash within `most` bits, else starts one; clusters never merge, and are named by their first id.

    An id can only join clusters of its own component, so the order is kept within components, and those
    spread over the cluster; ids without a link are alone and go through no Python.
    """
    tied = hashes.join(components(links), "id", "left")
    nodes = tied.where("root is not null")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list[int]] = []
        out = []
        for i, h in zip(*(rows.sort_values("id")[c].tolist() for c in ("id", "hash")), strict=True):
            of = next((c for c in clusters if any((h ^ k).bit_count() <= most if h ^ k >= 0 else ((h ^ k) + (1 << 64)).bit_count() <= most for k in c[1:])), None)
            if of is None:
                of = [i]
                clusters.append(of)
            of.append(h)
            out.append((i, of[0]))
        return pd.DataFrame(out, columns=["id", "cluster"])

    return nodes.groupBy("root").applyInPandas(run, "id long, cluster long").unionByName(tied.where("root is null").select("id", F.col("id").alias("cluster")))


def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of images by links of four bits or fewer: size, and how many sources and splits each crosses."""
    nodes = views.hashes(spark, sf_dir)
    # equal hashes are one node of hamming_pairs
    rep = nodes.groupBy("hash").agg(F.min("id").alias("rep"))
    roots = components(hamming_pairs(spark, sf_dir).select("a", "b"))
    own = nodes.join(rep, "hash").join(roots, F.col("rep") == roots.id, "left").select(nodes.id, F.coalesce("root", "rep").alias("root"))
    of = own.withColumn("source", F.col("id") % 8).withColumn("split", F.when(F.col("id") % 6 == 0, "val").otherwise("train"))
    return of.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("source").alias("sources"), F.countDistinct("split").alias("splits")).where("members > 1")


def first_fit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit clusters of images with their members."""
    nodes = views.hashes(spark, sf_dir)
    rep = nodes.groupBy("hash").agg(F.min("id").alias("rep"))
    same = nodes.join(rep, "hash").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return first_fit(nodes, hamming_pairs(spark, sf_dir).select("a", "b").unionByName(same))


def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What first-fit clusters amount to: images, clusters of several, surplus images and their share, clusters across sources and across splits, and those small ones across splits that a person should look at."""
    c = first_fit_clusters(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("id") % 8).alias("sources"), F.countDistinct((F.col("id") % 6 == 0)).alias("splits"))
    many = F.col("n") > 1
    t = c.agg(F.sum("n").alias("images"), F.count_if(many).alias("clusters"), F.sum(F.when(many, F.col("n") - 1).otherwise(0)).alias("surplus"), F.count_if(many & (F.col("sources") > 1)).alias("cross_source"), F.count_if(many & (F.col("splits") > 1)).alias("cross_split"), F.count_if(many & (F.col("splits") > 1) & (F.col("n") <= 6)).alias("to_review"))
    return t.withColumn("share", F.round(F.col("surplus") / F.greatest("images", F.lit(1)), 9))


QUERIES = (duplicate_components, first_fit_clusters, duplicate_report)


def oracles(views: str) -> dict[str, str]:
    # image by image, over a list of all hashes so far with their cluster; of the clusters that hold a near one the first counts
    fit = f"""WITH RECURSIVE own AS (SELECT vec_id AS id, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END), lambda s, v: s | v) AS hash FROM embeddings),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS n, * FROM (SELECT * FROM own UNION ALL SELECT id + 10000000, xor(hash, ((1::UBIGINT << (id // 20 % 7)) - 1)::UBIGINT) FROM own WHERE id % 20 = 0)),
w AS (SELECT 0::BIGINT AS n, 0::BIGINT AS id, [] :: STRUCT(c BIGINT, hash UBIGINT)[] AS seen, 0::BIGINT AS cluster
  UNION ALL SELECT n, id, list_append(seen, {{'c': coalesce(c, id), 'hash': hash}}), coalesce(c, id) FROM (SELECT w.seen, h.n, h.id, h.hash, list_min(list_transform(list_filter(w.seen, lambda m: bit_count(xor(m.hash, h.hash)) <= {MOST}), lambda m: m.c)) AS c FROM w JOIN h ON h.n = w.n + 1) x),
f AS (SELECT id, cluster FROM w WHERE n > 0)
"""
    return {
        "first_fit_clusters": fit + "SELECT * FROM f",
        "duplicate_report": fit
        + """, c AS (SELECT cluster, count(*) AS n, count(DISTINCT id % 8) AS sources, count(DISTINCT id % 6 = 0) AS splits FROM f GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS images, count(*) FILTER (n > 1) AS clusters, sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END)::BIGINT AS surplus, count(*) FILTER (n > 1 AND sources > 1) AS cross_source, count(*) FILTER (n > 1 AND splits > 1) AS cross_split, count(*) FILTER (n > 1 AND splits > 1 AND n <= 6) AS to_review FROM c)
SELECT *, round(surplus / greatest(images, 1)::DOUBLE, 9) AS share FROM t""",
        "duplicate_components": """WITH RECURSIVE own AS (SELECT vec_id AS id, list_reduce(list_prepend(0::UBIGINT, list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END)), lambda s, x: xor(s, x)) AS hash FROM embeddings),
h AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT id + 10000000, xor(hash, ((1::UBIGINT << (id // 20 % 7)::UBIGINT) - 1)::UBIGINT) FROM own WHERE id % 20 = 0),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id <> b.id AND bit_count(xor(a.hash, b.hash)) <= 4),
w AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON w.id = e.a),
r AS (SELECT id, min(root) AS root FROM w GROUP BY 1)
SELECT root, count(*) AS members, count(DISTINCT id % 8) AS sources, count(DISTINCT CASE WHEN id % 6 = 0 THEN 'val' ELSE 'train' END) AS splits FROM r GROUP BY 1 HAVING count(*) > 1""",
    }
