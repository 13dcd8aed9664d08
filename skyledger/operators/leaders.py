"""Leaders in order: each image joins the first representative within a few bits of its hash, or becomes one itself; representatives never merge. Decided in rounds of joins over candidate pairs, without a task per component."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.clusters import MOST, settled
from skyledger.operators.scores import near_hashes
from skyledger.sources import views


def lead(hashes: DataFrame, most: int = MOST) -> DataFrame:
    """hashes (id, hash) -> (id, leader): in order of id, each id has the first earlier leader within `most` bits of it, else it leads itself. Ids without hash lead themselves; ids must be unique.

    Ids of one hash have one leader, so only the first of each takes part, however many there are. In each round an open id whose earlier neighbours are all decided is decided: it follows if one of them
    leads, else it leads. An id that has a leading neighbour follows at once, whatever is open. So the
    rounds are as many as the longest chain of ids that wait for each other, and each works on open pairs only.
    """
    one = settled(hashes.where("hash is not null").groupBy("hash").agg(F.min("id").alias("id")))
    pairs = settled(near_hashes(one, most).select(F.col("a").alias("early"), F.col("b").alias("late")))
    open_ids = settled(pairs.select(F.col("late").alias("id")).distinct())
    leads = settled(pairs.select(F.col("early").alias("id")).distinct().join(open_ids, "id", "left_anti"))
    waiting = pairs
    while open_ids.limit(1).count():
        led = waiting.join(leads.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id")).distinct()
        still = open_ids.join(led, "id", "left_anti")
        held = waiting.join(still.withColumnRenamed("id", "early"), "early", "left_semi").join(still.withColumnRenamed("id", "late"), "late", "left_semi")
        blocked = held.select(F.col("late").alias("id")).distinct()
        fresh = still.join(blocked, "id", "left_anti")
        leads = settled(leads.unionByName(fresh))
        open_ids = settled(still.join(leads, "id", "left_anti"))
        waiting = settled(waiting.join(open_ids.withColumnRenamed("id", "late"), "late", "left_semi"))
    first = pairs.join(leads.withColumnRenamed("id", "early"), "early", "left_semi").join(leads.withColumnRenamed("id", "late"), "late", "left_anti").groupBy(F.col("late").alias("id")).agg(F.min("early").alias("leader"))
    of = one.join(first, "id", "left").select("hash", F.coalesce("leader", "id").alias("leader"))
    return hashes.join(of, "hash", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def leader_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image with the sequence that its leader begins: named by the leader's place among all leaders, with its size."""
    led = settled(lead(views.hashes(spark, sf_dir)))
    sizes = led.groupBy("leader").agg(F.count(F.lit(1)).alias("members"))
    return led.join(sizes, "leader").select("id", "leader", "members")


def oracles(_views: str) -> dict[str, str]:
    """SQL of the same: image by image, over the list of leaders so far."""
    return {
        "leader_sequences": f"""WITH RECURSIVE own AS (SELECT vec_id AS id, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END), lambda s, v: s | v) AS hash FROM embeddings),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS n, * FROM (SELECT * FROM own UNION ALL SELECT id + 10000000, xor(hash, ((1::UBIGINT << (id // 20 % 7)) - 1)::UBIGINT) FROM own WHERE id % 20 = 0)),
w AS (SELECT 0::BIGINT AS n, 0::BIGINT AS id, [] :: STRUCT(id BIGINT, hash UBIGINT)[] AS leaders, 0::BIGINT AS leader
  UNION ALL SELECT h.n, h.id, CASE WHEN f IS NULL THEN list_append(leaders, {{'id': h.id, 'hash': h.hash}}) ELSE leaders END, coalesce(f, h.id) FROM (SELECT w.leaders, h.n, h.id, h.hash, list_filter(w.leaders, lambda l: bit_count(xor(l.hash, h.hash)) <= {MOST})[1].id AS f FROM w JOIN h ON h.n = w.n + 1) h)
SELECT id, leader, count(*) OVER (PARTITION BY leader) AS members FROM w WHERE n > 0"""
    }


QUERIES = (leader_sequences,)
