"""Importance resampling towards a target: hashed n-gram counts of the corpus and of the target give each bucket a gain; documents are drawn by their gain and seeded Gumbel noise."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import read, settle, text_of

#: A feature's word: runs of lower-case ASCII letters, digits and all that isn't ASCII.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: monotonically_increasing_id() is the partition's number above so many bits, and the row's below.
_ROW_BITS = 33


def features(text: Column, most: int = 1) -> Column:
    """Array of all runs of 1 to `most` consecutive words of the text, joined by one space; only A-Z are lower-cased."""
    words = F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(FEATURE_WORD), F.lit(0))
    if most == 1:
        return words
    # in a lambda of its own, so that the words are taken once
    return F.element_at(F.transform(F.array(words), lambda w: _grams(w, most)), 1)


def _grams(words: Column, most: int) -> Column:
    none = F.array().cast("array<string>")
    run = lambda n: lambda i: F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(n)])
    runs = [F.when(F.size(words) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), run(n))) for n in range(2, most + 1)]
    return F.concat(words, *runs)


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, buckets: int, most: int = 1) -> DataFrame:
    """texts (text) -> (bucket, n): features by bucket, added up in each task before the exchange, so at most `buckets` rows leave a task."""
    return texts.select(F.explode(features(text_of(), most)).alias("feature")).groupBy(bucket_of(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int, most: int = 1) -> DataFrame:
    """(bucket, gain) of the buckets that docs fill: floor(1000 ln) of the target's smoothed share over the corpus'. Two tables of at most `buckets` rows; their totals alone come to the driver."""
    own = settle(bucket_counts(docs, buckets, most))
    wanted = settle(bucket_counts(target, buckets, most).withColumnRenamed("n", "t"))
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
    s, t = float(total(own, "n") + buckets), float(total(wanted, "t") + buckets)
    ratio = (F.coalesce("t", F.lit(0)) + F.lit(1.0)) * F.lit(s) / ((F.col("n") + F.lit(1.0)) * F.lit(t))
    return own.join(F.broadcast(wanted), "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc: Column, seed: int) -> Column:
    """Seeded Gumbel noise of a document in thousandths, of the first 32 bits of the digest of its id (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], eligible: str, share: Column) -> DataFrame:
    """rows with rank: 1, 2, 3... of the first share(n) of the n eligible rows in the order, null for the others.

    A distributed sort, eligible rows first; a row's place in its partition and the number of rows in the
    partitions before it give its rank, so nothing is numbered in one task. The sorted rows are settled,
    or a second sort might part them otherwise.
    """
    at = F.monotonically_increasing_id()
    placed = settle(rows.orderBy(F.col(eligible).desc(), *order).withColumns({"_part": F.shiftright(at, _ROW_BITS), "_row": at.bitwiseAND((1 << _ROW_BITS) - 1)}))
    # a row for each partition of the sort
    per = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(eligible)).alias("_e"))
    before = per.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), share(F.sum("_e").over(Window.partitionBy())).alias("_most"))
    rank = F.col("_before") + F.col("_row") + 1
    return placed.join(F.broadcast(before), "_part").withColumn("rank", F.when(rank <= F.col("_most"), rank).cast("long")).drop("_part", "_row", "_before", "_most")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, most: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every row of docs once: id_col, n_features, weight, score, rank; all long.

    Features are runs of 1 to `most` words of the whole text, repeats counted. weight is the sum of their
    buckets' gains (no features: 0), score adds seeded noise to it. Of the n documents with least_words
    words or more floor(percent * n / 100) have a rank, by score, ties by id (null first), then number of
    features and weight; all others have none. Null texts are empty, null ids have the noise of an empty
    id, repeated rows are each scored and may each be drawn, an empty table gives no rows, an empty
    target a weight by the corpus alone. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(texts, target.select(F.col(target_col).alias("text")), buckets, most)
    # numbered before the explode, so that all features of a row have its number
    each = texts.withColumn("_id", F.monotonically_increasing_id()).select("_id", "doc_id", F.explode_outer(features(text_of(), most)).alias("feature"))
    # words have no space inside
    word = F.col("feature").isNotNull() if most == 1 else F.instr("feature", " ") == 0
    each = each.select("_id", "doc_id", bucket_of(F.col("feature"), buckets).alias("bucket"), word.alias("word"))
    summed = each.join(F.broadcast(gain), "bucket", "left").groupBy("_id", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"), F.count_if("word").alias("n_words"))
    scored = summed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("_eligible"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")]
    drawn = ranked(scored, order, "_eligible", lambda n: F.floor(n * percent / 100))
    return drawn.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the benchmark's words; a tenth of those of 20 words or more drawn."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def oracle(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    """DuckDB SQL of op12; checksums byte by byte, of each distinct word once."""
    return f"""WITH tab AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{FEATURE_WORD}') AS words FROM documents),
dw AS MATERIALIZED (SELECT r, unnest(words) AS w FROM d),
bw AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{FEATURE_WORD}')) AS w FROM benchmark),
b AS MATERIALIZED (SELECT w, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(w)), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::UBIGINT)), lambda c, k: xor(c >> 8, t[(xor(c, k) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % {buckets})::INT AS bucket
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)), tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bw JOIN b USING (w) GROUP BY 1),
g AS (SELECT s.bucket, floor(1000.0::DOUBLE * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {buckets})::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {buckets})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
wt AS (SELECT r, sum(gain) AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT d.r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN wt USING (r)),
sc AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score, n_features >= {least_words} AS ok FROM h),
rk AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS k, count(*) FILTER (ok) OVER () AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND k <= {percent} * n // 100 THEN k END::BIGINT AS rank FROM rk"""
