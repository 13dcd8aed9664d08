"""Toxicity by multiple-instance learning: noisy-or of sentence scores, trained from document labels, then used to locate sentences."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import read, settle, text_of

#: Standard errors by which a word's log odds must speak for label 1.
LEAST_Z = 2.0
SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")


class NoisyOr:
    """P(document is toxic) = 1 - prod over sentences (1 - sigmoid(bias + weights of the sentence's distinct words)).

    Holds at most max_words words, so its size is bounded whatever it is trained on.
    """

    def __init__(self, weights: dict[str, float], bias: float, floor: float):
        self.weights, self.bias, self.floor = weights, bias, floor

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, probability) of sentences with a known word; the others have probability sigmoid(bias), summed up in `floor`."""
        known = self.weights
        for s in SENTENCE.finditer(text):
            # cheap pass first: most sentences hold no known word
            hit = {w for w in TOKEN.findall(s.group().lower()) if w in known}
            if hit:
                z = self.bias + sum(known[w] for w in hit)
                yield s.start(), s.end(), 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str) -> float:
        safe = 1 - self.floor
        for _, _, p in self.sentences(text):
            safe *= 1 - p
        return float(min(1.0, max(0.0, 1 - safe)))


def telling_words(counts: Iterator[tuple[str, int, int]], n1: int, n0: int, max_words: int = 4096) -> list[str]:
    """Of (word, documents of label 1, of label 0) those that speak for label 1, the most telling first (log odds over its standard error)."""
    said = {}
    for w, a, b in counts:
        p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        z = (np.log(p / (1 - p)) - np.log(q / (1 - q))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if z > LEAST_Z:
            said[w] = z
    return sorted(said, key=lambda w: (-said[w], w))[:max_words]


def words_of(text: str) -> set[str]:
    # a sentence's bounds are no word characters, so the words of a text are those of its sentences
    return {m.group() for m in TOKEN.finditer(text.lower())}


def known_sentences(text: str, index: dict[str, int]) -> Counter:
    """How often each set of known words makes up the known words of a sentence."""
    found = Counter()
    for s in SENTENCE.finditer(text):
        if got := {index[w] for w in TOKEN.findall(s.group().lower()) if w in index}:
            found[tuple(sorted(got))] += 1
    return found


def fit(documents: list[tuple[int, Counter]], words: list[str], prior: float, steps: int = 300, rate: float = 0.1, decay: float = 2e-3) -> NoisyOr:
    """Fit by gradient descent on the log loss of (label, known_sentences) of documents, weighted so that label 1 has share `prior`.

    One class or no document gives a model without words, whose score is the prior.
    """
    y = np.array([label for label, _ in documents], float)
    n1 = int(y.sum())
    n0 = len(y) - n1
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if not n1 or not n0:
        return NoisyOr({}, -30.0, prior if n1 or n0 else 0.0)
    # flat rows of (sentence, word) and (sentence -> document, times)
    sent, word, doc, times = array("q"), array("q"), array("q"), array("q")
    for d, (_, sentences) in enumerate(documents):
        for got, n in sentences.items():
            sent.extend([len(doc)] * len(got))
            word.extend(got)
            doc.append(d), times.append(n)
    sent, word, doc, times = (np.array(x, np.int64) for x in (sent, word, doc, times))
    weight = np.where(y > 0, prior / n1, (1 - prior) / n0)
    # what no word explains: the share of label 1 among documents without a known word
    bare = np.ones(len(y), bool)
    bare[doc] = False
    base = float((weight * y)[bare].sum() / max(1e-9, weight[bare].sum())) if bare.any() else prior
    base = min(0.5, max(1e-4, base))
    w, bias = np.zeros(len(words)), -2.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(sent, w[word], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_safe = np.log1p(-base) + np.bincount(doc, times * np.log(np.maximum(1e-12, 1 - p)), len(y))
        pd = np.clip(1 - np.exp(log_safe), 1e-7, 1 - 1e-7)
        # d loss / d z of a sentence: p * (1 - y / pd)
        g = times * (weight[doc] * (1 - y[doc] / pd[doc])) * p
        grad = np.append(np.bincount(word, g[sent], len(words)) + decay * w / len(words), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], float(np.clip(bias - move[-1], -12, 0))
    return NoisyOr({x: float(w[i]) for i, x in enumerate(words) if abs(w[i]) > 1e-3}, bias, base)


def train(texts: list[str], labels: list[int], prior: float, max_words: int = 4096, min_docs: int = 5, **how) -> NoisyOr:
    """The model of a few texts at hand; words are kept that occur in min_docs of them at least."""
    n1 = sum(labels)
    in1, in0 = Counter(), Counter()
    for t, y in zip(texts, labels, strict=True):
        (in1 if y else in0).update(words_of(t))
    words = telling_words(((w, in1[w], in0[w]) for w in in1.keys() | in0.keys() if in1[w] + in0[w] >= min_docs), n1, len(labels) - n1, max_words)
    index = {w: i for i, w in enumerate(words)}
    return fit([(int(y), known_sentences(t, index)) for t, y in zip(texts, labels, strict=True)], words, prior, **how)


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = 8192, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", train_only: bool = True) -> tuple[DataFrame, float]:
    """(l_id, text, y) of at most `bound` labelled ids, half of each class where there are so many, in order of a hash of the id; and the share of label 1 among all labelled ids.

    train_only: only ids whose crc32(id as text) mod 3 is not 1. Ids and labels that are null are left
    out; each id counts once for each label it has; rows of one id with different texts all train.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("l_id"), (F.col(label_col) == 1).cast("int").alias("y")).distinct()
    if train_only:
        known = known.where(F.crc32(F.col("l_id").cast("string").cast("binary")) % 3 != 1)
    n, n1 = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    # at most `bound` ids: small enough to broadcast
    one = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(bound // 2)
    some = F.broadcast(settle(one(1).unionByName(one(0))))
    text = docs.select(F.col(id_col).alias("d_id"), text_of(text_col).alias("text"))
    return settle(text.join(some, F.col("d_id") == F.col("l_id")).select("l_id", "text", "y").distinct()), n1 / n if n else 0.0


def train_on(docs: DataFrame, labels: DataFrame, max_words: int = 4096, min_docs: int = 5, **which) -> NoisyOr:
    """The model of the labelled rows among docs (see training_rows), whose texts stay on the executors: words are counted there, and the driver gets the counts of words that occur in min_docs training texts, at most 64 * max_words of them, and the word numbers of each text's different sentences."""
    rows, prior = training_rows(docs, labels, **which)
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()

    def count(batches):
        import pyarrow as pa

        in1, in0 = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (in1 if y else in0).update(words_of(t.as_py()))
        words = list(in1.keys() | in0.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([in1[w] for w in words], pa.int64()), pa.array([in0[w] for w in words], pa.int64())], ["word", "a", "b"])

    counts = rows.select("text", "y").mapInArrow(count, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # words that label 1 has in no larger share can't speak for it
    counts = counts.where((F.col("a") + F.col("b") >= min_docs) & (F.col("a") * (n - n1) > F.col("b") * n1))
    some = counts.orderBy(F.desc(F.col("a") / (F.col("b") + 1)), "word").limit(64 * max_words).collect()
    words = telling_words(((r.word, r.a, r.b) for r in some), n1, n - n1, max_words)
    index = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def known(batches):
        import pyarrow as pa

        for batch in batches:
            found = [known_sentences(t.as_py(), index.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(f) for f in found], pa.list_(pa.list_(pa.int32()))), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))], ["l_id", "y", "sentences", "times"])

    type_of = rows.schema["l_id"].dataType.simpleString()
    got = rows.mapInArrow(known, f"l_id {type_of}, y int, sentences array<array<int>>, times array<long>").collect()
    got.sort(key=lambda r: (str(r.l_id), r.sentences))
    return fit([(r.y, Counter({tuple(w): n for w, n in zip(r.sentences, r.times, strict=True)})) for r in got], words, prior)


def drop_toxic(docs: DataFrame, model: NoisyOr, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold. A null text is the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([shared.value.score(t.as_py() or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, model: NoisyOr, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs with score, predicted and worst_sentences: array of (start, end, p) in code points, all sentences with p >= 0.5, the likeliest first.

    Null and empty texts hold no sentence; their score is that of a text without known words. Columns
    of docs named like the new ones are replaced.
    """
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("score", "predicted", "worst_sentences")] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("worst_sentences", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])))])
    names = [f.name for f in schema.fields[:-3]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        model, out = shared.value, to_arrow_schema(schema)
        for batch in batches:
            scores, spans = [], []
            for x in batch.column(batch.schema.get_field_index(text_col)):
                found, safe = [], 1 - model.floor
                for a, b, p in model.sentences(x.as_py() or ""):
                    safe *= 1 - p
                    found.append({"start": a, "end": b, "p": float(p)})
                scores.append(float(min(1.0, max(0.0, 1 - safe))))
                spans.append(sorted((f for f in found if f["p"] >= 0.5), key=lambda f: (-f["p"], f["start"])))
            s = np.array(scores)
            cols = [batch.column(batch.schema.get_field_index(c)).cast(out.field(c).type) for c in names] + [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32()), pa.array(spans, out.field("worst_sentences").type)]
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return docs.mapInArrow(run, schema)


def op4_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a row per row of documents, null and empty texts with the score of a text without known words. Repeated rows have equal scores."""
    docs = read(spark, sf_dir, "documents")
    model = train_on(docs, read(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", F.expr("transform(worst_sentences, s -> struct(s.start, s.end))").alias("worst_sentences"))
