"""Every stage on nulls, empty and repeated rows, clashing columns and an empty table; the mix's words against its targets."""

import random

import pytest

import corpus_pipeline
from skyledger.llm import minhash, toxicity

NAMES = ["score", "predicted", "kept_id", "kept_rows", "rows", "mixed_id", "mixed_source", "mixed_copies", "mixed_copy", "mix_copies", "class_id", "n", "shard", "range", "key", "lot", "l_id", "y"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in NAMES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    some = lambda: " ".join(r.choice(words) for _ in range(60)) + "."
    texts = [some() for _ in range(80)] + [some() + " You are a vile fool." for _ in range(40)] + ["", None, " ", "é" * 3000]
    rows = [(i, t, [None, "a", "b"][i % 3], *range(len(NAMES))) for i, t in enumerate(texts)]
    extra = list(range(len(NAMES)))
    rows += [(200, texts[0], "a", *extra), rows[3], rows[3], (None, texts[5], "b", *extra), (None, None, None, *extra), (201, "How many red apples does the old farmer pick before the sun goes down today", "a", *extra)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(80 <= i < 120)) for i in range(124)] + [(None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "How many red apples does the old farmer pick before the sun goes down today"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_in_turn(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "shards":
            assert out.columns == docs.columns, name
            assert all(tuple(r)[3:] == tuple(range(len(NAMES))) for r in out.collect()), name
        docs = out.cache()
        kept.append(docs.collect())
    toxic, near, leaks, mixed, shards = kept
    ids = lambda rows: sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))
    # 80 clean texts, four odd ones, and the rows added to them
    assert ids(toxic) == sorted([*range(80), 120, 121, 122, 123, 200, 201, 3, 3]) + [None, None]
    assert ids(near) == sorted([*range(80), 120, 122, 123, 201]) + [None, None] or ids(near) == sorted([*range(80), 120, 123, 201]) + [None, None]
    assert ids(leaks) == [i for i in ids(near) if i != 201]
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in leaks} and sum(r.doc_id is None for r in mixed) == 2
    assert len(shards) == len(mixed) and {r.shard for r in shards} <= set(range(24))


def test_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0, name


def test_mix_follows_its_targets(spark, tables):
    from skyledger.llm import mixing

    r = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(r.choice([2, 30, 400]))), "abc"[min(2, i % 5)]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.STAGES[3][1](spark, docs, tables).collect()
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    targets = {x.source: x.target for x in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    for s, target in targets.items():
        assert abs(sum(len(x.text.split()) for x in out if x.source == s) - target) <= 0.02 * target + 400


def test_training_on_executors_equals_training_here(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_on(docs, labels)
    rows, prior = toxicity.training_rows(docs, labels)
    rows = rows.orderBy("l_id").collect()
    here = toxicity.train([x.text for x in rows], [x.y for x in rows], prior)
    assert model.weights.keys() == here.weights.keys() and {"vile", "fool"} <= model.weights.keys()
    assert model.bias == pytest.approx(here.bias, rel=1e-6) and model.floor == pytest.approx(here.floor)


def test_near_links_are_found_on_a_table(spark):
    """All pairs of the distinct texts of sf0.01 by brute force: every link lies within a class."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    p = minhash.NearParams()
    idf = minhash.document_frequencies(docs, p)
    rows = docs.collect()
    sets = [dict(zip(h.tolist(), (n * idf[(h & (p.idf_slots - 1)).astype("int64")]).tolist(), strict=True)) for h, n in minhash.shingles(pa.array([x.text for x in rows]), p)]
    holders = {}
    for i, a in enumerate(sets):
        for h in a:
            holders.setdefault(h, []).append(i)
    shared = {}
    for some in holders.values():
        for x, i in enumerate(some):
            for j in some[:x]:
                shared[i, j] = shared.get((i, j), 0) + 1
    cls = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()}
    links = found = 0
    for i, j in shared:
        both = sum(min(w, sets[j][h]) for h, w in sets[i].items() if h in sets[j])
        if both >= p.similarity * (sum(sets[i].values()) + sum(sets[j].values()) - both):
            links += 1
            found += cls[rows[i].doc_id] == cls[rows[j].doc_id]
    assert links > 50 and found == links
