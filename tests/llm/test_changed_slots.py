"""A changed number or name hides only the windows that hold the conflict, in the query and in the pipeline."""

from skyledger.llm import decontamination, stages

ITEM = "A farmer picks 5 apples from the old tree behind the red barn and then rests for a long while until the sun goes down, so how many will be left after 5 days of rain"


def test_conflicts_void_their_windows_only(spark, tmp_path):
    texts = {1: ITEM, 2: ITEM.replace("5 days", "6 days"), 3: ITEM.replace("5 apples", "7 apples").replace("5 days", "9 days"), 4: "Then Alice gave 3 pens to Bob while Alice sang", 5: "Then Carol gave 3 pens to Bob while Eve sang"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, texts[4])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.item_id, r.exact) for r in decontamination.op7_template_decontamination(spark, str(tmp_path)).collect()}
    n = {r.doc_id: r.windows for r in decontamination.op7_template_decontamination(spark, str(tmp_path)).collect()}
    assert {d: got.get(d) for d in (1, 2, 3, 4)} == {1: (1, True), 2: (1, False), 3: (1, False), 4: (2, True)}
    assert n[1] == n[2] == n[3]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert not {r.doc_id for r in stages.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()} & {1, 2, 3, 4}


def test_a_window_with_a_conflict_is_dropped(spark):
    bench = spark.createDataFrame([(1, "they say Alice met her friend Alice today")], "item_id long, text string")
    df = spark.createDataFrame([(1, "they say Carol met her friend Carol today"), (2, "they say Carol met her friend Eve today")], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.find_leaks(df, bench, decontamination.EACH_WINDOW).collect()] == [1]
