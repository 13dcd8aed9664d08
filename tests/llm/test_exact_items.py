"""Items without a window of enough literals are found by their exact words."""

from skyledger.llm import decontamination


def test_items_short_of_literals(spark):
    bench = spark.createDataFrame([(1, "Compute 12 + 7 * 5 - 3 / 2"), (2, "Name Oslo"), (3, "11 13 17 19 23 29 31 37 41 43"), (4, "")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Please compute 12 + 7 * 5 - 3 / 2 now"), (2, "Compute 12 + 7 * 5 - 3 / 4"), (3, "First name Oslo."), (4, "primes: 7 11 13 17 19 23 29 31 37 41 43 47"), (5, "11 13 17 19 23 29 31 38"), (6, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.windows, r.exact) for r in decontamination.find_leaks(df, bench).collect()}
    assert got == {(1, 1, 1, True), (3, 2, 1, True), (4, 3, 3, True)}
    assert [r.doc_id for r in decontamination.decontaminate(df, bench).orderBy("doc_id").collect()] == [2, 5, 6]
