"""All offending sentences of a document are located."""

from skyledger.llm import toxicity


def test_every_offending_sentence(spark):
    model = toxicity.NoisyOr({"vile": 6.0, "fool": 7.0}, -3.0, 0.01)
    text = "".join(f" You {'vile' if i % 2 else 'fool'} {i}. Fine words here." for i in range(10))
    row = toxicity.score_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[s.start : s.end] for s in row.worst_sentences] == [f" You fool {i}" for i in range(0, 10, 2)] + [f" You vile {i}" for i in range(1, 10, 2)]
