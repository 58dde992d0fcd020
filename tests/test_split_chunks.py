"""Chunks of any text: the old cuts, in one pass over the text."""

from treeloom.streaming import split_chunks

TEXTS = {0: "", 1: None, 2: "a", 3: "a\U0001d538é\r\nb c", 4: "\n" * 7, 5: "x" * 12, 6: "ab\U0001d538" * 11}


def test_chunks_hold_so_many_characters(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, xml string")
    for size in (1, 3, 13):
        got = sorted(tuple(r) for r in split_chunks(docs, size).select("doc_id", "chunk", "last", "text").collect())
        want = []
        for k, t in TEXTS.items():
            cut = [t] if not t else [t[i : i + size] for i in range(0, len(t), size)]
            want += [(k, i, i == len(cut) - 1, c) for i, c in enumerate(cut)]
        assert got == want


def test_a_text_is_cut_in_one_pass(spark):
    docs = spark.range(1).selectExpr("id as doc_id", "repeat('0123456789', 1000000) as xml")
    cut = split_chunks(docs, 61)
    assert "substr" not in cut._jdf.queryExecution().optimizedPlan().toString()  # each would begin at the text's start
    assert cut.selectExpr("sum(length(text))").first()[0] == 10_000_000
