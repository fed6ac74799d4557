"""What the labelled sample sends to the driver: a text an id, and a bound in lines."""

from strandlake.llm import quality


def test_repeated_ids_are_one_text_and_lines_have_a_bound(spark, monkeypatch):
    text = "some words of a line\nand of another one\n"
    docs = spark.createDataFrame([(i, text * (1 + i % 3), "a") for i in range(40) for _ in range(1 + i % 4)] + [(None, text, "a"), (50, None, "a")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(50, 1), (60, 0), (7, 0)], "doc_id long, quality int")
    rows, good = quality.labelled(docs, labels)
    assert len(rows) >= 40 and sum(good) in (19, 20) and all(x.shape[1] == len(quality.FEATURES) for x in rows)
    total = sum(len(x) for x in rows)
    monkeypatch.setattr(quality, "MOST_TRAINED_LINES", total // 2)
    fewer, _ = quality.labelled(docs, labels)
    assert 0 < len(fewer) < len(rows) and total // 2 - 10 < sum(len(x) for x in fewer) <= total // 2
    assert quality.labelled(docs.limit(0), labels) == ([], [])
