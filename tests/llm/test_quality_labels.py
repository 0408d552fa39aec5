"""The quality filter without labels to learn from."""

from __future__ import annotations

from zlib import crc32

from tracemill.llm import quality


#: Held out, so its label teaches nothing.
HELD = next(i for i in range(8) if crc32(str(i).encode()) % 5 == 0)


def test_all_rows_stay_without_usable_labels(spark):
    # the untrained network scores the first four below 0.3
    texts = ["0" * 300, "1" * 300, "L" * 300, "P" * 300, "words of a text", "", None, "long " * 6000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for labels in ([], [(HELD, 1)], [(None, 1), (3, None)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        assert quality.accepted(df, table).count() == df.count()
        scores = quality.score_quality(df, table)
        assert scores.count() == df.count() and scores.filter("predicted = 0").count() > 0
