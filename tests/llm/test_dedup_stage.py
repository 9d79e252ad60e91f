"""The pipeline's removal of similar documents where ids repeat or are null."""

import random

import corpus_pipeline


def test_rows_of_one_id_are_documents_of_their_own(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda: " ".join(str(rnd.random()) for _ in range(100))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [
        (7, a + " end"), (7, b), (3, a),  # id 7: a near copy of id 3's text, and a text of its own
        (8, c), (8, c + " end"),  # near copies of one id
        (None, d), (None, d + " end"), (None, e), (None, a + " fin"),  # null ids: near copies, a text of its own, a copy of id 3's
        (9, ""), (10, None), (11, ""), (11, ""),  # no words, nothing similar; a repeated row
    ]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    left = corpus_pipeline.dedup_documents(spark, spark.read.parquet(path), "")
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert left.columns == ["doc_id", "text"]
    either = [x for x in got if x[1] in (c, c + " end", d, d + " end")]
    assert sorted((x[0] is None, x[1][:9]) for x in either) == sorted([(False, c[:9]), (True, d[:9])])
    assert sorted(map(str, set(got) - set(either))) == sorted(map(str, [(7, b), (3, a), (None, e), (9, ""), (10, None), (11, "")])) and len(got) == 8
