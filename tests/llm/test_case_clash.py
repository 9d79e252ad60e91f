import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", ["line dedup", "n-gram Jaccard join", "mixing sources"])
def test_columns_that_differ_by_case_alone(spark, name):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{line}\nown words", "en", "a", 9, "T1", 7, "S"), (2, f"{line}\nother", "en", "b", 9, "T2", 8, None), (3, None, "en", None, None, None, None, None), (4, line, "de", "a", 1, "T4", 1, "S")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT string, Doc_Id long, SOURCE string")
    out = STAGES[name](spark, docs, "")
    assert out.columns == docs.columns
    kept = {r[0]: r for r in out.toDF(*(f"c{i}" for i in range(8))).collect()}
    assert kept and all(r[5] == (f"T{i}" if i != 3 else None) for i, r in kept.items())
    if name != "n-gram Jaccard join":
        assert all(r[1] is None or r[4] == len(r[1]) for r in kept.values())
    if name == "line dedup":
        assert kept[2][1] == "other" and 4 not in kept and kept[1][1] == rows[0][1]


def test_shards_follow_the_bytes_of_text(spark, tmp_path, monkeypatch):
    from asofkit.llm import token_index
    from asofkit.llm.queries import tokenizer_path

    docs = spark.createDataFrame([(i, "some words of text " * 50) for i in range(300)], "doc_id long, text string")
    write = lambda name: token_index.write_shards(docs, f"file://{tmp_path}/{name}", tokenizer_path("byte_bpe_50k.json"), 2).count()
    few = write("a")
    monkeypatch.setattr(token_index, "SHARD_BYTES", 10_000)
    assert few == 4 and write("b") >= 25


def test_mixing_shuffles_texts_twice(spark):
    """Once for the order within a source, where the targets join without another shuffle, and once for the range sort."""
    docs = spark.createDataFrame([(i, f"some words {i}", "en", [None, "", "=", "a"][i % 4], 9) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    out = STAGES["mixing sources"](spark, docs, "")
    moved = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert moved and not any("<=>" in line or "coalesce" in line for line in moved)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(group") >= 1 and "Exchange hashpartitioning(coalesce" not in plan
    rows = out.collect()
    assert {r.source for r in rows} == {None, "", "=", "a"}  # the mix leaves documents of lighter sources out
