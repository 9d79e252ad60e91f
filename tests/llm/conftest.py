import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls in any column, empty and very long texts, ties, repeated rows and near copies."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = "\n".join(text(20) for _ in range(4))
    base = text(120)
    rows = []
    for i in range(60):
        kind, t = i % 6, text(rnd.randint(1, 80))
        if kind == 1:
            t = base.replace(" ", f" {words[i]} ", 1)
        if kind == 2:
            t = t + "\n" + passage + "\n" + text(5)
        if kind == 3:
            t = "\n".join(text(8) for _ in range(3)) + "\n\n" + text(3)
        rows.append((i, t, ["en", "de"][i % 2], f"s{i % 3}", len(t), "x"))
    rows += [(100, None, None, None, None, None), (101, "", "en", "s1", 0, ""), (102, "  \n\t ", "en", "s1", 5, None), (None, text(30), "en", None, 3, "y")]
    rows += [(103, text(30_000), "de", "s2", 1, "z"), (104, base.upper(), "en", "s0", 1, "z"), rows[0], rows[0], (105, "ÄÖ é " * 40, "de", "s0", 1, "z")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(corpus, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
