import random

from pyspark.sql import functions as F

from asofkit.llm import ngram_join

LINE = " ".join(f"licence{i}" for i in range(12))


def test_links_with_a_passage_in_every_text(spark):
    """All texts hold one line."""
    rnd = random.Random(3)
    texts = []
    for i in range(150):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(10, 60))]
        texts.append(" ".join([*base, LINE]))
        if i % 3 == 0:
            base[rnd.randrange(len(base))] = "other"
            texts += [" ".join([*base, LINE])] * (1 + i % 2)
    rows = list(enumerate(texts))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).select("doc_id", "component_id", "n_shingles")
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got.collect()} == {i: (find(i), len(sets[i])) for i in sets}
    assert got.where(F.col("component_id") < F.col("doc_id")).count() > 30
