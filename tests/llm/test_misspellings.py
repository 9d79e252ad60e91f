import random

import pytest

from asofkit.llm import toxicity

INSULTS = ["idiot", "moron", "worthless", "disgusting", "scoundrel"]


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(600)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        t = text(rnd.randint(10, 60))
        toxic = i % 3 == 0
        if toxic:
            for w in rnd.sample(INSULTS, 2):
                t.insert(rnd.randrange(len(t)), w)
        elif i % 20 == 1:  # reports on insults are not toxic
            k = rnd.randrange(len(t))
            t[k:k] = ["they", "reported", f'"{rnd.choice(INSULTS)}"']
        elif i % 5 == 0:
            t += ["scoundrels"[:-1] + "y", "disgustine"]  # ordinary words near terms
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")), words


def score(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.score for r in sorted(toxicity.score_documents(df, model).collect(), key=lambda r: r.doc_id)]


def test_misspelt_and_swapped_insults_count(spark, model):
    model, words = model
    rest = " ".join(words[:12])
    exact = score(spark, model, [f"{rest} {w}" for w in INSULTS])
    assert min(exact) > 0.7
    wrong = ["idoit", "idiiot", "morn", "moorn", "wortless", "worhtless", "disgsuting", "dizgusting", "scoundrle", "scoundrell"]
    found = score(spark, model, [f"{rest} {w}" for w in wrong])
    assert sum(x > 0.7 for x in found) >= 9 and max(found) <= max(exact)
    two = score(spark, model, [f"{rest} {w}" for w in ("disgstng", "skoundrell", "wortles")])
    assert all(x > score(spark, model, [rest])[0] for x in two)
    c = model.coefficients
    assert c[1] > c[2] > c[3] > 0 and 0 <= c[4] <= c[1] / 2


def test_quotation_is_not_abuse(spark, model):
    model, words = model
    rest = " ".join(words[20:32])
    plain, quoted, reported = score(spark, model, [f"{rest} moron", f'{rest} they reported "moron"', f"{rest} they reported moron"])
    assert quoted < 0.5 < plain and reported < plain


def test_ordinary_words_are_no_misspellings(spark, model):
    model, words = model
    rest = " ".join(words[40:52])
    none, near = score(spark, model, [rest, f"{rest} scoundrely disgustine"])
    assert near == pytest.approx(none)
    assert "disgustine" in model.ordinary
