import numpy as np
import pytest

from asofkit.llm import langid


@pytest.mark.filterwarnings("error::RuntimeWarning")
def test_labelled_texts_without_letters_teach_nothing(spark):
    texts = {"en": "the weather of this week is nice and warm", "de": "das wetter dieser woche ist schön und warm", "fr": "la météo de cette semaine est belle et chaude"}
    rows = [(i, f"{texts[lang]} {i}", lang) for i in range(30) for lang in texts]
    junk = [(1000 + i, t, lang) for i in range(40) for lang in texts for t in ("", "  \n", "12 34", None)]
    model = lambda r: langid.train(spark.createDataFrame(r, "doc_id long, text string, lang string"), per_class=12, landmarks=6)
    plain, mixed = model(rows), model(rows + junk)
    assert np.isfinite(mixed.weights).all() and np.array_equal(plain.weights, mixed.weights) and (mixed.sizes > 0).all()
    probe = spark.createDataFrame([(i, t) for i, t in enumerate([*texts.values(), "", " ", "7"])], "doc_id long, text string")
    found = sorted(tuple(r) for r in langid.identify(probe, mixed).collect())
    assert [r[1] for r in found] == ["en", "de", "fr", "und", "und", "und"] and all(0 <= r[2] <= 1 for r in found)


def test_sizes_of_zero_divide_nothing():
    bits = [bytes(8192), b"\x0f" * 8192, b"\xff" * 8192]
    assert np.isfinite(langid.fit(bits, ["a", "b", "c"], 2, 1e-2).weights).all()
