"""Extra columns of any name, empty tables, changed partitions, bounded samples, broken archives."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from asofkit.llm import langid, linededup, mixing, ngram_join, packing, permutation_index, token_index, toxicity, vector_dedup, warc
from asofkit.llm.queries import tokenizer_path

NAMES = ["id", "turn", "toxic", "class", "n", "row", "_row", "_gone", "_text", "h", "k", "t", "size", "o", "part", "words", "pos", "c0", "c1", "score", "lang_pred"]


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select(*docs.columns, *(docs.n_chars.alias(n) for n in NAMES))


def rows(df, *names):
    return sorted(map(str, (df.select(*names) if names else df).collect()))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 9 == 4), 1, 2) for i in range(60)], "doc_id long, toxic int, id int, turn int")


def test_extra_columns_change_nothing(docs, clashing, labels, spark):
    plain, more = (langid.identify(d, langid.train(d, per_class=5, landmarks=3)) for d in (docs, clashing))
    assert rows(plain) == rows(more)
    plain, more = (toxicity.score_documents(d, toxicity.train(d, labels)) for d in (docs, clashing))
    assert rows(plain) == rows(more)
    assert rows(mixing.curriculum_mix(docs)) == rows(mixing.curriculum_mix(clashing))
    assert rows(ngram_join.similar_documents(docs)) == rows(ngram_join.similar_documents(clashing))
    tokens = tokenizer_path("word_bpe_49k.json")
    assert rows(packing.pack_documents(docs, tokens), "doc_id", "start", "ids_crc32") == rows(packing.pack_documents(clashing, tokens), "doc_id", "start", "ids_crc32")
    tokens = tokenizer_path("byte_bpe_50k.json")
    assert rows(token_index.token_index(docs, tokens), "doc_id", "n_tokens", "ids_crc32") == rows(token_index.token_index(clashing, tokens), "doc_id", "n_tokens", "ids_crc32")
    cut = linededup.drop_repeated_runs(clashing)
    assert cut.columns == [*clashing.columns, "lines_removed"]
    assert rows(cut, *docs.columns, "lines_removed") == rows(linededup.drop_repeated_runs(docs))
    assert rows(cut, "doc_id", *NAMES) == rows(clashing, "doc_id", *NAMES)


def test_extra_columns_pass_through_the_stages(docs, clashing, labels, tmp_path, spark):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = stage(spark, docs, str(tmp_path)), stage(spark, clashing, str(tmp_path))
        assert more.columns == clashing.columns, name
        # Which of several equal rows stays is not fixed where they differ in other columns; here they do not.
        assert rows(more, "doc_id", "text", "_text", "row", "n_chars")[0].count("Row") == 1
        assert rows(plain, "doc_id", "text") == rows(more, "doc_id", "text"), name


def test_empty_vectors_and_pipeline(empty, spark, tmp_path):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert permutation_index.nearest(vectors, "id % 10 = 0").collect() == []
    assert vector_dedup.near_duplicates(vectors).collect() == []
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("cores", [1, 9])
def test_line_dedup_does_not_depend_on_the_cluster(docs, spark, cores):
    """The rows stay right when the input is cut into other partitions between two reads of it."""
    want = rows(linededup.drop_repeated_runs(docs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cut = linededup.drop_repeated_runs(docs)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(cores))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert rows(cut) == want == rows(linededup.drop_repeated_runs(docs))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_dedup_of_repeated_rows_and_self_overlap(spark):
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(13))
    long_ = "\n".join(line(k) for k in range(6))
    same = "\n".join([line(99)] * 9)
    found = {(r.doc_id, r.text, r.lines_removed) for r in linededup.drop_repeated_runs(spark.createDataFrame([(1, long_), (1, long_), (None, long_), (2, same), (3, None), (4, "")], "doc_id long, text string").repartition(3)).collect()}
    # The null key comes first and stays whole; a line that repeats on end stays for the first run of 50 words.
    assert (None, long_, 0) in found and (1, "", 6) in found and (3, None, 0) in found and (4, "", 0) in found
    assert [t.count("w99x0") for i, t, _ in found if i == 2] == [1]


def test_toxicity_model_does_not_depend_on_batches(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    text = lambda bad: " ".join([*(word() for _ in range(rnd.randint(0, 9))), *(["scumbag"] if bad else []), *(word() for _ in range(rnd.randint(0, 9)))])
    docs = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    one, many = (toxicity.train(docs.repartition(n), labels) for n in (1, 40))
    assert one.terms == many.terms and one.weights == many.weights and one.around == many.around and np.allclose(one.coefficients, many.coefficients)
    assert ("scumbag", False) in one.terms or any("scumbag".startswith(t) for t, _ in one.terms)


def test_toxicity_terms_need_different_texts(spark):
    """Words of one text that is copied with small changes do not become terms."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(7))
    base = [word() for _ in range(60)]
    copy = lambda: " ".join(word() if rnd.random() < 0.02 else w for w in base)
    bad = [copy() for _ in range(80)] + [" ".join([word(), word(), "vermin", word()]) for _ in range(80)]
    table = [(i, t) for i, t in enumerate(bad)] + [(1000 + i, " ".join(word() for _ in range(20))) for i in range(200)]
    model = toxicity.train(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 1000)) for i, _ in table], "doc_id long, toxic int"))
    assert not {t for t, _ in model.terms} & set(base)
    assert any("vermin".startswith(t) for t, _ in model.terms)


def test_samples_are_bounded_by_rows(spark):
    """A key that names many rows does not enlarge the sample."""
    docs = spark.range(3000).selectExpr("7L AS doc_id", "concat('text number ', id) AS text", "'en' AS lang").unionByName(spark.range(50).selectExpr("id + 100 AS doc_id", "concat('der text ', id) AS text", "'de' AS lang"))
    seen = []
    real, langid.fit = langid.fit, lambda rows, langs, *a: seen.append(langs)
    try:
        langid.train(docs, per_class=5)
        assert sorted(seen[0]) == ["de"] * 5 + ["en"] * 5
    finally:
        langid.fit = real


def test_kernel_and_ridge_against_the_definition(spark):
    """Kernel values are common n-grams over the root of the sizes (but for two n-grams of one column, here in 1 of 100
    values); the weights solve the ridge equations."""
    rnd = random.Random(6)
    text = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(5, 60)))
    texts = [text("abcd ") for _ in range(12)] + [text("cdef ") for _ in range(12)]
    langs = ["x"] * 12 + ["y"] * 12
    bits = []
    for t in texts:
        row = np.zeros(langid.COLUMNS, np.uint8)
        langid.presence(t, row)
        bits.append(np.packbits(row).tobytes())
    model = langid.fit(bits, langs, landmarks=4, ridge=1e-2)
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [*grams[:4], *grams[12:16]]
    k = np.array([[kernel(g, m) for m in marks] for g in grams])
    kmm = np.array([[kernel(a, b) for b in marks] for a in marks])
    y = np.array([[1.0, -1.0] if x == "x" else [-1.0, 1.0] for x in langs])
    weights = np.linalg.solve(k.T @ k + 1e-2 * len(texts) * kmm + 1e-6 * np.eye(8), k.T @ y)
    assert np.allclose(weights, model.weights, atol=2e-2)
    value = k @ weights
    share = np.exp(4 * value) / np.exp(4 * value).sum(1, keepdims=True)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i in range(len(texts)):
        assert found[i][0] == "xy"[value[i].argmax()] and found[i][1] == pytest.approx(share[i].max(), abs=2e-2)


def test_toxicity_scores_against_the_definition(spark):
    """Scores recomputed word by word from the model: hits by exact word, stem or edit distance, windows, quote marks."""
    model = toxicity.Model([("idiot", False), ("trash", False), ("worthl", True)], [2.0, 1.0, 1.5], {"said": 1.2, "reported": 0.7}, np.array([-1.0, 2.0, 1.0, 0.5, -0.5]))
    texts = ["you idiot", "they said idiot and trash", 'he "idiot" x', "an idoit here", "an idiott here", "worthless trash", "", None, "nothing bad", "“trash talk” reported " + "x " * 30 + "idiot."]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    def edits(a, b):
        swapped = {b[:i] + b[i + 1] + b[i] + b[i + 2 :] for i in range(len(b) - 1)}
        return 1 if a in swapped and a != b else distance(a, b)

    def score(text):
        raw = (text or "").lower().split(" ")
        words, x, hits = [w.strip(toxicity.TRIM) for w in raw], np.zeros(5), []
        x[0] = 1
        for p, w in enumerate(words):
            if w in ("idiot", "trash"):
                hit = (["idiot", "trash"].index(w), 0)
            elif w[:6] == "worthl":
                hit = (2, 0)
            else:
                near = [(edits(w, t), i) for i, t in enumerate(("idiot", "trash")) if edits(w, t) <= min(2 if len(w) >= 7 else 1, toxicity.allowed(len(t)))]
                hit = min(near)[::-1] if near else None
            hits.append(hit)
        for p, hit in enumerate(hits):
            if hit:
                low, high = max(p - 6, 0), min(p + 7, len(words))
                told = min(max(sum(model.around.get(words[k], 0) for k in range(low, high) if not hits[k]), -4), 8)
                quoted = any(v[:1] in toxicity.QUOTES and v for v in raw[low : p + 1]) and any(v.rstrip(".,;:!?)")[-1:] in toxicity.QUOTES and v.rstrip(".,;:!?)") for v in raw[p:high])
                x[4 if quoted else 1 + hit[1]] += model.weights[hit[0]] / (1 + np.exp(told)) * 2
        x[1:] = np.log1p(x[1:])
        return 1 / (1 + np.exp(-x @ model.coefficients))

    found = {r.doc_id: r.score for r in toxicity.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        assert found[i] == pytest.approx(score(t), abs=1e-9), t


def test_broken_archives_give_the_records_before_the_break():
    record = lambda body, length=None: b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: " + str(len(body) if length is None else length).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    read = lambda raw: [b for _, b in warc.parse_records(io.BytesIO(raw))]
    good = record(b"one") + record(b"two")
    assert read(good) == [b"one", b"two"]
    assert read(good + record(b"three")[:-9]) == [b"one", b"two"]
    assert read(good + record(b"x", "many") + record(b"y")) == [b"one", b"two"]
    assert read(good + b"WARC/1.1\r\nWARC-Type: met") == [b"one", b"two"]
    assert read(b"") == []


def test_very_long_texts(spark):
    long_ = "the quick idiot fox " * 60_000
    docs = spark.createDataFrame([(1, long_), (2, "der schnelle fuchs")], "doc_id long, text string")
    model = langid.fit([b"\xff" * 8192, b"\x0f" * 8192], ["a", "b"], 1, 1e-2)
    assert len(langid.identify(docs, model).collect()) == 2
    tox = toxicity.Model([("idiot", False)], [1.0], {}, np.array([-1.0, 1.0, 0, 0, 0]))
    assert {r.doc_id: r.predicted for r in toxicity.score_documents(docs, tox).collect()} == {1: 1, 2: 0}


def test_least_hashes_of_empty_rows_between_others():
    batch = pa.array(["a b", "", "c d e f g h", ""])
    from asofkit.llm.common import bytes_of, set_shingles, word_hashes

    _, start = set_shingles(*word_hashes(*bytes_of(batch)))
    assert np.diff(start).tolist() == [1, 0, 2, 0]
