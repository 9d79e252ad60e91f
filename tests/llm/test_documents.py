"""Corpus operators against brute force on a small table with every awkward case."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import langid, linededup, mixing, ngram_join, packing, queries, token_index, toxicity
from asofkit.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def encode(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_index_round_trip(docs, corpus, spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    got = token_index.token_index(docs, tokenizer_path("byte_bpe_50k.json"), 2, path).collect()
    want = Counter((r[0], crc([*encode("byte_bpe_50k.json", r[1]), 2])) for r in corpus)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    inorder = sorted(got, key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in inorder]
    assert keys == sorted(keys)
    assert [r.start for r in inorder] == np.cumsum([0, *(r.n_tokens for r in inorder)])[:-1].tolist()
    names = sorted(p.name.removesuffix(".idx") for p in (tmp_path / "tokens").glob("*.idx"))
    shards = [token_index.Shard(path, n) for n in names]
    found = [s.get(17) for s in shards]
    assert [f.tolist() for f in found if f is not None] == [[*encode("byte_bpe_50k.json", corpus[17][1]), 2]]
    assert all(s.get(999_999) is None for s in shards)


def test_perfect_hash_is_minimal():
    h = token_index.mix64(np.arange(5000, dtype=np.uint64))
    assert sorted(token_index.PerfectHash.build(h).slots(h)) == list(range(5000))


def test_packing_covers_every_token(docs, corpus):
    rows = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([p.length for p in pieces])
        assert [p.offset for p in pieces] == [0, *ends[:-1]] and ends[-1] <= 2048
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 2048 - ends[-1]
    assert padding == 0
    want = Counter((r[0], len(encode("word_bpe_49k.json", r[1])) + 1) for r in corpus)
    got = Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert got == want and sum(r.length for r in rows) == sum(k[1] * n for k, n in want.items())


def test_packer_prefers_level_of_least_squares():
    p = packing.Packer(10)
    for n in (6, 6, 4):
        p.add(n, np.zeros(n, np.uint32))
    assert len(p.closed) == 1 and [x[0] for x in p.closed[0]] == [6, 4]
    assert p.counts[6] == 1


def test_mixing_meets_targets(docs, corpus):
    rows = mixing.curriculum_mix(docs).collect()
    assert len(rows) == len(corpus)
    size = defaultdict(int)
    for r in corpus:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    by = defaultdict(list)
    for r in rows:
        by[r.source_size, round(r.target, 6)].append(r)
        assert r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies)
        assert all(0 <= c.position <= 1 for c in r.copies)
    for (n, target), some in by.items():
        assert target <= 3 * n + 1e-6 and abs(sum(r.taken for r in some) - target) <= 1
    total = sum(t for _, t in by)
    assert total == pytest.approx(sum(size.values()))
    again = mixing.curriculum_mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_source_targets_reshare_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (5, 2, 1), 3).collect()}
    # a stops at 30; b and null share the other 1070 as 2 to 1, null stops at 270, and b takes the rest.
    assert got == {"a": 30, "b": pytest.approx(800), None: 270}
    assert all(got[s] <= 3 * n for s, n in (("a", 10), ("b", 1000), (None, 90)))


def brute_components(corpus):
    sets = []
    for r in corpus:
        w = WORD.findall((r[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    least = {p: min((r[0] for r, q in zip(corpus, part) if q == p and r[0] is not None), default=None) for p in part}
    return Counter((r[0], len(s), least[p] if s else r[0]) for r, s, p in zip(corpus, sets, part))


@pytest.mark.parametrize("block", [4096, 3])
def test_ngram_join_matches_brute_force(docs, corpus, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect())
    assert got == brute_components(corpus)


def test_line_dedup_matches_sql(docs, corpus, spark, tmp_path):
    seen, unique = set(), []
    for r in corpus:  # the SQL needs unique ids
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            unique.append(r)
    path = str(tmp_path / "u")
    spark.createDataFrame(unique, docs.schema).repartition(2).write.parquet(path)
    got = linededup.drop_repeated_runs(spark.read.parquet(path)).select("doc_id", "text", "lines_removed").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT doc_id, text, lines_removed FROM ({queries.OP9_SQL})").fetchall())
    assert sum(r.lines_removed for r in got) > 0


def test_suffix_array_and_common_prefixes_by_definition(spark, tmp_path):
    rnd = random.Random(11)
    texts = ["a b\nc d\ne f", "c d\ne f\ng h", "a b\nc d\nx y", "c d"]
    texts += ["\n".join(rnd.choice(["l1", "l2 w", "l3 w w"]) for _ in range(rnd.randint(1, 14))) for _ in range(30)] + ["l1\n" * 9]
    path = str(tmp_path / "t")
    spark.createDataFrame([(i % 30 if i % 7 else None, i, t) for i, t in enumerate(texts)], "doc long, row long, text string").repartition(3).write.parquet(path)
    lines = linededup.repeated_lines(spark.read.parquet(path), 1)
    shallow = linededup.both_ways(lines, 4)
    suffixes = shallow.withColumn("deep", F.lit(100))
    array = linededup.suffix_array(suffixes, rounds=3)
    content = defaultdict(list)
    for r in sorted(suffixes.collect(), key=lambda r: (r.row, r.seg, r.j)):
        content[r.row, r.seg].append((r.j, r.line, r.need, r.left))

    def lines_from(r):
        return [line for j, line, _, _ in content[r.row, r.seg] if j >= r.j]

    words = {r.line: r.words for r in lines.select("line", "words").distinct().collect()}
    for (row, seg), own in content.items():
        for k, (_, _, need, left) in enumerate(own):
            sums = [sum(words[x[1]] for x in own[k : k + n]) for n in range(1, len(own) - k + 1)]
            assert left == len(own) - k and need == next((n + 1 for n, x in enumerate(sums) if x >= 4), None)
    got = linededup.common_prefixes(array, array, 3).orderBy("place").collect()
    keys = [(r.back, lines_from(r)[:8], r.doc is not None, r.doc or 0, r.row, r.j) for r in got]
    assert keys == sorted(keys) and len(keys) == 2 * lines.count()
    for before, r in zip(got, got[1:], strict=False):
        common = next((n for n, (x, y) in enumerate(zip(lines_from(before), lines_from(r))) if x != y), min(r.left, before.left))
        assert (r.before.row, r.before.seg, r.before.j) == (before.row, before.seg, before.j)
        assert r.lcp == (min(common, 8) if before.back == r.back else 0) or (common > 8 and r.lcp >= 8)
    array = linededup.suffix_array(shallow, rounds=3)  # ranked only as far as the parts of a stretch reach
    some = linededup.common_prefixes(array, array.where("need is not null"), 3, whole=False).orderBy("place").collect()
    for before, r in zip(some, some[1:], strict=False):
        same = before.back == r.back and lines_from(before)[: r.need] == lines_from(r)[: r.need]
        assert (r.lcp >= r.need) == same


def test_language_identification(docs, corpus, spark):
    rows = [(i, t * 3, lang) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de")] * 20)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(labelled, per_class=10, landmarks=4)
    probe = spark.createDataFrame([(1, "the dog"), (2, "und der hund"), (3, None), (4, "12 !?"), (None, "the cat")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(probe, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == ("und", 0.0) and got[4] == ("und", 0.0) and got[None][0] == "en"
    assert len(langid.identify(docs, model).collect()) == len(corpus)
    assert langid.train(labelled.where("false")) is None
    assert {r.lang_pred for r in langid.identify(probe, None).collect()} == {"und"}


def test_presence_kernel_is_a_count_of_common_ngrams():
    a, b = np.zeros(langid.COLUMNS, np.uint8), np.zeros(langid.COLUMNS, np.uint8)
    langid.presence("abca", a)
    langid.presence("bcax", b)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert a.sum() == len(grams("abca")) and (a & b).sum() == len(grams("abca") & grams("bcax"))


def test_levenshtein_trie_matches_definition():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = _next(row, x, b, i)
        return row[-1]

    def _next(row, x, b, i):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        return new

    terms = ["idiot", "moron", "disgusting", "scum"]
    trie = toxicity.Trie([(t, i) for i, t in enumerate(terms)])
    for word in ("idiot", "idoit", "idiots", "mron", "disgustin", "dsgustng", "scam", "xyz", ""):
        near = [(distance(word, t), -len(t), i) for i, t in enumerate(terms) if distance(word, t) <= min(2, toxicity.allowed(len(t)))]
        assert trie.match(word, 2) == ((min(near)[2], min(near)[0]) if near else None)


def test_toxicity_learns_and_scores(docs, corpus, spark):
    filler = ["one two three four", "five six seven", "eight nine ten eleven"]
    rows = [(i, f"{filler[i % 3]} {i} you are an idiot" if i % 4 == 0 else f"{filler[i % 3]} {i} fine words") for i in range(120)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(labelled, labels)
    assert "idiot" in [t for t, _ in model.terms]
    probe = spark.createDataFrame([(1, "such an IDIOT!"), (2, "fine words here"), (3, None), (4, ""), (5, "what an idoit"), (6, 'he said "you idiot" to them')], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_documents(probe, model).collect()}
    assert got[1][1] == 1 and got[2][1] == got[3][1] == got[4][1] == 0
    assert got[2][0] == got[3][0] <= got[6][0] < got[1][0]
    assert len(toxicity.score_documents(docs, model).collect()) == len(corpus)
    assert [r.doc_id for r in toxicity.drop_toxic(probe, model).select("doc_id").orderBy("doc_id").collect()] == [2, 3, 4, *([5] if got[5][1] == 0 else []), *([6] if got[6][1] == 0 else [])]


def test_empty_tables(empty, spark):
    assert packing.pack_documents(empty, tokenizer_path("word_bpe_49k.json")).collect() == []
    assert token_index.token_index(empty, tokenizer_path("byte_bpe_50k.json")).collect() == []
    assert mixing.curriculum_mix(empty).collect() == []
    assert ngram_join.similar_documents(empty).collect() == []
    assert linededup.drop_repeated_runs(empty).collect() == []
    assert langid.identify(empty, langid.train(empty)).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(empty, toxicity.train(empty, labels)).collect() == []
