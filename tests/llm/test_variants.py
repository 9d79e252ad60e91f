import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from asofkit.llm import variants

SCHEMA = "doc_id long, text string, TEXT string"


def brute_counts(docs):
    counts = Counter()
    for i, text, *_ in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_variants(counts):
    by_deletion = {}
    for w in counts:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_deletion.setdefault(v, set()).add(w)

    def distance_one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: {u for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for u in by_deletion.get(v, ()) if distance_one(w, u)} for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def vocabulary():
    rnd = random.Random(8)
    letters = "abcdeéß×"
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9))) for _ in range(250)}
    for w in sorted(words)[:120]:
        for _ in range(3):
            i = rnd.randrange(len(w))
            words.add(rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:]]))
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaaa", "common" + "x" * 300, "common" + "x" * 301}
    words |= {"abc" + "".join(rnd.choice("abcd") for _ in range(4)) for _ in range(150)}  # one group of many words
    return {w: rnd.choice([5, 6, 30, 40, 200, 1000, 5000]) for w in sorted(words) if len(w) >= 6}


@pytest.mark.parametrize("block", [variants.BLOCK, 300])
def test_equals_brute_force(spark, vocabulary, block):
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    assert sorted(map(tuple, variants.spelling_variants(words, block=block).collect()), key=lambda r: r[0]) == brute_variants(vocabulary)


def test_whole_texts(spark):
    rnd = random.Random(4)
    base = ["Straßenbahn", "weather", "whether", "feather", "Élysée", "Ämterhaus", "kurz", "beginning", "begining"]
    docs = [(i, " ".join(rnd.choice(base) for _ in range(200)) + "1weathe2", "weather " * 50) for i in range(60)]
    docs += [(None, "feathre " * 9, None), (70, None, None), (71, "", ""), (72, "12 34", None), docs[0], docs[0], (73, "feather " * 20_000, None)]
    got = variants.spelling_variants(variants.count_words(spark.createDataFrame(docs, SCHEMA).repartition(3), drop_every=199))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute_variants(brute_counts(docs))


def test_index_by_definition():
    rnd = np.random.default_rng(2)
    seq = rnd.integers(0, 11, 300)
    w = variants.Wavelet(seq, 11)
    for _ in range(200):
        lo, hi = sorted(rnd.integers(0, 301, 2).tolist())
        c = int(rnd.integers(0, 11))
        got = [int(x[0]) for x in w.narrow(np.array([c]), np.array([lo]), np.array([hi]))]
        assert got == [(seq[:lo] == c).sum(), (seq[lo:hi] == c).sum(), (seq[lo:hi] < c).sum()]
    text = rnd.integers(0, 3, 200)
    assert variants.suffix_order(text).tolist() == sorted(range(200), key=lambda i: text[i:].tolist())


def test_empty_and_short(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert variants.spelling_variants(variants.count_words(empty, drop_every=199)).collect() == []
    with pytest.raises(Exception, match="six code points"):
        variants.spelling_variants(spark.createDataFrame([("kurz", 9)], "word string, n long"))
