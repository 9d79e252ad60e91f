import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import ppm


def tokens(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def stream(text):
    return b"".join(w.encode() + b" " for w in tokens(text)) + b"\n"


def brute_trie(texts, order):
    trie = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        s = b"\n" * order + stream(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                trie[k][s[i - k : i]][s[i]] += 1
    return trie


def brute_log10(trie, context, symbol):
    """PPM with method D and symbol exclusion, by its definition."""
    total, out = 0.0, set()
    for k in range(len(trie) - 1, -1, -1):
        node = trie[k].get(context[len(context) - k :])
        if not node:
            continue
        left = {s: n for s, n in node.items() if s not in out}
        if not left:
            continue
        if symbol in left:
            return total + math.log10((left[symbol] - 0.5) / sum(left.values()))
        total += math.log10(len(left) / 2 / sum(left.values()))
        out |= set(left)
    return total - math.log10(ppm.SYMBOLS - len(out))


def brute(rows, learn, order):
    train = [t for i, t, *_ in rows if learn(i)]
    trie, counts = brute_trie(train, order), Counter(w for t in train for w in [*tokens(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t, *_ in rows:
        s = b"\n" * order + stream(t)
        ws = [*tokens(t), "\n"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((i, learn(i), len(ws), sum(counts[w] > 0 for w in ws), n, base, sum(brute_log10(trie, s[j - order : j], s[j]) for j in range(order, len(s)))))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[2], round(r[5], 6))


@pytest.mark.parametrize("order, piece, segment", [(5, ppm.PIECE_BYTES, 1 << 20), (3, 2000, 1 << 20), (6, 5000, 97)])
def test_equals_brute_force(spark, docs, corpus, order, piece, segment, monkeypatch):
    if segment != ppm.SEGMENT:  # segments are a matter of memory alone, so they are tried without Spark
        monkeypatch.setattr(ppm, "SEGMENT", segment)
        import pyarrow as pa

        from asofkit.llm.common import bytes_of

        for _, t, *_ in corpus[:40]:
            rows = ppm.canonical(*bytes_of(pa.array([t], pa.string())))
            assert rows == [(stream(t), len(tokens(t)))]
            parts = list(ppm.Texts(pa.compress(rows[0][0], codec="zstd", asbytes=True), [len(rows[0][0])], order).segments())
            whole = b"\n" * order + rows[0][0]
            grams = [int.from_bytes(whole[j - order : j][::-1] + bytes(7 - order) + whole[j : j + 1], "big") for j in range(order, len(whole))]
            assert np.concatenate([p[1] for p in parts]).tolist() == grams and sum(len(p[3]) for p in parts) == len(tokens(t))
        return
    rows = [r for r in corpus if len(r[1] or "") < 5000]
    given = docs.where("text is null or length(text) < 5000")
    learn = lambda i: i is None or i % 4 != 0
    got = ppm.score_documents(given, F.coalesce(F.col("doc_id") % 4 != 0, F.lit(True)), order=order, piece=piece, bucket=5000).collect()
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows, learn, order), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9), a


def test_probabilities_sum_to_one():
    trie = brute_trie(["abra cadabra", "abbra kadabra bra"], 3)
    for context in (b"bra", b"zzz", b"ab ", b"\n\n\n"):
        assert sum(10 ** brute_log10(trie, context, s) for s in range(256) if s not in (9, 11, 12, 13)) == pytest.approx(1)


def test_long_texts_and_empty_tables(spark, docs, empty):
    assert ppm.score_documents(empty, F.lit(True)).collect() == []
    got = {r.doc_id: r for r in ppm.score_documents(docs, F.col("doc_id") == 103).collect()}
    assert got[103].n_tokens == 30_001 == got[103].train_tokens
    assert got[103].score == pytest.approx(got[103].base_score, rel=0.02)  # words drawn evenly: a unigram model is all there is
    nothing = {r.doc_id: r for r in ppm.score_documents(docs, F.lit(False)).collect()}
    assert nothing[101].score == pytest.approx(-math.log10(ppm.SYMBOLS)) and nothing[101].train_tokens == 0 and nothing[101].base_score == pytest.approx(0)
    with pytest.raises(ValueError, match="order"):
        ppm.score_documents(docs, F.lit(True), order=9)
