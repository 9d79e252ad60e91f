import math
import random

import numpy as np
import pytest

from asofkit.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, VEC_ID string"


def brute(rows, step=50, least=50, most=95):
    """The contract, row by row in Python's integers."""
    valid = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        valid[i] = min(valid.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in valid.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), i, other) for i, (other, w) in valid.items() if i != a and len(w) == len(q))
        for p, pid in [(-s, i) for s, i, other in scored if other == label][:5]:
            hits = [(i, -s) for s, i, other in scored if other != label and least * p <= -100 * s <= most * p][:3]
            out += [(a, pid, k + 1, n, p, s) for k, (n, s) in enumerate(hits)]
    return sorted(out)


def random_rows(n, dim=6, clusters=8):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(clusters, dim))
    return [(int(i), [float(x) for x in centres[i % clusters] + 0.4 * rnd.normal(size=dim)], int(rnd.integers(0, 4)), None) for i in range(n)]


AWKWARD = [
    (1000, None, 1, None), (1001, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1, None), (1002, [float("nan")] * 6, 1, None), (1003, [float("inf")] * 6, 1, None),
    (1050, [0.0] * 6, 2, None), (1100, [], 2, None), (1101, [], 3, None), (1150, [1.0, 2.0], 1, None), (1151, [2.0, 1.0], 1, None), (1152, [0.5, 0.8], 0, None),
    (1200, [0.5] * 6, None, None), (None, [0.5] * 6, 1, None), (1250, [-0.5] * 6, 1, None), (1250, [-0.5] * 6, 1, None), (1251, [0.5] * 6, 1, None), (1251, [0.4] * 6, 1, "x"),
]


@pytest.mark.parametrize("block, sample", [(8192, 1024), (64, 8), (64, 0)])
def test_equals_brute_force(spark, block, sample):
    rows = random_rows(400) + AWKWARD
    rows += [(2000 + i, rows[3][1], i % 3, None) for i in range(60)]  # copies: ties by id
    got = hn.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), "id % 50 = 0", block=block, anchor_block=16, sample=sample)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_scores_beyond_doubles_stay_exact(spark):
    rows = [(i, [2.0**40 + i, 2.0**20 * (i % 5), 1.0], i % 2, None) for i in range(0, 120, 3)]
    got = hn.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), "id % 30 = 0", least=-100, most=1000)
    clamp = lambda r: (*r[:4], min(r[4], 2**63 - 1), min(r[5], 2**63 - 1))
    assert {r.positive_score for r in got.collect()} == {clamp(r)[4] for r in brute(rows, 30, -100, 1000)} == {2**63 - 1}
    small = [(i, [x / 2.0**18 for x in v], label, None) for i, v, label, _ in rows]
    got = hn.mine_hard_negatives(spark.createDataFrame(small, SCHEMA), "id % 30 = 0", least=-100, most=1000)
    assert sorted(map(tuple, got.collect())) == brute(small, 30, -100, 1000)


def test_bounds_enclose_scores_and_prune():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(12, 32))
    x = np.floor(256 * (centres[rnd.integers(0, 12, 600)] + 0.05 * rnd.normal(size=(600, 32))))
    x[0] = 0
    refs = hn.far_apart(x, 12)
    angles, norm = hn.angles_to(x, refs), np.linalg.norm(x, axis=1)
    low, high = hn.score_bounds((angles, norm), (angles, norm))
    score = x @ x.T
    assert (low <= score).all() and (score <= high).all()
    asked = high >= np.partition(low, -5, axis=1)[:, -5:-4]
    assert asked.mean() < 0.25  # clustered vectors: most pairs are never scored


def test_empty(spark):
    assert hn.mine_hard_negatives(spark.createDataFrame([], SCHEMA), "id % 50 = 0").collect() == []
