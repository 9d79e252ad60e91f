"""Recall of sign hashing at the threshold, and groups of near copies too dense for lists of pairs."""

import numpy as np
import pytest

from asofkit.llm import vector_dedup


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, 32))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.905, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate([*a, *(c * a + np.sqrt(1 - c * c) * b)])]
    found = {r.vec_id: r.component_id for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    hit = sum(found[1500 + i] == found[i] for i in range(1500))
    assert hit / 1500 >= 0.998


@pytest.mark.parametrize("block", [4096, 40])
def test_dense_groups_count_every_link(spark, block, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(24)
    x = np.concatenate([centre + 0.33 * rng.standard_normal((150, 24)), rng.standard_normal((100, 24))]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    found = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    want = link.sum(1) - 1
    assert want.max() > 20 and sum(abs(found[i] - want[i]) for i in range(250)) <= 0.002 * want.sum()
