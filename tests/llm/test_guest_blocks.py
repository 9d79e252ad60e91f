"""The second round of a large cluster: bounded groups in which all members of different blocks meet."""

from collections import defaultdict

import pytest

from asofkit.llm import ngram_join


@pytest.mark.parametrize("linked", [0, 50])
def test_no_group_holds_more_than_two_blocks(spark, monkeypatch, linked):
    block, m = 8, 80
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [(7, c, 1, bytearray(8), bytearray(4), bytearray(4), bytearray(4), m // block, c % (m // block)) for c in range(m)]
    large = spark.createDataFrame(rows, "cluster long, class long, n long, tokens binary, p0 binary, p1 binary, p2 binary, blocks int, block int")
    parts = spark.createDataFrame([(c, 0) for c in range(linked)], "node long, component long")
    groups = defaultdict(list)
    for r in ngram_join._visits(large, parts).collect():
        groups[r.cluster, r.at, r.chunk].append(r)
    met = set()
    for g in groups.values():
        guests, home = ([r for r in g if r.guest is x] for x in (True, False))
        assert len({r["class"] for r in g}) == len(g) and len(home) == block and len(guests) <= 3 * block
        met |= {frozenset((a["class"], b["class"])) for a in guests for b in home}
    # All pairs of different blocks and components.
    assert met >= {frozenset((a, b)) for a in range(m) for b in range(max(a + 1, linked), m) if (a - b) % (m // block)}
