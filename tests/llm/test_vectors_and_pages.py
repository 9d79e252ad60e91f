"""Vector operators, WARC round trips, components and the pipeline against brute force."""

import base64
import gzip
import hashlib
import importlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from asofkit.llm import permutation_index, vector_dedup, warc
from asofkit.llm.components import connected_components


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16))
    near = base[:40] + 0.15 * rng.standard_normal((40, 16))
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate([*base, *near, *[base[7]] * 12, base[3] * 2])]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, None), (903, [1.0, None] * 8, 1), (904, [], 1), (905, [1.0, 2.0], 1), (50, rows[50][1], 1)]
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), rows


def cosines(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    same = [(i, v) for i, v in good if len(v) == 16]
    x = np.stack([v for _, v in same])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [i for i, _ in same], x @ x.T


@pytest.mark.parametrize("block", [4096, 10])
def test_vector_dedup_matches_brute_force(vectors, block, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    df, rows = vectors
    ids, c = cosines(rows)
    link = c >= 0.9
    part = np.arange(len(ids))
    for i, j in zip(*np.nonzero(link)):
        part[part == part[j]] = part[i]
    least = {p: min(i for i, q in zip(ids, part) if q == p) for p in set(part)}
    want = Counter((i, int(link[k].sum()) - 1, least[part[k]]) for k, i in enumerate(ids))
    want += Counter((i, 0, i) for i in (900, 901, 902, 903, 904, 905))
    got = vector_dedup.near_duplicates(df, 0.9).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_nearest_recall(vectors):
    df, rows = vectors
    ids, c = cosines(rows)
    got = permutation_index.nearest(df, "id % 10 = 0", block=100, least=60).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r)
    hit = total = 0
    for k, i in enumerate(ids):
        if i % 10 == 0 and ids.index(i) == k:
            order = sorted((round(-c[k, m], 12), j) for m, j in enumerate(ids) if j != i)
            best = [j for _, j in dict.fromkeys(order)][:5]
            mine = found[i]
            assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
            hit, total = hit + len({r.vec_id for r in mine} & set(best)), total + 5
            for r in mine:
                assert r.score == pytest.approx(c[k, ids.index(r.vec_id)], abs=1e-12)
    assert hit / total >= 0.9


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c/\r\nX: y", "é" * 5000), (4, "http://d", None), (5, "", ""), (6, "http://f", "<p>one</p>"), (None, "http://g", "solo"), (6, "http://f", "<p>one</p>")]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(path)
    pages = spark.read.parquet(path)
    out = warc.round_trip(pages, f"file://{tmp_path}/warc").collect()
    assert len(out) == len(rows) and all(r.request and r.metadata for r in out)
    by = Counter()
    for r in out:
        page = dict(r.metadata.fields).get("pageId")
        by[page, r.response.record_type] += 1
        if r.response.record_type == "response" and page:
            body = next(h or "" for i, _, h in rows if str(i) == page).encode()
            assert bytes(r.response.payload) == body and r.response.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if r.response.record_type == "revisit":
            assert r.response.refers_to.startswith("<urn:capture:6:" if page in ("1", "2", "6") else "<urn:capture:5:")
    assert by == Counter({("1", "revisit"): 1, ("2", "revisit"): 1, ("3", "response"): 1, ("4", "revisit"): 1, ("5", "response"): 1, ("6", "response"): 1, ("6", "revisit"): 1, (None, "response"): 1})
    files = list((tmp_path / "warc").glob("*.warc.gz"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 3 * len(rows) + len(files)
    few = warc.round_trip(pages, f"file://{tmp_path}/w2", min_bytes=11).collect()
    assert Counter(r.response.record_type for r in few)["revisit"] == 0
    assert warc.round_trip(pages.where("false"), f"file://{tmp_path}/w3").collect() == []


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(300 + i, 301 + i) for i in range(40)]
    part = list(range(400))
    for a, b in edges:
        part = [part[b] if p == part[a] else p for p in part]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = {n: min(m for m in nodes if part[m] == part[n]) for n in nodes}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stages(docs, corpus, spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([(i, int(i % 9 == 4)) for i in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, n = docs, [len(corpus)]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        n.append(now.count())
    assert n[3] < n[2] <= n[1] <= n[0]  # near copies and repeated rows go
    assert now.agg({"length": "sum"}).first()[0] > 0
