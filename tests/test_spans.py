import numpy as np
import pytest

from asofkit.operators import spans as S

from test_growth import most_rows

GUIDED = {
    "For FY 2026, the company expects adjusted EPS in the range of $4.20 to $4.50 per share.": [("EPS", "FY2026", "NON_GAAP", "USD_PER_SHARE", 4.2, 4.5)],
    "Our FY 2025 outlook: we expect revenue from $10.0 to $10.5 billion.": [("REVENUE", "FY2025", "UNSPECIFIED", "USD", 10.0e9, 10.5e9)],
    "We expect adjusted EPS of $4.20 next year.": [],
    "For FY 2025 our outlook includes revenue and adjusted EPS in a range of $4.20 to $4.50.": [("EPS", "FY2025", "NON_GAAP", "USD_PER_SHARE", 4.2, 4.5)],
    "For FY 2025 we expect revenue of $4.20 to $4.50.": [],
    "For Q3 2024 we expect revenue of $1,200 million to $1,300 million and earnings per share of (0.20) to (0.10), in $.": [("EPS", "Q3-2024", "UNSPECIFIED", "USD_PER_SHARE", -0.2, -0.1), ("REVENUE", "Q3-2024", "UNSPECIFIED", "USD", 1.2e9, 1.3e9)],
    "Third quarter of 2024 outlook: net sales 1,200 to 1,300 million": [("REVENUE", "Q3-2024", "UNSPECIFIED", "USD", 1.2e9, 1.3e9)],
    "Our FY 2025 outlook: revenue between $900 million and $1.1 billion.": [("REVENUE", "FY2025", "UNSPECIFIED", "USD", 0.9e9, 1.1e9)],
    "2025 fiscal year guidance, GAAP: capex through 3 to 2 million.": [("CAPEX", "FY2025", "GAAP", "USD", 2e6, 3e6)],
    "FY2025 outlook: gross margin 12% - 14%, and for the whole of the year EPS 10 to 12 cents": [("EPS", "FY2025", "UNSPECIFIED", "USD_PER_SHARE", 0.1, 0.12), ("MARGIN", "FY2025", "UNSPECIFIED", "PERCENT", 12.0, 14.0)],
    "In fiscal year 2023 we grew. For the third quarter of 2024 we expect revenue of 3 to 4 million, as we said in the spring about FY2025.": [("REVENUE", "Q3-2024", "UNSPECIFIED", "USD", 3e6, 4e6)],
    "Revenue was 3 to 4 million in FY 2025.": [],  # no cue
    "FY 2025 outlook." + " x" * 300 + " revenue 3 to 4 million": [],  # cue and period too far away
    "": [],
}


def test_guidance_ranges(spark):
    texts = list(GUIDED)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (99, None, "x"), (None, texts[1], "x")]
    got = S.extract_ranges(spark.createDataFrame(rows, "id long, t string, T2 string"), "id", "t").collect()
    found = {}
    for r in got:
        found.setdefault(r.key, []).append(tuple(r)[1:])
    assert found.pop(None) == GUIDED[texts[1]]
    for i, t in enumerate(texts):
        want = GUIDED[t]
        have = sorted(found.get(i, []))
        assert [x[:4] for x in have] == [x[:4] for x in want], t
        assert [x[4:] for x in have] == [pytest.approx(x[4:]) for x in want], t


def test_ties_go_to_the_name_and_wrong_spellings_give_nothing(spark):
    one = "FY2025 outlook: revenue 3 to 4 million"
    metrics = {"B": ("revenue", "USD"), "A": ("revenue", "USD")}
    assert [r.metric for r in S.extract_ranges(spark.createDataFrame([(1, one)], "id long, t string"), "id", "t", metrics).collect()] == ["A"]


TOPICS = {"DEMAND": ["demand", "customer demand", "order activity"], "MARGIN": ["operating margin"]}
CUES = {"EXPECTATION": ["expect"], "EXPANSION": ["improve", "record-high"], "UNCERTAINTY": ["volatile"]}


def facts(spark, rows, **more):
    df = spark.createDataFrame(rows, "id long, t string")
    found = S.sentence_facts(df, "id", "t", TOPICS, CUES, ["compared with"], ["not", "don't"], boilerplate=["forward-looking statements"], **more)
    return {(r.id, r.n, r.topic): (r.topic_phrases, r.families, r.negated, r.compared) for r in found.collect()}


def test_topics_cues_negation_and_comparison(spark):
    first = "We do not expect customer demand to improve compared with the prior year because order activity remains volatile."
    rows = [
        (1, f"A short one. {first} Operating  margin\nshould reach a record high level in this year."),
        (2, "This release contains forward-looking statements about future demand and our ability to improve operating margin."),
        (3, "Demand 12 34 56 78 90 12 34 improve 45 67."),
        (4, "Operating margins improve in this year, and demands improve."),  # other words
        (5, None),
        (6, ""),
        (1, f"A short one. {first} Operating  margin\nshould reach a record high level in this year."),
    ]
    assert facts(spark, rows) == {
        (1, 1, "DEMAND"): (["customer demand", "demand", "order activity"], ["EXPANSION", "EXPECTATION", "UNCERTAINTY"], True, True),
        (1, 2, "MARGIN"): (["operating margin"], ["EXPANSION"], False, False),
    }


def test_distance_and_lookback(spark):
    far = "We expect " + "so very much " * 8 + "of demand today."
    assert facts(spark, [(1, far)], within=20) == {} and (1, 0, "DEMAND") in facts(spark, [(1, far)], within=200)
    said = "They don't know whether we expect demand."
    assert facts(spark, [(1, said)], lookback=4)[1, 0, "DEMAND"][2] and not facts(spark, [(1, said)], lookback=2)[1, 0, "DEMAND"][2]


def test_positions_count_characters(spark):
    rows = [(1, "äß a1 é22 333")]
    got = S.spans(spark.createDataFrame(rows, "id long, t string"), "id", "t", {"n": "[0-9]+", "w": "[a-zäßé]+"}).collect()
    assert sorted((r.kind, r.start, r.end, r.value) for r in got) == [("n", 4, 5, "1"), ("n", 7, 9, "22"), ("n", 10, 13, "333"), ("w", 0, 2, "äß"), ("w", 3, 4, "a"), ("w", 6, 7, "é")]


def test_phrases_of_signs_overlap_and_lie_within_a_sentence(spark):
    """Phrases that begin within each other, that hold signs, and texts with the mark in them."""
    rows = [(1, "don't in the the in-the sale\x01price % gain, Don 't"), (2, "nothing of it"), (3, "")]
    listed = ["in the", "the in", "the", "the in the", "don ' t", "%", "% gain", "sale price", "the the in the sale"]
    phrases = spark.createDataFrame([(p, "k", p[:1]) for p in listed], "phrase string, kind string, name string")
    got = S.phrase_hits(spark.createDataFrame(rows, "id long, t string"), "t", phrases, listed).collect()
    text = rows[0][1]
    at = lambda part, start=0: (text.index(part, start), text.index(part, start) + len(part))
    want = [("don ' t", *at("don't")), ("don ' t", *at("Don 't")), ("in the", *at("in the")), ("in the", *at("in-the")), ("the in", *at("the in")), ("the in the", *at("the in-the"))]
    want += [("the", *at("the")), ("the", *at("the", 10)), ("the", *at("the", 15)), ("the the in the sale", *at("the the in-the sale")), ("%", *at("%")), ("% gain", *at("% gain")), ("sale price", *at("sale\x01price"))]
    assert sorted((r.phrase, r.start, r.end) for r in got) == sorted(want) and {r.id for r in got} == {1}


def test_topics_with_signs_and_no_topics_at_all(spark):
    df = spark.createDataFrame([(1, "We do not expect that today's R&D spending will improve very much.")], "id long, t string")
    (row,) = S.sentence_facts(df, "id", "t", {"RND": ["R&D"]}, CUES, negations=["not"]).collect()
    assert (row.topic_phrases, row.families, row.negated) == (["r & d"], ["EXPANSION", "EXPECTATION"], True)
    assert S.sentence_facts(df, "id", "t", {}, CUES).collect() == []


def test_a_sentence_is_cut_at_phrases_and_not_token_by_token(spark):
    """Neither a row for each run of tokens nor an interpreted loop over them."""
    df = spark.createDataFrame([(i, "We expect " + "so very much of it and more " * 18 + f"of demand {i}.") for i in range(50)], "id long, t string")
    found = S.sentence_facts(df, "id", "t", TOPICS, CUES, most=1000, within=900)
    assert "array_append" not in found._jdf.queryExecution().executedPlan().toString()
    rows, most = most_rows(found)
    assert len(rows) == 50 and most <= 200


def test_ranges_are_found_where_the_text_is_read(spark):
    """No text's matches are shuffled or sorted in a window: what a task holds does not grow with the table."""
    one = "FY2025 outlook: revenue {} to {} million. "
    long = "".join(one.format(i, i + 1) + "filler words " * 9 for i in range(3000))
    found = S.extract_ranges(spark.createDataFrame([(1, long), (1, long), (2, one.format(7, 8)), (3, "FY2025 outlook: revenue")], "id long, t string"), "id", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    got = sorted((r.key, r.low) for r in found.collect())
    assert got == [(1, i * 1e6) for i in range(3000)] + [(2, 7e6)]


def test_nearest_by_definition():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 30):
        at, among, turn = rnd.integers(0, 40, 25), rnd.integers(0, 40, n), rnd.permutation(n)
        best, away = S._nearest(at, among, turn)
        want = [min((abs(int(a) - int(m)), int(t), j) for j, (m, t) in enumerate(zip(among, turn))) for a in at]
        assert [(d, j) for d, _, j in want] == list(zip(away.tolist(), best.tolist()))
