from asofkit.operators import texts as T


def test_no_task_holds_the_text_of_a_key(spark):
    rows = [("a", "<p>One 123</p>"), ("a", "two<script>x</script>"), ("a", None), ("b", ""), (None, "Nicht 12"), (None, "3")]
    parts = spark.createDataFrame(rows, "site string, html string")
    got = T.text_signals(parts, "site", "html", {"number": "[0-9]{3}", "nicht": "nicht"})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    # As the texts joined by line ends would give: "One 123\ntwo\n", "" and "Nicht 12\n3".
    assert {r.site: tuple(r)[1:] for r in got.collect()} == {"a": (12, True, False), "b": (0, False, False), None: (10, False, True)}
