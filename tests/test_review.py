from tracefolio.operators import review

POINT = "document_id string, item_key string, text string, evidence_page int, evidence_quote string"
FACT = "document_id string, field string, value double, n_citations int"


def build(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    pages = spark.createDataFrame([("a", 1, "Revenue grew by\n12 percent"), ("a", 2, "other"), ("b", 1, "x")], "document_id string, page_number int, text string")
    points = [("a", f"p{i}", "t", 1, "revenue grew by 12 percent") for i in range(6)] + [("b", "p0", "t", 1, "never said this"), ("b", "p1", "t", 9, "no such page"), ("b", "p2", "t", None, None)]
    facts = spark.createDataFrame([("a", "revenue", 1.0, 1), ("a", "roe", None, 0), ("b", "revenue", 2.0, 0)], FACT)
    cited = review.cite_points(spark.createDataFrame(points, POINT), pages)
    return docs, facts, cited, review.issues(cited, facts, docs)


def test_issues_and_states(spark):
    docs, facts, cited, found = build(spark)
    assert sorted((r["document_id"], r["item_key"], r["severity"]) for r in found.collect()) == [
        ("b", "p0", "review"), ("b", "p1", "review"), ("b", "p2", "review"), ("b", "revenue", "review"), ("b", "summary_output", "warning"), ("c", "summary_output", "review"),
    ]
    got = {r["document_id"]: (r["verified"], r["pending"], r["status"]) for r in review.states(cited, facts, found, docs).collect()}
    assert got == {"a": (7, 0, "passed"), "b": (0, 4, "needs_confirmation"), "c": (0, 0, "needs_confirmation")}


def test_decisions(spark):
    *_, found = build(spark)
    actions = spark.createDataFrame([("b", "p0", "approve", 1), ("b", "p0", "rerun", 2), ("b", "p1", "rerun", 1), ("b", "p1", "approve", 2)], "document_id string, item_key string, action string, at int")
    left = {(r["document_id"], r["item_key"]) for r in review.decide(found, actions).collect()}
    assert ("b", "p0") in left and ("b", "p1") not in left
    fresh = found.where("item_key = 'p2'")
    keys = lambda c: sorted(r["item_key"] for r in review.rerun(found, fresh, c).collect())
    assert keys("numeric") == ["p0", "p1", "p2", "summary_output", "summary_output"] and keys("summary") == ["p2", "revenue"] and keys("citation") == ["p2", "summary_output", "summary_output"]


def test_changed_fields(spark):
    s = "document_id string, revenue double, roe double"
    got = review.changed_fields(spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 2.0), ("c", 1.0, None)], s), spark.createDataFrame([("a", 1.0, None), ("b", 1.0, None), ("d", None, 3.0)], s), ["revenue", "roe"])
    assert sorted((r["document_id"], r["changed"]) for r in got.collect()) == [("b", ["roe"]), ("c", ["revenue"]), ("d", ["roe"])]
