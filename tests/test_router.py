"""Answers out of graphs and histories, against brute force; what a question meets is counted a name, not listed."""

import random

from graphloom.operators import linking, router


def joins_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_structural_counts_names_not_pairs(spark):
    draw = random.Random(5)
    nodes = [(draw.choice([None, *range(12)]), draw.choice(["load", "save", "walk", None]), draw.choice([["Function"], ["Class"], ["Class", "Function"]])) for _ in range(50)]
    calls = [(draw.randrange(12), draw.randrange(14)) for _ in range(40)]
    questions = [(i, " ".join(draw.choice(["load", "save?", "walk", "none", "it"]) for _ in range(3))) for i in range(12)]
    want = {}
    for qid, text in questions:
        said = {w for w in text.replace("?", "").split() if len(w) > 3}
        hit = {(i, tuple(labels)) for i, name, labels in nodes if name in said}
        if hit:
            made = sum(i == dst for i, labels in hit if "Function" in labels for _, dst in calls)
            want[qid] = (len(hit), made, 0.85 if made else 0.5)
    n = spark.createDataFrame(nodes, "id int, name string, labels array<string>")
    q, c = spark.createDataFrame(questions, "qid int, text string"), spark.createDataFrame(calls, "src int, dst int")
    found = router.structural(q, n, c)
    assert {r.qid: (r.nodes, r.relationships, r.confidence) for r in found.collect()} == want
    assert found.count() == len(want)

    triples = [(i, draw.choice(["load", "walk", "none"]), draw.choice(["CALLS", "uses"]), draw.choice(["save", "no"])) for i in range(6) for _ in range(2)]
    for qid, _ in questions:
        own = [t for t in triples if t[0] == qid]
        hit = {i for i, name, _ in nodes for t in own if name in (t[1], t[3])}
        if hit:
            made = sum(src in {i for i, name, _ in nodes for t in own if name == t[1] and t[2] == "CALLS" and i is not None} for src, _ in calls)
            want[qid] = (len(hit), made, 0.85 if made else 0.5)
    facts = linking.structural_by_facts(q, spark.createDataFrame(triples, "qid int, subject string, predicate string, object string"), n, c)
    assert {r.qid: (r.nodes, r.relationships, r.confidence) for r in facts.collect()} == want


def test_each_question_meets_one_row_a_name(spark):
    """10,000 questions and 10,000 nodes of one name: no join makes a row for each pair."""
    q = spark.range(10_000).selectExpr("id AS qid", "'load it' AS text")
    n = spark.range(10_000).selectExpr("id", "'load' AS name", "array('Function') AS labels")
    found = router.structural(q, n, spark.range(5).selectExpr("id AS src", "id AS dst"))
    assert found.selectExpr("count(*)", "min(nodes)", "max(nodes)", "max(relationships)").first() == (10_000, 10_000, 10_000, 5)
    assert "Aggregate [name" in joins_of(found)
    h = spark.range(10_000).selectExpr("id", "'load it' AS text", "id AS ts")
    newest = router.temporal(q, h, "ts")
    assert newest.selectExpr("count(*)", "min(id)").first() == (10_000, 9_999)
    told = joins_of(newest).split("Join")[1]
    assert "Aggregate [word" in told
