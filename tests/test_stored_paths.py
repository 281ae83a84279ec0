"""What grows with the graph: the number of buckets; what does not: how often a walk computes its edges."""

from graphloom.operators import paths, stored


def test_buckets_follow_the_edges(spark, tmp_path, monkeypatch):
    nodes = spark.range(90).selectExpr("cast(id AS string) AS id", "array('N') AS labels", "cast(id AS string) AS name")
    edges = spark.range(90).selectExpr("cast(id AS string) AS src", "cast((id + 1) % 90 AS string) AS dst", "'T' AS type")
    monkeypatch.setattr(stored, "BUCKET_ROWS", 10)
    for name, rows, want in (("many_buckets", edges, 9), ("few_buckets", edges.limit(3), spark.sparkContext.defaultParallelism)):
        g = stored.StoredGraph.save(nodes, rows, name, str(tmp_path / name))
        told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}_in").collect()}
        assert int(told["Num Buckets"]) == want
        assert g.degrees("in").count() == rows.count()
        g.drop()


def test_edges_are_computed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    pairs = [(i, (i * 7 + 3) % 20) for i in range(20)]
    edges = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2).map(seen), "src int, dst int")
    nodes = spark.range(20).selectExpr("cast(id AS int) AS id")
    assert paths.ripple(edges, nodes.where("id = 3")).count() and read.value == 20
    assert paths.criticality(nodes, edges, 5).count() == 5 and read.value == 40
