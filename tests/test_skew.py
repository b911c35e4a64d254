"""Hot keys: how they are sliced, and that slicing changes no result."""

from pyspark.sql import functions as F

from rankloom.operators import ranking
from rankloom.operators.joins import heavy_keys, measured_bytes, salted_join


def counts(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "k string, n long")


def slices(frame):
    return {row[0]: row[1] for row in frame.collect()}


def test_slices_follow_the_rows_of_a_key(spark):
    sizes = {"hot": 1_000_001, "warm": 250_000, "at": 100_000, "cold": 7}
    assert slices(heavy_keys(counts(spark, sizes), ["k"], "n", slice_rows=100_000)) == {"hot": 11, "warm": 3}
    assert slices(heavy_keys(counts(spark, sizes), ["k"], "n")) == {}


def test_there_are_never_more_heavy_keys_than_parts(spark):
    sizes = {f"k{i}": 1000 for i in range(500)}
    assert heavy_keys(counts(spark, sizes), ["k"], "n", slice_rows=1, parts=100).count() == 0
    assert heavy_keys(counts(spark, {**sizes, "hot": 10**6}), ["k"], "n", slice_rows=1, parts=100).collect()[0][1] == 67
    assert heavy_keys(counts(spark, sizes).limit(0), ["k"], "n").count() == 0


def test_salted_join_is_the_plain_join(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS k")
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k49", 4), ("none", 5)], "k string, v int")
    heavy = heavy_keys(rows.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", slice_rows=100)
    found = salted_join(rows, lookup, ["k"], heavy, F.col("id"))
    plain = rows.join(lookup, "k")
    assert sorted(map(tuple, found.select("id", "k", "v").collect())) == sorted(map(tuple, plain.select("id", "k", "v").collect()))


def test_one_hot_query_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_MANY_PARTITIONS", 4)
    rows = spark.range(5000).repartition(40).selectExpr("'q' AS qid", "id AS doc_id", "CAST(id % 90 AS DOUBLE) AS score")
    found = [(r.doc_id, r["rank"]) for r in ranking.top_k(rows, 7).orderBy("rank").collect()]
    best = sorted(range(5000), key=lambda i: (-(i % 90), i))[:7]
    assert found == [(doc, place + 1) for place, doc in enumerate(best)]


def test_measured_bytes_is_no_less_than_the_texts(spark):
    frame = spark.createDataFrame([("é" * 10, "x"), (None, None)], "a string, b string")
    assert measured_bytes(frame, "a", "b") >= 21 + 2 * 64
    assert measured_bytes(frame.limit(0), "a") == 0
