"""Filtered semi-joins: the same rows, and few of the others in the shuffle."""

import pytest
from pyspark.sql import functions as F
from wayfare.operators import semi


@pytest.fixture(scope="module")
def sides(spark):
    rows = spark.range(400_000).select(F.when(F.col("id") % 1000 > 0, F.concat(F.lit("u"), F.col("id") % 100_000)).alias("ad_id"), "id", F.repeat(F.lit("x"), 50).alias("payload")).persist()
    ids = spark.range(0, 100_000, 50).select(F.concat(F.lit("u"), "id").alias("ad_id"))
    return rows, ids.unionByName(ids).unionByName(spark.createDataFrame([(None,)], "ad_id string"))


def rows_of(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("most_bits", [semi.MOST_BITS, 1 << 15])
def test_same_rows(sides, most_bits):
    rows, ids = sides
    want = rows_of(rows.join(ids, "ad_id", "left_semi"))
    assert len(want) > 1000
    got = semi.filtered_semi(rows, ids, most_bits=most_bits)
    assert got.columns == rows.columns and rows_of(got) == want
    assert rows_of(semi.filtered_semi(rows, ids.limit(0))) == []


def shuffled(df):
    """Bytes that the plan that ran has shuffled."""
    df.write.format("noop").mode("overwrite").save()
    qe = df._jdf.queryExecution()
    df.collect()
    total, todo = 0, [qe.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("shuffleBytesWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_fewer_bytes_are_shuffled(spark, sides):
    rows, ids = sides
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plain, filtered = shuffled(rows.join(ids, "ad_id", "left_semi")), shuffled(semi.filtered_semi(rows, ids))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert 0 < filtered < plain / 4
    table, bits = semi.bit_table(ids.distinct())
    passed = semi.may_be_in(rows, table, bits).count()
    held = len(rows_of(rows.join(ids, "ad_id", "left_semi")))
    assert held <= passed <= held + 0.12 * 400_000
