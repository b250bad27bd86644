import pytest

from hornspark import streaming
from hornspark.engine import Engine


@pytest.fixture
def stream(spark, tmp_path):
    spark.createDataFrame([("a", "b")], "x string, y string").coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([("b", "c")], "x string, y string").coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    return lambda: spark.readStream.schema("x string, y string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_monotone_rules_are_a_streaming_plan(spark, stream, tmp_path):
    names = spark.createDataFrame([("b", "Bob")], "k string, n string")
    df = streaming.streaming_rows('o(X, N) :- e(X, Y), name(Y, N). o(X, "any") :- e(X, _).', "o", {"e": stream(), "name": names})
    assert df.isStreaming
    q = df.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("streamed").collect())) == [("a", "Bob"), ("a", "any"), ("b", "any")]
    with pytest.raises(streaming.NotMonotone):
        streaming.streaming_rows("t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z).", "t", {"e": stream()})


def test_maintained_recursion(spark, stream):
    seen = []
    engine = Engine(spark).add("t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z).")
    q = streaming.maintain(engine, "t", stream(), "e", lambda df, n: seen.append(sorted(map(tuple, df.collect()))))
    q.processAllAvailable()
    q.stop()
    assert sorted(r for batch in seen for r in batch) == [("a", "b"), ("a", "c"), ("b", "c")] and len(seen) == 2
