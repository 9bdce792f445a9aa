from __future__ import annotations

from tuplewise import Relation, streaming
from tuplewise.sources import read, read_keyed, write, write_keyed

ROWS = [{"id": f"k{i}", "value": i} for i in range(50)]


def test_read_write(spark, tmp_path):
    write(Relation.of(ROWS), str(tmp_path / "j"), "json")
    assert read(spark, str(tmp_path / "j"), "json").is_equal(ROWS)


def test_keyed(spark, tmp_path):
    write_keyed(Relation.of(ROWS), str(tmp_path / "k"), "id", 8)
    r = read_keyed(spark, str(tmp_path / "k"), "id", 8)
    one = r.restrict({"id": "k7"})
    assert one.to_array() == [{"id": "k7", "value": 7}] and len(one.df.inputFiles()) <= 8
    assert "PartitionFilters: [isnotnull(_bucket" in one.df._jdf.queryExecution().executedPlan().toString().replace("#", "_#").replace("_bucket_", "_bucket")
    assert r.restrict(lambda t: t.value < 2).is_equal(ROWS[:2]) and r.is_equal(ROWS)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i, i % 3, f"2024-01-01 00:{i:02d}:00") for i in range(12)], "id long, g long, t string").selectExpr("id", "g", "CAST(t AS TIMESTAMP) AS t").write.parquet(str(tmp_path / "s"))
    stream = Relation(spark.readStream.schema("id long, g long, t timestamp").parquet(str(tmp_path / "s")))
    jobs = {
        "s_rows": stream.restrict({"g": 1}).project(["id"]),
        "s_minus": stream.project(["g"]).minus(Relation.of([{"g": 1}])),
        "s_windows": streaming.summarize_windows(stream, "t", "5 minutes", ["g"], {"n": "count"}, "1 minute"),
        "s_set": streaming.as_set(stream, "t", "1 minute"),
    }
    for name, relation in jobs.items():
        streaming.start(relation, name).awaitTermination(60)
    assert sorted(r.id for r in spark.table("s_rows").collect()) == [1, 4, 7, 10]
    assert sorted(r.g for r in spark.table("s_minus").collect()) == [0, 2]
    assert {r.n for r in spark.table("s_windows").collect()} <= {1, 2} and spark.table("s_set").count() == 12
