from pyspark.sql import functions as F

from lattica.operators import pipelines
from lattica.operators.pipelines import Pipeline

PIPE = Pipeline("Thing", "id", [("Key", "id", None, None), ("Name", "name", "nobody", F.trim), ("Mass", "mass", None, None)], ["mass"], [("mass", "ERROR", "RANGE", lambda: F.col("mass") < 0), ("mass", "WARN", "RANGE", lambda: F.col("mass") > 100)])
FORM = "Key string, Name string, Mass double, extra int"


def test_run_merges_and_rejects(spark, tmp_path):
    first = spark.createDataFrame([("a", " A ", 1.0, 1), ("a", "later", 5.0, 1), ("b", None, 500.0, 1), ("c", "C", -1.0, 1), (None, "no key", 1.0, 1)], FORM)
    second = spark.createDataFrame([("b", "B", None, 1), ("d", "D", 2.0, 1)], FORM)
    folder = str(tmp_path)
    assert pipelines.stored(spark, f"{folder}/Thing") is None
    assert pipelines.run(PIPE, first, folder, dry=True).collect() == [("Thing", 5, 2, 1, 2)]
    assert pipelines.stored(spark, f"{folder}/Thing") is None
    pipelines.run(PIPE, first, folder)
    assert sorted(map(tuple, pipelines.stored(spark, f"{folder}/Thing").collect())) == [("a", "A", 1.0), ("b", "nobody", 500.0)]
    assert {(r["id"], r["findings"][0]["code"]) for r in spark.read.parquet(f"{folder}/rejected/Thing").collect()} == {("c", "RANGE"), (None, "REQUIRED")}
    pipelines.run(PIPE, second, folder)
    assert sorted(map(tuple, pipelines.stored(spark, f"{folder}/Thing").collect())) == [("a", "A", 1.0), ("b", "B", 500.0), ("d", "D", 2.0)]
    # a version that isn't in the list doesn't count
    spark.range(1).write.parquet(f"{folder}/Thing/data-3")
    assert pipelines.stored(spark, f"{folder}/Thing").count() == 3
    assert pipelines.load(pipelines.accepted(PIPE, first), "id", f"{folder}/Thing") == 3


def test_nothing(spark, tmp_path):
    assert pipelines.run(PIPE, spark.createDataFrame([], FORM), str(tmp_path)).collect() == [("Thing", 0, 0, 0, 0)]
    assert pipelines.stored(spark, f"{tmp_path}/Thing").count() == 0
