import json

from pyspark.sql import functions as F

from lattica.operators import pipelines
from lattica.operators.pipelines import Pipeline
from lattica.streaming.ingest import arriving, ingest

PIPE = Pipeline("Study", "id", [("nct", "id", None, None), ("phase", "phase", None, None), ("n", "n", None, None)], ["n"], [("n", "ERROR", "RANGE", lambda: F.col("n") < 0)])


def test_goes_on_where_it_ended(spark, tmp_path):
    source, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "checkpoint")
    source.mkdir()

    def put(name, *records):
        (source / name).write_text("\n".join(json.dumps(r) for r in records))

    def run():
        ingest(arriving(spark, str(source), "nct string, phase string, n int"), PIPE, store, checkpoint)
        return {r["id"]: (r["phase"], r["n"]) for r in pipelines.stored(spark, store).collect()}

    put("a.json", {"nct": "1", "phase": "P1", "n": 5}, {"nct": "2", "n": -1}, {"phase": "no id"})
    assert run() == {"1": ("P1", 5)}
    assert run() == {"1": ("P1", 5)}  # nothing new
    put("b.json", {"nct": "1", "phase": "P2"}, {"nct": "3", "n": 7})
    assert run() == {"1": ("P2", 5), "3": (None, 7)}
    assert sorted(r["n"] for r in spark.read.parquet(f"{store}/rejected").groupBy("batch").agg(F.count("*").alias("n")).collect()) == [2]


def test_a_batch_counts_once(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("1", "P1", 5)], "id string, phase string, n int")
    other = spark.createDataFrame([("1", "P9", 9)], "id string, phase string, n int")
    assert [pipelines.load(rows, "id", store, 0), pipelines.load(other, "id", store, 0), pipelines.load(other, "id", store, 1), pipelines.load(rows, "id", store)] == [1, 1, 2, 3]
    assert pipelines.stored(spark, store).first()["phase"] == "P1"
