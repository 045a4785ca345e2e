from collections import Counter

from lattica.streaming import events

ROWS = "/root/testdata/sf0.001/events.parquet"


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = spark.read.parquet(ROWS)
    rows.union(rows.limit(10)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: events.events(spark, str(tmp_path / "in"), 1)
    assert len(run(spark, events.once(stream(), late="60 days"), "once", "append")) == rows.count()
    n = run(spark, events.windowed(stream(), late="60 days"), "windowed", "complete")
    assert sum(r.n for r in n) == rows.count() + 10
    want = Counter(r.user_id for r in rows.filter("event_type = 'error'").collect())
    found = run(spark, events.escalated(events.once(stream(), late="60 days")), "escalated", "append")
    assert {r.user_id for r in found} == {u for u, k in want.items() if k >= 3}
    state = {}
    batch = events.upserting(lambda: state.get("t", rows.limit(0).select("user_id", "ts", "value")), lambda df: state.update(t=spark.createDataFrame(df.collect(), df.schema)), "user_id")
    part = rows.select("user_id", "ts", "value")
    batch(part, 0)
    batch(part, 0)
    assert state["t"].count() == rows.select("user_id").distinct().count()
