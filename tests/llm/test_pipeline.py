from collections import defaultdict

import corpus_pipeline
from lattica.llm import language_id, length_packing, toxicity
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def norm(text):
    return (text or "").encode().translate(LOW)


def shingle_set(text, k):
    words = norm(text).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def test_run_is_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id for r in language_id.identified(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")).filter("accepted").collect()}
    first = docs.filter(F.col("doc_id").isin(list(known)))
    mild = {r.doc_id for r in toxicity.scored(first, toxicity.learned(first, labels)).filter("predicted = 0").collect()}
    groups = defaultdict(list)
    for d in mild:
        groups[norm(texts[d])].append(d)
    ids = sorted(max(g) for g in groups.values())
    sets = {d: shingle_set(texts[d], 5) for d in ids}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {d for d in ids if find(d) == d or not sets[d]}
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in found} == want and len(found) == len(want)
    expected = length_packing.packed(docs.filter(F.col("doc_id").isin(list(want))), corpus_pipeline.BUCKETS, corpus_pipeline.BUDGET).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))


def test_language_of_rows_without_an_id(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")
    bare = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    both = bare.unionByName(spark.createDataFrame([(None, "123 !!", "en", "s"), (None, None, None, None)], docs.schema))
    kept = language_id.kept_languages(both)
    assert kept.filter("text is null or text = '123 !!'").count() == 0 and kept.filter("doc_id is null").count() > 0


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    rows = [(1, "The cat sat on the mat and looked at the dog", "en", "s"), (1, "The cat sat on the mat and looked at the dog", "en", "s"), (2, None, None, None), (None, "the other one is here with us", None, "s"), (3, "", "en", "s"), (4, "x " * 50_000, "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars", "1 AS score", "2 AS component", "'z' AS sha")
    spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, now, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == now.columns
            made.write.parquet(path := str(tmp_path / f"{name}-{frame is docs}"))
            now = spark.read.parquet(path)
        assert (now.count() > 0) == (frame is docs)
