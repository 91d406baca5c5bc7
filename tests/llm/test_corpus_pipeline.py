import corpus_pipeline
from slotcast.llm import ordinal
from tests.llm.test_scans import rated
from tests.llm.test_substrings_and_join import brute_components, shingles


def tables(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_equals_brute_force(spark, tmp_path):
    rows = rated(400, 3)
    labels = [(i, int(g > 0), int(g == 1)) for i, _, g in rows]
    texts = [(i, t) for i, t, _ in rows]
    texts += [(1000 + i, t + " more") for i, t in texts[:60]]  # near duplicates
    item = " ".join(f"item{i}" for i in range(12))
    texts += [(2000 + i, item + " " + " ".join(t.split()[30:])) for i, t in texts[60:90]]  # contaminated
    path = tables(spark, tmp_path, [(i, t, "en", "src", len(t)) for i, t in texts], labels, [(1, item)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    chosen = {r.doc_id for r in ordinal.rate(docs, ordinal.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))).collect() if r.selected}
    first = brute_components([(i, t) for i, t in texts if i in chosen])
    left = {i: t for i, t in texts if i in chosen and first[i][1] == i}
    held = shingles(item)
    want = {i: len(t) for i, t in left.items() if 4 * len(held & shingles(t)) < 3 * len(held)}
    got = corpus_pipeline.run(spark, path).collect()
    assert len(got) == len(want) and {r.doc_id: r.n_chars for r in got} == want
    assert len(want) < len(left) < len(chosen) < len(texts) and all(len(r.token_ids) == r.n_tokens > 0 for r in got)


def test_run_without_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [(1, 1, 0)], [(1, "an item of some words")])).count() == 0


def test_null_ratings_are_left_out(spark):
    labels = spark.createDataFrame([(1, None, 0), (2, None, 1), (3, 0, None), (4, 1, None), (5, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.id: r.grade for r in ordinal.rated_ids(labels).collect()} == {3: 0, 5: 2, 6: 1}
