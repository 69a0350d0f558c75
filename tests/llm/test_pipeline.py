"""The pipeline's stages on a small table against plain versions."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumewatch.llm import language, mixing
from tests.llm import brute
from tests.llm import test_near_copies as near_copies


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == columns
    assert {r.doc_id for r in seen["language"]} == {
        i for i, t in text.items() if t is not None and any(c.isalpha() for c in t)}
    groups = collections.defaultdict(list)
    for r in seen["language"]:
        groups[brute.lower(r.text)].append(r.doc_id)
    assert sorted(r.doc_id for r in seen["exact_dedup"]) == sorted(max(g) for g in groups.values())
    left = [(r.doc_id, r.text) for r in seen["exact_dedup"]]
    grams = [near_copies.sets(t) for _, t in left]
    near = [(i, j) for i in range(len(left)) for j in range(i)
            if 10 * len(grams[i] & grams[j]) >= 8 * len(grams[i] | grams[j])]
    assert sorted(r.doc_id for r in seen["simhash_dedup"]) == sorted(
        set(brute.smallest([i for i, _ in left], brute.roots(len(left), near))))
    sizes = collections.Counter()
    for r in seen["simhash_dedup"]:
        sizes[r.source] += len(brute.WORD.findall(r.text))
    want, got = brute.targets(sizes), collections.Counter()
    for r in seen["mix"]:
        got[r.source] += len(brute.WORD.findall(r.text))
    longest = max(len(brute.WORD.findall(r.text)) for r in seen["simhash_dedup"])
    assert all(abs(got[s] - want[s]) <= longest for s in sizes)
    assert max(collections.Counter(r.doc_id for r in seen["mix"]).values()) <= 2
    assert sorted((r.doc_id, brute.sha(r.text)) for r in seen["mix"]) == sorted(
        (r.doc_id, r.decoded_sha256) for r in seen["encode"])


def test_empty_and_awkward_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    awkward = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "Words here", None, None, 10),
         (2, "Words here", None, None, 10), (3, "words HERE", "en", "a", 10), (None, "Other text", "de", "", 3)],
        docs.schema)
    for k, table in enumerate((docs.where("false"), awkward)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, now, sf).write.parquet(path)
            now = spark.read.parquet(path)
            if name == "simhash_dedup":
                kept = sorted((r.doc_id or -1) for r in now.collect())
        assert kept == ([] if k == 0 else [-1, 3])


def test_certain_predictions_name_the_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    unnamed = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 3, None).otherwise(F.col("lang")))
    given = {r.doc_id: r.lang for r in unnamed.select("doc_id", "lang").collect()}
    model = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(unnamed).collect()}
    for r in language.known_language(unnamed).collect():
        found, score = model[r.doc_id]
        assert r.lang == (found if given[r.doc_id] is None or score >= language.CERTAIN else given[r.doc_id])
    assert len(pred) == len(model)


def test_wordless_documents_of_a_full_source_stay_at_the_epochs(spark):
    """A source at its limit has no fraction left: what has no words is taken as often as the rest."""
    rows = [(i, "" if i % 3 else "one two", "small") for i in range(30)] + [
        (i, "w " * 50, "large") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = {r.doc_id: r["count"] for r in mixing.mix(df).groupBy("doc_id").count().collect()}
    assert {times[i] for i in range(30)} == {2} and max(times.values()) <= 2


@pytest.mark.parametrize("edges", [2_000_000, 5])
def test_components_of_many_hubs(spark, monkeypatch, edges):
    """Every node has edges to many hubs; the first table has about one for each."""
    import random

    from plumewatch.llm import graph

    monkeypatch.setattr(graph, "EDGES", edges)
    rnd = random.Random(1)
    pairs = [(i, h) for i in range(100, 400) for h in range(i % 2, 40, 2)]
    pairs += [(1000 + i, 1001 + i) for i in range(90)] + [(rnd.randrange(3000, 3300), rnd.randrange(3000, 3300))
                                                          for _ in range(250)] + [(7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    got = {r.node: r.root for r in graph.components(df).collect()}
    root = brute.roots(4000, pairs)
    assert got == {n: root[n] for p in pairs if p[0] != p[1] for n in p}
    thin = df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).repartition(4, "u").mapInArrow(
        graph._thin(edges), "u long, v long").count()
    assert thin <= 300 + 4 * 40 + 90 + 250
