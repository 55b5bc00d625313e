"""The pipeline's stages, each against a plain version on what the stage before kept."""

import brute
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_operators import held_packing, ids_of

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, the raw documents first."""
    out, folder = [spark.read.parquet(f"{SMALL}/documents.parquet")], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SMALL).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_toxic_documents_go(spark):
    """On sf0.01: the smallest tables hold too few toxic labels to learn from."""
    folder = SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before, after = texts(docs), texts(corpus_pipeline.toxicity(spark, docs, folder))
    toxic, clean = [i for i in before if labels.get(i) == 1], [i for i in before if labels.get(i) == 0]
    assert after.items() <= before.items() and sum(i not in after for i in toxic) >= 0.7 * len(toxic) and sum(i in after for i in clean) >= 0.95 * len(clean)


def test_copies_go(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert after.keys() == {i for i, (_, _, kept, _) in brute.exact(before).items() if kept}


def test_near_copies_go(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert after.keys() == {i for i, (_, c) in brute.near(before, 5, 80).items() if i == c}


def test_mix_is_near_its_targets(spark, stages):
    from tessella.llm.mixing import count_words, mix

    words = stages[4].withColumn("w", count_words(F.coalesce("text", F.lit("")))).groupBy("source").agg(F.sum("w").alias("w"))
    wanted = {r["source"]: (r["target"], r["m"]) for r in mix(stages[3]).groupBy("source", "target").agg(F.max("size").alias("m")).collect()}
    for r in words.collect():
        assert abs(r["w"] - wanted[r["source"]][0]) <= wanted[r["source"]][1]
    assert set(texts(stages[4])) <= set(texts(stages[3]))


def test_packing_holds_the_mix(stages):
    mixed = stages[4].collect()
    tokens = sum(len(x) for x in ids_of([r["text"] for r in mixed]))
    assert stages[5].agg(F.sum("length")).first()[0] == tokens
    held_packing(stages[5].collect(), {})  # sequences without gaps
    once = {r["doc_id"] for r in stages[4].groupBy("doc_id").count().where("count = 1").collect()}
    lengths = {r["doc_id"]: r["n"] for r in stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert all(lengths[r["doc_id"]] == len(i) for r, i in zip(mixed, ids_of([r["text"] for r in mixed])) if r["doc_id"] in once)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SMALL).count() == stages[5].count()


def test_null_columns_and_no_rows(spark, stages):
    twice = " ".join(f"w{i}" for i in range(30))
    some = [(1, None, None, None, None), (None, "a text", None, None, None), (3, "", "en", None, 0), (4, twice, None, "a", 1), (4, twice, None, "a", 1), (4, "other words", None, "a", 1)]
    for rows, left in (([], set()), (some, {None, 3, 4})):
        docs = spark.createDataFrame(rows, stages[0].schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        found = docs.collect()
        assert {r["doc_id"] for r in found} <= {None, 1, 3, 4} and {r["doc_id"] for r in found} >= left - {None}
        assert bool(found) == bool(rows)
