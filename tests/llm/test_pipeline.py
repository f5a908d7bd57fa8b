from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from .test_filters import brute_counts
from .test_near import brute_components, sets_of
from .conftest import TEXTS, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage gets and returns on the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((docs, got))
        docs = got
    return out


def test_stages_return_documents(stages):
    for docs, got in stages[:-1]:
        assert got.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))
        # rows leave, none comes in, and what stays stays as often as it was
        assert not Counter(map(tuple, got.collect())) - Counter(map(tuple, docs.collect())) and got.count() > 0.8 * docs.count()


def test_rules_stage(stages):
    docs, got = stages[0]
    kept = {r["doc_id"] for r in got.select("doc_id").collect()}
    failed = set()
    for i, t in rows_of(docs):
        c = brute_counts(t)
        if c[0] < 10 or 100 * c[4] > 20 * c[0]:
            failed.add(i)
    # so few labels certify no cutoff: only the base rules reject
    assert kept == {i for i, _ in rows_of(docs)} - failed and failed


def test_classifier_stage_keeps_good_documents(spark, stages):
    docs, got = stages[1]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    before = good & {i for i, _ in rows_of(docs)}
    after = good & {i for i, _ in rows_of(got)}
    assert len(after) >= 0.98 * len(before)


def test_near_duplicate_stage(stages):
    docs, got = stages[2]
    own = brute_components(sets_of(rows_of(docs), 5), 80)
    assert {i for i, _ in rows_of(got)} == {i for i, c in own.items() if i == c}
    assert len(set(own.values())) < len(own)


def test_packing_stage(stages):
    docs, got = stages[3]
    assert {r["doc_id"] for r in got.collect()} == {i for i, _ in rows_of(docs)}
    total = got.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in total) <= 2048
    assert len(total) == -(-sum(r[1] for r in total) // 2048)


def test_run_and_registration(spark, stages):
    names = {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
    out = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, stages[-1][1].select(key).collect()))


@pytest.fixture(scope="module")
def awkward(odd):
    """The odd documents with names that are no identifiers, a nested column and names the stages use themselves."""
    return odd.withColumns({
        "my col": F.col("doc_id") * 2, "a-b": F.struct(F.col("n").alias("x y"), F.col("lang").alias("`z.w`")), "a.b": F.array("lang"),
        "_counts": F.lit(1), "_judged": F.lit(2), "_cuts": F.lit(3), "_cut_key": F.lit("k"), "n_words": F.lit(4), "h1": F.lit(5), "pieces": F.lit(6),
    })


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_any_columns(spark, awkward, no_documents, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, awkward, SF)
    empty = run(spark, no_documents, SF)
    assert empty.count() == 0
    if stage == "best_fit_packing":
        # every row is packed, empty ones too
        assert got.where("piece = 0").count() == awkward.count()
        return
    assert got.columns == awkward.columns and got.schema == awkward.schema and empty.columns == no_documents.columns
    before, after = (Counter(map(str, x.collect())) for x in (awkward, got))
    assert not after - before
    ids = {r["doc_id"] for r in got.select("doc_id").collect()}
    if stage == "quality_rules":
        bad = {i for i, t in rows_of(awkward) if (c := brute_counts(t))[0] < 10 or 100 * c[4] > 20 * c[0]}
        assert ids == {i for i, _ in rows_of(awkward)} - bad
    if stage == "ngram_jaccard":
        own = brute_components({i: s for i, s in sets_of(rows_of(awkward), 5).items() if i is not None}, 80)
        assert {i for i in ids if i is not None} == {i for i, c in own.items() if i == c}
        assert TEXTS.index(None) in ids


def test_composed_stages_on_odd_rows(spark, awkward, tmp_path):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        got, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.count() <= got.count() or name == "best_fit_packing"
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
