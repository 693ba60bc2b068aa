"""Every stage beside what its operator or a brute-force version says about the same input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_components

import corpus_pipeline
from tidemark.llm import pii_spans, quality_fm, raking

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table with a null text, an empty one, a null id, a repeated row and an identifier."""
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    extra = spark.createDataFrame([(9000, None, "en", "src0", None), (9001, "", None, None, 0), (None, "no id", "en", "src1", 5),
                                   (9002, "write to jane@example.com or bob at example dot com", "en", "src1", 51)], some.schema)
    return some.unionByName(extra).unionByName(some.where("doc_id = 3")).cache()


def rows(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixture", "packing"]


def test_quality_stage(spark, docs):
    got = corpus_pipeline.keep_good(spark, docs, SF)
    model = quality_fm.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality_fm.score(docs, model).toPandas()
    assert got.schema == docs.schema and got.count() == (scored.score >= 0.5).sum()
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and doc_id < 60")
    assert labels.join(got, "doc_id", "left_anti").count() <= 0.1 * labels.count()


def test_near_duplicate_stage(spark, docs):
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    components = brute_components(given)
    got = rows(corpus_pipeline.keep_one_of_each(spark, docs, SF))
    kept = [i for i, c in components.items() if i == c] + [None]
    assert sorted((r[0] for r in got), key=str) == sorted(kept, key=str)
    assert set(got) <= set(rows(docs))


def test_near_duplicate_stage_takes_four_fifths(spark, docs):
    """Copies between 80 and 85 percent go, those below 80 stay."""
    rng = random.Random(6)
    given = []
    for group in range(12):
        base = [f"w{group}x{rng.randint(0, 10**6)}" for _ in range(120)]
        given.append((100 * group, " ".join(base)))
        for edits in range(1, 5):
            words = list(base)
            for k in range(edits):
                words[20 + 25 * k] = f"e{group}y{edits}z{k}"
            given.append((100 * group + edits, " ".join(words)))
    frame = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in given], docs.schema)
    got = {r[0] for r in rows(corpus_pipeline.keep_one_of_each(spark, frame, SF))}
    assert got == {i for i, c in brute_components(given, 80).items() if i == c}
    assert len(got) < len({i for i, c in brute_components(given, 85).items() if i == c})


def test_masking_stage(spark, docs):
    got = {r[0]: r for r in rows(corpus_pipeline.mask_personal_data(spark, docs, SF))}
    for r in rows(docs):
        text = r[1] and pii_spans.masked(r[1])
        assert got[r[0]][1] == text and got[r[0]][2:4] == r[2:4] and got[r[0]][4] == (r[4] if text == r[1] else len(text))
    assert got[9002][1] == "write to <EMAIL> or <EMAIL>"


def test_mixture_stage(spark, docs):
    got = rows(corpus_pipeline.mix_sources(spark, docs, SF))
    weights = raking.weights(docs, keep=corpus_pipeline.KEEP).toPandas()
    assert len(got) == weights.kept.sum() and set(got) <= set(rows(docs))


def test_whole_pipeline(spark, tmp_path):
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80")
    some.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert 0 < out.doc_id.nunique() <= some.count()
    for _, group in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (group.offset + group.length).iloc[-1] <= 4096 and group.offset.iloc[0] == 0
        assert (group.offset.iloc[1:].to_numpy() == (group.offset + group.length).iloc[:-1].to_numpy()).all()


def test_empty_tables(spark, docs):
    none = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
