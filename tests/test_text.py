"""Name folding at length."""

import time

from pyspark.sql import functions as F

from tidemark.functions import text as tx


def test_letters_without_ligatures_are_passed_over_at_once(spark):
    df = spark.range(0, 4, 1, 1).select(F.concat(F.repeat(F.lit("Müller à la carte "), 60_000), F.lit("½"), F.col("id").cast("string")).alias("t"))
    df.select(F.length(tx.fold(F.lit("warm"))).alias("n")).collect()
    looked = df.select(F.regexp_instr("t", F.lit(tx._ANY_SEVERAL)).alias("at"))
    start = time.perf_counter()
    assert looked.agg(F.count_if(F.col("at") > 0)).first()[0] == 4
    assert time.perf_counter() - start < 5


def test_every_ligature_is_still_found(spark):
    rows = spark.createDataFrame([(c, p) for c, p in tx._SEVERAL.items()], "c string, parts string")
    assert rows.filter(~F.col("c").rlike(tx._ANY_SEVERAL)).count() == 0
