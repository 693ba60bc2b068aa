"""Operator 2: order MinHash fingerprints, sensitive to edit distance.

The symbols are words, the k-mers are runs of ``k`` words; the j-th occurrence of a k-mer in a text is an element of its
own, (k-mer, j). A hash sends every element to one of ``SKETCHES`` sketches and orders it there. Each sketch keeps the
``TUPLE`` least elements, puts their k-mers back into text order and hashes that tuple. Two texts of small edit distance
share most elements in the same order, so many of their tuples agree; a reordered text loses tuples though it keeps its
elements. One pass of hashing serves all sketches, since every sketch has its own part of the hash range.

Likeness is the share of equal tuples among the sketches that are filled in at least one text; two texts without words
have likeness 1. Fewer words than ``k`` count as one k-mer.

Built from DataFrame functions only, on arrays within a row; per text, memory and time follow its number of words (the
sorts add a logarithm). Digests inside have 64 bits, fingerprints 32 bits a tuple.

Defined results. Null text: as empty. The next document is the one with the next larger id; the last one's is the first.
Repeated ids: each row is fingerprinted, and as a next document the id stands for its smallest text. Null ids: no edited
text is defined, they are their own next document. Empty table: an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import settle

SKETCHES, TUPLE = 64, 2
_SKETCH_BITS, _HASH_BITS, _PLACE_BITS = 6, 26, 31  # together the 63 bits of a positive long
_SPACES = "[\\x20\\t\\n\\x0B\\f\\r]+"


def _low(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1))


def _above(value: Column, bits: int) -> Column:
    return F.shiftright(value, bits)


def _joined(high: Column, low: Column, bits: int) -> Column:
    return F.shiftleft(high, bits).bitwiseOR(low)


def _indices(size: Column) -> Column:
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _starts(name: str, bits: int) -> Column:
    """Places in a sorted array where the part above the given bits changes."""
    return F.filter(_indices(F.size(name)), lambda i: (i == 0) | (_above(F.get(name, i), bits) != _above(F.get(name, i - 1), bits)))


def with_tuples(rows: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with an array of one integer per filled sketch: its number in the upper six bits, the tuple's hash below.

    Every step is a column of its own, since steps look into the arrays that earlier ones made.
    """
    words = F.transform(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPACES), ""), lambda w: F.xxhash64(w))
    out = rows.withColumn("__words", words)
    n = F.size("__words")
    pairs = F.zip_with(F.slice("__words", 1, F.greatest(n - 1, F.lit(0))), F.slice("__words", 2, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("__kmers", F.when(n >= 2, pairs).otherwise(F.col("__words"))).drop("__words")
    # k-mers by hash and place: within one hash, the order of places numbers the occurrences.
    out = out.withColumn("__sorted", F.sort_array(F.transform(
        "__kmers", lambda h, i: _joined(_low(h, 32), i.cast("bigint"), _PLACE_BITS))))
    out = out.withColumn("__runs", _starts("__sorted", _PLACE_BITS))
    ends = F.concat(F.slice("__runs", 2, F.greatest(F.size("__runs"), F.lit(1))), F.array(F.size("__sorted")))
    numbers = F.flatten(F.zip_with("__runs", F.slice(ends, 1, F.size("__runs")), lambda a, b: F.sequence(F.lit(0), b - a - 1)))
    elements = F.zip_with("__sorted", numbers, lambda s, j: _joined(
        _low(F.xxhash64(_above(s, _PLACE_BITS), j), _SKETCH_BITS + _HASH_BITS), _low(s, _PLACE_BITS), _PLACE_BITS))
    out = out.withColumn("__elements", F.sort_array(elements)).drop("__sorted", "__runs")
    # The least elements of every sketch, then by sketch and place, which is text order.
    sketch = _HASH_BITS + _PLACE_BITS
    least = F.filter("__elements", lambda e, i: (i < TUPLE) | (_above(e, sketch) != _above(F.get("__elements", i - TUPLE), sketch)))
    out = out.withColumn("__least", F.sort_array(F.transform(
        least, lambda e: _joined(_above(e, sketch), _low(e, _PLACE_BITS), _PLACE_BITS)))).drop("__elements")
    out = out.withColumn("__firsts", _starts("__least", _PLACE_BITS))

    def kmer(i: Column) -> Column:
        return F.get("__kmers", _low(F.get("__least", i), _PLACE_BITS).cast("int"))

    def number(i: Column) -> Column:
        return _above(F.get("__least", i), _PLACE_BITS)

    hashed = F.transform("__firsts", lambda i: _joined(number(i), _low(
        F.when(number(i) == number(i + 1), F.xxhash64(kmer(i), kmer(i + 1))).otherwise(F.xxhash64(kmer(i))), _HASH_BITS), _HASH_BITS))
    return out.withColumn(name, F.transform(hashed, lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int"))).drop("__kmers", "__least", "__firsts")


def as_text(tuples: str) -> Column:
    """A fingerprint: eight hexadecimal digits for every filled sketch."""
    return F.array_join(F.transform(tuples, lambda x: F.lower(F.lpad(F.hex(_low(x.cast("bigint"), 32)), 8, "0"))), "")


def likeness(left: str, right: str) -> Column:
    """Equal tuples among the sketches filled in at least one of both."""
    equal = F.size(F.array_intersect(left, right)).cast("double")
    numbers = [F.transform(side, lambda x: F.shiftrightunsigned(x, _HASH_BITS)) for side in (left, right)]
    filled = F.size(left) + F.size(right) - F.size(F.array_intersect(*numbers))
    return F.when(filled == 0, 1.0).otherwise(equal / filled)


def next_ids(documents: DataFrame) -> DataFrame:
    """doc_id and next_id for every distinct id, in ascending order, the last one followed by the first.

    Ids are split into ranges; within a range a window looks ahead, and the last id of a range takes the first of the next
    range from a table with one row per range.
    """
    ids = settle(documents.select("doc_id").where("doc_id is not null").distinct().repartitionByRange("doc_id")
                 .withColumn("range", F.spark_partition_id()))
    inside = ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id")))
    firsts = ids.groupBy("range").agg(F.min("doc_id").alias("first"))  # one row per partition
    smallest = ids.agg(F.min("doc_id")).first()[0]
    follow = firsts.select("range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.lit(smallest).cast("bigint")).alias("follow"))
    return settle(inside.join(follow, "range").select("doc_id", F.coalesce("next_id", "follow").alias("next_id")))


def edited(documents: DataFrame) -> DataFrame:
    """doc_id, next_id, text, n_chars and the text whose last quarter the next document's beginning replaces."""
    known = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    order = next_ids(documents)
    sizes = known.groupBy("doc_id").agg(F.max(F.floor(F.char_length("text") / 4)).cast("int").alias("need"))
    wanted = order.join(sizes, "doc_id").select(F.col("doc_id").alias("before"), F.col("next_id").alias("doc_id"), "need")
    parts = (known.join(wanted, "doc_id").select(F.col("before").alias("doc_id"), F.expr("left(text, need)").alias("part"),
                                                 F.col("doc_id").alias("next_id")))
    # An id that occurs once has one part already; repeated ids give their smallest.
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.isEmpty():
        parts = parts.groupBy("doc_id", "next_id").agg(F.min("part").alias("part"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    out = known.join(parts, "doc_id").select(
        "doc_id", "next_id", "text", F.char_length("text").cast("long").alias("n_chars"),
        F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 4) as int))"),
                 F.substring("part", F.lit(1), quarter)).alias("edited"))
    alone = documents.where("doc_id is null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("next_id"),
        F.coalesce("text", F.lit("")).alias("text"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.lit(None).cast("string").alias("edited"))
    return out.unionByName(alone)


def compare(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document."""
    both = with_tuples(with_tuples(edited(documents), "text", "own"), "edited", "other")
    rows = settle(both.select("doc_id", "next_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                              "own", F.when(F.col("edited").isNotNull(), F.col("other")).alias("other")))
    after = rows.select(F.col("doc_id").alias("next_id"), F.col("own").alias("after"))
    if not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        after = after.groupBy("next_id").agg(F.min("after").alias("after"))
    return (rows.join(after, "next_id", "left")
            .select("doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"),
                    likeness("own", "other").alias("near_edited"),
                    F.when(F.col("doc_id").isNull(), 1.0).otherwise(likeness("own", "after")).alias("near_next")))
