"""Operator 10: mix sources, languages and topics to target weights by iterative proportional fitting.

Token counts are summed to cells (source, language, topic). Raking scales the cells until every marginal has its target
share; the cells stay a DataFrame, their sums are combined on the map side, and only single numbers (deviation, the
sampling rate) reach the driver. A document is kept with probability min(1, rate * factor of its cell), where the rate
is calibrated so that the expected tokens kept are the budget; the draw is a hash of the id, so it repeats.

A cell whose rate times factor is above one is short of its target in such a draw, however the rate is chosen. What the
draw reaches is in ``Mix.margins`` per category and, as the largest miss, in ``margin_missed``. Where documents may be
taken more than once, ``copies`` (``sample`` with ``repeat``) meets the targets and the budget both, in expectation.

Built from DataFrame functions only.

Targets default to the observed token shares to the power ``temperature``, normalised: below one, small sources gain.
The topic defaults to the text's form; any column expression may take its place.

Defined results. Null text: no tokens, form "empty". Null source, language or topic: a category of its own. Null ids:
drawn as the empty id. Repeated rows: drawn alike. Targets that contradict each other: the result of the sweep at which
the deviation stopped falling, with a warning in the log and what the margins are off in ``margin_off``. Cells without tokens: factor zero, never kept unless the whole table
has none; an empty table gives an empty result. Further columns are kept by ``sample`` and ignored by ``weights``.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from tidemark.session import measured_bytes, settle, written

MARGINS = ("source", "lang", "topic")
BROADCAST_BYTES = 4 << 20
#: Sweeps go on until the targets are met or the deviation stops falling; a number here bounds them besides.
SWEEPS: int | None = None
#: The deviation has stopped falling if this many sweeps lower it by less than one part in a thousand.
STALL_SWEEPS = 10
#: So many sweeps are one Spark job. The result does not depend on it.
SWEEPS_A_JOB = 5
LOG = logging.getLogger(__name__)


@dataclass
class Mix:
    """Factor of every cell (columns source, lang, topic, factor) and the calibrated rate.

    ``margins`` has the target, observed and reached token share of each category (columns margin, category, target,
    observed, reached), ``missed`` the largest difference of reached and target, ``copy_rate`` the rate without a bound of one.
    """

    cells: DataFrame
    rate: float
    off: float = 0.0
    margins: DataFrame | None = None
    missed: float = 0.0
    copy_rate: float = 1.0


def token_count(text: Column) -> Column:
    words = F.split(text, "[\\x20\\t\\n\\x0B\\f\\r]+")
    return F.coalesce(F.array_size(F.array_remove(words, "")), F.lit(0)).cast("long")


def form(text: Column, tokens: Column) -> Column:
    """What a text looks like: empty, note, table, marked, article or long."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    marks = F.regexp_count(text, F.lit("[*#$%&!]"))
    return (F.when(tokens == 0, "empty").when(bars * 4 > tokens, "table").when(marks * 2 > tokens, "marked")
            .when(tokens < 60, "note").when(tokens < 600, "article").otherwise("long"))


def described(documents: DataFrame, topic: Column | None = None) -> DataFrame:
    """The documents as ``__row``, their id, and the tokens and keys of their cell."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), F.col("doc_id"), F.col("text"), F.col("source"), F.col("lang")]
    counted = documents.select(*kept, token_count(F.col("text")).alias("__tokens"), *([] if topic is None else [topic.alias("__named")]))
    keys = {"source": F.col("source"), "lang": F.col("lang"), "topic": form(F.col("text"), F.col("__tokens")) if topic is None else F.col("__named")}
    return counted.select("__row", "doc_id", "__tokens", *[F.coalesce(k.cast("string"), F.lit("(none)")).alias(f"__{n}") for n, k in keys.items()])


def default_targets(cells: DataFrame, temperature: float) -> dict[str, DataFrame]:
    """Per margin the target share of each category."""
    out = {}
    for name in MARGINS:
        mass = settle(cells.groupBy(name).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("part")).where("part > 0"))
        whole = mass.agg(F.sum("part")).first()[0] or 1.0
        out[name] = mass.select(name, (F.col("part") / F.lit(whole)).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6) -> tuple[DataFrame, float]:
    """cells (source, lang, topic, tokens) with the raked share of each; categories without a target get none.

    Sums of a category are windows over the cells, so a sweep adds no join to the plan, and three exchanges only where the
    cells are more than ``BROADCAST_BYTES`` by measure; the cells of some sweeps are written by one job, which also observes what the margins were off before each. With the result comes
    that deviation at the last sweep: above the tolerance, and logged, if targets contradict each other or the sweeps come
    too slowly nearer to them.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    shares = cells.withColumn("share", F.col("tokens") / F.lit(float(total) if total else 1.0))
    if not total:
        return written(shares, "cells"), 0.0
    for name in MARGINS:
        aim = targets[name].select(name, F.col("target").cast("double").alias(f"__{name}"))
        shares = shares.join(aim, name, "left").withColumn(f"__{name}", F.coalesce(f"__{name}", F.lit(0.0)))
    shares = written(shares, "cells")
    few = measured_bytes(shares) <= BROADCAST_BYTES
    # The target of a category without cells can never be met.
    lost = max((targets[name].join(shares.select(name).distinct(), name, "left_anti").agg(F.max(F.abs("target"))).first()[0] or 0.0) for name in MARGINS)
    offs: list[float] = []
    while True:
        # Windows over one partition need no exchange; more cells than the bound are dealt by category.
        shares, some = swept(shares.coalesce(1) if few else shares, min(SWEEPS_A_JOB, (SWEEPS or 10**9) - len(offs)))
        for at, off in enumerate(some):
            offs.append(max(off, lost))
            if offs[-1] <= tolerance or stalled(offs) or len(offs) == SWEEPS:
                break
        else:
            shares = shares.select(*MARGINS, "tokens", F.col(f"share_{at}").alias("share"), *[f"__{n}" for n in MARGINS])
            continue
        break
    if offs[-1] > tolerance:
        LOG.warning("raking stopped after %d sweeps with margins off by %.2g", len(offs), offs[-1])
    return shares.select(*MARGINS, "tokens", F.col(f"share_{at}").alias("share")), offs[-1]


def swept(shares: DataFrame, sweeps: int) -> tuple[DataFrame, list[float]]:
    """The cells with share_i after each of some sweeps (from 0), and what the margins were off before each, at most."""
    out, now = shares, F.col("share")
    for i in range(sweeps):
        out = out.withColumn(f"off_{i}", F.lit(0.0))
        for name in MARGINS:
            target = F.col(f"__{name}")
            out = out.withColumn("__now", now).withColumn("__sum", F.sum("__now").over(W.partitionBy(name)))
            out = out.withColumn(f"off_{i}", F.greatest(f"off_{i}", F.abs(F.col("__sum") - target)))
            out = out.withColumn("__now", F.when(F.col("__sum") > 0, F.col("__now") * target / F.col("__sum")).otherwise(0.0))
            now = F.col("__now")
        out = out.withColumn(f"share_{i}", now)
    seen = Observation()
    out = written(out.drop("share", "__now", "__sum").observe(seen, *[F.max(f"off_{i}").alias(f"off_{i}") for i in range(sweeps)]), "cells")
    return out, [seen.get[f"off_{i}"] or 0.0 for i in range(sweeps)]


def stalled(offs: list[float]) -> bool:
    """Whether the last sweeps hardly lowered the least deviation so far."""
    return len(offs) > STALL_SWEEPS and min(offs[-STALL_SWEEPS:]) > 0.999 * min(offs[:-STALL_SWEEPS])


def calibrated_rate(cells: DataFrame, budget: float) -> float:
    """The rate at which sum(tokens * min(1, rate * factor)) is the budget; cells that reach 1 stay there."""
    rate, filled = 0.0, None
    for _ in range(1000):
        full = F.col("factor") * F.lit(rate) >= 1
        row = cells.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("tokens"),
                        F.sum(F.when(~full, F.col("tokens") * F.col("factor")).otherwise(0.0)).alias("mass")).first()
        if row["n"] == filled or not row["mass"]:
            break
        filled, rate = row["n"], max(rate, (budget - (row["tokens"] or 0)) / row["mass"])
    return rate


def reached_margins(cells: DataFrame, targets: dict[str, DataFrame], rate: float) -> DataFrame:
    """Per category its target, its share of all tokens and its share of those that the draw keeps, in expectation."""
    cells = cells.withColumn("kept", F.col("tokens") * F.least(F.lit(1.0), F.lit(rate) * F.col("factor")))
    whole = cells.agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept")).first()

    def share(name: str) -> Column:
        return F.coalesce(F.col(name) / F.lit(float(whole[name] or 0) or 1.0), F.lit(0.0))

    parts = [cells.groupBy(name).agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept")).join(targets[name], name, "full")
             .select(F.lit(name).alias("margin"), F.col(name).alias("category"), F.coalesce("target", F.lit(0.0)).alias("target"),
                     share("tokens").alias("observed"), share("kept").alias("reached")) for name in MARGINS]
    return settle(parts[0].union(parts[1]).union(parts[2]))


def plan_mix(documents: DataFrame, temperature: float = 0.5, keep: float = 0.5, topic: Column | None = None,
             targets: dict[str, DataFrame] | None = None) -> Mix:
    """Rake the documents' tokens and calibrate the rate to keep the given share of all tokens (in expectation)."""
    cells = (described(documents, topic)
             .groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"))
             .agg(F.sum("__tokens").alias("tokens")))
    return mix_of_cells(settle(cells), temperature, keep, targets)


def mix_of_cells(cells: DataFrame, temperature: float, keep: float, targets: dict[str, DataFrame] | None = None) -> Mix:
    targets = targets or default_targets(cells, temperature)
    raked, off = rake(cells, targets)
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    # The factor is the raked share against the observed one.
    factor = F.when(F.col("tokens") > 0, F.col("share") * F.lit(float(total)) / F.col("tokens")).otherwise(0.0 if total else 1.0)
    cells = settle(raked.select(*MARGINS, "tokens", factor.alias("factor")))
    if not total:
        return Mix(cells.drop("tokens"), 1.0, off)
    rate = calibrated_rate(cells, keep * total)
    margins = reached_margins(cells, targets, rate)
    missed = margins.agg(F.max(F.abs(F.col("reached") - F.col("target")))).first()[0] or 0.0
    mass = cells.agg(F.sum(F.col("tokens") * F.col("factor"))).first()[0]
    return Mix(cells.drop("tokens"), rate, off, margins, missed, keep * total / mass if mass else 0.0)


def report(mix: Mix, most: int = 20) -> None:
    """Log the categories whose share the draw misses most, if it misses any by a thousandth."""
    if mix.margins is None or mix.missed < 0.001:
        return
    miss = F.abs(F.col("reached") - F.col("target"))
    rows = mix.margins.orderBy(miss.desc(), "margin", "category").limit(most).collect()
    LOG.warning("the mixture misses its targets by up to %.3f: %s", mix.missed, "; ".join(
        f"{r['margin']} {r['category']}: target {r['target']:.3f}, observed {r['observed']:.3f}, reached {r['reached']:.3f}" for r in rows))


def sized_broadcast(cells: DataFrame) -> DataFrame:
    """Broadcast the cells if their measured bytes allow; otherwise Spark shuffles and splits hot keys."""
    size = cells.agg(F.sum(F.octet_length("source") + F.octet_length("lang") + F.octet_length("topic") + 64)).first()[0] or 0
    return F.broadcast(cells) if size <= BROADCAST_BYTES else cells


def _draw(described_documents: DataFrame, mix: Mix) -> DataFrame:
    """Adds __factor, __probability, __kept and __copies to described documents."""
    cells = sized_broadcast(mix.cells).toDF("__source", "__lang", "__topic", "__factor")
    id_text = F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = F.conv(F.substring(F.md5(id_text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    return (described_documents.join(cells, ["__source", "__lang", "__topic"])
            .withColumn("__probability", F.least(F.lit(1.0), F.lit(mix.rate) * F.col("__factor")))
            .withColumn("__kept", uniform < F.col("__probability"))
            .withColumn("__copies", F.ceil(F.lit(mix.copy_rate) * F.col("__factor") - uniform).cast("long")))


def weights(documents: DataFrame, mix: Mix | None = None, topic: Column | None = None, **settings: float) -> DataFrame:
    """Per document: its cell, tokens, weight of a token, probability, whether it is kept, and how often if it may repeat."""
    narrow = settle(described(documents.select("doc_id", "text", "lang", "source"), topic)
                    .select("doc_id", "__tokens", "__source", "__lang", "__topic"))
    if mix is None:
        cells = (narrow.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"))
                 .agg(F.sum("__tokens").alias("tokens")))
        mix = mix_of_cells(settle(cells), settings.get("temperature", 0.5), settings.get("keep", 0.5))
    return _draw(narrow, mix).select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"), F.col("__factor").alias("token_weight"),
        F.col("__probability").alias("probability"), F.col("__kept").alias("kept"),
        F.col("__copies").alias("copies"), F.lit(mix.off).alias("margin_off"), F.lit(mix.missed).alias("margin_missed"))


def sample(documents: DataFrame, mix: Mix, topic: Column | None = None, repeat: bool = False) -> DataFrame:
    """The documents that the draw keeps, with their own columns; with ``repeat`` each as often as it has copies."""
    drawn = _draw(described(documents, topic), mix)
    if repeat:
        drawn = drawn.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
        return drawn.select("__row.*")
    return drawn.where("__kept").select("__row.*")
