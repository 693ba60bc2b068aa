"""Scoring rules, calibration metrics and gate verdicts over tables of predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.maths import array_sum, clip, let
from tidemark.operators.ordered import exact_percentiles
from tidemark.session import SMALL_BYTES, TidemarkError, measured_bytes, settle, small, written

# Clipping of probabilities and logits, the ridge of the slope fit, the normal quantile.
LOG_EPS = 1e-12
LOGIT_CLIP = 1e-6
SLOPE_RIDGE = 1e-8
Z_975 = 1.959963985


# -- scoring rules -----------------------------------------------------------------------------------

def log_loss(y: Column, p: Column) -> Column:
    q = clip(p, LOG_EPS, 1 - LOG_EPS)
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def brier(y: Column, p: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def _mean(loss: Column, weight: Column | None) -> Column:
    """Mean of a row's loss; a weight says for how many rows it stands. A NULL loss takes no part."""
    return F.avg(loss) if weight is None else F.try_divide(F.sum(loss * weight), F.sum(F.when(loss.isNotNull(), weight)))


def multiclass_log_loss(y: Column, probs: Column, weight: Column | None = None) -> Column:
    return _mean(-F.ln(clip(F.get(probs, y), LOG_EPS, 1 - LOG_EPS)), weight)


def multiclass_brier(y: Column, probs: Column, weight: Column | None = None) -> Column:
    return _mean(let(probs, lambda v: array_sum(
        F.transform(v, lambda p, k: F.pow(p - F.when(k == y, 1.0).otherwise(0.0), 2))
    )), weight)


def ranked_probability_score(y: Column, probs: Column) -> Column:
    """Mean squared distance of the running sums of ordered classes, divided by K - 1."""

    def row(v: Column) -> Column:
        n = F.size(v)
        inner = F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda k: F.pow(array_sum(F.slice(v, F.lit(1), k)) - F.when(y < k, 1.0).otherwise(0.0), 2),
        )
        broken = F.raise_error(F.lit("probabilities need two classes and a sum of 1")).cast("double")
        return F.when((n < 2) | (F.abs(array_sum(v) - 1) > 1e-6), broken).otherwise(array_sum(inner) / (n - 1))

    return F.avg(let(probs, row))


def scores(df: DataFrame, key: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    label, prob = F.col(y), F.col(p)
    return df.groupBy(*key).agg(
        F.count("*").alias("n"), log_loss(label, prob).alias("log_loss"), brier(label, prob).alias("brier")
    )


# -- reliability -------------------------------------------------------------------------------------

def width_bin(p: Column, n_bins: int) -> Column:
    """Index of the half-open bin [i/B, (i+1)/B), corrected against the edges themselves; 1 goes in the last."""
    guess = F.floor(p * n_bins)
    low = F.when(p < guess / n_bins, guess - 1).when(p >= (guess + 1) / n_bins, guess + 1).otherwise(guess)
    return F.least(F.greatest(low, F.lit(0)), F.lit(n_bins - 1)).cast("int")


def quantile_edges(df: DataFrame, n_bins: int, p: str = "p") -> list[float]:
    probs = [i / n_bins for i in range(n_bins + 1)]
    row = exact_percentiles(df.select(F.col(p).cast("double").alias(p)), [], p, probs, [f"e{i}" for i in range(n_bins + 1)]).first()
    edges = sorted(set(row))
    edges[0], edges[-1] = 0.0, 1.0
    return edges if len(edges) > 1 else [0.0, 1.0]


def group_quantile_edges(df: DataFrame, key: Sequence[str], n_bins: int, p: str = "p") -> DataFrame:
    """Per group the distinct exact quantiles as an ascending array ``edges`` from 0 to 1.

    The percentiles come from ordered passes over slices, so that a group with most of the rows stays split.
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    names = [f"_e{i}" for i in range(n_bins + 1)]
    found = exact_percentiles(df.select(*key, F.col(p).cast("double").alias(p)), list(key), p, probs, names)
    inner = F.array_sort(F.array_distinct(F.array(*names)))
    inner = F.when(F.size(inner) > 2, F.slice(inner, F.lit(2), F.size(inner) - 2)).otherwise(F.array().cast("array<double>"))
    return found.select(*key, F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0))).alias("edges"))


def edge_bin(p: Column, edges: Column, n_bins: int) -> Column:
    """How many inner edges are at or below the value; ``edges`` holds at most n_bins + 1 of them."""
    found = F.lit(0)
    for i in range(1, n_bins):
        inner = F.lit(i) < F.size(edges) - 1
        found = found + (inner & (p >= F.get(edges, F.lit(i)))).cast("int")
    return found


def reliability(df: DataFrame, n_bins: int = 10, binning: str = "width", key: Sequence[str] = (),
                y: str = "y", p: str = "p") -> DataFrame:
    """Non-empty bins with their edges, size, mean prediction and observed rate."""
    prob, key = F.col(p), list(key)
    sums = [F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed_rate")]
    if binning == "width":
        cuts = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
        bins = df.withColumn("bin", width_bin(prob, n_bins)).groupBy(*key, "bin").agg(*sums).withColumn("edges", cuts)
    elif binning == "quantile" and not key:
        cuts = F.array(*[F.lit(float(e)) for e in quantile_edges(df, n_bins, p)])
        bins = df.withColumn("bin", edge_bin(prob, cuts, n_bins)).groupBy("bin").agg(*sums).withColumn("edges", cuts)
    elif binning == "quantile":
        edges = small(group_quantile_edges(df, key, n_bins, p))
        same = [F.col(k).eqNullSafe(F.col(f"_edge_{k}")) for k in key]
        placed = df.join(edges.select(*[F.col(k).alias(f"_edge_{k}") for k in key], "edges"), same)
        bins = placed.withColumn("bin", edge_bin(prob, F.col("edges"), n_bins)).groupBy(*key, "bin").agg(*sums, F.first("edges").alias("edges"))
    else:
        raise TidemarkError(f"binning must be 'width' or 'quantile', got {binning!r}")
    return bins.withColumn("bin_lo", F.get("edges", F.col("bin"))).withColumn("bin_hi", F.get("edges", F.col("bin") + 1)).drop("edges")


def calibration_error(bins: DataFrame, key: Sequence[str] = (), out: str = "ece") -> DataFrame:
    gap = F.abs(F.col("mean_predicted") - F.col("observed_rate"))
    return bins.groupBy(*key).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias(out))


# -- calibration slope -------------------------------------------------------------------------------

#: So many Newton steps are one Spark job. The result does not depend on it.
STEPS_A_JOB = 4


def calibration_slope(df: DataFrame, group: str | None = None, y: str = "y", p: str = "p",
                      max_steps: int = 50) -> DataFrame:
    """Logistic regression of the outcome on the predicted log-odds, one row per group, for any number of groups.

    Equal predictions are counted once. The state (two coefficients and their Hessian per group) is a table that every
    Newton step joins and replaces; its 2x2 systems are solved as columns. Only the number of unfinished groups reaches the
    driver. ``converged`` is false where the last step still moved, as it does in groups that a threshold separates.
    """
    q = clip(F.col(p).cast("double"), LOGIT_CLIP, 1 - LOGIT_CLIP)
    name = F.col(group) if group else F.lit(0)
    counted = written(df.groupBy(name.alias("_g"), F.ln(q / (1 - q)).alias("_x")).agg(
        F.count("*").alias("_n"), F.sum(F.col(y).cast("double")).alias("_y")), "cells")
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    state = small(counted.select("_g").distinct().select("_g", zero.alias("a"), zero.alias("b"), none.alias("w0"), none.alias("w1"), none.alias("w2"),
                                                         F.lit(False).alias("converged")))
    few = measured_bytes(state) <= SMALL_BYTES
    if state.isEmpty():
        raise TidemarkError("the slope needs at least one row")
    for _ in range(-(-max_steps // STEPS_A_JOB)):
        for _ in range(STEPS_A_JOB):
            state = _slope_step(counted, F.broadcast(state) if few else state)
        state = written(state, "slopes")
        if state.filter(~F.col("converged")).isEmpty():
            break
    se = F.sqrt(F.greatest(F.col("w0") / (F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")), F.lit(0.0)))
    out = state.select(F.col("_g").alias(group or "_g"), F.col("b").alias("slope"), F.col("a").alias("intercept"), se.alias("slope_se"), "converged")
    return out if group else out.drop("_g")


def _slope_step(counted: DataFrame, state: DataFrame) -> DataFrame:
    """The state after one Newton step; groups that have converged stay as they are."""
    held = state.select(F.col("_g").alias("_of"), "a", "b", *[F.col(c).alias(f"_{c}") for c in ("w0", "w1", "w2")], "converged")
    rows = counted.join(held, F.col("_g").eqNullSafe(F.col("_of"))).withColumn("_pi", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("_x")))))
    x, w = F.col("_x"), F.col("_n") * F.greatest(F.col("_pi") * (1 - F.col("_pi")), F.lit(1e-10))
    r = F.col("_y") - F.col("_n") * F.col("_pi")
    kept = ["a", "b", "_w0", "_w1", "_w2", "converged"]
    sums = rows.groupBy("_g").agg(
        F.sum(r).alias("r0"), F.sum(r * x).alias("r1"), (F.sum(w) + SLOPE_RIDGE).alias("w0"), F.sum(w * x).alias("w1"),
        (F.sum(w * x * x) + SLOPE_RIDGE).alias("w2"), *[F.first(c).alias(c) for c in kept])
    det = F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
    sums = sums.withColumn("da", (F.col("r0") * F.col("w2") - F.col("r1") * F.col("w1")) / det).withColumn(
        "db", (F.col("r1") * F.col("w0") - F.col("r0") * F.col("w1")) / det)
    done = F.col("converged")
    return sums.select(
        "_g", F.when(done, F.col("a")).otherwise(F.col("a") + F.col("da")).alias("a"), F.when(done, F.col("b")).otherwise(F.col("b") + F.col("db")).alias("b"),
        *[F.when(done, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("w0", "w1", "w2")],
        (done | (F.greatest(F.abs("da"), F.abs("db")) < 1e-10)).alias("converged"))


def slope_usability(slopes: DataFrame, z: float = Z_975) -> DataFrame:
    """A slope is usable when its interval excludes 0; it departs when the interval excludes 1."""
    lo, hi = F.col("slope") - z * F.col("slope_se"), F.col("slope") + z * F.col("slope_se")
    return slopes.withColumn("ci_lo", lo).withColumn("ci_hi", hi).withColumn(
        "slope_usable", ~F.lit(0.0).between(F.col("ci_lo"), F.col("ci_hi"))
    ).withColumn("departs_from_one", ~F.lit(1.0).between(F.col("ci_lo"), F.col("ci_hi")))


def one_vs_rest(df: DataFrame, y: str = "y", probs: str = "probs") -> DataFrame:
    """One binary series per class."""
    return df.select(
        *[c for c in df.columns if c not in (y, probs)], F.col(y).alias("_y"), F.posexplode(probs).alias("outcome", "p")
    ).withColumn("y", (F.col("_y") == F.col("outcome")).cast("int")).drop("_y")


def evaluate(df: DataFrame, group: str, n_bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """The whole report per group: scoring rules, calibration error, slope with its interval."""
    return _report(df, group, [calibration_error(reliability(df, n_bins, key=[group], y=y, p=p), [group])], y, p)


def _report(df: DataFrame, group: str, errors: Sequence[DataFrame], y: str, p: str) -> DataFrame:
    report = scores(df, [group], y, p)
    for part in [*errors, small(slope_usability(calibration_slope(df, group, y, p)))]:
        other = part.withColumnRenamed(group, "_group")
        report = report.join(other, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    return report


def reliability_tables(df: DataFrame, key: Sequence[str] = (), n_bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Both reliability tables, told apart by the column ``binning``."""
    both = [reliability(df, n_bins, b, key, y, p).withColumn("binning", F.lit(b)) for b in ("width", "quantile")]
    return both[0].unionByName(both[1])


def evaluate_classes(df: DataFrame, n_bins: int = 10, y: str = "y", probs: str = "probs") -> tuple[DataFrame, DataFrame]:
    """Every class against the rest: the report with both calibration errors, and both reliability tables."""
    rest = written(one_vs_rest(df, y, probs), "classes")  # read by every part of the report
    bins = settle(reliability_tables(rest, ["outcome"], n_bins))
    errors = [calibration_error(bins.filter(F.col("binning") == b), ["outcome"], out) for b, out in (("width", "ece"), ("quantile", "ece_quantile"))]
    return _report(rest, "outcome", errors, "y", "p"), bins


def evaluate_binary(df: DataFrame, n_bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """One row with both binnings' calibration errors and the slope; the parts are single numbers."""
    parts = {
        "ece": calibration_error(reliability(df, n_bins, y=y, p=p)).first()[0],
        "ece_quantile": calibration_error(reliability(df, n_bins, "quantile", y=y, p=p)).first()[0],
        **slope_usability(calibration_slope(df, y=y, p=p)).first().asDict(),
    }
    return scores(df, (), y, p).select("*", *[F.lit(v).alias(k) for k, v in parts.items()])


# -- comparisons and verdicts ------------------------------------------------------------------------

def compare_models(predictions: DataFrame, model: str, baselines: Mapping[str, str], y: str = "y",
                   key: Sequence[str] = ()) -> DataFrame:
    """Log loss and Brier of a model and its baselines in one pass, and whether it is below all of them."""
    label = F.col(y)
    named = {"model": model, **baselines}
    sums = [F.count("*").alias("n")]
    for name, column in named.items():
        sums += [log_loss(label, F.col(column)).alias(f"{name}_log_loss"), brier(label, F.col(column)).alias(f"{name}_brier")]
    beats = F.lit(True)
    for name in baselines:
        for metric in ("log_loss", "brier"):
            beats = beats & (F.col(f"model_{metric}") < F.col(f"{name}_{metric}"))
    return predictions.groupBy(*key).agg(*sums).withColumn("beats_baselines", beats)


def not_worse(predictions: DataFrame, raw: str, calibrated: str, y: str = "y", key: Sequence[str] = (),
              tolerance: float = 1e-9) -> DataFrame:
    """Is the calibrated prediction no worse than the raw one on both scoring rules?"""
    compared = compare_models(predictions, calibrated, {"raw": raw}, y, key)
    ok = (F.col("model_log_loss") <= F.col("raw_log_loss") + tolerance) & (F.col("model_brier") <= F.col("raw_brier") + tolerance)
    return compared.drop("beats_baselines").withColumn("not_worse", ok)


def feature_value(with_feature: DataFrame, without_feature: DataFrame, key: str, y: str = "y", p: str = "p") -> DataFrame:
    """Change of both scoring rules from adding a feature; both tables must hold the same rows."""
    both = with_feature.select(key, y, F.col(p).alias("_with")).join(
        without_feature.select(key, F.col(p).alias("_without")), key, "full"
    )
    sums = compare_models(both, "_with", {"without": "_without"}, y)
    unmatched = both.agg(F.count_if(F.col("_with").isNull() | F.col("_without").isNull())).first()[0]
    if unmatched:
        raise TidemarkError(f"{unmatched} rows are in only one of the two tables")
    return sums.select(
        "n", (F.col("model_log_loss") - F.col("without_log_loss")).alias("delta_log_loss"),
        (F.col("model_brier") - F.col("without_brier")).alias("delta_brier"),
    )


def verdicts(df: DataFrame, decision: str = "decision_text") -> DataFrame:
    """PASS, PASS-with-accepted-departure, BASE-RATE-ONLY or FAIL, in the fixed order of the gate."""
    departs = F.col("departs_from_one") & F.col("slope_usable")
    silent = departs & (F.trim(F.coalesce(F.col(decision), F.lit(""))) == "")
    return df.withColumn(
        "verdict",
        F.when(silent, F.raise_error(F.lit("a slope away from 1 needs a stated decision")).cast("string"))
        .when(~F.col("slope_usable"), "BASE-RATE-ONLY")
        .when(~F.col("beats_baselines"), "FAIL")
        .when(F.col("departs_from_one") & ~F.col("calibrator_built"), "PASS-with-accepted-departure")
        .otherwise("PASS"),
    )


# -- baselines ---------------------------------------------------------------------------------------

def group_rates(train: DataFrame, group: str, condition: Column) -> DataFrame:
    """Share of an outcome per group with the overall share beside it."""
    return train.groupBy(group).agg(F.avg(condition.cast("double")).alias("rate"))


def class_shares(train: DataFrame, key: Sequence[str], outcome: str, classes: Sequence[int]) -> DataFrame:
    shares = F.array(*[F.avg((F.col(outcome) == k).cast("double")) for k in classes])
    return train.groupBy(*key).agg(shares.alias("shares"))


def trailing_class_baseline(rates: Sequence[Column], fallback: Column) -> Column:
    """Trailing class rates, missing ones from the group, rescaled to one; all-zero rates give the group's."""
    filled = F.array(*[F.coalesce(r, F.get(fallback, F.lit(k))) for k, r in enumerate(rates)])
    return let(filled, lambda v: let(array_sum(v), lambda total: F.when(
        total > 0, F.transform(v, lambda x: x / total)
    ).otherwise(fallback)))
