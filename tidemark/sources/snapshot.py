"""A provider's payload as a run: every dataset appended at one instant, and a heartbeat row for each, whatever happened."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame

from tidemark.operators.quality import heartbeat_rows
from tidemark.operators.timetravel import naive_literal
from tidemark.sources.catalog import CATALOG
from tidemark.sources.store import ObservationStore, WriteResult

HEARTBEAT = "heartbeat"
_OUTCOMES = "target_dataset string, outcome string, payload_hash string, n_rows long, error string"


def snapshot(
    store: ObservationStore, job: str, fetch: Callable[[], Mapping[str, DataFrame]], targets: tuple[str, ...],
    *, at: datetime, source: str, **stamp,
) -> dict[str, WriteResult]:
    """Fetch, check and append ``targets`` at one instant; the heartbeat is written even where a step fails.

    A failed fetch fails every target, a failed write its own target and those after it; the error is raised again once
    the heartbeat is stored. A target that the payload lacks has failed too, but stops nothing.
    """
    results: dict[str, WriteResult] = {}
    problem: Exception | None = None
    try:
        frames = fetch()
        for name in targets:
            if name in frames:
                if name in CATALOG:
                    CATALOG[name].validate(frames[name])
                results |= store.write_all({name: frames[name]}, valid_at=at, observed_at=at, source=source, **stamp)
    except Exception as error:  # noqa: BLE001 - recorded, then raised again
        problem = error
    outcomes = [_outcome(name, results.get(name), problem) for name in targets]
    rows = store.spark.createDataFrame(outcomes, _OUTCOMES)
    store.write(HEARTBEAT, heartbeat_rows(rows, job, naive_literal(at)), valid_at=at, observed_at=at, source=job, skip_if_unchanged=False)
    if problem is not None:
        raise problem
    return results


def _outcome(name: str, result: WriteResult | None, problem: Exception | None) -> tuple:
    if result is not None:
        return name, "written" if result.written else "skipped_unchanged", result.content_hash, result.n_rows, None
    reason = "the payload holds no such dataset" if problem is None else f"{type(problem).__name__}: {problem}"
    return name, "failed", None, None, reason
