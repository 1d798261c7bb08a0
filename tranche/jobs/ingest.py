"""From loan files to the model-ready matrix with its accounting."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tranche.operators import features, labels
from tranche.sources.loan_files import parsed
from tranche.sources.schemas import ACQUISITION, PERFORMANCE


@dataclass
class Dataset:
    matrix: DataFrame
    stats: DataFrame
    missing: DataFrame


def build(
    acquisition_lines: DataFrame, performance_lines: DataFrame, horizon: int = labels.HORIZON, target: str = "d90", strict: bool = False,
    own: list[features.Feature] | None = None, benchmark: Mapping[int, float] = features.BENCHMARK, keep: tuple[str, ...] = ("state",),
) -> Dataset:
    """own: features in place of the usual ones. benchmark: yearly rates that the usual rate_spread is taken from. keep:
    acquisition fields that the matrix carries along for grouping."""
    chosen = own or features.spec(benchmark)
    acquisitions = parsed(acquisition_lines, ACQUISITION, strict)
    months = parsed(performance_lines, PERFORMANCE, strict)
    every = features.joined(acquisitions, labels.label_loans(months, horizon), chosen, target, keep)
    return Dataset(features.matrix(features.feature_rows(every), chosen, keep), features.accounting(every), features.missing_by_field(every))
