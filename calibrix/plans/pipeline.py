"""User-level pipeline: one lazy plan per output, all batches at once.

    p = BatchPipeline(runs_df, batches_df)
    p.results()          # final result rows for every batch, per its method
    p.comparison()       # uncorrected / vendor / corrected, per sample

Nothing is collected; each property is a DataFrame the caller writes.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from calibrix.operators import compare, plots, quantify, results
from calibrix.operators.calibration import batch_fits, batch_lines, samples
from calibrix.session import split_hot_batches


class BatchPipeline:
    """``split`` says how calibrators form the two sets: by accuracy (outside or
    inside the window) or by known concentration (up to ``threshold`` or above).
    Fits, routing threshold and corrected results follow it."""

    def __init__(self, runs: DataFrame, batches: DataFrame, split: str = "accuracy",
                 threshold: float = 1.0):
        if split not in ("accuracy", "concentration"):
            raise ValueError(f"split must be 'accuracy' or 'concentration', not {split!r}")
        self.runs = runs
        self.batches = batches
        self.split_at = threshold if split == "concentration" else None
        split_hot_batches(runs.sparkSession)

    @cached_property
    def _fits(self) -> tuple[DataFrame, DataFrame]:
        return batch_fits(self.runs, self.batches, self.split_at)

    @property
    def scored_calibrators(self) -> DataFrame:
        return self._fits[0]

    @property
    def summary(self) -> DataFrame:
        return self._fits[1]

    @cached_property
    def samples(self) -> DataFrame:
        return quantify.quantify_samples(samples(self.runs), self.summary)

    def comparison(self, sort: bool = True) -> DataFrame:
        return compare.comparison(self.samples, sort=sort)

    def comparison_nocorr(self) -> DataFrame:
        return compare.comparison_nocorr(self.samples)

    @cached_property
    def finalized(self) -> DataFrame:
        return results.finalize(self.samples)

    def batch_means(self) -> DataFrame:
        return quantify.batch_means(self.samples)

    @cached_property
    def ordered_samples(self) -> DataFrame:
        """Samples by position with uncorrected results, written once for the
        order plots (``plots.recovery_by_order``, ``plots.conc_by_order``)."""
        return plots.ordered_samples(self.runs, batch_lines(self.runs, self.batches))
