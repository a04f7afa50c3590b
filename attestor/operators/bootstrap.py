"""Paired percentile bootstrap of a mean difference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from attestor.functions.shipping import ship

SAMPLES, SEED = 10_000, 20261013
#: Draws that are held at once.
HELD = 1 << 22


def interval(values: np.ndarray, samples: int, seed: int) -> tuple[float, float]:
    """2.5% and 97.5% quantiles (linear) of resampled means; values in the order of their cases."""
    rng, n = np.random.default_rng(seed), len(values)
    step = max(1, HELD // n)
    means = np.concatenate([values[rng.integers(0, n, (min(step, samples - k), n))].mean(1) for k in range(0, samples, step)])
    low, high = np.quantile(means, [0.025, 0.975])
    return float(low), float(high)


def _group(key: str, samples: int, seed: int, pdf: pd.DataFrame) -> pd.DataFrame:
    values = pdf.sort_values("case_id")["delta"].to_numpy()
    low, high = interval(values, samples, seed)
    return pd.DataFrame({key: [pdf[key].iloc[0]], "cases": [len(values)], "mean": [values.mean()], "low": [low], "high": [high]})


def paired_bootstrap(deltas: DataFrame, key: str, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """One row per key from (key, case_id, delta): cases, mean, low, high.  A key holds one study's cases."""
    ship(deltas.sparkSession)
    return deltas.filter("delta is not null").groupBy(key).applyInPandas(lambda pdf: _group(key, samples, seed, pdf), f"{key} string, cases long, mean double, low double, high double")
