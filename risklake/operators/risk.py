"""Loss simulation and forecasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklake.functions.scalars import clamp, half_up, option_value

#: Cost model; parameters with these defaults.
HOURLY_RATE = 85
COST_PER_RECORD = 164
RATE, VOLATILITY, YEARS = 0.05, 0.4, 0.25


PERCENTILES = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
#: A mixing function for counters: odd step, and shifts and odd factors of its rounds.
STEP = 0x9E3779B97F4A7C15
ROUNDS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
WORD = (1 << 64) - 1


def draws(scan_id: int, paths: np.ndarray, kind: int) -> np.ndarray:
    """Numbers in [0, 1) for a scan's paths (unsigned numbers) that depend on scan, path and kind alone: mixed counters."""
    x = paths * np.uint64(STEP) + np.uint64((scan_id * 3 + kind + 1) * 0xD6E8FEB86659FD93 & WORD)
    for shift, factor in ROUNDS:
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return (x >> np.uint64(11)) * 2.0**-53


def order_statistics(scan_id: int, p: float, paths: int, users: int) -> list[float]:
    """The simulated losses at PERCENTILES. Only paths with a loss are drawn out; the others are zeros in front of them."""
    every = np.arange(paths, dtype=np.uint64)
    hit = every[draws(scan_id, every, 1) < p]
    losses = users * (0.8 + draws(scan_id, hit, 0) * 2.2) * COST_PER_RECORD * np.exp(draws(scan_id, hit, 2) * 2)
    ranks = [int(paths * q) - (paths - len(hit)) for _, q in PERCENTILES]
    wanted = sorted({r for r in ranks if r >= 0})
    losses = np.partition(losses, wanted) if wanted else losses
    return [float(losses[r]) if r >= 0 else 0.0 for r in ranks]


def loss_simulation(counts: DataFrame, paths: int = 10_000, users: int = 1000) -> DataFrame:
    """counts(scan_id, critical, high, total): percentiles of simulated losses. A scan's paths are arrays in the task that has its
    row, so nothing is exploded or shuffled and a task holds one scan's paths; the draws depend on scan and path, so reruns agree."""

    def simulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, chances = batch.column("scan_id").to_pylist(), batch.column("_p").to_pylist()
            found = np.array([order_statistics(i, p, paths, users) for i, p in zip(ids, chances, strict=True)]).reshape(-1, len(PERCENTILES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found.T)], names=[*batch.schema.names, *(f"_{n}" for n, _ in PERCENTILES)])

    p = F.least(F.lit(0.99), 0.15 * F.col("critical") + 0.05 * F.col("high"))
    light = counts.select("scan_id", "critical", "high", "total", p.cast("double").alias("_p"))
    # Few bytes but much work a row: a fixed number of partitions, which adaptive execution does not join to one.
    light = light.repartition(4 * counts.sparkSession.sparkContext.defaultParallelism, "scan_id")
    ran = light.mapInArrow(simulate, T.StructType([*light.schema.fields, *(T.StructField(f"_{n}", T.DoubleType()) for n, _ in PERCENTILES)]))
    cost = (12 * F.col("critical") + 6 * F.col("high") + F.col("total")) * HOURLY_RATE
    expected = users * COST_PER_RECORD * F.col("_p")
    p95 = F.col("_p95")
    rating = F.when(p95 > 100_000, F.when(F.col("critical") > 5, "D").otherwise("CCC")).when(p95 > 25_000, "B").when(p95 > 5000, "BBB").when(p95 > 1000, "A").when(p95 > 100, "AA").otherwise("AAA")
    return ran.select(
        "scan_id",
        *[half_up(F.col(f"_{name}")).alias(name) for name, _ in PERCENTILES],
        half_up(expected).alias("expected_loss"),
        half_up(option_value(cost.cast("double"), expected, YEARS, RATE, VOLATILITY)).alias("option_value"),
        F.when((F.col("critical") == 0) & ~rating.isin("AAA", "AA", "A"), "A").otherwise(rating).alias("rating"),
    )


def forecasts(scores: DataFrame) -> DataFrame:
    """scores(scan_id, score, critical, high, medium): one row per forecast with its colour."""
    c, h, m, s = F.col("critical"), F.col("high"), F.col("medium"), F.col("score")
    rows = [
        ("release_confidence", clamp(s - c * 8 - h * 3, 5, 98), (70, 45), True),
        ("outage_probability", clamp(c * 22 + h * 10 + m * 3, 5, 95), (60, 30), False),
        ("churn_risk", clamp(c * 12 + h * 6 + m * 2, 3, 85), (30, 15), False),
        ("user_frustration", clamp(100 - s + c * 5, 0, 100), (60, 35), False),
        ("customer_trust", clamp(s - c * 15 - h * 5, 5, 98), (70, 45), True),
        ("rollback_probability", clamp(c * 20 + h * 8, 2, 90), (60, 30), False),
    ]
    colour = lambda v, at, good: F.when(v >= at[0], "green" if good else "red").when(v >= at[1], "amber").otherwise("red" if good else "green")
    every = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("long").alias("value"), colour(v, at, good).alias("colour")) for n, v, at, good in rows])
    return scores.select("scan_id", F.explode(every).alias("x")).select("scan_id", "x.*")
