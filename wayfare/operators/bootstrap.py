"""Bootstrap intervals of a metric's difference between two models, with all replicates' weights made in the task.

A row's weights are Poisson draws from its own hash and the replicate's number, so they need not be stored or moved: N rows go
through the plan, not N times the replicates. For AUC rows are dealt to ranges of the score and sorted there; a task
walks over its range with one number for each replicate and passes on the range's positives, negatives and area, and
prefix sums of negatives over the ranges join them. For Brier each task passes on its sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.sources.tables import written

#: Weights made at once.
_ENTRIES = 1 << 20
#: Rows that count for more copies than this get the normal limit of their Poisson weight.
_NORMAL = 30


def _uniform(keys: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) for each key and step: the mixing function of a 64-bit counter generator."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + steps.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def poisson_weights(keys: np.ndarray, copies: np.ndarray, replicates: int) -> np.ndarray:
    """(rows x replicates): what `copies` equal rows weigh together in each replicate, a Poisson(copies) draw."""
    u = _uniform(keys, np.arange(1, replicates + 1))
    out = np.empty(u.shape)
    for n in np.unique(np.minimum(copies, _NORMAL + 1)):
        if n <= _NORMAL:
            at, terms = copies == n, int(n + 10 * math.sqrt(n) + 12)
            steps = np.cumsum([math.exp(-n + k * math.log(n) - math.lgamma(k + 1)) for k in range(terms)])
            out[at] = np.searchsorted(steps, u[at])
        else:
            at = copies > _NORMAL
            second = _uniform(keys[at], np.arange(replicates + 1, 2 * replicates + 1))
            normal = np.sqrt(-2 * np.log(u[at])) * np.cos(2 * np.pi * second)
            out[at] = np.maximum(0, np.round(copies[at, None] + np.sqrt(copies[at, None]) * normal))
    return out


def _parts(batches, columns: tuple[str, ...], replicates: int):
    """(columns, weights) of consecutive rows, so many that their weights are bounded."""
    size = max(1, _ENTRIES // replicates)
    for batch in batches:
        arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_n", *columns)]
        for a in range(0, batch.num_rows, size):
            key, n, *rest = (x[a : a + size] for x in arrays)
            yield *rest, poisson_weights(key.view(np.uint64), n, replicates)


class _Area:
    """Positives, negatives and area under the curve of scores met in ascending order, a number for each replicate."""

    def __init__(self, replicates: int):
        self.pos, self.neg, self.area = np.zeros((3, replicates))
        self.tied, self.tied_pos, self.tied_neg = None, np.zeros(replicates), np.zeros(replicates)

    def add(self, p: np.ndarray, label: np.ndarray, w: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        pos, neg = (np.add.reduceat(w * (label == v)[:, None], first, axis=0) for v in (1, 0))
        if self.tied is not None and self.tied == p[0]:
            pos[0] += self.tied_pos
            neg[0] += self.tied_neg
        else:
            self.close()
        below = self.neg + np.cumsum(neg[:-1], axis=0) - neg[:-1]
        self.area += (pos[:-1] * (below + neg[:-1] / 2)).sum(axis=0)
        self.pos, self.neg = self.pos + pos[:-1].sum(axis=0), self.neg + neg[:-1].sum(axis=0)
        self.tied, self.tied_pos, self.tied_neg = p[-1], pos[-1], neg[-1]

    def close(self) -> None:
        """Counts the last score, whose rows have all been met."""
        self.area += self.tied_pos * (self.neg + self.tied_neg / 2)
        self.pos, self.neg = self.pos + self.tied_pos, self.neg + self.tied_neg
        self.tied_pos, self.tied_neg = np.zeros((2, len(self.area)))


def _row(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in columns.values()], names=list(columns))


def _aucs(merged: DataFrame, p: str, replicates: int) -> DataFrame:
    """(replicate, auc)."""

    def walk(batches):
        area = _Area(replicates)
        for scores, label, w in _parts(batches, (p, "label"), replicates):
            area.add(scores, label, w)
        area.close()
        yield _row(part=TaskContext.get().partitionId(), pos=area.pos, neg=area.neg, area=area.area)

    parts = merged.repartitionByRange(p).sortWithinPartitions(p).mapInArrow(walk, "part long, pos array<double>, neg array<double>, area array<double>")
    each = parts.select("part", F.posexplode(F.arrays_zip("pos", "neg", "area")).alias("replicate", "x")).select("part", "replicate", "x.*")
    # a row for each range and replicate, however many rows were scored
    before = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    area = F.sum(F.col("area") + F.col("pos") * F.col("before"))
    return each.groupBy("replicate").agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def _briers(merged: DataFrame, columns: tuple[str, str], replicates: int) -> DataFrame:
    """(replicate, difference of the first and the second model's Brier score)."""

    def add(batches):
        total, loss = np.zeros(replicates), np.zeros(replicates)
        for label, x, y, w in _parts(batches, ("label", *columns), replicates):
            total += w.sum(axis=0)
            loss += ((x - label) ** 2 - (y - label) ** 2) @ w
        yield _row(total=total, loss=loss)

    sums = merged.mapInArrow(add, "total array<double>, loss array<double>").select(F.posexplode(F.arrays_zip("total", "loss")).alias("replicate", "x"))
    return sums.groupBy("replicate").agg(F.try_divide(F.sum("x.loss"), F.sum("x.total")).alias("d"))


def bootstrap_difference(scored: DataFrame, metric: str = "roc_auc", replicates: int = 400, seed: int = 42, a: str = "p_a", b: str = "p_b") -> DataFrame:
    """Mean and 95 % interval of metric(b) - metric(a) over Poisson replicates; for Brier the sign is turned, so up is better.

    Equal rows are merged first, as their hash is one; rows without a label or a score take no part. Replicates with one class
    have no AUC and are left out.
    """
    rows = scored.select(F.col("label").cast("int").alias("label"), F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)).na.drop()
    merged = rows.groupBy("label", a, b).agg(F.count("*").alias("_n")).withColumn("_key", F.xxhash64(F.lit(seed), "label", a, b))
    if metric == "brier":
        each = _briers(merged, (a, b), replicates)
    else:
        merged = written(merged)  # sampled for the ranges and read for each model
        one, two = (_aucs(merged, p, replicates).withColumnRenamed("auc", f"_{i}") for i, p in enumerate((a, b)))
        each = one.join(two, "replicate").select("replicate", (F.col("_1") - F.col("_0")).alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))  # of one number a replicate
    return each.agg(F.avg("d").alias("mean_difference"), q.alias("q"), F.count("d").alias("replicates")).select(
        F.lit(metric).alias("metric"), "mean_difference", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "replicates"
    )
