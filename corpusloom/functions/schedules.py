"""Training schedules as Column expressions over an epoch or step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _phase(epoch: Column, first: int, last: int, a: float, b: float) -> Column:
    p = (epoch - first) / float(last - first)
    return a * (1 - p) + b * p


def weights(epoch: Column, planned: int = 375) -> dict[str, Column]:
    """Curriculum ratio and the weights of the contrastive, cross-entropy, destination and distillation losses."""
    a, b = int(0.3 * planned), int(0.7 * planned)
    when = lambda first, mid, last, *rest: F.when(epoch <= a, first).when(epoch <= b, mid).when(epoch < planned, last)
    return {
        "curriculum": when(_phase(epoch, 0, a, 1.0, 0.7), _phase(epoch, a, b, 0.7, 0.3), _phase(epoch, b, planned, 0.3, 0.0)).otherwise(0.0),
        "contrastive": when(F.lit(10.0), _phase(epoch, a, b, 10.0, 7.0), F.lit(7.0)).when(epoch < 450, _phase(epoch, planned, 450, 7.0, 3.0)).otherwise(3.0),
        "ce": when(F.lit(0.1), _phase(epoch, a, b, 0.1, 0.8), _phase(epoch, b, planned, 0.8, 1.2)).when(epoch < 525, 0.6).when(epoch < 550, _phase(epoch, 525, 550, 0.6, 0.8)).otherwise(0.8),
        "destination": when(F.lit(0.8), _phase(epoch, a, b, 0.8, 0.3), _phase(epoch, b, planned, 0.3, 0.05)).otherwise(0.05),
        "kd": when(F.lit(0.5), _phase(epoch, a, b, 0.5, 1.0), _phase(epoch, b, planned, 1.0, 0.7)).when(epoch < 525, _phase(epoch, planned, 525, 0.7, 1.2)).otherwise(1.4),
    }


def linear(epoch: Column, start: float, end: float, total: int) -> Column:
    return start + (end - start) * F.least(F.greatest(epoch / float(total), F.lit(0.0)), F.lit(1.0))


def learning_rate(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then two cosine bands."""
    band = int(total * 0.15)
    wave = lambda scale, first, width: F.greatest(F.lit(0.0), scale * (1.0 + F.cos(F.lit(3.141592653589793) * (step - first) / float(max(1, width)))))
    return F.when(step < warmup, step / float(max(1, warmup))).when(step < warmup + band, wave(0.5, warmup, band)).otherwise(wave(0.3, warmup + band, total - warmup - band))
