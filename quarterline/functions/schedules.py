"""Learning-rate warm-up and sinusoidal time features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def warmup_cosine(epoch: Column, warmup: int, epochs: int, least: float = 0.0) -> Column:
    """Factor that rises linearly over the warm-up and then falls as half a cosine to the least."""
    done = F.least(F.lit(1.0), (epoch - warmup) / max(1, epochs - warmup))
    return F.when(epoch < warmup, (epoch + 1) / max(1, warmup)).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(math.pi * done)))


def time_embedding(q: Column, width: int) -> Column:
    """Sines and cosines of q at geometric frequencies."""
    rates = [math.exp(-math.log(10_000.0) * k / max(1, width // 2)) for k in range(width // 2)]
    return F.array(*[F.sin(q * r) for r in rates], *[F.cos(q * r) for r in rates])
