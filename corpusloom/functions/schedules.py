"""Learning-rate schedules as pure expressions of the step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _warm(step: Column, warmup: int, rest: Column) -> Column:
    return F.when(step < warmup, step / float(warmup)).otherwise(rest) if warmup else rest


def linear(step: Column, warmup: int, steps: int, floor: float) -> Column:
    """Warm up, then fall linearly to ``floor`` of the peak at ``steps``."""
    s = (step - warmup) / float(steps - warmup)
    return _warm(step, warmup, F.when(step <= steps, s * floor + (1 - s)).otherwise(floor))


def inverse_sqrt(step: Column, warmup: int, exponent: float, floor: float) -> Column:
    """Warm up, then fall as the inverse power of the step, not below ``floor``."""
    return _warm(step, warmup, F.greatest(F.pow(F.lit(float(warmup)), F.lit(exponent)) / F.pow(step.cast("double"), F.lit(exponent)), F.lit(floor)))


def cosine(step: Column, warmup: int, steps: int, floor: float, cycle: float = 1.0, theta: float = 1.0) -> Column:
    """Warm up, then cosines of ``cycle`` of the steps each between the peak and ``floor``, every second one mirrored; ``theta`` bends
    the time."""
    sign = F.when(F.pmod(F.floor(step / float(steps * cycle)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    s = F.greatest((step - warmup) / float(steps - warmup), F.lit(0.0))
    wave = F.cos(F.lit(math.pi) * F.pow(s, F.lit(theta)) / F.lit(cycle))
    return _warm(step, warmup, F.when(step <= steps, F.lit(floor) + 0.5 * (1 - floor) * (sign * wave + 1)).otherwise(floor))


def stable_decay(step: Column, warmup: int, steps: int, decay_fraction: float, floor: float, cycle: float = 1.0) -> Column:
    """Warm up once; in every cycle of ``cycle`` of the steps stay at the peak, and over the last fraction of all steps up to the cycle's
    end fall so that the inverse grows linearly to that of ``floor``."""
    width = int(steps * cycle)
    end = F.when(step == steps, steps).otherwise((F.floor(step / width) + 1) * width)
    length = F.floor(end * F.lit(decay_fraction))
    progress = (step - (end - length)) / length
    down = 1 / (progress * (1 / floor) + (1 - progress))
    return _warm(step, warmup, F.when(step <= end - length, 1.0).when(step <= end, down).otherwise(floor))


def stable_root_decay(step: Column, warmup: int, steps: int, decay_fraction: float) -> Column:
    """Warm up, stay at the peak, and fall by the square root to nothing over the last fraction of the steps."""
    start = steps - round(steps * decay_fraction)
    s = F.least((step - start) / float(steps - start), F.lit(1.0))
    return _warm(step, warmup, F.when(step < start, 1.0).otherwise(F.greatest(1 - F.sqrt(s), F.lit(0.0))))
