"""Colour grading as an ordered list of steps; a neutral setting adds nothing to the plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import lang

NEUTRAL = 0.01


@dataclass(frozen=True)
class Settings:
    """A preset: one value per step."""

    gains: tuple[float, float, float] = (1.0, 1.0, 1.0)
    exposure: float = 0.0
    matrix: tuple[float, ...] | None = None
    gamma: float = 1.0
    transfer: str = ""
    vibrance: float = 1.0
    saturation: float = 1.0
    toning: float = 0.0
    tone: tuple[int, int, int] = (255, 255, 255)
    contrast: float = 0.0


def _neutral(value: float, at: float) -> bool:
    return abs(value - at) < NEUTRAL


def steps(s: Settings) -> list[tuple[str, object]]:
    """(name, rule) for the settings that do something; a rule maps three columns to three."""
    out: list[tuple[str, object]] = []
    gains = [g * 2.0**s.exposure if s.exposure < 0 else g for g in s.gains]
    if any(not _neutral(g, 1.0) for g in gains):
        out.append(("gains", lambda c: [X.clamp16(X.trunc(v * F.lit(float(g)))) for v, g in zip(c, gains)]))
    if s.matrix is not None:
        out.append(("matrix", lambda c: [X.clamp16(X.trunc(v)) for v in X.matrix(c, s.matrix)]))
    if s.transfer:
        gain = 2.0**s.exposure if s.exposure > 0 else 1.0
        out.append(("transfer", lambda c: [X.clamp16(X.trunc(65535.0 * lang.compile_column(s.transfer, v / F.lit(65535.0) * F.lit(gain)))) for v in c]))
    elif not _neutral(s.gamma, 1.0):
        out.append(("gamma", lambda c: [X.clamp16(X.trunc(65535.0 * F.round(F.pow(v / F.lit(65535.0), F.lit(1 / s.gamma)), 6))) for v in c]))
    if not _neutral(s.vibrance, 1.0):
        out.append(("vibrance", lambda c: X.vibrance(c, s.vibrance)))
    if not _neutral(s.saturation, 1.0):
        out.append(("saturation", lambda c: X.saturation(c, s.saturation)))
    if not _neutral(s.toning, 0.0):
        out.append(("toning", lambda c: X.toning(c, s.toning, s.tone)))
    if not _neutral(s.contrast, 0.0):
        out.append(("contrast", lambda c: [X.clamp16(X.trunc(v * X.contrast_factor(X.luma(*c), s.contrast * 0.65))) for v in c]))
    return out


def grade(rgb: DataFrame, settings: Settings) -> DataFrame:
    """All active steps over (frame, y, x, r, g, b)."""
    for _, rule in steps(settings):
        new: list[Column] = rule([F.col("r"), F.col("g"), F.col("b")])
        rgb = rgb.select("frame", "y", "x", *[v.alias(n) for v, n in zip(new, "rgb")])
    return rgb
