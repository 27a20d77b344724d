"""Confidence of readings and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The calibration's coefficients, the gate's caps and the bands.
TOKEN_WEIGHT, LAYOUT_WEIGHT, OFFSET, FLOOR = 7.93, 1.787, 1.197, 1e-12
HIGH, MEDIUM = 0.90, 0.70
LLM_DOUBT, LLM_CAP, VALIDATOR_CAP, REPAIRED_CAP = 0.5, 0.75, 0.3, 0.75


def calibrated(token: Column, layout: Column) -> Column:
    z = TOKEN_WEIGHT * F.log(F.greatest(token, F.lit(FLOOR))) + LAYOUT_WEIGHT * layout + OFFSET
    return 1 / (1 + F.exp(-z))


def band(p: Column) -> Column:
    return F.when(p >= HIGH, "high").when(p >= MEDIUM, "medium").otherwise("low")


def gate(ocr: Column, verifier: Column, grounding: Column, llm: Column, validator_ok: Column, repaired: Column) -> Column:
    """The weaker of reading and verifier times grounding, capped by doubts; rounded to four places."""
    score = F.least(ocr, verifier) * grounding
    score = F.when(llm < LLM_DOUBT, F.least(score, F.lit(LLM_CAP))).otherwise(score)
    score = F.when(~validator_ok, F.least(score, F.lit(VALIDATOR_CAP))).otherwise(score)
    return F.round(F.when(repaired, F.least(score, F.lit(REPAIRED_CAP))).otherwise(score), 4)


def noisy_or(confidence: Column) -> Column:
    """1 - prod(1 - c) over a group, null as 0, null if all are null."""
    return F.when(F.count(confidence) > 0, F.round(1 - F.product(1 - F.coalesce(confidence, F.lit(0.0))), 4))
