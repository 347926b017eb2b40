"""Exposure, attributable risk and derived scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazegrid.functions.atmosphere import clip
from hazegrid.schema import CITY_POPULATION, MORTALITY_RATE, RANKING_BETA


def exposure(conc: Column, population: Column) -> Column:
    return conc * population


def exposure_millions(conc: Column, population: Column) -> Column:
    return conc * population / 1e6


def excess(conc: Column, baseline: Column | float) -> Column:
    """Concentration above the baseline, never below zero; null stays null."""
    base = F.lit(baseline) if isinstance(baseline, (int, float)) else baseline
    return clip(conc - base, 0.0)


def attributable_risk_pct(conc: Column, beta: Column | float, baseline: Column | float) -> Column:
    """(1 - exp(-beta * excess)) in percent."""
    b = F.lit(beta) if isinstance(beta, (int, float)) else beta
    return (F.lit(1.0) - F.exp(-b * excess(conc, baseline))) * 100


def catchment_or_share(population: Column) -> Column:
    """Known catchment, else a sixth of the city."""
    return F.coalesce(population.cast("double"), F.lit(CITY_POPULATION / 6))


def attributable_deaths(population: Column, ar_pct: Column) -> Column:
    return catchment_or_share(population) * MORTALITY_RATE * ar_pct / 100


def excess_deaths_per_day(population: Column, ar_pct: Column) -> Column:
    return population * MORTALITY_RATE / 365 * ar_pct / 100


def impact_score(conc: Column, population: Column, beta: float = RANKING_BETA) -> Column:
    return F.round(conc * population * beta / 1e6, 4)


# ---- fixed values: score thresholds, labels and marker sizes ----------------------------
TIERS = [(0.50, "🔴 Critical Risk (Hotspot)", 18), (0.28, "🟠 Moderate Risk (Elevated)", 14)]
LOW_TIER = ("🟢 Lower Relative Risk (Buffer)", 12)


def risk_tier(score: Column) -> tuple[Column, Column]:
    """Tier label and marker size of an impact score."""
    label = F.when(score.isNull(), F.lit(None).cast("string"))
    size = F.when(score.isNull(), F.lit(None).cast("int"))
    for least, text, px in TIERS:
        label = label.when(score >= least, text)
        size = size.when(score >= least, px)
    return label.otherwise(LOW_TIER[0]), size.otherwise(LOW_TIER[1])
