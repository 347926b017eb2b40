"""Rule scores that hint at what caused a reading.

Every rule has a time gate. Inside the gate a reading earns a weighted score when its
pollutants pass their thresholds, and a small constant when they do not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.schema import SOURCE_RULES, SOURCES

LABELS = {"score_traffic": "traffic", "score_brick_kiln": "brick_kiln",
          "score_biomass": "biomass", "score_construction": "construction"}
MIXED = "mixed"


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _in_ranges(value: Column, ranges: list[tuple]) -> Column:
    return reduce(lambda a, b: a | b, [value.between(low, high) for low, high in ranges])


def _exceeds(inputs: dict[str, Column], least: dict[str, float]) -> list[Column]:
    return [F.coalesce(inputs[name] > x, F.lit(False)) for name, x in least.items()]


def score(rule: dict, inputs: dict[str, Column]) -> Column:
    """A rule's score from its inputs: 0 outside the gate, and inside it the weighted sum (at most 1) or the partial score."""
    gate = _all([_in_ranges(inputs[n], r) for n, r in rule["gate"].items()] + _exceeds(inputs, rule["gate_above"]))
    full = _all([_in_ranges(inputs[n], r) for n, r in rule["within"].items()] + _exceeds(inputs, rule["above"]))
    parts = [F.least((inputs[n] - offset) / scale, F.lit(1.0)) * weight for weight, n, offset, scale in rule["terms"]]
    for weight, n, ranges, other in rule["steps"]:
        share = reduce(lambda e, r: e.when(inputs[n].between(*r[0]), r[1]), ranges[1:], F.when(inputs[n].between(*ranges[0][0]), ranges[0][1]))
        parts.append(share.otherwise(other) * weight)
    total = F.least(reduce(lambda a, b: a + b, parts, F.lit(rule["always"])), F.lit(1.0))
    return F.when(gate & full, total).when(gate, F.lit(rule["partial"])).otherwise(F.lit(0.0))


def rule_inputs() -> dict[str, Column]:
    c = {n: F.col(n) for n in ("hour", "dow", "month", "pm25", "pm10", "no2", "so2", "co")}
    return c | {"ratio": F.try_divide(c["pm10"], F.when(c["pm25"] > 0, c["pm25"]))}


def with_source_scores(df: DataFrame) -> DataFrame:
    """Add a score per rule; needs hour, dow, month and the pollutant columns."""
    inputs = rule_inputs()
    return df.withColumns({name: score(rule, inputs) for name, rule in SOURCE_RULES.items()})


def likely_source(scores: dict[str, Column] | None = None) -> Column:
    """Name of the highest score; ``mixed`` when two lead together or none is positive."""
    cols = scores or {s: F.col(s) for s in SOURCES}
    cols = {name: F.round(c, 9) for name, c in cols.items()}  # ties survive float noise
    best = F.greatest(*cols.values())
    leaders = reduce(lambda a, b: a + b, [F.when(c == best, 1).otherwise(0) for c in cols.values()])
    expr = F.when((best <= 0) | (leaders > 1) | best.isNull(), MIXED)
    for name, c in cols.items():
        expr = expr.when(c == best, LABELS[name])
    return expr


def relative_shares(cols: list[str] = SOURCES) -> dict[str, Column]:
    """Each score as a percentage of the row total; an all-zero row stays zero."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    return {c: F.col(c) / F.when(total == 0, 1.0).otherwise(total) * 100 for c in cols}


def dominant_label(kiln: Column, dust: Column, traffic_score: Column) -> Column:
    """Readable main source of a station from its mean scores."""
    def pct(c: Column) -> Column:
        return F.bround(c * 100, 0).cast("long").cast("string")
    return (
        F.when(kiln > 0.15, F.concat(F.lit("Brick Kilns ("), pct(kiln), F.lit("%) & Construction")))
        .when(dust > 0.50, F.concat(F.lit("Construction Dust ("), pct(dust), F.lit("%)")))
        .otherwise(F.concat(F.lit("Traffic Exhaust ("), pct(traffic_score), F.lit("%)")))
    )
