"""Table schemas and the constants that are part of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: names and orders ---------------------------------------------------
POLLUTANTS = ["pm25", "pm10", "no2", "o3", "so2", "co"]
WEATHER = ["temperature", "humidity", "wind_speed", "wind_direction", "pressure"]
WEATHER_RENAME = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "wind_speed_10m": "wind_speed",
    "wind_direction_10m": "wind_direction",
    "surface_pressure": "pressure",
}
SEASONS = ["Winter", "Pre-Monsoon", "Monsoon", "Post-Monsoon"]
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Pre-Monsoon": (3, 4, 5),
    "Monsoon": (6, 7, 8, 9),
    "Post-Monsoon": (10, 11),
}
SOURCES = ["score_traffic", "score_brick_kiln", "score_biomass", "score_construction"]

# ---- fixed values: source rules -------------------------------------------------------
# gate: ranges of an input within which a rule applies at all; above: what an input must exceed for the full score, in the gate
# (gate_above) or beyond it (above); terms: weight, input, offset, full scale; steps: weight, input, ranges with their share, other share;
# always: part of the score that the gate implies; partial: score in the gate when the full one is not reached.
# `ratio` is pm10 / pm25 where pm25 is positive.
SOURCE_RULES = {
    "score_traffic": {
        "gate": {"hour": [(8, 10), (17, 20)], "dow": [(2, 6)]}, "gate_above": {}, "within": {}, "above": {"no2": 30, "pm10": 60},
        "terms": [(0.30, "no2", 0.0, 80.0), (0.25, "pm10", 0.0, 120.0)], "steps": [], "always": 0.45, "partial": 0.3,
    },
    "score_brick_kiln": {
        "gate": {"month": [(11, 12), (1, 4)], "hour": [(6, 12)]}, "gate_above": {}, "within": {}, "above": {"so2": 15, "pm10": 80},
        "terms": [(0.35, "so2", 0.0, 50.0), (0.30, "pm10", 0.0, 150.0)],
        "steps": [(0.20, "month", [((12, 12), 1.0), ((1, 2), 1.0), ((11, 11), 0.7), ((3, 3), 0.7)], 0.4), (0.15, "hour", [((7, 11), 1.0)], 0.5)],
        "always": 0.0, "partial": 0.2,
    },
    "score_biomass": {
        "gate": {"month": [(10, 11)], "hour": [(17, 22)]}, "gate_above": {}, "within": {}, "above": {"co": 1.0, "pm25": 50},
        "terms": [(0.40, "co", 0.0, 5.0), (0.35, "pm25", 0.0, 120.0)], "steps": [(0.25, "month", [((11, 11), 1.0)], 0.7)],
        "always": 0.0, "partial": 0.15,
    },
    "score_construction": {
        "gate": {}, "gate_above": {"ratio": 2.5}, "within": {"hour": [(7, 18)]}, "above": {"pm25": 5},
        "terms": [(0.50, "ratio", 2.5, 4.5), (0.30, "pm10", 0.0, 200.0)], "steps": [(0.20, "hour", [((9, 16), 1.0)], 0.5)],
        "always": 0.0, "partial": 0.10,
    },
}

# ---- fixed values: bounds and limits --------------------------------------------------
BBOX = {"lat_min": 23.65, "lat_max": 23.90, "lon_min": 90.30, "lon_max": 90.50}
PPM_TO_UGM3 = {"no2": 1882.0, "o3": 1961.0, "so2": 2619.0, "co": 1145.0}
PHYSICAL_MAX = {
    "pm25": 1500.0, "pm10": 3000.0, "no2": 500.0, "o3": 400.0, "so2": 500.0, "co": 100.0,
}
DAILY_LIMITS = {"pm25": 15, "pm10": 45, "no2": 25, "o3": 100, "so2": 40, "co": 4}
FILL_HOURS = 3
FILL_ROWS = 3
CLIP_K = 1.5
FLAG_K = 3.0

# ---- fixed values: health -------------------------------------------------------------
ANNUAL_BASELINE = {"pm25": 5.0, "pm10": 15.0}
DAILY_PM10_BASELINE = 45.0
MORTALITY_RATE = 6.1 / 1000
CITY_POPULATION = 10_356_500
CRF_ANNUAL = [
    # key, pollutant, beta, label
    ("pm25_long_term", "pm25", 0.008, "PM2.5 Long-Term (Pope et al.)"),
    ("pm25_annual", "pm25", 0.0086, "PM2.5 Annual (India D-in-D 2024)"),
]
CRF_DAILY_BETA = 0.004
RANKING_BETA = 0.0086

# ---- fixed values: population ---------------------------------------------------------
CATCHMENT_KM = 3.0
DEFAULT_DENSITY = 23_000
DEFAULT_CATCHMENT = 650_309          # 23,000 people/km2 within 3 km, truncated
DEFAULT_CATCHMENT_COARSE = 600_000
DEFAULT_EXPOSURE_POPULATION = 300_000
KNOWN_CATCHMENTS = [
    # station id, area, people
    ("222094", "Baridhara/Gulshan", 280_000),
    ("2796", "Dhaka University/Old Dhaka", 450_000),
    ("236353", "Dhanmondi", 380_000),
    ("233592", "Gulshan", 300_000),
]
AREA_DENSITY = [
    # keyword, area, people per km2
    ("hazaribagh", "Hazaribagh/Jigatola", 42_000),
    ("jigatola", "Hazaribagh/Jigatola", 42_000),
    ("mirpur", "Mirpur", 38_000),
    ("dhanmondi", "Dhanmondi", 35_000),
    ("moghbazar", "Moghbazar", 33_000),
    ("badda", "Badda", 30_000),
    ("dhaka university", "Dhaka University/Old Dhaka", 40_000),
    ("uttara", "Uttara", 20_000),
    ("baridhara", "Baridhara", 16_000),
    ("gulshan", "Gulshan", 18_000),
    ("diplomatic", "Baridhara/Gulshan (Diplomatic Zone)", 16_000),
]
AREA_POPULATION = [
    ("mirpur", "Mirpur", 1_200_000),
    ("dhanmondi", "Dhanmondi", 600_000),
    ("gulshan", "Gulshan", 450_000),
    ("uttara", "Uttara", 850_000),
    ("old dhaka", "Old Dhaka", 1_500_000),
    ("tejgaon", "Tejgaon", 700_000),
    ("motijheel", "Motijheel", 500_000),
    ("narayanganj", "Narayanganj", 750_000),
]
UNMATCHED_AREA = "estimated (Dhaka metro average)"

# ---- schemas --------------------------------------------------------------------------
READING = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])
STATION = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("station_name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])
WIDE = T.StructType(
    [T.StructField("station_id", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in POLLUTANTS]
)
WEATHER_HOURLY = T.StructType(
    [T.StructField("station_id", T.StringType()), T.StructField("ts_hour", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER]
)
CLEANED = T.StructType(
    STATION.fields
    + [T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.FloatType()) for c in POLLUTANTS]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER]
    + [
        T.StructField("population_catchment", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)


def normalize(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Project `df` onto `schema`: declared order and types, absent columns as typed nulls.

    One projection, so no operator has to test which columns happen to exist.
    """
    present = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    if keep_extra:
        declared = set(schema.fieldNames())
        cols += [F.col(c) for c in df.columns if c not in declared]
    return df.select(*cols)
