"""Air-quality index from concentrations, its categories and the advice that goes with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: breakpoints (c_low, c_high, index_low, index_high) -------------------
PM25_SEVEN = [
    (0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300), (250.5, 350.4, 301, 400), (350.5, 500.4, 401, 500),
]
PM10_SEVEN = [
    (0.0, 54.0, 0, 50), (55.0, 154.0, 51, 100), (155.0, 254.0, 101, 150),
    (255.0, 354.0, 151, 200), (355.0, 424.0, 201, 300), (425.0, 504.0, 301, 400),
    (505.0, 604.0, 401, 500),
]
PM25_SIX = [
    (0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300), (250.5, 500.4, 301, 500),
]
# ---- fixed values: category per upper index bound --------------------------------------
CATEGORIES = [
    (50, "Good"), (100, "Moderate"), (150, "Unhealthy for Sensitive Groups"),
    (200, "Unhealthy"), (300, "Very Unhealthy"),
]
TOP_CATEGORY = "Hazardous"
NO_CATEGORY = "Unknown"
# ---- fixed values: advice per upper index bound (commuter, mask, ventilation) -----------
ADVICE = [
    (50,
     "Ideal conditions across Dhaka. Open-air commutes via rickshaw or bicycle pose minimal respiratory strain.",
     "Masking not required for general population.",
     "Open windows across Mirpur, Dhanmondi, and Gulshan for natural convective exchange."),
    (100,
     "Acceptable air. Unusually sensitive individuals on major arterial routes (Airport Rd, Mirpur Rd) should take light precautions.",
     "Surgical or cloth mask optional for dust protection.",
     "Windows can remain open; best air exchange window between 12:00 PM and 3:30 PM."),
    (150,
     "Active commuters on open CNGs, rickshaws, and motorcycles will experience particulate irritation during rush hour.",
     "N95 / KN95 particulate respirator strongly recommended for children, asthmatics, and transit police.",
     "Keep windows closed during early morning rush hours (08:00–10:00). Open briefly around solar noon."),
    (200,
     "Heavy exhaust and brick-kiln smoke trapping. Motorcyclists and open-vehicle commuters face elevated fine particulate deposition.",
     "Mandatory N95 / FFP2 respirators with airtight seal for anyone outdoors >30 minutes.",
     "Seal residential windows; run HEPA air purification where available. Avoid natural ventilation before 1:00 PM."),
    (None,
     "CRITICAL: Severe thermal inversion in progress. High concentrations of combustion soot and toxic aerosol.",
     "Strict N95/P100 respirator requirement. Eliminate outdoor walking and cycling.",
     "Complete window sealing. Do not open windows. Vulnerable groups must remain indoors."),
]
# ---- fixed values: warning per concentration band ---------------------------------------
WARNINGS = [
    (12.0, "🟢 Minimal health impact. Air quality is considered satisfactory."),
    (35.4, "🟡 Acceptable quality. Very sensitive individuals may experience minor respiratory symptoms."),
    (55.4, "🟠 General public not likely affected; active children/adults and people with respiratory disease should limit outdoor exertion."),
    (150.4, "🔴 Everyone may begin to experience health effects; sensitive groups may experience more serious effects. Avoid prolonged outdoor exertion."),
    (250.4, "🟣 Health warnings of emergency conditions. The entire population is more likely to be affected. Stay indoors."),
    (500.4, "🟤 Health alert: everyone may experience more serious health effects. Remain indoors and keep activity levels low."),
]
TOP_WARNING = "🟤 Extreme Health Alert: Hazardous toxic conditions. Remain indoors completely."
NO_DATA_WARNING = "No data available."


def index(conc: Column, bands: list[tuple], gaps: str = "null", top: str = "cap") -> Column:
    """Piecewise-linear index of a concentration.

    gaps  ``null``: values between two bands and negatives have no index;
          ``ceil``: negatives count as 0 and a gap value belongs to the band above it.
    top   ``cap``: 500 above the last band; ``extend``: the last line goes on, up to 999.
    """
    c = conc if gaps == "null" else F.greatest(conc, F.lit(0.0))

    def line(band: tuple) -> Column:
        c_low, c_high, i_low, i_high = band
        return (c - F.lit(float(c_low))) * ((i_high - i_low) / (c_high - c_low)) + float(i_low)

    expr = F.when(conc.isNull(), F.lit(None).cast("double"))
    for band in bands:
        inside = c <= band[1] if gaps == "ceil" else c.between(band[0], band[1])
        expr = expr.when(inside, line(band))
    above = F.lit(500.0) if top == "cap" else F.least(line(bands[-1]), F.lit(999.0))
    return expr.when(c > bands[-1][1], above)


def index_strict(conc: Column, pollutant: str = "pm25") -> Column:
    """Seven bands, no rounding, no index in the gaps."""
    return index(conc, PM25_SEVEN if pollutant == "pm25" else PM10_SEVEN)


def index_ceiling(conc: Column) -> Column:
    """Six PM2.5 bands, gaps closed upward, rounded half to even, extended to 999."""
    return F.bround(index(conc, PM25_SIX, gaps="ceil", top="extend")).cast("int")


def index_live(conc: Column) -> Column:
    """Six PM2.5 bands, rounded half to even; null for missing, negative and gap values."""
    return F.bround(index(conc, PM25_SIX)).cast("int")


def overall(*sub_indices: Column) -> Column:
    """Largest sub-index, ignoring nulls."""
    return F.greatest(*sub_indices)


def category(aqi: Column) -> Column:
    expr = F.when(aqi.isNull(), NO_CATEGORY)
    for upper, name in CATEGORIES:
        expr = expr.when(aqi <= upper, name)
    return expr.otherwise(TOP_CATEGORY)


def advice(aqi: Column) -> tuple[Column, Column, Column]:
    """Commuter, mask and ventilation advice for an index value."""
    def pick(i: int) -> Column:
        expr = F.when(aqi.isNull(), F.lit(None).cast("string"))
        for upper, *texts in ADVICE[:-1]:
            expr = expr.when(aqi <= upper, texts[i])
        return expr.otherwise(ADVICE[-1][i + 1])
    return pick(0), pick(1), pick(2)


def warning(conc: Column) -> Column:
    """Health warning for a PM2.5 reading; gap values are ``Unknown``."""
    expr = F.when(conc.isNull() | (conc < 0), NO_DATA_WARNING)
    expr = expr.when(conc > PM25_SIX[-1][1], TOP_WARNING)
    for (c_low, c_high, *_), (_, text) in zip(PM25_SIX, WARNINGS):
        expr = expr.when(conc.between(c_low, c_high), text)
    return expr.otherwise(NO_CATEGORY)
