"""Fixed values of the market domain. They must stay as they are for results to be right."""

from __future__ import annotations

import datetime as dt

LOCAL_TZ = "America/Chicago"

# --- fixed values: analysis parameters -------------------------------------------------------
ZONE_HUB_PAIRS = [("LZ_HOUSTON", "HB_HOUSTON"), ("LZ_NORTH", "HB_NORTH"),
                  ("LZ_SOUTH", "HB_SOUTH"), ("LZ_WEST", "HB_WEST")]
HUB_PAIRS = [("HB_WEST", "HB_NORTH"), ("HB_HOUSTON", "HB_NORTH"),
             ("HB_SOUTH", "HB_HOUSTON"), ("HB_PAN", "HB_WEST")]
PRICE_THRESHOLDS = [25, 50, 75, 100, 150, 200, 300, 500, 1000]
SPIKE_THRESHOLDS = [50, 75, 100, 150, 200]
SPIKE_MIN_LENGTHS = [1, 2, 4]
EFFICIENCIES = [0.80, 0.85, 0.88, 0.90, 1.0]
NET_LOAD_QUANTILES = [0.75, 0.9]
PEAK_HOURS = [16, 17, 18, 19, 20]
QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
OUTCOMES = ["correct", "wrong_answer", "sql_error", "format_error"]
REWARDS = {"correct": 1.0, "wrong_answer": 0.0, "sql_error": 0.0, "format_error": -0.2}

# --- fixed values: reward constants ----------------------------------------------------------
INVALID_REWARD = -1.0
UNORDERED_PENALTY = 0.1
MIN_BASELINE_LOSS = 5.0
MAX_ABS_VALUE = 50_000.0
SCALE_RANGE = (0.25, 4.0)
Z90 = 1.2816

# --- fixed values: operating-day splits with a week between them -----------------------------
SPLITS = [("train", dt.date(2023, 1, 1), dt.date(2025, 8, 31)),
          ("val", dt.date(2025, 9, 8), dt.date(2026, 2, 28)),
          ("test", dt.date(2026, 3, 8), dt.date(2026, 8, 31))]

# --- fixed values: storage fleet and commitment rule -----------------------------------------
FLEET = {"units": 1000, "unit_kw": 20.0, "unit_kwh": 39.2, "rte": 0.85, "degradation": 10.0}
COMMIT_BASE, COMMIT_MIN = 0.8, 0.2
MARKET_REDESIGN = dt.date(2025, 12, 5)

# --- fixed values: column and name recodes ---------------------------------------------------
FORECAST_ZONE_COLUMNS = {"Coast": "coast", "East": "east", "FarWest": "far_west", "North": "north",
                         "NorthCentral": "north_central", "SouthCentral": "south_central",
                         "Southern": "south", "West": "west", "SystemTotal": "system_total"}
LOAD_COLUMNS = {"Coast": "coast_mw", "East": "east_mw", "Far West": "far_west_mw", "North": "north_mw",
                "North Central": "north_central_mw", "South": "south_mw",
                "South Central": "south_central_mw", "West": "west_mw", "Total": "total_mw"}
LOAD_ZONES = {"coast_mw": "coast", "east_mw": "east", "far_west_mw": "far_west", "north_mw": "north",
              "north_central_mw": "north_central", "south_mw": "south",
              "south_central_mw": "south_central", "west_mw": "west", "total_mw": "system_total"}
ZONE_PRICE_POINT = {"coast": "LZ_HOUSTON", "east": "LZ_NORTH", "far_west": "LZ_WEST", "north": "LZ_NORTH",
                    "north_central": "LZ_NORTH", "south": "LZ_SOUTH", "south_central": "LZ_CPS",
                    "west": "LZ_WEST", "system_total": "HB_HUBAVG"}
SERVICES = ["REGUP", "REGDN", "RRS", "NSPIN", "ECRS"]
POINT_TYPES = {"HU": "hub", "SH": "hub", "AH": "hub", "LZ": "load_zone"}

# --- fixed values: weather points (name, zone, lat, lon, forecast office, weight in the zone) -
WEATHER_POINTS = [
    ("houston_iah", "coast", 29.98, -95.34, "HGX", 0.45),
    ("houston_hobby", "coast", 29.65, -95.28, "HGX", 0.40),
    ("galveston", "coast", 29.27, -94.86, "HGX", 0.15),
    ("tyler", "east", 32.35, -95.40, "SHV", 0.60),
    ("lufkin", "east", 31.23, -94.75, "SHV", 0.40),
    ("midland", "far_west", 31.94, -102.19, "MAF", 0.40),
    ("odessa", "far_west", 31.85, -102.37, "MAF", 0.30),
    ("pecos", "far_west", 31.38, -103.51, "MAF", 0.30),
    ("wichita_falls", "north", 33.98, -98.49, "OUN", 0.55),
    ("paris", "north", 33.64, -95.45, "FWD", 0.45),
    ("dfw", "north_central", 32.90, -97.04, "FWD", 0.75),
    ("waco", "north_central", 31.61, -97.23, "FWD", 0.25),
    ("austin", "south_central", 30.19, -97.67, "EWX", 0.45),
    ("san_antonio", "south_central", 29.53, -98.47, "EWX", 0.55),
    ("corpus_christi", "south", 27.77, -97.51, "CRP", 0.40),
    ("mcallen", "south", 26.18, -98.24, "BRO", 0.40),
    ("laredo", "south", 27.54, -99.46, "CRP", 0.20),
    ("abilene", "west", 32.41, -99.68, "SJT", 0.55),
    ("san_angelo", "west", 31.36, -100.50, "SJT", 0.45),
]
ZONE_OFFICES = {"coast": ["HGX", "CRP"], "east": ["SHV", "FWD", "HGX"], "far_west": ["MAF"],
                "north": ["FWD", "OUN"], "north_central": ["FWD"], "south": ["CRP", "BRO"],
                "south_central": ["EWX"], "west": ["SJT", "MAF", "LUB"]}
SYSTEM_OFFICES = ["FWD", "HGX", "EWX"]

# --- fixed values: weather models (key, cycle hours, native step hours, latency hours) -------
WEATHER_MODELS = [("gfs", 6, 1, 8.0), ("ecmwf", 6, 3, 8.0), ("icon", 6, 1, 5.0), ("gem", 12, 3, 7.0)]
WEATHER_VARIABLES = {"temperature_2m": "temp_c", "dew_point_2m": "dewpoint_c",
                     "cloud_cover": "cloud_cover_pct", "wind_speed_10m": "wind_speed_kmh",
                     "precipitation": "precip_mm"}

# --- fixed values: text patterns -------------------------------------------------------------
THEMES = {
    "storms": r"thunderstorm|\btstorms?\b|\bstorms?\b|convecti",
    "severe": r"severe|tornado|\bhail\b|damaging wind|\bshear\b",
    "heat": r"heat advisory|heat index|excessive heat|record high|triple.digit",
    "heavy_rain": r"flash flood|flooding|heavy rain|excessive rain",
    "tropical": r"tropical|hurricane",
    "quiet": r"\bquiet\b|clear skies|little change|benign",
}
ZONE_ABBREV_OFFSET_HOURS = {"CDT": -5, "CST": -6, "MDT": -6, "MST": -7, "EDT": -4, "EST": -5,
                            "UTC": 0, "GMT": 0}
ZONE_LABEL = {"coast": "Coast (Houston)", "east": "East (Tyler/Lufkin)",
              "far_west": "Far West (Permian Basin)", "north": "North (Wichita Falls/Paris)",
              "north_central": "North Central (Dallas-Fort Worth)",
              "south": "Southern (Corpus Christi/Rio Grande Valley)",
              "south_central": "South Central (Austin/San Antonio)",
              "west": "West (Abilene/San Angelo)", "system_total": "System total"}
