"""Declared shapes of the canonical tables: ordered columns and their types."""

from __future__ import annotations

_TIME = {"operating_date": "date", "hour_ending": "smallint", "repeated_hour": "boolean", "start_local": "timestamp_ntz",
         "end_local": "timestamp_ntz", "start_utc": "timestamp_ntz", "end_utc": "timestamp_ntz"}
_QUARTER = {"operating_date": "date", "hour_ending": "smallint", "quarter": "smallint", **{
    k: v for k, v in _TIME.items() if k not in ("operating_date", "hour_ending")}}
_ZONES = ["coast_mw", "east_mw", "far_west_mw", "north_mw", "north_central_mw", "south_mw", "south_central_mw", "west_mw", "total_mw"]

TABLES: dict[str, dict[str, str]] = {
    "rt_price_15min": {"point": "string", "point_type": "string", **_QUARTER, "price": "double"},
    "da_price_hourly": {"point": "string", "point_type": "string", **_TIME, "price": "double"},
    "load_hourly": {**_TIME, **{z: "double" for z in _ZONES}},
    "fuel_mix_15min": {"fuel": "string", **_QUARTER, "generation": "double", "energy": "double", "settlement_type": "string"},
    "service_price_hourly": {"service": "string", **_TIME, "price": "double"},
    "wind_forecast_hourly": {**_TIME, "actual": "double", "forecast": "double", "publish_time_local": "timestamp_ntz"},
    "solar_forecast_hourly": {**_TIME, "actual": "double", "forecast": "double", "publish_time_local": "timestamp_ntz"},
    "load_forecast_hourly": {**_TIME, "forecast": "double", "publish_time_local": "timestamp_ntz"},
    "forecast_vintage": {"operating_date": "date", "hour_ending": "smallint", "zone": "string", "model": "string", "in_use": "boolean",
                         "forecast": "double", "publish_time": "timestamp_ntz", "vintage": "string", "repeated_hour": "boolean", "doc_id": "string"},
    "actual_load": {"operating_date": "date", "hour_ending": "smallint", "zone": "string", "actual_mw": "double",
                    "repeated_hour": "boolean", "start_utc": "timestamp_ntz"},
}

SORT_KEYS: dict[str, list[str]] = {
    "rt_price_15min": ["point", "start_utc"], "da_price_hourly": ["point", "start_utc"], "load_hourly": ["start_utc"],
    "fuel_mix_15min": ["fuel", "start_utc"], "service_price_hourly": ["service", "start_utc"], "wind_forecast_hourly": ["start_utc"],
    "solar_forecast_hourly": ["start_utc"], "load_forecast_hourly": ["start_utc"],
    "forecast_vintage": ["zone", "operating_date", "hour_ending"], "actual_load": ["operating_date", "zone", "start_utc"],
}
