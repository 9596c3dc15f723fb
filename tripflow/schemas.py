"""Row types and the ordered feature contract.

Fixed values, in this whole file: names, types, order and limits that files, tables and models of this data share.
"""

from __future__ import annotations

MONEY = ["base_passenger_fare", "driver_pay", "tips", "tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee", "cbd_congestion_fee"]

TRIP = (
    "hvfhs_license_num string, dispatching_base_num string, originating_base_num string, request_datetime timestamp_ntz, on_scene_datetime timestamp_ntz, "
    "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID int, DOLocationID int, trip_miles double, trip_time bigint, "
    "base_passenger_fare double, tolls double, bcf double, sales_tax double, congestion_surcharge double, airport_fee double, tips double, driver_pay double, "
    "shared_request_flag string, shared_match_flag string, access_a_ride_flag string, wav_request_flag string, wav_match_flag string, cbd_congestion_fee double")

#: The columns that batch plans take of a trip.
TRIP_PROJECTION = [
    "PULocationID", "DOLocationID", "request_datetime", "pickup_datetime", "dropoff_datetime", "trip_miles", "trip_time", "base_passenger_fare", "driver_pay", "tips", "congestion_surcharge",
    "airport_fee", "tolls", "bcf", "sales_tax", "share_match_flag", "share_request_flag", "wav_request_flag", "access_a_ride_flag", "wav_match_flag", "hvfhs_license_num", "cbd_congestion_fee",
]

EVENT = (
    "event_type string, event_time string, trip_id string, hvfhs_license_num string, dispatching_base_num string, originating_base_num string, "
    "PULocationID int, DOLocationID int, request_datetime string, wav_request_flag string, access_a_ride_flag string, shared_request_flag string, "
    "pickup_datetime string, on_scene_datetime string, dropoff_datetime string, trip_miles double, trip_time int, "
    + ", ".join(f"{c} double" for c in MONEY) + ", shared_match_flag string, wav_match_flag string")

WEATHER_COLS = ["temperature_2m", "relative_humidity_2m", "surface_pressure", "precipitation", "rain", "snowfall", "cloud_cover", "weather_code", "wind_speed_10m", "wind_gusts_10m"]
WEATHER_TYPES = {"zone_id": "int", "window_end": "timestamp_ntz", **{c: "int" if c in ("cloud_cover", "weather_code") else "double" for c in WEATHER_COLS}}
WEATHER = ", ".join(f"{c} {t}" for c, t in WEATHER_TYPES.items())
LEAD_COLS = ["temperature_2m", "relative_humidity_2m", "surface_pressure", "cloud_cover", "weather_code"]
LEAD_STEPS = [1, 2, 3]
LAG_STEPS = [92, 668]

DEMAND = ["requests_60m", "wav_req", "aar_req", "share_req", "uber_req"]
PICKUP = ["pickup_60m", "pickup_delay_mean", "pickup_delay_std", "matched_rp", "wav_match", "share_match"]
DROPOFF = ["dropoff_60m", "matched_rd"]
#: Mean over valid trips, by its source column.
STATS = {
    "avg_trip_time": "trip_time", "avg_fare": "base_passenger_fare", "avg_driver_pay": "driver_pay", "avg_tips": "tips", "avg_bcf": "bcf", "avg_tolls": "tolls",
    "avg_congestion_surcharge": "congestion_surcharge", "avg_airport_fee": "airport_fee", "avg_sales_tax": "sales_tax", "avg_cbd_congestion_fee": "cbd_congestion_fee", "avg_distance": "trip_miles",
}
COUNTS = [*DEMAND, "pickup_60m", "matched_rp", "wav_match", "share_match", *DROPOFF]
NEIGHBOR = ["neighbor_requests_60m", "neighbor_pickup_delay_mean", "num_neighbors"]
LAGGED = ["requests_60m", "pickup_60m", "dropoff_60m", "pickup_delay_mean", "neighbor_requests_60m", "neighbor_pickup_delay_mean", "imbalance"]
CYCLES = [f"{c}_{f}" for c in ("slot_15m", "dow", "hou", "woy", "mon") for f in ("sin", "cos")]
#: Training and inference agree by position.
FEATURES = [
    "zone_id", *DEMAND, *PICKUP, *DROPOFF, *STATS, *WEATHER_COLS, *NEIGHBOR, "imbalance", "is_weekend", "is_holiday", *CYCLES,
    *[f"{c}_lag{s}" for c in LAGGED for s in LAG_STEPS], *[f"{c}_lead{s}" for c in LEAD_COLS for s in LEAD_STEPS],
]
REQUIRED_WEATHER = [*WEATHER_COLS, *[f"{c}_lead{s}" for c in LEAD_COLS for s in LEAD_STEPS]]
FEATURES_WITHOUT_WEATHER = [c for c in FEATURES if c not in set(REQUIRED_WEATHER)]

PREDICTION = (
    "zone_id int, window_end timestamp, predicted_class smallint, pred_confidence float, used_model string, model_version string, predicted_at timestamp, shadow_predicted_class smallint, "
    + ", ".join(f"proba_{i} float" for i in range(6)) + ", " + ", ".join(f"shadow_proba_{i} float" for i in range(6)))
KEYS = ["zone_id", "window_end"]
N_ZONES = 263
N_CLASSES = 6
