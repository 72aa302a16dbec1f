"""Fixed values that results depend on.

These must stay exactly as they are for results to be right: physical constants, enum values, thresholds,
lookup tables and published projection parameters.
"""

# -- Earth model ------------------------------------------------------------------------------------------------
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = 111_320.0

# -- local metric grid: transverse Mercator on GRS80, published parameters of EPSG:2039 --------------------------
GRID_SEMI_MAJOR_M = 6_378_137.0
GRID_INVERSE_FLATTENING = 298.257222101
GRID_ORIGIN_LAT = 31.7343936111111
GRID_ORIGIN_LON = 35.2045169444444
GRID_SCALE = 1.0000067
GRID_FALSE_EASTING_M = 219_529.584
GRID_FALSE_NORTHING_M = 626_907.39

# -- time -------------------------------------------------------------------------------------------------------
LOCAL_ZONE = "Asia/Jerusalem"
LAST_DEPARTURE_S = 23 * 3600 + 30 * 60

# -- street modes -----------------------------------------------------------------------------------------------
MODE_SPEED_MPS = {
    "walk": 1.35,
    "bike": 4.7,
    "scooter": 5.0,
    "car": 10.5,
    "motorcycle": 11.5,
    "truck": 8.5,
}
ROAD_MODES = ("car", "motorcycle", "truck")
CYCLE_MODES = ("bike", "scooter")
TRANSIT_MODES = ("transit", "bike_transit", "scooter_transit", "rental_transit")
ALL_MODES = tuple(MODE_SPEED_MPS) + TRANSIT_MODES
PREFERENCES = (
    "fastest", "balanced_shade", "maximum_shade", "fewer_lights", "safer_streets", "fewer_transfers",
)
WALK_PREFERENCES = ("fastest", "balanced_shade", "maximum_shade")
ROAD_PREFERENCES = ("fastest", "fewer_lights")
FOLDABLE_KINDS = ("folding_bike", "personal_scooter")

# -- provider mode names ----------------------------------------------------------------------------------------
PROVIDER_MODE = {
    "WALK": "walk",
    "BIKE": "bike",
    "BICYCLE": "bike",
    "SCOOTER": "scooter",
    "CAR": "car",
    "BUS": "transit",
    "RAIL": "transit",
    "SUBWAY": "transit",
    "TRAM": "transit",
    "FERRY": "transit",
    "BIKE_SHARING": "bike",
}

# -- maneuver type codes and instruction keywords (first match wins) ---------------------------------------------
MANEUVER_CODE = {
    4: "arrive", 5: "arrive", 6: "arrive",
    9: "slight_right", 10: "right", 11: "right",
    12: "uturn", 13: "uturn",
    14: "left", 15: "left", 16: "slight_left",
}
MANEUVER_KEYWORDS = (
    (("destination",), "arrive"),
    (("u-turn", "uturn"), "uturn"),
    (("slight left", "bear left"), "slight_left"),
    (("slight right", "bear right"), "slight_right"),
    (("left",), "left"),
    (("right",), "right"),
)

# -- coverage box (min_lon, min_lat, max_lon, max_lat) of the feature store ---------------------------------------
COVERAGE_BBOX = (34.69, 31.94, 34.93, 32.20)

# -- schedule feeds ---------------------------------------------------------------------------------------------
GTFS_REQUIRED = ("stops.txt", "routes.txt", "trips.txt", "stop_times.txt")
GTFS_CALENDARS = ("calendar.txt", "calendar_dates.txt")
GTFS_LAT_RANGE = (29.0, 34.0)
GTFS_LON_RANGE = (33.0, 36.0)

# -- bundles ----------------------------------------------------------------------------------------------------
BUNDLE_SCHEMA_VERSION = 1
BUNDLE_REQUIRED = ("street_graph", "places", "transit", "shade_profiles")

# -- route comparison -------------------------------------------------------------------------------------------
SHADE_PENALTIES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
SIGNAL_DELAY_S = 25.0
MAX_ACCESS_M = 3_000.0
CORRIDOR_M = 260.0
MAX_SHADOW_M = 250.0
SIGNAL_RADIUS_M = 18.0
SIGNAL_CLUSTER_M = 25.0
REVERSE_RADIUS_M = 2_000.0

# -- navigation session machine: state -> event -> next state (events not listed leave the state unchanged) ------
NAVIGATION_TRANSITIONS = {
    "idle": {"RESTORE": "preview", "PLAN": "planning.requesting"},
    "planning.requesting": {
        "WARMING": "planning.warming", "ROUTES_READY": "preview", "FAIL": "error", "STOP": "idle",
    },
    "planning.warming": {
        "WARMING": "planning.warming", "ROUTES_READY": "preview", "FAIL": "error", "STOP": "idle",
    },
    "preview": {
        "START": "navigating", "PERMISSION_DENIED": "permissionDenied", "PLAN": "planning.requesting",
        "STOP": "idle",
    },
    "navigating": {"OFF_ROUTE": "recalculating", "ARRIVE": "arrived", "STOP": "idle"},
    "recalculating": {
        "ROUTES_READY": "navigating", "REROUTE_UNAVAILABLE": "offline", "FAIL": "navigating", "STOP": "idle",
    },
    "offline": {"OFF_ROUTE": "recalculating", "ARRIVE": "arrived", "STOP": "idle"},
    "permissionDenied": {"RETRY": "preview", "STOP": "idle"},
    "arrived": {"STOP": "idle"},
    "error": {
        "RETRY": "planning.requesting", "PLAN": "planning.requesting", "STOP": "idle",
        "DESTINATION_SELECTED": "idle",
    },
}

# fixed values: age at which a shared vehicle's status counts as stale
STALE_S = 120
