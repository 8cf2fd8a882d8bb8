"""Thresholds, weights and lookup values.

Every entry is a fixed value that results depend on; callers may pass their own dict of the
same shape to any operator that takes one.
"""

# Physical bounds per parameter: (min, max). Fixed values.
BOUNDS = {
    "PM10": (0.0, 2000.0),
    "PM2.5": (0.0, 1000.0),
    "CO": (0.0, 100000.0),
    "NO2": (0.0, 1000.0),
    "NO": (0.0, 1000.0),
    "NOx": (0.0, 2000.0),
    "O3": (0.0, 1000.0),
    "TVOC": (0.0, 20000.0),
    "CO2": (300.0, 10000.0),
    "Humidity": (0.0, 100.0),
    "Pressure": (870.0, 1085.0),
    "Wind_Speed": (0.0, 200.0),
    "Wind_Direction": (0.0, 360.0),
    "WaterLevel": (0.0, 100.0),
    "WaterTemp": (-5.0, 40.0),
    "Conductivity": (0.0, 50.0),
    "LAEQ nappali": (20.0, 140.0),
    "LAEQ éjszakai": (20.0, 140.0),
}

# Unit rules: parameter -> (declared unit, inferred unit, range min, range max). Fixed values.
UNIT_RULES = {"CO2": ("µg/m3", "ppm", 300.0, 10000.0)}

# Detection limits: parameter -> (limit, unit). Fixed values.
FLOORS = {"NO": (0.7, "µg/m3")}

# Fine/coarse pairs that cannot invert: (fine, coarse, tolerance). Fixed values.
CROSS_RULES = (("PM2.5", "PM10", 0.0),)

# Detector thresholds. Fixed values.
FLOOR_HOURS = 6
GAP_HOURS = 6
LOW_VARIANCE_FRACTION = 0.10
LOW_VARIANCE_MIN_PEERS = 3
CUSUM_K = 0.5
CUSUM_H = 5.0
CUSUM_MIN_POINTS = 24
DEAD_HOURS = 72
DEAD_COUNTER_POINTS = 672
RESET_RATIO = 0.5
COUNTER_INTERVAL_S = 900
NETWORK_WIDE_FRACTION = 0.95
STANDARD_MAJORITY = 0.5
DEFAULT_CADENCE_S = 3600

# Source-file token -> measurement domain, first match wins; then plain words. Fixed values.
FILE_DOMAINS = (
    ("Levego", "air"),
    ("Felszin_alatti_viz", "groundwater"),
    ("Zaj", "noise"),
)
DOMAIN_WORDS = ("groundwater", "water", "air", "noise", "soil")

# Vendor export: columns (timestamp, location, parameter, value, unit), timestamp format,
# station id pattern in the file name, location pattern. Fixed values.
VENDOR_COLUMNS = ("timestamp", "Location", "Mérőeszköz", "érték", "mértékegység")
VENDOR_TIME_FORMAT = "yyyy-MM-dd-HH-mm"
VENDOR_STATION_PATTERN = r"(?i)(DEB-KER\d+)"
LOCATION_PATTERN = r"^(.*?)\s*\(\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\)\s*$"

# Counter archive: id columns and cumulative measures. Fixed values.
COUNTER_IDS = ("time", "uuid", "nick", "lat", "lng")
COUNTER_MEASURES = (
    "cars_60+",
    "vans_opposite_direction",
    "vans_0-30",
    "vans_30-60",
    "vans_60+",
    "trucks_opposite_direction",
    "trucks_0-30",
    "trucks_30-60",
    "trucks_60+",
    "uncategorized",
)
COUNTER_UNIT = "vehicles/15min"

# Curated station zones (provisional). Fixed values.
STATION_ZONES = {
    "DEB-KER01": "industrial",
    "DEB-KER02": "suburban",
    "DEB-KER03": "background",
    "DEB-KER04": "suburban",
    "DEB-KER05": "urban",
    "DEB-KER06": "urban",
    "DEB-KER07": "urban",
    "DEB-KER08": "urban",
    "DEB-KER09": "urban",
    "DEB-KER10": "urban",
    "DEB-KER11": "urban",
    "DEB-KER12": "background",
    "DEB-KER13": "suburban",
    "DEB-KER14": "suburban",
    "DEB-KER15": "urban",
    "DEB-KER18": "suburban",
}

# Trust weights and windows. Fixed values.
TRUST_WEIGHTS = {
    "HealthConf": 0.35,
    "ImputationCertainty": 0.15,
    "CrossSensorConsistency": 0.20,
    "PhysicalPlausibility": 0.30,
}
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.2, "info": 0.05}
SEVERITY_DEFAULT = 0.2
HEALTH_DECAY = 0.3
WINDOW_HOURS = 168
NEIGHBOUR_RELIEF = 0.5
PEERS_K = 3
PEERS_MIN = 2
PEERS_MIN_POINTS = 3
DISAGREE_RHO = 0.3
SAFETY_MARGIN = 0.10
EXPOSURE_STUB = 1.0
INSTANT_CADENCE_H = 24

# Wind graph and adjudication. Fixed values.
WIND_SIGMA_DEG = 25.0
WIND_HALF_SATURATION = 2.0
DISTANCE_DECAY_KM = 5.0
CUTOFF_KM = 15.0
CALM_SPEED = 0.1
HORIZON_MAX_MIN = 60.0
EVALUATION_S = 3600
SPEED_FLOOR = 0.3
ATTENUATION_FLOOR = 0.02
GENUINE_AT = 0.6
FAULT_AT = 0.2
MIN_USABLE = 2
CORROBORATION_TOLERANCE = 0.5
WEIGHT_FLOOR = 0.05
BASELINE_HOURS = 48
AMBIGUOUS_CAP = 0.5
BAND_HIGH = 0.75
BAND_MODERATE = 0.5
ROAD_K = 3
CORRIDORS_MAX = 24
EARTH_KM = 6371.0088
EARTH_EXPOSURE_KM = 6371.0
SPATIAL_OFFSET_KM = 0.05
EXPOSURE_RADIUS_KM = 0.5
EXPOSURE_BAND = (0.6, 1.6)
EXPOSURE_MIN_SERVICE = 1.0

# Models. Fixed values.
POLLUTANTS = ("PM10", "NO2", "O3", "CO", "CO2")
CV_FOLDS = 4
R2_BAND = (0.15, 0.90)
CONFORMAL_ALPHA = 0.1
CONFORMAL_MIN_N = 20
WIND_BIAS = 1.0
IMPUTED_TEMPERATURE = 10.0
METEO_RAW_Z = 1.5
METEO_RESID_ABS_Z = 0.6
RECALL_FLOORS = {
    "flatline": 0.80,
    "drift": 0.55,
    "dropout": 0.80,
    "gain": 0.55,
}
ARTEFACT_PRECISION_FLOOR = 0.50

# Operations. Fixed values.
HAZARD = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25, "info": 0.1}
HAZARD_DEFAULT = 0.25
GENUINENESS = {"GENUINE_EVENT": 1.0, "AMBIGUOUS": 0.5, "LIKELY_FAULT": 0.15}
UNADJUDICATED_GENUINENESS = 0.5
UNADJUDICATED_CONFIDENCE = 0.6
TRANSITIONS = (
    ("open", "acknowledged"),
    ("acknowledged", "dispatched"),
    ("acknowledged", "resolved"),
    ("dispatched", "resolved"),
)

# Fault classes forced by a reason code, and their precedence (lower wins). Fixed values.
RULE_CLASSES = {
    "R07": ("physically_impossible", 0),
    "R08": ("physically_impossible", 0),
    "R09": ("physically_impossible", 0),
    "R02": ("communication_failure", 2),
    "R12": ("frozen", 1),
    "R10": ("unit_inconsistency", 3),
}
FAULT_CLASSES = (
    "none",
    "communication_failure",
    "frozen",
    "physically_impossible",
    "unit_inconsistency",
    "calibration_drift",
    "meteorological_artefact",
)
