"""Fixed column lists, limits and name tables of the station data.

Timestamps are TIMESTAMP_NTZ holding UTC wall-clock time, so that results do
not depend on the session time zone. Missing values are SQL nulls, never NaN.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of a raw station file, in file order.
RAW_COLUMNS = [
    "data",
    "hour",
    "precipitacao_total",
    "pressao_atmosferica",
    "pressao_atmosferica_max",
    "pressao_atmosferica_min",
    "radiacao_global",
    "temperatura",
    "ponto_orvalho",
    "temperatura_max",
    "temperatura_min",
    "ponto_orvalho_max",
    "ponto_orvalho_min",
    "umidade_relativa_max",
    "umidade_relativa_min",
    "umidade_relativa",
    "vento_direcao",
    "vento_rajada",
    "vento_velocidade",
]

MEASUREMENTS = RAW_COLUMNS[2:]
COORDINATES = ["latitude", "longitude", "altitude"]
TARGET = "rad_prox_hora"

# Measurements and target that are filled from neighbouring stations (gusts are not).
IMPUTED_FEATURES = [c for c in MEASUREMENTS if c != "vento_rajada"] + [TARGET]

# Station files kept besides the home region, and ignored ones.
REGION_TAG = "INMET_SE_SP"
IGNORED_STATIONS = ["C891"]
EXTRA_STATIONS = [
    "A850", "A849", "S705", "A759", "A704", "S717", "A520", "A561",
    "A525", "A509", "A529", "A619", "A628", "A635", "A746",
]

# Plausible ranges; a reading below its limit counts as missing.
LOWER_LIMITS = {
    "precipitacao_total": 0.0,
    "pressao_atmosferica": 0.0,
    "pressao_atmosferica_max": 0.0,
    "pressao_atmosferica_min": 0.0,
    "umidade_relativa": 0.0,
    "umidade_relativa_max": 0.0,
    "umidade_relativa_min": 0.0,
    "temperatura": 10.0,
    "temperatura_max": 10.0,
    "temperatura_min": 10.0,
    "vento_velocidade": 0.0,
}

# Lower limits used for the rain and radiation climatology.
CLIMATE_LOWER_LIMITS = {
    "precipitacao_total": 0.0,
    "radiacao_global": 0.0,
    "umidade_relativa": 0.0,
    "umidade_relativa_max": 0.0,
    "umidade_relativa_min": 0.0,
    "temperatura": 0.0,
    "temperatura_max": 0.0,
    "temperatura_min": 0.0,
    "ponto_orvalho": 0.0,
    "ponto_orvalho_max": 0.0,
    "ponto_orvalho_min": 0.0,
}

# Fixed values of the preparation job.
SENTINEL = -9999.0
MAX_RADIATION = 8000.0
DAYLIGHT_HOURS = (10, 21)
OUTLIER_MARGIN = 300.0
TEST_YEARS = (2019, 2021)
MIN_SAMPLES = 11 * 365 * 7
IMPUTE_DISTANCE_KM = 150.0
COMPOSE_DISTANCE_KM = 120.0
MIN_STATIONS = 3

# Columns that are replaced by principal components.
PCA_GROUPS = {
    "pressao": (["pressao_atmosferica", "pressao_atmosferica_max", "pressao_atmosferica_min"], ["pca_pressao"]),
    "umidade": (
        ["umidade_relativa", "umidade_relativa_max", "umidade_relativa_min"],
        ["pca_umidade_1", "pca_umidade_2"],
    ),
    "temperatura": (["temperatura", "temperatura_max", "temperatura_min"], ["pca_temperatura"]),
    "ponto_orvalho": (["ponto_orvalho", "ponto_orvalho_max", "ponto_orvalho_min"], ["pca_ponto_orvalho"]),
}

# Algorithm short names and the class names found in model file names.
MODEL_NAMES = {
    "mlp": "MLPRegressor",
    "rf": "RandomForestRegressor",
    "extr": "ExtraTreesRegressor",
    "xgb": "XGBRegressor",
    "svr": "SVR",
    "sr": "StackingRegressor",
}

READING_SCHEMA = T.StructType(
    [T.StructField("station_id", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in MEASUREMENTS + COORDINATES]
)
