"""From typed station readings to scaled training rows, for all stations in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmesh import schemas
from sunmesh.operators import cleaning as cl
from sunmesh.operators.idw import impute_cascade, impute_single_pass
from sunmesh.operators.moments import apply_pca_groups, fit_pca_groups
from sunmesh.operators.neighbours import station_pairs
from sunmesh.operators.ordered import forward_fill, next_hour_target
from sunmesh.operators.quantiles import mask_outliers
from sunmesh.operators.scaling import apply_scaler, fit_scaler
from sunmesh.sources.tables import materialise


@dataclass(frozen=True)
class Settings:
    """Defaults are the published settings; ``impute`` is ``none``, ``cascade`` or ``single_pass``."""

    impute: str = "cascade"
    max_km: float = schemas.IMPUTE_DISTANCE_KM
    min_stations: int = schemas.MIN_STATIONS
    hours_ahead: int = 1
    strict_time: bool = False
    max_radiation: float = schemas.MAX_RADIATION
    outlier_margin: float = schemas.OUTLIER_MARGIN
    daylight_hours: tuple[int, int] = schemas.DAYLIGHT_HOURS
    test_years: tuple[int, int] = schemas.TEST_YEARS
    min_rows: int = schemas.MIN_SAMPLES
    scaling: str = "rbst"
    fit_pca_on: str = "train"
    fill_limit: int = 2
    lower_limits: Mapping[str, float] = field(default_factory=lambda: dict(schemas.LOWER_LIMITS))


@dataclass(frozen=True)
class Prepared:
    rows: DataFrame
    """Unscaled rows of all listed stations with ``split`` and ``status``."""
    scaled: DataFrame
    """Scaled rows of the stations to train."""
    status: DataFrame
    sites: DataFrame
    pca: DataFrame | None
    scaler: DataFrame


def clean(readings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Unique, valid daylight readings with canonical coordinates and the target, outliers removed."""
    day = cl.drop_duplicate_times(cl.daylight(readings, settings.daylight_hours))
    valid = cl.mask_ranges(day, upper_exclusive={"radiacao_global": settings.max_radiation})
    located = cl.overwrite_coordinates(valid, cl.canonical_coordinates(readings))
    valid = materialise(located, "daylight")
    # The target is taken after the daylight filter and before the range rules, like the readings it copies.
    led = next_hour_target(valid, "radiacao_global", schemas.TARGET, settings.hours_ahead, settings.strict_time)
    ranged = cl.mask_sentinel(cl.mask_ranges(led, settings.lower_limits), [*schemas.MEASUREMENTS, schemas.TARGET])
    stored = materialise(ranged, "cleaned")
    return mask_outliers(stored, ["radiacao_global", schemas.TARGET], settings.outlier_margin)


def site_table(readings: DataFrame) -> DataFrame:
    """One row per station: ``station_id, lat, lon, alt``."""
    return cl.canonical_coordinates(readings).withColumnsRenamed({"latitude": "lat", "longitude": "lon", "altitude": "alt"})


def impute(cleaned: DataFrame, sites: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fill gaps from neighbouring stations, then carry the last value over at most ``fill_limit`` rows."""
    if settings.impute == "none":
        return cleaned
    features = list(schemas.IMPUTED_FEATURES)
    pairs = station_pairs(sites, settings.max_km)
    if settings.impute == "cascade":
        filled = impute_cascade(cleaned, sites, pairs, features, settings.min_stations)
    else:
        filled = impute_single_pass(cleaned, pairs, features, settings.min_stations)
    carried = [*features, "vento_rajada"]
    return forward_fill(materialise(filled, "imputed"), ["station_id"], ["ts"], carried, settings.fill_limit)


def prepare(readings: DataFrame, settings: Settings = Settings(), pca_groups: Mapping[str, tuple[Sequence[str], Sequence[str]]] | None = None) -> Prepared:
    """The whole preparation. Each stored step is read by column afterwards, never recomputed."""
    pca_groups = schemas.PCA_GROUPS if pca_groups is None else pca_groups
    cleaned = materialise(clean(readings, settings), "outliers-masked")
    sites = materialise(site_table(cleaned), "sites")
    complete = cl.drop_incomplete(impute(cleaned, sites, settings), [*schemas.MEASUREMENTS, schemas.TARGET])
    split = materialise(cl.assign_split(cl.with_time_parts(complete), settings.test_years), "complete")
    status = materialise(cl.station_status(split, settings.min_rows), "status")

    fit_rows = split.where(F.col("split") == "train") if settings.fit_pca_on == "train" else split
    params, reduced = None, split
    if pca_groups:
        params = materialise(fit_pca_groups(fit_rows, pca_groups), "components")
        reduced = apply_pca_groups(split, params, pca_groups)
    rows = reduced.join(status.select("station_id", "status"), "station_id")

    dropped = {"station_id", "ts", "split", "status", "year", *schemas.COORDINATES}
    features = [c for c in rows.columns if c not in dropped]
    trainable = rows.where((F.col("status") == "train") & F.col("split").isNotNull())
    trainable = trainable.withColumns({c: F.col(c).cast("double") for c in ("doy", "hour")})
    scaler = materialise(fit_scaler(trainable.where(F.col("split") == "train"), features, settings.scaling), "scaler")
    scaled = apply_scaler(trainable, scaler, features).select("station_id", "ts", "split", *features)
    return Prepared(rows, scaled, status, sites, params, scaler)
