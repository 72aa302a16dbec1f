"""Sun position from the public NOAA solar-calculator equations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def _poly(t: Column, *terms: float) -> Column:
    result = F.lit(terms[-1])
    for term in reversed(terms[:-1]):
        result = result * t + term
    return result


def _between(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def with_solar_position(frame: DataFrame, epoch_s: Column, lat: Column, lon: Column) -> DataFrame:
    """Add ``azimuth`` and ``elevation`` (degrees, with refraction) of the sun at an instant in epoch seconds.

    The equations are laid out as successive columns: as one nested expression every shared term would be repeated
    in the generated code.
    """
    day, t = c("_day"), c("_t")
    mean, anomaly, ecc, node, apparent = c("_l0"), c("_m"), c("_e"), c("_om"), c("_lam")
    tilt, decl, y, hour, phi, true = c("_eps"), c("_dec"), c("_y"), c("_ha"), c("_phi"), c("_h")
    steps: list[dict[str, Column]] = [
        {"_day": epoch_s / 86400.0, "_phi": F.radians(lat), "_lon": lon},
        {"_t": (day + 2440587.5 - 2451545.0) / 36525.0},
        {
            "_l0": F.radians(F.pmod(_poly(t, 280.46646, 36000.76983, 0.0003032), F.lit(360.0))),
            "_m": F.radians(_poly(t, 357.52911, 35999.05029, -0.0001537)),
            "_e": _poly(t, 0.016708634, -0.000042037, -0.0000001267),
            "_om": F.radians(_poly(t, 125.04, -1934.136)),
        },
        {
            "_lam": mean + F.radians(
                F.sin(anomaly) * _poly(t, 1.914602, -0.004817, -0.000014)
                + F.sin(anomaly * 2) * _poly(t, 0.019993, -0.000101)
                + F.sin(anomaly * 3) * 0.000289 - 0.00569 - F.sin(node) * 0.00478
            ),
            "_eps": F.radians(
                (_poly(t, 21.448, -46.8150, -0.00059, 0.001813) / 60.0 + 26.0) / 60.0 + 23.0 + F.cos(node) * 0.00256
            ),
        },
        {"_dec": F.asin(F.sin(tilt) * F.sin(apparent)), "_y": F.pow(F.tan(tilt / 2), F.lit(2.0))},
        {
            "_eq": F.degrees(
                y * F.sin(mean * 2) - ecc * 2 * F.sin(anomaly) + ecc * y * 4 * F.sin(anomaly) * F.cos(mean * 2)
                - y * y * 0.5 * F.sin(mean * 4) - ecc * ecc * 1.25 * F.sin(anomaly * 2)
            ) * 4
        },
        {"_ha": F.radians(F.pmod((day - F.floor(day)) * 1440.0 + c("_eq") + c("_lon") * 4, F.lit(1440.0)) / 4 - 180.0)},
        {
            "_h": 90.0 - F.degrees(F.acos(_between(F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour)))),
            "azimuth": F.pmod(
                F.degrees(F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180.0, F.lit(360.0)
            ),
        },
        {"_te": F.tan(F.radians(true))},
        {
            "elevation": true + F.when(true > 85, 0.0)
            .when(true > 5, 58.1 / c("_te") - 0.07 / F.pow("_te", F.lit(3.0)) + 0.000086 / F.pow("_te", F.lit(5.0)))
            .when(true > -0.575, _poly(true, 1735.0, -518.2, 103.4, -12.79, 0.711))
            .otherwise(-20.774 / c("_te")) / 3600.0
        },
    ]
    result = frame
    for step in steps:
        result = result.withColumns(step)
    return result.select(*frame.columns, "azimuth", "elevation")
