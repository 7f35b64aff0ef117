"""Column expressions: missing values, complex products, phase, geometry, time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from echofold.params import C_LIGHT


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, which is the only missing value we keep."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def power(re: Column, im: Column) -> Column:
    """Squared magnitude of a sample, NULL where it is not finite."""
    return finite(re * re + im * im)


def safe_div(num: Column, den: Column) -> Column:
    """NULL where the denominator is zero (ANSI mode raises otherwise)."""
    return num / F.nullif(den, F.lit(0.0))


def mean_in_order(values: Column) -> Column:
    """Mean of an array's doubles added one after another; NULLs do not count, no value gives NULL."""
    v = F.filter(values, lambda x: x.isNotNull())
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(v), F.lit(0))


def steady_mean(c: Column, unit: int = 1_000_000_000) -> Column:
    """Mean of positions or times whose sum does not depend on the order of the rows.

    Whole parts and fractions (to 1 / unit) are added as whole numbers, so a mean
    on the edge of a rounding stays there.
    """
    c, n = c.cast("double"), F.nullif(F.count(c), F.lit(0))
    whole = F.floor(c)
    s, part = F.sum(whole), F.sum(F.round((c - whole) * unit).cast("long"))
    rest = s % n
    return ((s - rest) / n) + (rest + part / float(unit)) / n


def field(name: str):
    """Lambda that takes one field of a struct, for array functions."""
    return lambda e: e[name]


def conj_product(sec_re, sec_im, ref_re, ref_im) -> tuple[Column, Column]:
    """sec * conj(ref) as (re, im)."""
    return (sec_re * ref_re + sec_im * ref_im, sec_im * ref_re - sec_re * ref_im)


def wrap(phase: Column) -> Column:
    """Angle folded into (-pi, pi]."""
    return F.atan2(F.sin(phase), F.cos(phase))


def db(power: Column) -> Column:
    """Decibels; NULL for non-positive power."""
    return F.when(power > 0, 10.0 * F.log10(power))


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = (F.unix_date(F.to_date(ts)).cast("long") * 86400
             + F.hour(ts) * 3600 + F.minute(ts) * 60)
    micros = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
    return whole * 1000000 + micros


def is_aligned(cols: list[str], aligned="aligned", applied="coalign_applied") -> Column:
    """Usable-pair flag: explicit flag, else alignment applied, else usable."""
    parts = [F.col(c) for c in (aligned, applied) if c in cols]
    return F.coalesce(*parts, F.lit(True))


def zmotion_applied(c: Column | None) -> Column:
    """Build flag; products that do not carry it were compensated."""
    return F.lit(True) if c is None else F.coalesce(c, F.lit(True))


def kz(fc, n, sign: int = -1) -> Column:
    """Phase per metre of displacement at refractive index n."""
    return F.lit(sign * 4.0 * math.pi / C_LIGHT) * fc * n


def predicted_shift(mean_dz: Column, applied: Column) -> Column:
    """Delay a vertical baseline puts on a compensated pair."""
    return F.when(applied, -mean_dz / (C_LIGHT / 2)).otherwise(F.lit(0.0))


def local_metres(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """(east, north) metres from a reference point, equirectangular.

    Fixed values: 110540 m per degree of latitude, 111320 m per degree of
    longitude at the equator.
    """
    north = (lat - lat0) * 110540.0
    east = (lon - lon0) * 111320.0 * F.cos(F.radians(lat0))
    return east, north


def polar_stereo_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Antarctic polar stereographic metres (WGS84, true scale at 71 S, central meridian 0).

    Snyder (1987), ellipsoidal polar form.
    """
    a, f = 6378137.0, 1 / 298.257223563
    e = math.sqrt(f * (2 - f))
    ts = math.radians(71.0)

    def t_of(sin_phi, tan_half):
        return tan_half / F.pow((1 - e * sin_phi) / (1 + e * sin_phi), F.lit(e / 2))

    t_c = math.tan(math.pi / 4 - ts / 2) / (
        (1 - e * math.sin(ts)) / (1 + e * math.sin(ts))) ** (e / 2)
    m_c = math.cos(ts) / math.sqrt(1 - (e * math.sin(ts)) ** 2)
    phi = F.radians(-lat)
    t = t_of(F.sin(phi), F.tan(F.lit(math.pi / 4) - phi / 2))
    rho = F.lit(a * m_c / t_c) * t
    lam = F.radians(lon)
    return rho * F.sin(lam), rho * F.cos(lam)


def legendre(x: Column, order: int) -> list[Column]:
    """P0..PK at x by the three-term recurrence."""
    p = [F.lit(1.0), x]
    for k in range(1, order):
        p.append(((2 * k + 1) * x * p[k] - k * p[k - 1]) / (k + 1))
    return p[: order + 1]


def legendre_slope(x: Column, order: int) -> list[Column]:
    """First derivatives of P0..PK at x."""
    p = legendre(x, order)
    d = [F.lit(0.0), F.lit(1.0)]
    for k in range(1, order):
        d.append((2 * k + 1) * p[k] + d[k - 1])
    return d[: order + 1]
