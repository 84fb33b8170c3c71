"""Scalar column expressions: hydraulics, text cleaning, return periods, kernels."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HYDRAULIC_PARAMETERS = ("wse", "depth", "velocity")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- hydraulics -----------------------------------------------------------------------------------


def depth(value: str | Column, elevation: str | Column) -> Column:
    """Water depth, never negative; NaN stays NaN."""
    return F.greatest(_col(value) - _col(elevation), F.lit(0.0))


def raw_depth(series: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """Depth that may be negative: level minus the cell's elevation."""
    joined = series.join(cells.select("cell_id", "elevation"), "cell_id")
    return joined.select(*series.columns, (F.col(value) - F.col("elevation")).alias("raw_depth"))


def speed(vx: str | Column, vy: str | Column) -> Column:
    return F.sqrt(_col(vx) * _col(vx) + _col(vy) * _col(vy))


def floor_to_ground(value: str | Column, elevation: str | Column, fill_nan: bool = True) -> Column:
    """Raise a level below ground to ground; optionally treat NaN as ground too."""
    value, elevation = _col(value), _col(elevation)
    below = value < elevation
    if fill_nan:
        below = below | F.isnan(value) | value.isNull()
    return F.when(below, elevation).otherwise(value)


def max_surface(*cols: str | Column) -> Column:
    """Highest of several levels; one of them may be given twice or alone."""
    picked = [_col(c) for c in cols]
    return picked[0] if len(picked) == 1 else F.greatest(*picked)


def hydraulic_value(df: DataFrame, parameter: str) -> DataFrame:
    """``value`` that is modelled: level, clipped depth, or speed."""
    if parameter == "wse":
        value = F.col("wse")
    elif parameter == "depth":
        value = depth("wse", "elevation")
    elif parameter == "velocity":
        value = speed("vx", "vy")
    else:
        raise ValueError(f"unknown hydraulic parameter {parameter!r}; use one of {HYDRAULIC_PARAMETERS}")
    return df.withColumn("value", value)


# --- text and time --------------------------------------------------------------------------------

# The three solver time layouts, as regular expression and date pattern.
TIME_LAYOUTS = (
    (r"(\d{2}[A-Za-z]{3}\d{4} \d{2}:\d{2}:\d{2}\.\d+)", "ddMMMyyyy HH:mm:ss.SSSSSS"),
    (r"(\d{2}[A-Za-z]{3}\d{4} \d{2}:\d{2}:\d{2})", "ddMMMyyyy HH:mm:ss"),
    (r"(\d{2}[A-Za-z]{3}\d{4}:\d{4})", "ddMMMyyyy:HHmm"),
)


def parse_model_time(col: str | Column) -> Column:
    """Timestamp found in a solver label or record path; text without one is an error."""
    text = _col(col)
    parsed = []
    for regex, layout in TIME_LAYOUTS:
        found = F.regexp_extract(text, regex, 1)
        day = F.initcap(F.substring(found, 1, 9))
        rest = F.substring(found, 10, 32)
        # Fractions may have any number of digits up to six.
        whole = F.rpad(rest, 16, "0") if layout.endswith("SSSSSS") else rest
        parsed.append(F.when(found != "", F.try_to_timestamp(F.concat(day, whole), F.lit(layout))))
    failure = F.raise_error(F.concat(F.lit("no model time in: "), text))
    return F.coalesce(*parsed, F.when(text.isNotNull(), failure.cast("timestamp"))).cast("timestamp_ntz")


def clean_boundary_id(col: str | Column) -> Column:
    """Trim, then drop one leading ``bc_`` and one trailing ``_base``."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(col)), "^bc_", ""), "_base$", "")


def rewrite_path_dates(col: str | Column, start: str | Column, end: str | Column) -> Column:
    """Put ``start-end`` (ddMonyyyy) in the fifth part of a ``/``-separated record path."""
    parts = F.split(_col(col), "/")
    window = F.concat_ws("-", F.date_format(_col(start), "ddMMMyyyy"), F.date_format(_col(end), "ddMMMyyyy"))
    rest = F.slice(parts, 6, F.greatest(F.size(parts) - 5, F.lit(0)))
    return F.concat_ws("/", F.slice(parts, 1, 4), F.array(window), rest)


def file_name(col: str | Column) -> Column:
    """Last component of a local path or URI; object-store URIs are percent-decoded."""
    text = _col(col)
    # Object stores have no query part in the path we need; decode only the path.
    path = F.regexp_extract(text, r"^s3://[^/?#]*([^?#]*)", 1)
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    plain = F.when(text.startswith("s3://"), decoded).otherwise(text)
    return F.substring_index(F.regexp_replace(plain, "/+$", ""), "/", -1)


def feature_class(col: str | Column) -> Column:
    return F.when(_col(col).startswith("precip_"), F.lit("precip")).otherwise(F.lit("boundary"))


# --- return periods -------------------------------------------------------------------------------


def rp_close(a: str | Column, b: str | Column, tol: float = 0.15) -> Column:
    """Whether two return periods differ by less than ``tol`` of the larger."""
    a, b = _col(a), _col(b)
    return F.try_divide(F.abs(a - b), F.greatest(a, b)) < tol


def log_dist(p: str | Column, q: str | Column, rp: str | Column | float) -> Column:
    """Joint log10 distance of two return periods to a target; NULL where a log is undefined."""
    target = F.lit(float(rp)) if isinstance(rp, (int, float)) else _col(rp)
    a, b = F.log10(_col(p) / target), F.log10(_col(q) / target)
    return F.sqrt(a * a + b * b)


def confidence_band(df: DataFrame, level: float = 0.95, mean: str = "mean", var: str = "var") -> DataFrame:
    """Add ``low`` and ``high`` of the central normal interval."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    half = F.lit(z) * F.sqrt(F.col(var))
    return df.withColumns({"low": F.col(mean) - half, "high": F.col(mean) + half})


# --- kernels --------------------------------------------------------------------------------------

KERNELS = ("Matern12", "Matern32", "Matern52", "RBF", "Exponential")
UNUSABLE_KERNELS = ("Linear", "Polynomial", "Periodic")


def check_kernel(name: str) -> str:
    if name in UNUSABLE_KERNELS:
        raise ValueError(f"kernel {name} has no (variance, lengthscale) form and cannot be fitted; use one of {KERNELS}")
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; use one of {KERNELS}")
    return name


def kernel(name: str, variance: float = 1.0, lengthscale: float = 1.0):
    """Column function of the squared distance for one stationary kernel."""
    check_kernel(name)

    def of_squared_distance(d2: str | Column) -> Column:
        r = F.sqrt(_col(d2)) / F.lit(float(lengthscale))
        if name == "Matern12":
            shape = F.exp(-r)
        elif name == "Matern32":
            s = F.lit(3.0**0.5) * r
            shape = (1 + s) * F.exp(-s)
        elif name == "Matern52":
            s = F.lit(5.0**0.5) * r
            shape = (1 + s + s * s / 3) * F.exp(-s)
        elif name == "RBF":
            shape = F.exp(-r * r / 2)
        else:
            shape = F.exp(-r / 2)
        return F.lit(float(variance)) * shape

    return of_squared_distance
