"""Numbers in and out of text, and size arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchweave.functions.names import to_col

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def try_float(value) -> Column:
    """Parsed number; NULL for blank or unreadable text."""
    text = F.trim(to_col(value).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def fixed(value, decimals: int) -> Column:
    """Fixed decimals, ties to even."""
    return F.format_string(f"%.{decimals}f", F.bround(to_col(value), decimals))


def or_missing(text: Column, missing: str = "n/a") -> Column:
    return F.coalesce(text, F.lit(missing))


def metric_text(value, decimals: int = 4, missing: str = "n/a") -> Column:
    number = to_col(value)
    return or_missing(F.when(number.isNotNull(), fixed(number, decimals)), missing)


def percent_text(value, decimals: int = 1, missing: str = "n/a") -> Column:
    return metric_text(to_col(value) * 100.0, decimals, missing)


def interval_text(lower, upper, decimals: int = 1) -> Column:
    return F.concat(F.lit("("), percent_text(lower, decimals), F.lit("--"), percent_text(upper, decimals), F.lit(")"))


def mean_std_text(mean, std, decimals: int = 2) -> Column:
    """Percent mean and deviation; a single value has deviation zero, no value reads NA."""
    middle = to_col(mean)
    text = F.concat(
        fixed(middle * 100.0, decimals), F.lit(" ± "), fixed(F.coalesce(to_col(std), F.lit(0.0)) * 100.0, decimals)
    )
    return or_missing(F.when(middle.isNotNull(), text), "NA")


def format_bytes(value) -> Column:
    number = to_col(value).cast("double")
    out = F.concat(fixed(number / float(1024**4), 2), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(number < float(1024 ** (power + 1)), F.concat(fixed(number / float(1024**power), 2), F.lit(" " + unit))).otherwise(out)
    return F.when(number.isNull(), F.lit("n/a")).otherwise(out)


def fit_long_side(width, height, long_side: int) -> tuple[Column, Column]:
    """Aspect-preserving size whose longer edge is ``long_side``; NULL for impossible inputs."""
    w, h = to_col(width), to_col(height)
    longest = F.greatest(w, h)
    scale = F.lit(float(long_side)) / longest.cast("double")

    def edge(side: Column) -> Column:
        scaled = F.greatest(F.lit(1).cast("bigint"), F.bround(side * scale, 0).cast("bigint"))
        return F.when((w <= 0) | (h <= 0), F.lit(None).cast("bigint")).when(longest == long_side, side.cast("bigint")).otherwise(scaled)

    return edge(w), edge(h)
