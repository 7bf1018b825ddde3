"""Scalar functions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_nodes(n: Column) -> Column:
    """1.97M, 56K or the number itself."""
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.2f", n / F.lit(1e6)), F.lit("M")))
        .when(n >= 1_000, F.concat(F.floor(n / 1000).cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def to_number(text: Column, kind: str = "double") -> Column:
    """Bad numbers become null."""
    return text.try_cast(kind)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a, b)


def ratio_percent(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) * 100


def ideal_time(t1: Column, ranks: Column) -> Column:
    return F.try_divide(t1, ranks)


def efficiency(t1: Column, ranks: Column, t: Column) -> Column:
    return F.try_divide(t1, ranks * t)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def gteps(n: Column, m: Column, seconds: Column) -> Column:
    """Traversed edges (n * m) a second, in billions; 0 if no time passed."""
    return F.when(seconds > 0, n.cast("double") * m.cast("double") / seconds / 1e9).otherwise(0.0)


def batch_size(free_bytes: Column, bytes_a_source: Column, most: int = 1024, override: int | None = None) -> Column:
    """Sources processed at once: 85 % of the free memory, between 1 and ``most``. A positive override may only lower it."""
    fits = F.greatest(F.lit(1), F.least(F.floor(free_bytes * 0.85 / bytes_a_source), F.lit(most))).cast("int")
    return F.least(F.lit(override), fits) if override is not None and override > 0 else fits


def cell(value: Column, digits: int, suffix: str = "") -> Column:
    """A table cell; missing values are two dashes."""
    return F.when(value.isNull() | F.isnan(value), F.lit("--")).otherwise(F.concat(F.format_string(f"%.{digits}f", value), F.lit(suffix)))


def on_off(flag: Column) -> Column:
    return F.when(flag != 0, "ON").otherwise("OFF")


def tier(nodes: Column) -> Column:
    """Size class of a graph, which decides the strategies that run on it."""
    return F.when(nodes <= 11_023, "small").when(nodes <= 500_000, "medium").when(nodes <= 2_000_000, "large").otherwise("xlarge")


MOST_NODES = 9_000_000_000  # fixed value: the largest graph that a run list covers

#: The implementations that are run on each size class.
RUNS_ON = {
    "small": ["Sequential", "OpenMP", "GPU", "GPU_Managed", "GPU_ReadMostly", "GPU_Opt"],
    "medium": ["OpenMP", "GPU", "GPU_Managed", "GPU_ReadMostly", "GPU_Opt"],
    "large": ["GPU", "GPU_ReadMostly", "GPU_Opt"],
    "xlarge": ["GPU_Opt"],
}


def runs_on(nodes: Column) -> Column:
    """The implementations that are run on a graph of this size, as an array."""
    size = tier(nodes)
    out = F.lit(None).cast("array<string>")
    for name, those in RUNS_ON.items():
        out = F.when(size == name, F.array(*[F.lit(x) for x in those])).otherwise(out)
    return out
