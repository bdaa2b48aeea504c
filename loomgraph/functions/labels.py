"""Scalar functions for names, stamps and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction_label(f: Column) -> Column:
    """100.0 -> '100', 0.1 -> '0p1'."""
    return F.when(f == F.floor(f), f.cast("long").cast("string")).otherwise(F.replace(f.cast("string"), F.lit("."), F.lit("p")))


def parse_fraction_label(s: Column) -> Column:
    return F.replace(s, F.lit("p"), F.lit(".")).cast("double")


def run_stamp(ts: Column) -> Column:
    """yyyyMMddTHHmmss."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def stamp_of_file(name: Column) -> Column:
    return F.regexp_extract(name, r"\d{8}T\d{6}", 0)


def throughput(nodes: Column, seconds: Column) -> Column:
    """nodes / seconds; 0 if no time has passed."""
    return F.when(seconds <= 0, F.lit(0.0)).otherwise(F.try_divide(nodes.cast("double"), seconds))


def number_list(s: Column, kind: str = "double") -> Column:
    """'1, 10,,100' -> array of numbers; blanks are skipped."""
    return F.transform(F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast(kind))


def first_given(*cols: Column) -> Column:
    """The first value that is neither null nor an empty string ('0' counts)."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in cols))


def figure_label(f: Column) -> Column:
    """As figures are named: '100pct' from 100 on, else up to four decimals without closing zeros, '0.1' -> '0p1pct'."""
    plain = F.regexp_replace(F.format_string("%.4f", f), r"\.?0+$", "")
    return F.when(f >= 100, F.lit("100pct")).otherwise(F.concat(F.replace(plain, F.lit("."), F.lit("p")), F.lit("pct")))
