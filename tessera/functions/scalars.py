"""Row-level functions: logs, distances, codes, flag strings and month arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius, kilometres.
EARTH_KM = 6371.0088


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_log(c: str | Column) -> Column:
    """ln, null for values of zero or less."""
    return F.when(col(c) > 0, F.ln(col(c)))


def transform_value(c: str | Column, how: str) -> Column:
    """``none``, ``log`` (null at or below zero) or ``log1p`` (null at or below -1)."""
    return {"none": col(c), "log": safe_log(c), "log1p": F.when(col(c) > -1, F.log1p(col(c)))}[how]


def log1p_abs(c: str | Column) -> Column:
    return F.log1p(F.abs(col(c)))


def real_growth(nominal: str | Column, prices: str | Column) -> Column:
    """Growth beyond prices, ``(1 + nominal) / prices - 1``."""
    return F.try_divide(1 + col(nominal), col(prices)) - 1


def shown_pct(share: str | Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.round(col(share) * 100, 1)


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0)
    )
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def gaussian_similarity(distance: str | Column, sigma: str | Column | float) -> Column:
    s = F.lit(float(sigma)) if isinstance(sigma, (int, float)) else col(sigma)
    return F.exp(-F.pow(F.try_divide(col(distance), s), F.lit(2.0)))


def gravity_log(mass_i: str, mass_j: str, distance: str, beta: float, least: float) -> Column:
    """ln of both masses minus ``beta`` times ln of the distance, at least ``least``."""
    return safe_log(mass_i) + safe_log(mass_j) - beta * F.ln(F.greatest(col(distance), F.lit(float(least))))


def version_distance(year: str | Column, start: str, end: str) -> Column:
    """Years from a point to the half-open interval; 0 inside."""
    y = col(year)
    return F.when(y < col(start), col(start) - y).when(y >= col(end), y - col(end) + 1).otherwise(0)


def month_fields(date: str) -> dict[str, Column]:
    """``year`` and ``month`` of a ``YYYY-MM`` string; other strings give null."""
    ok = col(date).rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    return {
        "year": F.when(ok, F.substring(date, 1, 4).cast("int")),
        "month": F.when(ok, F.substring(date, 6, 2).cast("int")),
    }


def month_columns(date: str, first_year: int, last_year: int) -> dict[str, Column]:
    """``t`` (months since January of the first year), ``year`` and ``month`` of ``YYYY-MM``; others, and other years, raise."""
    fields = month_fields(date)
    ok = fields["year"].between(first_year, last_year)
    t = F.when(ok, (fields["year"] - first_year) * 12 + fields["month"] - 1).otherwise(
        F.raise_error(F.concat(F.lit("no month of the panel: "), F.coalesce(col(date), F.lit("null"))))
    )
    return {"t": t.cast("int"), **fields}


def section_letter(label: str | Column, total: str, pattern: str, alike: Mapping[str, str]) -> Column:
    """The pattern's group, look-alike letters replaced; ``TOTAL`` for exactly the total's label; null without a match."""
    found = F.translate(F.regexp_extract(col(label), pattern, 1), "".join(alike), "".join(alike.values()))
    return F.when(col(label) == total, F.lit("TOTAL")).otherwise(F.nullif(found, F.lit("")))


def dummies(c: str | Column, values: Sequence[str], prefix: str) -> dict[str, Column]:
    """A 0/1 column for each value but the first; null counts as none of them."""
    return {f"{prefix}{i}": F.coalesce((col(c) == v).cast("int"), F.lit(0)) for i, v in enumerate(values) if i}


def month_ordinal(ts: str | Column, base_year: int) -> Column:
    return ((F.year(col(ts)) - base_year) * 12 + F.month(col(ts)) - 1).cast("int")


def normalize_code(c: str | Column, length: int = 8) -> Column:
    """Digits only; eight of them, or eleven that end in zeros, of which eight stay; else null."""
    digits = F.regexp_replace(col(c), r"\D", "")
    return F.when(F.length(digits) == length, digits).when(
        (F.length(digits) == length + 3) & digits.endswith("000"), F.substring(digits, 1, length)
    )


def code_prefix(c: str | Column, length: int = 2) -> Column:
    return F.substring(col(c), 1, length)


def map_or_fail(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Mapped value; an unknown value that isn't null raises when evaluated."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.create_map(*pairs)[col(c)]
    return F.when(col(c).isNull() | found.isNotNull(), found).otherwise(
        F.raise_error(F.concat(F.lit("unknown value: "), col(c)))
    )


def join_flags(columns: Sequence[str | Column]) -> Column:
    """Sorted union of ``;``-separated flag strings; null if there is none."""
    parts = F.flatten(F.array(*[F.coalesce(F.split(col(c), ";"), F.array().cast("array<string>")) for c in columns]))
    union = F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), ";")
    return F.nullif(union, F.lit(""))


def has_flag(c: str | Column, flags: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(col(c), ";"), F.array(*[F.lit(f) for f in flags])), F.lit(False))


def compare_errors(a: str | Column, b: str | Column, tolerance: float = 1e-12) -> Column:
    """``a``, ``b`` or ``tie``: which error is smaller beyond the tolerance."""
    return (
        F.when(col(a).isNull() | col(b).isNull(), F.lit(None).cast("string"))
        .when(col(a) < col(b) - tolerance, F.lit("a"))
        .when(col(b) < col(a) - tolerance, F.lit("b"))
        .otherwise("tie")
    )
