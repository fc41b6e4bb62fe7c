"""Scalar functions of the feature layer, as column expressions.

Missing is NULL throughout. Floating NaN from outside becomes NULL on the way in, since Spark orders NaN above all
numbers; text that isn't a number becomes NULL, and a division by zero does.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included; trim() knows the ASCII blank alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """Text to double; anything but a plain decimal number is NULL ('12d', 'NaN' and '1_000' too)."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def values_to_null(c: Column, values: Iterable) -> Column:
    return F.when(~c.isin(list(values)), c)


def filled(c: Column, token: str = "__NA__") -> Column:
    """Stripped text; missing or empty becomes the token."""
    return F.coalesce(F.nullif(strip(c.cast("string")), F.lit("")), F.lit(token))


def keep_or(c: Column, keep: Iterable[str], other: str = "OTHERS") -> Column:
    text = strip(c.cast("string"))
    return F.when(text.isin(sorted(keep)), text).otherwise(other)


def flag(condition: Column) -> Column:
    """1 where the condition holds; 0 where it doesn't or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom where bottom is above 0."""
    return F.when(bottom > 0, top / bottom)


def right_closed(c: Column, edges: Sequence[float], labels: Sequence[str], outside: str = "nan") -> Column:
    """Label of the bin (edge, next edge]; outside all of them, or missing, the text for that."""
    cases = [F.when((c > low) & (c <= high), label) for low, high, label in zip(edges, edges[1:], labels)]
    return F.coalesce(*cases, F.lit(outside))


def by_range(c: Column, cases: Sequence[tuple[float, Column]], above: Column) -> Column:
    """The value of the first case whose bound c doesn't exceed, else `above`; missing stays missing."""
    out = F.when(c.isNull(), None)
    for bound, value in cases:
        out = out.when(c <= bound, value)
    return out.otherwise(above)


def sum_of_known(columns: Sequence[Column]) -> Column:
    """Row-wise sum in which missing counts as 0; all missing gives missing."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def first_match(c: Column, pattern: str) -> Column:
    """The first group of the first match, else NULL."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def token(c: Column, index: int) -> Column:
    """The token at this place (from 0) among those between white space, else NULL."""
    return F.get(F.split(strip(c), r"(?U)\s+"), F.lit(index))


def split_once(c: Column) -> tuple[Column, Column, Column]:
    """The stripped text, what precedes its first white space, and what follows; '' for what isn't there."""
    text = F.coalesce(strip(c), F.lit(""))
    parts = F.split(text, r"(?U)\s+", 2)
    return text, F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def joined_key(*parts: Column) -> Column:
    """The parts with a blank between, missing ones empty, stripped."""
    pieces = [F.coalesce(p, F.lit("")) for p in parts]
    return strip(F.concat_ws(" ", *pieces))


def text_key(*parts: Column) -> Column:
    """The parts as text with a blank between; missing reads 'nan', so that missing parts equal each other."""
    return F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("nan")) for p in parts])


def squeezed(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def without_tokens(c: Column, suffix: str) -> Column:
    """Without the tokens that end in the suffix."""
    return F.array_join(F.filter(F.split(squeezed(c), " "), lambda t: ~F.endswith(t, F.lit(suffix))), " ")


def checked(c: Column, digits: int) -> Column:
    """c as text; raises where it isn't so many digits."""
    text = c.cast("string")
    bad = F.raise_error(F.concat(F.lit(f"not {digits} digits: "), F.coalesce(text, F.lit("missing"))))
    return F.when(text.rlike(rf"^\d{{{digits}}}$"), text).otherwise(bad)


def year_month_quarter(ym: Column) -> tuple[Column, Column, Column]:
    """Parts of YYYYMM; raises on anything else."""
    text = checked(ym, 6)
    month = F.substring(text, 5, 2).cast("int")
    return F.substring(text, 1, 4).cast("int"), month, F.floor((month - 1) / 3).cast("int") + 1


def positive_gap(a: Column, b: Column) -> Column:
    """max(a - b, 0), missing if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a - b, F.lit(0)))


def _half_chord(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    a, b = F.radians(y1), F.radians(y2)
    return F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)


def haversine(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Great-circle kilometres, by the arc tangent."""
    h = _half_chord(y1, x1, y2, x2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine_by_sine(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Great-circle kilometres, by the arc sine."""
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(_half_chord(y1, x1, y2, x2), F.lit(1.0))))


def planar(y: Column, x: Column, lat0: Column) -> tuple[Column, Column]:
    """Kilometres north and east on a plane true at latitude lat0."""
    return F.radians(y) * EARTH_KM, F.radians(x) * F.cos(F.radians(lat0)) * EARTH_KM


def power_weight(n: Column, exponent: float = 0.7) -> Column:
    return F.pow(n.cast("double"), F.lit(exponent))


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("long")


def snake_case(name: str) -> str:
    out = ""
    for i, ch in enumerate(name):
        starts = ch.isupper() and i > 0 and (not name[i - 1].isupper() or name[i + 1 : i + 2].islower())
        out += ("_" if starts else "") + ch.lower()
    return out


def parameter_tag(params: Mapping[str, object], short: Mapping[str, str]) -> str:
    """A file-name tag such as _n400_lr005: the short name and value of each known parameter, dots left out."""
    return "".join(f"_{short[k]}{str(params[k]).replace('.', '')}" for k in short if k in params)
