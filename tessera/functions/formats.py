"""Numbers as text, as columns: fixed, general, percent and grouped by thousands.

Digits are rounded half up on the number's shortest decimal form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, decimals: int = 4) -> Column:
    return F.format_string(f"%.{decimals}f", x.cast("double"))


def percent(x: Column, decimals: int = 1) -> Column:
    """A share as percent: 0.125 is 12.5%."""
    return F.concat(fixed(x.cast("double") * 100, decimals), F.lit("%"))


def grouped(x: Column) -> Column:
    """A whole number with commas."""
    return F.format_string("%,d", x.cast("long"))


def general(x: Column, digits: int = 6) -> Column:
    """As many significant digits, without trailing zeros; with an exponent below -4 or from ``digits`` on."""
    x = x.cast("double")
    scientific = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.substring_index(scientific, "e", -1).try_cast("int")
    bare = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    plain = F.coalesce(*[F.when(exponent == e, F.format_string(f"%.{digits - 1 - e}f", x)) for e in range(-4, digits)])
    short = F.concat(bare(F.substring_index(scientific, "e", 1)), F.lit("e"), F.substring_index(scientific, "e", -1))
    special = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, "0")
    return F.when(x.isNull(), None).otherwise(F.coalesce(special, F.when((exponent < -4) | (exponent >= digits), short).otherwise(bare(plain))))
