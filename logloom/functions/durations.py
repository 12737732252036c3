"""Duration and rate text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import MIB, RATE_PRESETS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stripped(text: Column) -> Column:
    # Anything that is neither a digit nor a letter is ignored: "1.5s" reads as "15s".
    return F.lower(F.regexp_replace(text, r"[^0-9\p{L}]", ""))


def duration_ok(text: Column | str) -> Column:
    """True when the text is a duration: units h/m/s, a trailing bare number is seconds.

    ``500ms`` is not one: ``m`` is minutes and the ``s`` has no number.
    """
    text = _col(text)
    return F.coalesce(
        text.rlike(r"\S") & _stripped(text).rlike(r"^([0-9]+[hms])*([0-9]+)?$"), F.lit(False)
    )


def duration_ms(text: Column | str) -> Column:
    """Milliseconds of a duration text, NULL when it is not one (or exceeds 64 bits)."""
    text = _col(text)
    # Each part is a number with an optional unit; the sum runs inside the row.
    parts = F.regexp_extract_all(_stripped(text), F.lit(r"([0-9]+[hms]?)"), F.lit(1))
    unit = lambda p: (
        F.when(F.endswith(p, F.lit("h")), F.lit(3_600_000)).when(F.endswith(p, F.lit("m")), F.lit(60_000)).otherwise(F.lit(1_000))
    )
    total = F.aggregate(
        parts,
        F.lit(0).cast("bigint"),
        lambda acc, p: F.try_add(acc, F.try_multiply(F.regexp_extract(p, r"^([0-9]+)", 1).try_cast("bigint"), unit(p))),
    )
    return F.when(duration_ok(text), total)


def preset_value(name: Column, what: str) -> Column:
    """``lps`` or ``mb`` of a default preset, NULL for other names."""
    out = None
    for preset, mb, lps in RATE_PRESETS:
        value = F.lit(lps if what == "lps" else mb).cast("bigint")
        out = F.when(name == preset, value) if out is None else out.when(name == preset, value)
    return out


def rate_lps(text: Column | str, presets: Column | None = None) -> Column:
    """Logs per second of a rate text, NULL when it is neither a preset nor a number.

    Preset names are case-sensitive and win; numbers take one K or M suffix in
    any case; fractions are rejected.  ``presets`` replaces the default lookup.
    """
    text = _col(text)
    upper = F.upper(text)
    digits = F.regexp_extract(upper, r"^\+?([0-9]+)[KM]?$", 1)
    factor = F.when(upper.endswith("M"), F.lit(1_000_000)).when(upper.endswith("K"), F.lit(1_000)).otherwise(F.lit(1))
    number = F.when(F.length(digits) > 0, F.try_multiply(digits.try_cast("bigint"), factor.cast("bigint")))
    return F.coalesce(preset_value(text, "lps") if presets is None else presets, number)


def est_throughput_mb(lps: Column | str) -> Column:
    """MB/s of a rate at 200 bytes per line, rounded up."""
    return F.ceil(_col(lps).cast("double") * F.lit(200.0) / F.lit(float(MIB))).cast("bigint")
