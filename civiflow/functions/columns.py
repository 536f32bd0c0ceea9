"""Scalar expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the final-status rule.
FINAL_STATUSES = ("closed", "completed")
BAD_STATUS_PATTERN = "cancelled|canceled|invalid|incomplete"

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 86_400_000_000


# Every character text stripping treats as white space.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks; text of graphic ASCII and blanks has no other."""
    return F.when(c.rlike(r"[^ -~]"), F.btrim(c, F.lit(SPACES))).otherwise(F.trim(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_nonempty(df: DataFrame, names: list[str]) -> Column:
    """First non-blank value among the columns that exist."""
    present = [blank_to_null(F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def to_timestamp_or_null(c: Column, formats: list[str] | None = None) -> Column:
    """Zone-less timestamp; text in none of the formats gives NULL."""
    if not formats:
        return c.try_cast("timestamp_ntz")
    tries = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


DECIMAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"

NUMERIC = r"^(tinyint|smallint|int|bigint|float|double|decimal\(.*)$"


def to_double_or_null(c: Column) -> Column:
    """Number; text that is none, and NaN, give NULL.

    Suffixed and hexadecimal literals, which the cast would take, are no numbers.
    The type is a constant of the plan, so columns that are numbers skip the pattern.
    """
    number = F.when(F.typeof(c).rlike(NUMERIC) | c.cast("string").rlike(DECIMAL), c.try_cast("double"))
    return F.nullif(number, F.lit(float("nan")))


def epoch_micros(c: Column) -> Column:
    """Microseconds since 1970; the session time zone is UTC."""
    return F.unix_micros(c.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(float(MICROS_PER_HOUR))


def days_between(start: Column, end: Column) -> Column:
    """Duration in days, NULL when negative."""
    days = (epoch_micros(end) - epoch_micros(start)) / F.lit(float(MICROS_PER_DAY))
    return F.when(days >= 0, days)


def has_final_status(status: Column) -> Column:
    # No letter beyond ASCII becomes one of these words in lower case.
    text = strip(status)
    return text.rlike(rf"(?i)\A(?:{'|'.join(FINAL_STATUSES)})\z") & ~text.rlike(f"(?i){BAD_STATUS_PATTERN}")


def has_valid_coordinates(latitude: Column, longitude: Column) -> Column:
    return (
        latitude.between(-90, 90)
        & longitude.between(-180, 180)
        & ~((latitude == 0) & (longitude == 0))
    )


def routing_target(agency: Column, category: Column) -> Column:
    """Agency that handles the request, its category where no agency is known."""
    return F.coalesce(blank_to_null(agency), category)


def day_of_week(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)


def is_weekend(c: Column) -> Column:
    return F.weekday(c).isin(5, 6).cast("int")


def grid(c: Column, precision: int = 2) -> Column:
    scale = float(10**precision)
    return F.floor(c * F.lit(scale)) / F.lit(scale)


def predicted(score: Column, threshold: float = 0.5) -> Column:
    return (score >= F.lit(float(threshold))).cast("int")


def sigmoid(raw: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))


def attack_confidence(score: Column) -> Column:
    return F.greatest(score, F.lit(1.0) - score)


def pct_overhead(value: Column, baseline: Column) -> Column:
    return F.lit(100.0) * (value - baseline) / F.greatest(F.abs(baseline), F.lit(1e-12))


def megabytes(size: Column) -> Column:
    return size / F.lit(1048576.0)


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become NULL, as JSON has no spelling for them."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.nullif(den, F.lit(0)))


def inner_edges(bins: int) -> list[float]:
    """Inner edges of equal bins over [0, 1], in double arithmetic."""
    return [i * (1.0 / bins) for i in range(1, bins)]


def score_bin(score: Column, bins: int = 10) -> Column:
    """Right-closed bin number: how many inner edges lie below the score."""
    return reduce(lambda a, b: a + b, [(score > F.lit(e)).cast("int") for e in inner_edges(bins)])
