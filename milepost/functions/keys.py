"""Column expressions for keys and numbers in event tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_missing(c: Column) -> Column:
    """Null, blank, or the text "nan" in any case (a NaN reads as that)."""
    text = F.trim(c.cast("string"))
    return text.isNull() | (text == "") | (F.lower(text) == "nan")


def finite(c: Column) -> Column:
    """A double, with NaN and the infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_number(c: Column) -> Column:
    """A finite double from a number or text; commas and blanks are dropped.

    The column's type is known when the query is planned, so only one branch is
    left of this: numbers never pass through text.
    """
    text = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(""))
    number = F.typeof(c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    # every number begins so; a text that can't be cast costs an exception inside
    begins = text.rlike(r"^[\x00-\x20]*[-+.0-9]")
    return F.when(number, finite(c.try_cast("double"))).otherwise(finite(F.when(begins & ~is_missing(c), text.try_cast("double"))))


@dataclass(frozen=True)
class PadRule:
    """How route ids are padded with zeros: ``numeric`` ids only, ``all`` ids,
    or ``off``; ``width`` is held between 0 and 32."""

    mode: str = "numeric"
    width: int = 8

    def __post_init__(self) -> None:
        if self.mode not in ("numeric", "all", "off"):
            raise ValueError(f"pad mode {self.mode!r}: numeric, all or off")
        object.__setattr__(self, "width", max(0, min(32, int(self.width))))


#: Numbers with a point, as text.
DECIMAL = r"^[-+]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"


def pad_route_id(c: Column, rule: PadRule = PadRule()) -> Column:
    """The route id as it is compared: trimmed, a decimal number cut to its
    whole part, padded by ``rule``; missing ids are null."""
    text = F.trim(c.cast("string"))
    padded = lambda t: F.lpad(t, F.greatest(F.length(t), F.lit(rule.width)), "0")
    if rule.mode == "off":
        padded = lambda t: t
    by_rule = lambda t: F.when(t.rlike("^[0-9]+$"), padded(t)).otherwise(t) if rule.mode == "numeric" else padded(t)
    number = text.try_cast("double")
    # bound to a name, as it is looked at several times
    whole = F.transform(F.array(F.format_string("%.0f", F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double"))), by_rule)[0]
    # most ids are plain digits; only what looks like a decimal number is read as one
    return F.when(text.rlike("^[0-9]+$"), padded(text)).when(text.rlike(DECIMAL) & finite(number).isNotNull(), whole).when(~is_missing(c), by_rule(text))


def parse_date(c: Column) -> Column:
    """A timestamp from the common ways to write one; null if none fits."""
    text = F.trim(c.cast("string"))
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "M/d/yyyy H:mm", "yyyy/M/d", "yyyyMMdd"]
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def measure_text(c: Column) -> Column:
    """A measure as plain decimal text: 0.496, 5, never with an exponent."""
    x = c.cast("double")
    text, size = x.cast("string"), F.abs(x)
    # most are written so without an exponent or rounding: formatting costs far more
    short = ((size == 0) | size.between(1e-3, 9e6)) & (F.length(text) - F.instr(text, ".") <= 10)
    plain = F.when(short, text).otherwise(F.format_string("%.10f", x))
    return F.when(c.isNotNull(), F.rtrim(F.rtrim(plain, F.lit("0")), F.lit(".")))
