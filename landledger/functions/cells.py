"""Typed reading and tolerant comparison of untyped table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances of the comparison.
REL_TOL, ABS_TOL = 1e-3, 1e-9
GEOM_REL_TOL, GEOM_INT_SLACK, GEOM_INT_SHARE = 1e-2, 2, 0.01
NEAR_MISS_FACTOR = 10

# Words read as booleans.
TRUE_WORDS, FALSE_WORDS = ["true", "yes", "t"], ["false", "no", "f"]

_INT = r"^[+-]?\d+(_\d+)*$"
_FLOAT = r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"

CELL = "struct<kind:string,i:bigint,n:string,d:double,s:string>"


def _then(value: Column, step) -> Column:
    """``step(value)`` with the value computed once, however often the step reads it."""
    return F.element_at(F.transform(F.array(value), step), 1)


def parse(raw: Column) -> Column:
    """Integer, else float, else trimmed text, as ``struct<kind, i, n, d, s>``.

    ``n`` spells an integer of any size without leading zeros; ``i`` is null beyond 64 bits.
    """

    def numbers(text: Column) -> Column:
        plain = F.replace(text, F.lit("_"), F.lit(""))
        digits = F.regexp_replace(F.regexp_replace(plain, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
        return F.struct(
            F.when(text.rlike(_INT), plain.try_cast("bigint")).alias("i"),
            F.when(text.rlike(_INT), F.when(digits == "-0", "0").otherwise(digits)).alias("n"),
            F.when(text.rlike(_FLOAT), plain.try_cast("double")).alias("d"),
            text.alias("s"),
        )

    def typed(read: Column) -> Column:
        kind = F.when(read["n"].isNotNull(), "i").when(read["d"].isNotNull(), "f").otherwise("s")
        return F.struct(kind.alias("kind"), read["i"].alias("i"), read["n"].alias("n"), read["d"].alias("d"), read["s"].alias("s"))

    return _then(_then(F.trim(F.coalesce(raw, F.lit("")), F.lit(" \t\r\n")), numbers), typed)


def word_value(cell: Column) -> Column:
    """The boolean a word stands for, null for anything but a boolean word."""
    word = F.lower(cell["s"])
    return F.when(
        cell["kind"] == "s", F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)
    )


def boolean_value(cell: Column) -> Column:
    return F.coalesce(word_value(cell), F.when((cell["kind"] == "i") & cell["i"].isin(0, 1), cell["i"] == 1))


def decimals(value: Column) -> Column:
    """Decimal places of a double in its shortest form, null from 1e16 up and below 1e-4."""

    def count(size: Column) -> Column:
        return _then(
            size.cast("string"),
            lambda text: F.when(
                (size == 0) | ((size >= 1e-4) & (size < 1e16)),
                F.greatest(
                    F.length(F.regexp_replace(text, r"^\d+\.(0(?=E|$))?|E.*$", ""))
                    - F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0)),
                    F.lit(1),
                ),
            ),
        )

    return _then(F.abs(value), count)


def quantize(answer: Column, golden: Column) -> Column:
    """Answer rounded to the precision the golden value is written with."""

    def rounded(scale: Column) -> Column:
        # beyond 2^53 a double has no fraction left to round
        keep = scale.isNull() | (F.abs(answer * scale) > 2.0**53)
        return F.when(keep, answer).otherwise(F.rint(answer * scale) / scale)

    return _then(F.pow(F.lit(10.0), decimals(golden)), rounded)


def close(a: Column, b: Column, rel: Column) -> Column:
    def near(x: Column) -> Column:
        finite = (F.abs(x) < float("inf")) & (F.abs(b) < float("inf"))
        room = F.greatest(rel * F.greatest(F.abs(x), F.abs(b)), F.lit(ABS_TOL))
        return ~F.isnan(x) & ~F.isnan(b) & ((x == b) | (finite & (F.abs(x - b) <= room)))

    return _then(a, near)


def matches(answer: Column, golden: Column, geometry: Column, slack: float = 1.0) -> Column:
    """True where a parsed answer cell equals the golden cell within tolerance."""
    a_word, g_word = word_value(answer), word_value(golden)
    a_bool, g_bool = boolean_value(answer), boolean_value(golden)
    as_boolean = (a_word.isNotNull() | g_word.isNotNull()) & a_bool.isNotNull() & g_bool.isNotNull()
    both_int = (answer["kind"] == "i") & (golden["kind"] == "i")
    both_num = (answer["kind"] != "s") & (golden["kind"] != "s")
    gap = F.abs(answer["d"] - golden["d"])
    room = F.lit(slack) * F.greatest(F.lit(float(GEOM_INT_SLACK)), GEOM_INT_SHARE * F.abs(golden["d"]))
    loose = geometry | F.lit(slack > 1.0)
    rel = F.lit(slack) * F.when(geometry, GEOM_REL_TOL).otherwise(REL_TOL)
    both_text = (answer["kind"] == "s") & (golden["kind"] == "s")
    return (
        F.when(as_boolean, a_bool == g_bool)
        .when(both_int, F.when(loose, gap <= room).otherwise(answer["n"] == golden["n"]))
        .when(both_num, close(quantize(answer["d"], golden["d"]), golden["d"], rel))
        .when(both_text, F.lower(answer["s"]) == F.lower(golden["s"]))
        .otherwise(F.lit(False))
    )
