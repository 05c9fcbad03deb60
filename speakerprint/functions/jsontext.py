"""Strict JSON objects out of free text, as VARIANT values.

An expression that is used several times inside a lambda or a branch is computed as often; :func:`bound` computes it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from speakerprint.functions.vectors import as_col


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), 0)


def strict_object(text: str | Column) -> Column:
    """VARIANT of a text that is exactly one JSON object, else null.

    The text is parsed inside a one-element array, because the parser alone accepts trailing
    characters after a complete value. Of equal keys the last counts, as in scripts, where the session allows them
    (``session.ship`` and ``get_session`` do); otherwise such an object is null.
    """

    def parsed(t: Column) -> Column:
        items = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).try_cast("array<variant>")
        return F.when(t.startswith("{") & t.endswith("}"), bound(items, lambda a: F.when(F.size(a) == 1, F.get(a, 0))))

    return bound(as_col(text), parsed)


def keys_of(value: Column) -> Column:
    """Keys of an object, also of null values; none where there is no object."""
    return F.coalesce(F.map_keys(value.try_cast("map<string,variant>")), F.array().cast("array<string>"))


def script_number(value: Column) -> Column:
    """Text of a double as a script writes it: the fewest digits that give the number again, 21 places before an exponent is used."""

    def told(v: Column) -> Column:
        whole = v.cast("bigint").cast("string")
        special = F.when(v == 0, "0").when(F.abs(v) == float("inf"), F.when(v < 0, "-Infinity").otherwise("Infinity"))
        return special.when((F.abs(v) < 1e15) & (F.floor(v) == v), whole).otherwise(
            bound(_shortest(F.abs(v)), lambda s: F.concat(F.when(v < 0, "-").otherwise(""), _placed(s)))
        )

    return bound(value, told)


def _shortest(value: Column) -> Column:
    """Scientific notation with the fewest digits that give the number again.

    The engine's own digits but the last are tried first: where they do not give the number, as nearly always, none is spared.
    """
    own = F.call_function("printf", F.lit("%.16e"), value)
    kept = F.length(F.rtrim(F.split_part(own, F.lit("e"), F.lit(1)), F.lit("0"))) - 2

    def searched(digits: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda p: _scientific(value, p))
        every = F.get(F.filter(tries, lambda t: t.cast("double") == value), 0)
        return F.when(digits == 0, _scientific(value, digits)).when(_scientific(value, digits - 1).cast("double") != value, _scientific(value, digits)).otherwise(every)

    return bound(kept, searched)


def _placed(scientific: Column) -> Column:
    """Scientific notation as a script places its digits."""
    parts = F.struct(
        F.rtrim(F.replace(F.split_part(scientific, F.lit("e"), F.lit(1)), F.lit("."), F.lit("")), F.lit("0")).alias("digits"),
        (F.split_part(scientific, F.lit("e"), F.lit(2)).cast("int") + 1).alias("places"),
    )

    def text(found: Column) -> Column:
        digits, places = found["digits"], found["places"]
        size = F.length(digits)
        fraction = F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit(""))
        exponent = F.concat(F.substr(digits, F.lit(1), F.lit(1)), fraction, F.when(places > 1, "e+").otherwise("e"), (places - 1).cast("string"))
        return (
            F.when((size <= places) & (places <= 21), F.rpad(digits, places, F.lit("0")))
            .when((places > 0) & (places <= 21), F.concat(F.substr(digits, F.lit(1), places), F.lit("."), F.substr(digits, places + 1)))
            .when((places > -6) & (places <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -places), digits))
            .otherwise(exponent)
        )

    return bound(parts, text)


def _scientific(value: Column, digits: Column) -> Column:
    """Scientific notation with so many digits after the point."""
    return F.call_function("printf", F.concat(F.lit("%."), digits.cast("string"), F.lit("e")), value)


def script_text(value: Column) -> Column:
    """Text of a JSON value as a script's string conversion writes it.

    38.0 and 38 are both "38", 1.5e10 is "15000000000", null is "null", a flat array is its values joined by commas.
    """

    def told(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return bound(
            kind,
            lambda k: F.when(k == "VOID", "null")
            .when(k.isin("DOUBLE", "FLOAT", "BIGINT") | k.startswith("DECIMAL"), script_number(v.try_cast("double")))
            .when(k.startswith("ARRAY"), F.array_join(v.try_cast("array<string>"), ",", ""))
            .when(k.startswith("OBJECT"), "[object Object]")
            .otherwise(v.try_cast("string")),
        )

    return bound(value, told)
