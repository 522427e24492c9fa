"""Scalar JSON values as text, and lengths counted the way JSON clients count them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def longer_than(text: Column, limit: int) -> Column:
    """Whether the text has more than ``limit`` UTF-16 units.

    UTF-8 never has fewer bytes than UTF-16 has units, and UTF-16 never fewer units than
    characters, so these lengths settle nearly every row and the re-encoding runs on the rest only.
    """
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return (F.octet_length(text) > limit) & ((F.char_length(text) > limit) | (units > limit))


def kind(value: Column) -> Column:
    """Type name of a variant; NULL when the value is missing altogether."""
    return F.schema_of_variant(value)


def is_number(value_kind: Column) -> Column:
    return value_kind.isin("BIGINT", "DOUBLE", "FLOAT") | value_kind.startswith("DECIMAL")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value, so that using it often computes it once and keeps the plan small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shortest(number: Column) -> Column:
    """Shortest ``d.ddde±x`` text that reads back as the same double."""
    # Every double of at most 15 digits reads back from them, so trailing zeros can go; below
    # the smallest normal double fewer digits are significant and each length is tried.
    attempts = [F.format_string(f"%.{digits}e", number) for digits in (14, 15, 16)]
    found = F.coalesce(*[F.when(a.try_cast("double") == number, a) for a in attempts])
    short = [F.format_string(f"%.{digits}e", number) for digits in range(17)]
    tiny = F.coalesce(*[F.when(a.try_cast("double") == number, a) for a in short])
    trimmed = F.regexp_replace(F.regexp_replace(found, r"0+e", "e"), r"\.e", "e")
    return F.when(number < 2.2250738585072014e-308, tiny).otherwise(trimmed)


def _written_out(number: Column, style: Callable[[Column, Column, Column], Column]) -> Column:
    """``style`` gets the sign, the digits without a point, and the first digit's exponent."""
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))

    def styled(parts: Column) -> Column:
        return let(
            F.struct(
                F.replace(parts[0], F.lit("."), F.lit("")).alias("digits"),
                parts[1].try_cast("int").alias("exponent"),
            ),
            lambda d: style(sign, d["digits"], d["exponent"]),
        )

    return F.when(number == 0, F.lit("0")).otherwise(
        let(F.abs(number), lambda size: let(F.split(_shortest(size), "e"), styled))
    )


def _positional(sign: Column, digits: Column, exponent: Column) -> Column:
    size = F.length(digits)
    return F.concat(
        sign,
        F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
        .when(exponent >= size - 1, F.rpad(digits, exponent + 1, F.lit("0")))
        .otherwise(
            F.concat(
                F.substring(digits, F.lit(1), exponent + 1),
                F.lit("."),
                F.substring(digits, exponent + 2, size),
            )
        ),
    )


def _with_exponent(sign: Column, digits: Column, exponent: Column) -> Column:
    fraction = F.when(
        F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))
    ).otherwise(F.lit(""))
    mark = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    power = F.abs(exponent).cast("string")
    return F.concat(sign, F.substring(digits, 1, 1), fraction, mark, power)


def _as_displayed(sign: Column, digits: Column, exponent: Column) -> Column:
    """Numbers as shown to people: an exponent from 1e21 up and below 1e-6."""
    return F.when(exponent.between(-6, 20), _positional(sign, digits, exponent)).otherwise(
        _with_exponent(sign, digits, exponent)
    )


def _exact_integer(value: Column) -> Column:
    """Integers up to 2^53 are exact in a double."""
    return value.try_cast("bigint").between(-(2**53), 2**53)


def scalar_text(value: Column) -> Column:
    """Text of a string, boolean or number; numbers in full positional notation.

    JSON numbers are doubles to their producers, so integers beyond 2^53 and long
    decimals take the double's value first.
    """
    through_double = let(value.try_cast("double"), lambda n: _written_out(n, _positional))
    # Fixed value: 15 digits are exact in a double.

    def number_text(value_kind: Column, text: Column) -> Column:
        digits = F.regexp_replace(text, r"^[-0.]+|\.", "")
        return (
            F.when((value_kind != "DOUBLE") & (F.length(text) <= 15), text)
            .when((value_kind == "BIGINT") & _exact_integer(value), text)
            .when(value_kind.startswith("DECIMAL") & (F.length(digits) <= 15), text)
            .otherwise(through_double)
        )

    def by_kind(value_kind: Column) -> Column:
        text = value.try_cast("string")
        return F.when(value_kind.isin("STRING", "BOOLEAN"), text).otherwise(
            let(text, lambda t: number_text(value_kind, t))
        )

    return let(kind(value), by_kind)


def _number_display(value: Column, value_kind: Column) -> Column:
    def shown(number: Column) -> Column:
        infinite = F.when(number > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity"))
        return F.when(F.abs(number) == float("inf"), infinite).otherwise(
            _written_out(number, _as_displayed)
        )

    # Such an integer's own text is what its double shows, without the search for its digits.
    plain = (value_kind == "BIGINT") & _exact_integer(value)
    return F.when(plain, value.try_cast("string")).otherwise(let(value.try_cast("double"), shown))


def _display_scalar(value: Column, value_kind: Column) -> Column:
    return (
        F.when(value_kind.isin("STRING", "BOOLEAN"), value.try_cast("string"))
        .when(is_number(value_kind), _number_display(value, value_kind))
        .otherwise(F.lit("[object Object]"))
    )


#: Lists within lists that are written out; a deeper list shows as its JSON.
_NESTED_LISTS = 3


def _display_item(item: Column, depth: int) -> Column:
    """An item of a list: null is empty, a list joins its own items."""
    return let(
        kind(item),
        lambda name: F.when(F.is_variant_null(item), F.lit(""))
        .when(name.startswith("ARRAY"), _display_list(item, depth))
        .otherwise(_display_scalar(item, name)),
    )


def _display_list(value: Column, depth: int) -> Column:
    if depth == 0:
        return F.to_json(value)
    items = value.try_cast("array<variant>")
    return F.array_join(F.transform(items, lambda item: _display_item(item, depth - 1)), ",")


def display_text(value: Column) -> Column:
    """Any JSON value inside a message: missing is ``undefined``, lists join with commas."""
    value_kind = kind(value)
    return (
        F.when(value.isNull(), F.lit("undefined"))
        .when(F.is_variant_null(value), F.lit("null"))
        .when(value_kind.startswith("ARRAY"), _display_list(value, _NESTED_LISTS))
        .otherwise(_display_scalar(value, value_kind))
    )


@lru_cache(maxsize=8)
def attributes_text(column: str) -> Column:
    """Every attribute value as text, in the row itself; an empty map when there are none."""
    texts = F.transform_values(
        F.col(column).try_cast("map<string,variant>"), lambda _, value: scalar_text(value)
    )
    return F.coalesce(texts, F.create_map().cast("map<string,string>"))
