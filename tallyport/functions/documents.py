"""JSON documents read strictly: one value and nothing behind it, fields of their types, names in any case.

A document becomes a VARIANT once and is opened level by level: an object as a struct of VARIANTs, whose types are then
checked. What a lenient reader turns into nulls (a number for a text, a fraction for a count, cut or trailing text) is an
error here. Null stands for a missing value everywhere; a missing text is empty, a missing count 0, a missing list empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical(raw: Column, names: tuple[str, ...]) -> Column:
    """The text with these names of members as they are given, whatever case they had. In JSON a quoted word before a
    colon is a name, never part of a text, whose quotes are escaped."""
    text = raw.cast("string")
    anywhere = "|".join(names)
    fixed = text
    for name in names:
        fixed = F.regexp_replace(fixed, rf'(?i)"{name}"(\s*:)', f'"{name}"$1')
    return F.when(text.rlike(rf'"(?!(?:{anywhere})")(?i:{anywhere})"\s*:'), fixed).otherwise(text)


def enclosed(text: Column) -> Column:
    """A VARIANT list with the one JSON value of a text as its first element; null if there is none, or anything behind
    it, or a repeated name.

    The parser stops behind the first value it can close, so the text is read as the first element of a list whose
    second one is the text's own hash: a text with more than one value, or one that closes the list itself, would have to
    hold its own hash in that place.
    """

    def read(t: Column) -> Column:
        mark = F.hex(F.xxhash64(t["text"]))
        whole = F.struct(mark.alias("mark"), F.try_parse_json(F.concat(F.lit("["), t["text"], F.lit(',"'), mark, F.lit('"]'))).alias("v"))
        return let(whole, lambda w: F.when(F.try_variant_get(w["v"], "$[1]", "string") == w["mark"], w["v"]))

    return let(F.struct(text.alias("text")), read)


def document(text: Column) -> Column:
    """The one JSON value of a text as a VARIANT; see :func:`enclosed`."""
    return F.try_variant_get(enclosed(text), "$[0]", "variant")


def opened(value: Column, names: tuple[str, ...], path: str = "$") -> Column:
    """An object as a struct of VARIANTs, null for anything else."""
    return F.try_variant_get(value, path, "struct<" + ",".join(f"{n}:variant" for n in names) + ">")


def is_null(value: Column) -> Column:
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))


def fits(value: Column, kind: str) -> Column:
    """Whether a value is missing, null or of a kind: STRING, or BIGINT for a number of 63 bits without point or
    exponent."""
    return value.isNull() | F.schema_of_variant(value).isin(kind, "VOID")


def text_of(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))


def count_of(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "bigint"), F.lit(0).cast("bigint"))


def elements(value: Column) -> Column:
    """The elements of a list, none if it is missing; null for anything else."""
    return F.when(is_null(value), F.array().cast("array<variant>")).otherwise(F.try_variant_get(value, "$", "array<variant>"))


def all_fit(items: Column, kind: str) -> Column:
    """Whether there are ``items``, and all are of a kind."""
    return F.coalesce(F.forall(items, lambda v: fits(v, kind)), F.lit(False))


def texts_fit(value: Column) -> Column:
    """Whether a value is missing, or an object whose values are all texts."""
    return is_null(value) | all_fit(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), "STRING")


def count_at(text: Column, path: str) -> Column:
    """The integer at a path of a JSON text; null if the text is no whole document, or there is none at the path."""
    return let(F.try_variant_get(document(text), path, "variant"), lambda v: F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")))
