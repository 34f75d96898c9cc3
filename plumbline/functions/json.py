"""Reading loosely shaped JSON: objects as ``map<string, string>``, lists as ``array<string>``.

A nested value is its JSON text, a JSON string its content and a JSON null missing. Keys
are looked up on demand, so a field the source never sent is simply absent. A number
counts as its digits where text is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quantity, text


def as_object(value: Column) -> Column:
    """The object a JSON text holds, missing when it holds anything else."""
    return F.when(F.startswith(F.ltrim(value), F.lit("{")), F.from_json(value, "map<string,string>"))


def as_list(value: Column) -> Column:
    """The list a JSON text holds, missing when it holds anything else."""
    return F.when(F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, "array<string>"))


def member(record: Column, name: Column | str) -> Column:
    return F.try_element_at(record, F.lit(name) if isinstance(name, str) else name)


def as_text(value: Column) -> Column:
    """Non-blank trimmed text; an object is no text."""
    return F.when(~F.startswith(F.ltrim(value), F.lit("{")), text(value))


def as_label(value: Column) -> Column:
    """Text, or what names an object: display name, unique name, name, then id."""
    names = ("displayName", "uniqueName", "name", "id")
    named = [text(F.get_json_object(value, f"$.{n}")) for n in names]
    return F.when(F.startswith(F.ltrim(value), F.lit("{")), F.coalesce(*named)).otherwise(
        text(value)
    )


def as_quantity(value: Column) -> Column:
    """A number or numeric text; anything else is missing."""
    return quantity(value)


def as_id(value: Column) -> Column:
    """A whole number of up to 18 digits; a fraction is cut off, as of a quantity."""
    return F.trim(value.cast("string")).try_cast("decimal(38,4)").try_cast("bigint")


def fields_of(record: Column) -> Column:
    """The nested ``fields`` object, or the record itself."""
    return F.coalesce(as_object(member(record, "fields")), record)


def pick(df: DataFrame, **names: Sequence[str]) -> DataFrame:
    """Stage raw members as columns ``<alias>_0``, ``<alias>_1`` ... , one per name.

    A name is looked up in the ``fields`` column first and then in ``record``. Parsing
    a staged column may repeat it freely; parsing the lookup itself would repeat the
    lookup.
    """
    return df.withColumns(
        {
            f"{alias}_{i}": F.coalesce(
                member(F.col("fields"), name), member(F.col("record"), name)
            )
            for alias, listed in names.items()
            for i, name in enumerate(listed)
        }
    )


def picked(parse, alias: str, count: int) -> Column:
    """First staged member of ``alias`` that parses."""
    return F.coalesce(*[parse(F.col(f"{alias}_{i}")) for i in range(count)])


def first_of(parse, record: Column, names: Sequence[str]) -> Column:
    """First of the named members that parses."""
    return F.coalesce(*[parse(member(record, n)) for n in names])
