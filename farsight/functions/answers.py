"""Typed reading of JSON answers by path.

An answer is parsed once to a variant, and its fields are taken by name into a struct of variants, whose types are then
looked at. Members that are not asked for are ignored wherever they stand. Names match in any case, the exact spelling
first; a whole number may stand in a string. A field that is there with another JSON type makes the answer
unusable. Absent and null fields are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# A reader gives the value of a variant and whether the variant has another type than the reader's.
Reader = Callable[[Column], tuple[Column, Column]]


def text(value: Column) -> tuple[Column, Column]:
    """A JSON string."""
    return F.try_variant_get(value, "$", "string"), ~F.schema_of_variant(value).isin("STRING", "VOID")


def whole(value: Column) -> tuple[Column, Column]:
    """A whole number of 32 bits, also one in a string."""
    shown = F.try_variant_get(value, "$", "string")
    number = F.when(shown.rlike(r"^[+-]?[0-9]+$"), shown.try_cast("int"))
    kind = F.schema_of_variant(value)
    return number, ~kind.isin("BIGINT", "STRING", "VOID") | ((kind != "VOID") & number.isNull())


def texts(value: Column) -> tuple[Column, Column]:
    """A list of strings and nulls."""
    parts = F.try_variant_get(value, "$", "array<variant>")
    other = (F.schema_of_variant(value) != "VOID") & F.coalesce(F.exists(parts, lambda p: F.coalesce(text(p)[1], F.lit(False))), F.lit(True))
    return F.transform(parts, lambda p: text(p)[0]), other


def _member(of: Column, name: str) -> Column:
    folded = F.map_values(F.map_filter(of, lambda k, _: F.lower(k) == name.lower()))
    return F.coalesce(F.element_at(of, name), F.get(folded, F.lit(0)))


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _folded(value: Column, fields: dict, nested: dict[str, dict]) -> Column:
    """The fields' variants with names in any case: every object as a map of its members."""

    def struct_of(names) -> Callable[[Column], Column]:
        return lambda m: F.when(m.isNotNull(), F.struct(*[_member(m, n).alias(n) for n in names]))

    def of(members: Column) -> Column:
        parts = {name: F.try_variant_get(_member(members, name), "$", "array<variant>") for name in nested}
        lists = [F.transform(F.transform(parts[name], _members), struct_of(inner)).alias(name) for name, inner in nested.items()]
        return F.when(members.isNotNull(), F.struct(*[_member(members, n).alias(n) for n in fields], *lists))

    return F.get(F.transform(F.array(_members(value)), of), F.lit(0))


def _typed(found: Column, fields: dict[str, Reader], *more: Column) -> Column:
    values = {name: read(found[name]) for name, read in fields.items()}
    other = F.lit(False)
    for _, wrong in values.values():
        other |= F.coalesce(wrong, F.lit(False))
    return F.struct(*[value.alias(name) for name, (value, _) in values.items()], *more, other.alias("other_type"))


def answer(payload: Column, fields: dict[str, Reader], nested: dict[str, dict[str, Reader]] | None = None) -> Column:
    """The typed ``fields`` of a JSON text that is an object, null if it is unusable.

    ``nested`` fields are lists of objects with fields of their own; such a list has to be there and to hold objects
    only. An answer whose names are spelled otherwise is read member by member, all others at once.
    """
    nested = nested or {}
    inner = [name for of in nested.values() for name in of]
    names = "|".join(dict.fromkeys([*fields, *nested, *inner]))
    other_case = F.regexp_count(payload, F.lit(rf'(?i)"({names})"\s*:')) > F.regexp_count(payload, F.lit(rf'"({names})"\s*:'))
    shape = [f"{n}:variant" for n in fields] + [f"{n}:array<struct<{','.join(f'{k}:variant' for k in of)}>>" for n, of in nested.items()]
    exact = lambda v: F.try_variant_get(v, "$", f"struct<{','.join(shape)}>")

    def item(of: dict[str, Reader]) -> Callable[[Column], Column]:
        return lambda i: F.when(i.isNotNull(), _typed(i, of))

    def read(found: Column) -> Column:
        lists = [F.transform(found[name], item(of)).alias(name) for name, of in nested.items()]
        return F.when(found.isNotNull(), _typed(found, fields, *lists))

    def usable(r: Column) -> Column:
        good = r.isNotNull() & ~r["other_type"]
        for name in nested:
            good &= r[name].isNotNull() & ~F.exists(r[name], lambda i: F.coalesce(i["other_type"], F.lit(True)))
        return F.coalesce(good, F.lit(False))

    # Bound one after the other, so that every step is evaluated once.
    found = F.transform(F.array(F.try_parse_json(payload)), lambda v: F.when(other_case, _folded(v, fields, nested)).otherwise(exact(v)))
    return F.get(F.filter(F.transform(found, read), usable), F.lit(0))
