"""Text and JSON columns: strict parsers, names, and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(prefix: str, start_ms: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.call_function("div", start_ms, F.lit(1000)).cast("string"))


def partition_name(base: str, start_ms: Column) -> Column:
    return F.concat(F.lit(f"{base}_p"), start_ms.cast("string"))


def stream_name(symbol: Column, suffix: str) -> Column:
    return F.concat(F.lower(symbol), F.lit("@"), F.lit(suffix))


def bool_of(text: Column) -> Column:
    """true or false by their names, in any case and with blanks around; null otherwise."""
    name = F.lower(F.trim(text))
    return F.when(name == "true", True).when(name == "false", False)


def strict_decimal(text: Column, kind: str = "decimal(38,18)", sign: str = "any") -> Column:
    """Plain decimal text that fits ``kind`` without loss; null otherwise.

    ``sign`` is any, positive or non_negative. Exponents, words and blanks don't count.
    """
    number = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), text.try_cast(kind))
    scale = int(kind.rstrip(")").split(",")[1])
    exact = ~F.regexp_replace(text, r"0+$", "").rlike(rf"\.[0-9]{{{scale + 1},}}$")
    number = F.when(exact | ~text.contains("."), number)
    if sign == "positive":
        return F.when(number > 0, number)
    if sign == "non_negative":
        return F.when(number >= 0, number)
    return number


def strict_integer(text: Column, positive: bool = False) -> Column:
    """Whole-number text that fits 64 bits; null otherwise."""
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.when(number > 0, number) if positive else number


def first_path(doc: Column, *paths: str) -> Column:
    """First non-null value among JSON paths."""
    return F.coalesce(*(F.get_json_object(doc, p) for p in paths))


def unwrapped(doc: Column) -> Column:
    """The ``data`` member of a stream envelope, or the document itself."""
    return F.coalesce(F.get_json_object(doc, "$.data"), doc)


def listed(text: Column) -> Column:
    """A JSON array of strings, or comma-separated text with or without brackets."""
    parsed = F.from_json(text, "array<string>")
    pieces = F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), ",")
    split = F.transform(pieces, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    split = F.filter(split, lambda x: x != "")
    return F.when(text.rlike(r"^\s*\[.*\]\s*$") & parsed.isNotNull(), parsed).otherwise(split)


def json_merge(old: Column, new: Column) -> Column:
    """Top-level union of two flat JSON objects as text, keys sorted; the new one wins."""
    kind = "map<string,string>"
    a, b = F.from_json(old, kind), F.from_json(new, kind)
    a, b = F.coalesce(a, F.create_map().cast(kind)), F.coalesce(b, F.create_map().cast(kind))
    both = F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both))))


def zipped(labels: Column, tokens: Column) -> Column:
    """Pairs (label, token) by position; null unless the arrays are equally long."""
    return F.when(F.size(labels) == F.size(tokens), F.arrays_zip(labels.alias("label"), tokens.alias("token")))
