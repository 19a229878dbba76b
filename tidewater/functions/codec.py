"""Strict text codecs: flat JSON objects with an exact set of fields, and decimals as text.

JSON parsers forgive what a ledger must not: a repeated name, a number with a fraction, a
field that is new or lacking. Here the members of an object are read off its text by one
pattern, so they can be counted and their literals told apart, and every row gets the first
rule that it breaks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"'
_LITERAL = rf"{_TEXT}|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null"
_MEMBER = rf"\s*{_TEXT}\s*:\s*(?:{_LITERAL})\s*"
_NAME = rf"^\s*({_TEXT})\s*:\s*"
_BLANKS = " \t\n\x0b\f\r"
#: Kinds of fields, with the literals that they take. A trailing ? in a schema allows null.
KINDS = {
    "integer": r"^-?(0|[1-9][0-9]{0,18})$",
    "boolean": r"^(true|false)$",
    "decimal": r'^"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?"$',
}
_TYPES = {"integer": "bigint", "boolean": "boolean", "decimal": "string"}


def _pieces(text: Column) -> Column:
    """The members of a flat object as text, with the white space around them."""
    return F.regexp_extract_all(text, F.lit(_MEMBER), F.lit(0))


def _named(pieces: Column) -> Column:
    """(name, literal) of members."""
    literal = lambda m: F.rtrim(F.regexp_replace(m, _NAME, ""), F.lit(_BLANKS))
    return F.transform(pieces, lambda m: F.struct(F.regexp_replace(F.regexp_extract(m, _NAME, 1), '^"|"$', "").alias("name"), literal(m).alias("literal")))


def members(text: Column) -> Column:
    """(name, literal) of a flat object's members in order, repeated ones too; names without quotes."""
    return _named(_pieces(text))


def field_difference(names: Column, expected: Sequence[str]) -> tuple[Column, Column]:
    """Names that are missing and names that are unknown, both sorted."""
    wanted = F.array(*map(F.lit, expected))
    return F.sort_array(F.array_except(wanted, names)), F.sort_array(F.array_except(names, wanted))


def _flat(text: Column, pieces: Column) -> Column:
    """Whether a text is its members with commas between them and braces round them."""
    joined = F.concat(F.lit("{"), F.array_join(pieces, ","), F.lit("}"))
    return F.when(F.size(pieces) > 0, F.btrim(text, F.lit(_BLANKS)) == joined).otherwise(text.rlike(r"^\s*\{\s*\}\s*$"))


def _literal(found: Column, name: str) -> Column:
    own = F.filter(found, lambda m: m["name"] == name)
    return F.coalesce(F.try_element_at(own, F.lit(-1))["literal"], F.lit("null"))


def _checked(flat: Column, names: Column, literals: Mapping[str, Column], schema: Mapping[str, str], exact: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    missing, unknown = field_difference(names, list(schema))
    rules = {"not_a_flat_object": flat, "repeated_field": F.size(F.array_distinct(names)) == F.size(names)}
    if exact:
        rules |= {"missing_field": F.size(missing) == 0, "unknown_field": F.size(unknown) == 0}
    columns = {}
    for name, kind in schema.items():
        bare, literal = kind.rstrip("?"), literals[name]
        good = literal.rlike(KINDS[bare])
        value = F.when(good, F.regexp_replace(literal, '^"|"$', "").try_cast(_TYPES[bare]))
        if bare == "integer":
            good &= value.isNotNull()
        rules[f"wrong_{name}"] = good | (literal == "null") if kind.endswith("?") else good
        columns[name] = value
    return columns, rules


def decoded(text: Column, schema: Mapping[str, str], exact: bool = True) -> tuple[dict[str, Column], dict[str, Column]]:
    """Columns of a flat object, and the rules it has to meet, in the order they are tried.

    ``schema`` has a kind for each field. With ``exact`` there may be no other field.
    Columns are null where the literal isn't of its kind. Decimals stay text. Every column
    reads the text anew; over a table use ``decoded_rows``.
    """
    found = members(text)
    names = F.transform(found, lambda m: m["name"])
    return _checked(_flat(text, _pieces(text)), names, {c: _literal(found, c) for c in schema}, schema, exact)


def decoded_rows(df: DataFrame, text: str, schema: Mapping[str, str], exact: bool = True) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """``decoded`` of a text column: rows to take the columns and rules from.

    One pass of one pattern takes a row's members apart, in columns of their own, from which
    the rest follows; the optimizer keeps such columns apart rather than copy what they cost.
    """
    rows = df.withColumn("_pieces", _pieces(F.col(text))).withColumns({"_flat": _flat(F.col(text), F.col("_pieces")), "_members": _named(F.col("_pieces"))})
    literals = {f"_literal_{c}": _literal(F.col("_members"), c) for c in schema}
    rows = rows.withColumns({"_names": F.transform("_members", lambda m: m["name"]), **literals}).drop("_pieces", "_members")
    columns, rules = _checked(F.col("_flat"), F.col("_names"), {c: F.col(f"_literal_{c}") for c in schema}, schema, exact)
    return rows, columns, rules


def encoded(fields: Mapping[str, Column], schema: Mapping[str, str]) -> Column:
    """A flat object's text, fields in the order of ``schema``; decimals as text, null spelt out."""
    parts = []
    for name, kind in schema.items():
        value = fields[name].cast("string")
        shown = F.concat(F.lit('"'), value, F.lit('"')) if kind.rstrip("?") == "decimal" else value
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(shown, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def financial_text(value: Column, kind: T.DataType) -> Column:
    """Plain decimal text of a decimal, whole number or decimal text; null for text that is none.

    Binary floats are refused when the query is made: they have lost the digits already.
    """
    if isinstance(kind, (T.FloatType, T.DoubleType, T.BooleanType)):
        raise TypeError(f"financial values are not {kind.simpleString()}")
    if not isinstance(kind, T.StringType):
        return value.cast("string")
    plain = F.when(value.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), value)
    exponent = value.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)[eE][+-]?[0-9]{1,3}$")
    number = value.try_cast("decimal(38,18)")
    shown = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    expanded = F.when(exponent, F.when(number == 0, "0").otherwise(shown))
    return F.coalesce(F.regexp_replace(plain, r"^\+", ""), expanded)
