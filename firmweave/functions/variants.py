"""Small readers over VARIANT values parsed from foreign JSON.

A VARIANT keeps what a typed struct loses: whether a key was absent (SQL NULL)
or present with an explicit null (a variant null).  Each reader is kept to a
few expressions, since a plan holds dozens of them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*(\.0+)?\s*$"
FLOAT_TEXT = (
    r"^\s*[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?\s*$"
)
# how falsy values other than null and '' are rendered
HOLLOW = "0,0.0,-0.0,false,[],{}"

# kinds, as the first letters of the variant's type; NULL means absent
OBJECT, LIST, TEXT, FLAG, NULL, DOUBLE = "OB", "AR", "ST", "BO", "VO", "DO"


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def is_object_text(text: Column) -> Column:
    """Cheap root test for a document that is known to parse."""
    return F.coalesce(text.rlike(r"^[ \t\r\n]*\{"), F.lit(False))


def at(value: Column, path: str) -> Column:
    """The variant at ``path``; SQL NULL when absent."""
    return F.try_variant_get(value, path, "variant")


def raw_text(value: Column, path: str = "$") -> Column:
    """Text as it stands (JSON for nested values); NULL for null and absent."""
    return F.try_variant_get(value, path, "string")


def members(value: Column, ddl: str, path: str = "$") -> Column:
    """The members of an object that the struct type ``ddl`` names, all read in one pass.

    NULL unless the value is an object.  A path looks its keys up one by one, each time
    from the start of the object: name here what is read of nearly every document.
    """
    return F.try_variant_get(value, path, ddl)


def kind(value: Column) -> Column:
    return F.substring(F.schema_of_variant(value), 1, 2)


def is_kind(value: Column, *kinds: str) -> Column:
    """Never NULL: absent is of no kind."""
    return F.coalesce(kind(value).isin(*kinds), F.lit(False))


def is_object(value: Column, path: str = "$") -> Column:
    """Never NULL.  Only an object can be read as a struct; cheaper than naming its whole type."""
    return F.try_variant_get(value, path, "struct<_: variant>").isNotNull()


def as_text(value: Column, path: str = "$", text: Column | None = None) -> Column:
    """Text of any JSON value, keeping emptiness.

    A falsy value that is not text (0, false, empty list or object) becomes the
    empty text so that it still counts as a gap; null and absent become NULL.
    ``text`` is its ``raw_text`` where a column holds that already.
    """
    text = raw_text(value, path) if text is None else text
    # one call: a list of comparisons in dozens of columns outgrows what the JVM compiles
    hollow = F.find_in_set(text, F.lit(HOLLOW)) > 0
    return F.when(hollow & (kind(at(value, path)) != TEXT), F.lit("")).otherwise(text)


def is_hollow(value: Column, path: str = "$", text: Column | None = None) -> Column:
    """Falsy but neither absent nor null: '', 0, false, [] or {}."""
    return F.coalesce(as_text(value, path, text) == "", F.lit(False))


def as_whole_number(value: Column, path: str = "$", text: Column | None = None) -> Column:
    """BIGINT from a whole number, a flag or whole-number text, else NULL.

    A number with a fraction is refused rather than cut, and text must be
    digits (inner underscores and an all-zero fraction are fine).
    """
    text = raw_text(value, path) if text is None else text
    number = F.try_variant_get(value, path, "double")
    digits = F.regexp_replace(text, r"[_\s]|\.0+\s*$", "")
    k = kind(at(value, path))
    return (
        F.when(text.rlike(INT_TEXT), digits.try_cast("bigint"))
        .when(k == FLAG, number.cast("bigint"))
        .when((k == DOUBLE) & (number == F.floor(number)), number.try_cast("bigint"))
    )


def as_number(value: Column, path: str = "$") -> Column:
    """DOUBLE from a number, a flag or number text, else NULL."""
    text = raw_text(value, path)
    plain = F.regexp_replace(text, r"[_\s]", "")
    return F.when(text.rlike(FLOAT_TEXT), plain.try_cast("double")).when(
        kind(at(value, path)) == FLAG, F.try_variant_get(value, path, "double")
    )


def elements(value: Column, path: str = "$") -> Column:
    """The items of a list as ARRAY<VARIANT>; NULL for anything else."""
    return F.try_variant_get(value, path, "array<variant>")


def all_text(value: Column, path: str = "$") -> Column:
    """True for a list holding nothing but text (also the empty list)."""
    return F.coalesce(
        F.forall(elements(value, path), lambda item: F.schema_of_variant(item) == "STRING"),
        F.lit(False),
    )
