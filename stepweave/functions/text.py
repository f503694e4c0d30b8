"""Text and JSON as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = "\u0001end"


def parse_document(text: Column) -> Column:
    """The VARIANT of a text that is one whole JSON document, else null.

    ``try_parse_json`` alone also takes a document followed by other text; here the text stands in an array before a mark, and the mark must be the second and last element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"\\u0001end"]')))
    whole = F.try_variant_get(wrapped, "$", "array<variant>")
    return F.when((F.size(whole) == 2) & (F.try_variant_get(F.get(whole, 1), "$", "string") == F.lit(_END)), F.get(whole, 0))


def rounded(value: Column, digits: int) -> Column:
    """Rounded half up; what differs from a half by the last bits of a sum, whose order isn't fixed, counts as the half."""
    return F.round(value + 1e-9, digits)


def json_text(text: Column) -> Column:
    """A text as a JSON string as Python writes it: quotes, backslashes and the control characters below a blank are escaped, nothing else; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    rare = text
    for code in range(32):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), rare).otherwise(text), F.lit('"'))
