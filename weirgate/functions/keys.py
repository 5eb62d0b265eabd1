"""Column functions that name records: digests of key columns and canonical forms of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATOR, _NULL, _ESCAPE = "\u001f", "\u0000", "\\"


def _escaped(value: Column) -> Column:
    """The value without separators and null marks of its own."""
    for mark, name in ((_ESCAPE, "e"), (_SEPARATOR, "s"), (_NULL, "n")):
        value = F.replace(value, F.lit(mark), F.lit(_ESCAPE + name))
    return value


def record_id(*cols: str) -> Column:
    """A SHA-256 of the key columns in lower case and trimmed; nulls keep their place and equal no value."""
    parts = [F.coalesce(_escaped(F.lower(F.trim(F.col(c).cast("string")))), F.lit(_NULL)) for c in cols]
    return F.sha2(F.concat_ws(_SEPARATOR, *parts), 256)


def content_digest(col: str) -> Column:
    """A SHA-256 of one column as it is; "null" for null."""
    return F.coalesce(F.sha2(F.col(col).cast("string"), 256), F.lit("null"))


def canonical_key(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Lower case, then each pattern replaced in turn."""
    out = F.lower(col)
    for pattern, by in rules:
        out = F.regexp_replace(out, pattern, by)
    return out


#: Scheme, leading www or m, query, fragment, last slash.
URL_RULES = [(r"^[a-z]+://", ""), (r"^(www|m)\.", ""), (r"[?#].*$", ""), (r"/$", "")]
