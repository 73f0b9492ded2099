"""Strict CSV cells as native expressions: no Python runs, and the code generator sees all of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive quantifiers: Java's matcher then loops instead of recursing, so long lines can't overflow its stack.
_CELL = r'"[^"]*+(?:""[^"]*+)*+"|[^",]*+'
_LINE = rf"^(?:{_CELL})(?:,(?:{_CELL}))*+\z"
_QUOTE = r'^\\[.]$|[,"\r\n]|^[ \t\x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'


def _value(v: Column | str) -> Column:
    return F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(""))


def cells(v: Column | str) -> Column:
    """array<string> of a line's cells; null for an empty or malformed line. A null line is an empty one."""
    v = _value(v)
    raw = F.regexp_extract_all(F.concat(F.lit(","), v), F.lit(rf",({_CELL})"), F.lit(1))

    def bare(c: Column) -> Column:
        return F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)

    return F.when((F.length(v) > 0) & v.rlike(_LINE), F.transform(raw, bare))


def nth_cell(v: Column | str, n: int) -> Column:
    """The 1-based nth cell; null if it's absent or the line is malformed."""
    return F.get(cells(v), F.lit(n - 1))


def first_cells(v: Column | str, n: int = 3) -> Column:
    """The first n cells as CSV again; the line itself if it's malformed or nothing remains."""

    def quoted(c: Column) -> Column:
        return F.when(c.rlike(_QUOTE), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    out = F.array_join(F.transform(F.slice(cells(v), 1, n), quoted), ",")
    return F.coalesce(F.nullif(out, F.lit("")), _value(v))
