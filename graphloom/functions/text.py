"""String helpers with the exact edge rules the tables need (all JVM-side columns)."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, and what ends a line of source text.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
OTHER_LINE_END = r"\r\n?|[\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"  # all but a plain \n
ENDERS = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def strip(c: Column) -> Column:
    """Both-ends strip of any white space; plain `trim` would only remove blanks."""
    return F.btrim(c, F.lit(SPACES))


def split_lines(c: Column) -> Column:
    """Lines of a text; a final line end does not open another line."""
    body = F.when(c.endswith("\r\n"), F.left(c, F.length(c) - 2)).when(
        F.right(c, F.lit(1)).isin(ENDERS), F.left(c, F.length(c) - 1)).otherwise(c)
    # A split on one plain character compiles no pattern for each text.
    return F.split(F.regexp_replace(body, OTHER_LINE_END, "\n"), "\n")


def or_else(first: Column, *others: Column) -> Column:
    """First value that is neither NULL nor the empty string; else the last argument."""
    options = [first, *others]
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options[:-1]], options[-1])


def glob_pattern(globs: list[str]) -> str:
    """One anchored regex for a list of shell globs; runs once on the driver."""
    return "^(" + "|".join(re.sub(r"^\(\?s:|\)\\[Zz]$", "", fnmatch.translate(g)) for g in globs) + ")$"


def any_fragment(fragments: list[str]) -> str:
    """Regex that is true when any of the plain fragments occurs."""
    return "|".join(re.escape(f) for f in fragments)


def human_size(size: Column) -> Column:
    """1536 -> '1.5 KB'; one decimal, halves to even."""
    def shown(unit: str, divisor: int) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(size / F.lit(float(divisor)), 1))

    ladder = F.when(size < 1024, shown("B", 1))
    for power, unit in enumerate(["KB", "MB", "GB"], start=1):
        ladder = ladder.when(size < 1024 ** (power + 1), shown(unit, 1024 ** power))
    return ladder.otherwise(shown("TB", 1024 ** 4))


def truncate(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit)
