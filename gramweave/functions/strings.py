"""Column functions on strings: positions are 0-based and count characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_at(text: Column, at: Column) -> Column:
    """The character at a position; null outside the text."""
    return F.when((at >= 0) & (at < F.length(text)), F.substring(text, at + 1, F.lit(1)))


def mismatches(a: Column, b: Column) -> Column:
    """Places where two strings of one length differ."""
    differ = lambda j: F.substring(a, j, F.lit(1)) != F.substring(b, j, F.lit(1))
    return F.when(a == b, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.length(a)), differ)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    most = F.least(F.length(a), F.length(b))
    differ = lambda j: F.substring(a, j, F.lit(1)) != F.substring(b, j, F.lit(1))
    first = F.array_min(F.filter(F.sequence(F.lit(1), most), differ))
    return F.when(most == 0, F.lit(0)).otherwise(F.coalesce(first - 1, most))


def only_of(text: Column, alphabet: str) -> Column:
    """Whether all characters are of the alphabet."""
    return F.translate(text, alphabet, "") == ""


def one_of(char: Column, alphabet: str) -> Column:
    return F.instr(F.lit(alphabet), char) > 0


def bit_width(x: Column) -> Column:
    """Binary digits of a positive number."""
    return F.length(F.bin(x))


def duration(seconds: Column) -> Column:
    """Whole seconds as hours, minutes and seconds: 3723 is `1h 2m 3s`."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s.cast("long"))).when(m > 0, F.format_string("%dm %ds", m, s.cast("long"))).otherwise(F.format_string("%ds", s.cast("long")))
