"""Text helpers used by several operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a bare strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Text without leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def snippet(text: Column, size: int) -> Column:
    """First ``size`` characters."""
    return F.substring(text, 1, size)


def shortened(text: Column, size: int) -> Column:
    """First ``size`` characters, with ``...`` when something was cut."""
    return F.when(F.length(text) > size, F.concat(snippet(text, size), F.lit("..."))).otherwise(text)


# Position of a token in its file as one LONG, so that "first seen" stays a
# fixed-width aggregate: 39 bits of line number, 24 bits of place in the line.
_PLACE_BITS = 24


def seen_at(line_no: Column, place: Column) -> Column:
    place = F.least(place.cast("long"), F.lit((1 << _PLACE_BITS) - 1))
    return F.shiftleft(line_no.cast("long"), _PLACE_BITS) + place


def seen_line(seen: Column) -> Column:
    return F.shiftright(seen, _PLACE_BITS)
