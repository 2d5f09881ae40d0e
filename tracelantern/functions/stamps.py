"""The first and the last time stamp of a file as fixed-width aggregates.

A stamp is 14 digits in fixed places.  Behind the number of its line they are one decimal,
so the smallest decimal of a file has the stamp of its first line with one: no text in an
aggregation buffer, no sort.  Digits may be of any script; a second decimal, behind the
same number, says of which, and is smallest for the same line.
"""

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places that the line number is moved up by, and a type that holds both.
_ROOM, _PACKED, _CODE = 26, "decimal(38,0)", "decimal(26,0)"
_DIGITS = 14


@lru_cache(maxsize=None)
def _zeros() -> str:
    """The digit zero of every script that has digits, ASCII first."""
    return "".join(chr(c) for c in range(0x110000) if unicodedata.decimal(chr(c), -1) == 0)


def _all_digits() -> str:
    return "".join(chr(ord(zero) + k) for zero in _zeros() for k in range(10))


# Any letter may stand for a script while digits are packed.
_LETTER = 0x4E00


def _behind(line_no: Column, code: Column) -> Column:
    return (line_no.cast("decimal(12,0)") * F.lit(str(10**_ROOM)).cast("decimal(27,0)") + code.cast(_CODE)).cast(_PACKED)


def packed(line_no: Column, stamp: Column) -> tuple[Column, Column]:
    """Two decimals for a stamp, null where it is null; line numbers end at 10^12."""
    plain = stamp.rlike("^[0-9T :-]*$")
    digits = F.when(plain, stamp).otherwise(F.translate(stamp, _all_digits(), "0123456789" * len(_zeros())))
    value = F.concat(F.regexp_replace(digits, "[^0-9]", ""), F.when(stamp.contains("T"), "1").otherwise("0")).cast("long")
    letters = "".join(chr(_LETTER + k) * 10 for k in range(len(_zeros())))
    scripts = F.aggregate(
        F.split(F.regexp_replace(F.translate(stamp, _all_digits(), letters), "[T :-]", ""), ""), F.lit(0).cast(_CODE),
        lambda code, letter: (code * len(_zeros()) + F.ascii(letter) - _LETTER).cast(_CODE),
    )
    return _behind(line_no, value), _behind(line_no, F.when(plain, F.lit(0).cast(_CODE)).when(stamp.isNotNull(), scripts))


def unpacked(values: Column, scripts: Column) -> Column:
    """The stamp of two decimals."""
    text = F.substring(F.lpad(values.cast("string"), 38, "0"), 24, _DIGITS + 1)
    code = F.substring(F.lpad(scripts.cast("string"), 38, "0"), 39 - _ROOM, _ROOM).cast(_CODE)
    zeros = F.lit([ord(zero) for zero in _zeros()])

    def digit(place: int) -> Column:
        plain = F.substring(text, place + 1, 1)
        script = F.pmod(F.floor(code / F.lit(str(len(_zeros()) ** (_DIGITS - 1 - place))).cast(_CODE)), F.lit(len(_zeros())))
        # code points beyond 16 bits take two halves
        point = F.element_at(zeros, script.cast("int") + 1) + plain.cast("int")
        return F.when(code == 0, plain).otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))

    year, month, day, hour, minute, second = (
        F.concat(*[digit(k) for k in places]) for places in (range(4), (4, 5), (6, 7), (8, 9), (10, 11), (12, 13))
    )
    between = F.when(F.substring(text, _DIGITS + 1, 1) == "1", "T").otherwise(" ")
    return F.concat(year, F.lit("-"), month, F.lit("-"), day, between, hour, F.lit(":"), minute, F.lit(":"), second)
