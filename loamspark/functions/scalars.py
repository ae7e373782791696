"""Column functions; all built from Spark's own, none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of numerals: letters, and the spellings of a decimal digit at each place.
LETTERS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ONES = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
TENS = ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")
HUNDREDS = ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")


def leading_int(text: Column) -> Column:
    """The number that the text begins with, 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def leading_double(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def first_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n][\s\S]*$", "")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def mean_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), c, lambda s, z: (s + z) / 3)


def series_expectation(n: Column) -> Column:
    """0 + 1 + ... + (n - 2)."""
    return F.floor((n - 2) * (n - 1) / 2).cast("long")


def repeated_value(values: Column) -> Column:
    """Of a list with 0 to n - 2 and one of them twice, that one."""
    total = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    return total - series_expectation(F.size(values))


def letter_value(letter: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair]), letter)


def decode_numeral(text: Column) -> Column:
    """A smaller letter before a larger one is taken off it, and the two are used up.  Null for other letters; 0 for "".

    The fold keeps the sum so far and the letter that still waits for its neighbour.
    """
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def step(s: Column, c: Column) -> Column:
        v, held = letter_value(c), s["held"]
        taken = v > held
        total = s["total"] + F.when(held == 0, 0).when(taken, v - held).otherwise(held)
        return F.struct(total.alias("total"), F.when((held > 0) & taken, 0).otherwise(v).alias("held"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("held"))
    known = ~text.rlike("[^IVXLCDM]")
    return F.when(known, F.aggregate(letters, start, step, lambda s: s["total"] + s["held"]))


def encode_numeral(n: Column) -> Column:
    """The shortest spelling; thousands are repeated, and below 1 it is empty."""
    digit = lambda names, unit: F.element_at(F.array(*map(F.lit, names)), (F.floor(n / unit) % 10 + 1).cast("int"))
    spelled = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(HUNDREDS, 100), digit(TENS, 10), digit(ONES, 1))
    return F.when(n > 0, spelled).when(n.isNotNull(), "")


def saved_letters(text: Column) -> Column:
    return F.length(text) - F.length(encode_numeral(decode_numeral(text)))


def rotated(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """A vector turned about the origin, its coordinates cut to whole numbers."""
    a = F.radians(degrees)
    return (x * F.cos(a) - y * F.sin(a)).cast("int"), (x * F.sin(a) + y * F.cos(a)).cast("int")
