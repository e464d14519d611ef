"""Check digits as integer Column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def digit(c: Column, place: int) -> Column:
    return F.substring(c, place, 1).cast("int")


def weighted(c: Column, weights: list[int]) -> Column:
    return reduce(lambda a, b: a + b, (digit(c, i + 1) * w for i, w in enumerate(weights)))


def tax_id_ok(c: Column) -> Column:
    """Ten digits: places 1 to 9 times themselves, modulo 11, is the tenth. A remainder of ten never is."""
    return F.when(c.rlike("^[0-9]{10}$"), weighted(c, [*range(1, 10)]) % 11 == digit(c, 10)).otherwise(False)


def social_ok(c: Column) -> Column:
    """Nine digits: weights 3 and 7 in turn, modulo 10, give the ninth."""
    return F.when(c.rlike("^[0-9]{9}$"), weighted(c, [3, 7] * 4) % 10 == digit(c, 9)).otherwise(False)


def block_ok(c: Column) -> Column:
    """Eight digits: weights 9, 7, 3, 1, 9, 7, 3; the eighth makes the sum a multiple of ten."""
    return F.when(c.rlike("^[0-9]{8}$"), (10 - weighted(c, [9, 7, 3, 1, 9, 7, 3]) % 10) % 10 == digit(c, 8)).otherwise(False)


def blocks_ok(c: Column) -> Column:
    """An account number's hyphened blocks, each with its own check digit."""
    return F.forall(F.split(c, "-"), block_ok)


def iban_ok(c: Column) -> Column:
    """ISO 13616: country and check digits moved to the end, letters as two-digit numbers, modulo 97 is one.

    The remainder is carried over pieces of at most seven digits, so no number outgrows a long.
    """
    compact = F.upper(F.regexp_replace(c, "[\\s ]", ""))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    number = F.array_join(F.transform(F.split(turned, ""), lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")
    pieces = F.transform(F.sequence(F.lit(1), F.length(number), F.lit(7)), lambda i: F.substring(number, i, F.lit(7)))
    rest = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: F.pmod(F.concat(a.cast("string"), p).cast("long"), F.lit(97)).cast("long"))
    return F.when(compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), rest == 1).otherwise(False)
