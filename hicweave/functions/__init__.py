"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and their complements, with ambiguity codes.
LETTERS = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENTS = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"


def floor_div(x: Column, by: Column | int) -> Column:
    """Whole division of counts and positions, which are not negative; no step through fractions."""
    return F.call_function("div", x.cast("long"), F.lit(by).cast("long"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, LETTERS, COMPLEMENTS))


def half(v: Column) -> Column:
    """v rounded to half precision, as a double: 11 significant bits, half to even, no steps below 2 ** -24."""
    e = F.greatest(F.floor(F.log2(v)), F.lit(-14))
    scale = F.pow(F.lit(2.0), F.lit(10) - e)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.bround(v * scale) / scale)


def transposed(code: Column) -> Column:
    """The pair code when the two contigs change places: 1 and 2 swap."""
    return F.when(code.isin(1, 2), 3 - code).otherwise(code)
