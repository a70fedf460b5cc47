"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns (E1b, E2, and the pair score of R1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of the hashing encoder: runs of letters or digits, lower-cased.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product of two equally long vectors, summed in DOUBLE (cosine once both are L2-normalised).

    For scoring explicit (query, article) pairs. Ranking a whole corpus goes through the block ranker
    (quarry.operators.rank), which never materialises all pairs.
    """
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_normalize(col) -> Column:
    """V / ||v||; a zero vector stays zero. Result is ARRAY<DOUBLE>.

    The norm is the accumulator handed to the finish function, so it is computed once per row (a norm
    expression inside the element lambda would be re-evaluated for every element). Pass a column
    reference: an expression given here is evaluated twice.
    """
    v = _col(col)
    return F.aggregate(
        v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda acc: F.transform(v, lambda x: F.when(acc > 0, x.cast("double") / F.sqrt(acc)).otherwise(F.lit(0.0))))
