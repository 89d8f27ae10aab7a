"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

HASH_DIM = 384
STORE_DIM = 1024


def hash_dim(token: Column) -> Column:
    """md5(token) mod 384 from the hex digits: mod 128 is in the last two digits, mod 3 is
    the digit sum (16 leaves 1), and the two determine the rest mod 384."""
    digest = F.md5(token)
    digit = lambda at: F.instr(F.lit("0123456789abcdef"), F.substring(digest, at, 1)) - 1
    ones = 32 - F.length(F.translate(digest, "147ad", ""))
    twos = 32 - F.length(F.translate(digest, "258be", ""))
    low, rest = (digit(31) % 8) * 16 + digit(32), (ones + 2 * twos) % 3
    return (low + 128 * ((rest - low % 3 + 3) * 2 % 3)).cast("int")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y),
                       F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """R2: zero for a zero vector."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def fit_vector(v: Column | str, dim: int = STORE_DIM) -> Column:
    """P20: zero-padded to the stored width; a wider vector is an error."""
    v = _col(v)
    padded = F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim) - F.size(v)))
    too_wide = F.raise_error(F.concat(F.lit("vector has "), F.size(v).cast("string"),
                                      F.lit(f" dims, the column holds {dim}")))
    return F.when(F.size(v) <= dim, padded).otherwise(
        F.when(too_wide.cast("string").isNull(), padded))
