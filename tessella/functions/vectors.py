"""Vector expressions on array columns; all run inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums and norms at or below this count as zero.
TINY = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` scaled to length one; null for a zero vector."""
    length = norm(a)
    return F.when(length > TINY, F.transform(a, lambda x: x.cast("double") / length))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def clamped_cosine(a: Column, b: Column) -> Column:
    """Cosine kept within 0 and 1; 0 for different lengths or a zero vector."""
    lengths = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (lengths > 0)
    return F.when(usable, clamp01(dot(a, b) / lengths)).otherwise(0.0)


def l2_similarity(a: Column, b: Column) -> Column:
    """1 - distance / sqrt(n), kept within 0 and 1; 0 for different lengths."""
    squares = total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, clamp01(1 - F.sqrt(squares) / F.sqrt(F.size(a)))).otherwise(0.0)


def rms_similarity(a: Column, b: Column) -> Column:
    """1 - root mean square distance, rounded to 4 places, not below 0."""
    squares = total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2))
    return F.round(F.greatest(F.lit(0.0), 1 - F.sqrt(squares / F.size(a))), 4)


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes, by 32-bit halves."""
    half = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    bits = [F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 9)]
    return bits[0] + bits[1]
