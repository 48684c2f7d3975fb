"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity cut to [0, 1]; 0 for empty vectors, unequal lengths or a zero norm."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(fits, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; null for empty vectors or unequal lengths."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.sqrt(square))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + distance); 0 where there is no distance."""
    return F.coalesce(1 / (1 + euclidean(a, b)), F.lit(0.0))


def parse(json: Column) -> Column:
    """A JSON list of numbers; malformed or empty text gives an empty vector."""
    return F.coalesce(F.from_json(json, "array<double>"), F.array().cast("array<double>"))


def packed_bits(values: Column, least: Column | float = 0.0) -> Column:
    """Sign bits (value > least) packed into 64-bit words, the first value in the lowest bit."""
    least = F.lit(float(least)) if isinstance(least, (int, float)) else least
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / 64).cast("int") - 1, F.lit(0)))

    def word(k: Column) -> Column:
        part = F.slice(values, k * 64 + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(x > least, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))

    return F.transform(words, word)


def median_of(values: Column) -> Column:
    """The median of an array; of an even number the mean of the middle two."""
    ordered, n = F.sort_array(values), F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(ordered, half).cast("double")).otherwise((F.get(ordered, half - 1).cast("double") + F.get(ordered, half).cast("double")) / 2)


def hamming_similarity(a: Column, b: Column, bits: Column | int) -> Column:
    """1 - differing bits / bits, over packed words."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    return 1 - apart / bits
