"""Distances between array columns and signatures of arrays, all as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from simloom.functions.scalars import unit01

# Coefficient weights by bin (rows 0..5) and channel (columns 0..2).
SIGNATURE_WEIGHTS = {
    "scanned": [
        [5.00, 19.21, 34.37],
        [0.83, 1.26, 0.36],
        [1.01, 0.44, 0.45],
        [0.52, 0.53, 0.14],
        [0.47, 0.28, 0.18],
        [0.30, 0.14, 0.27],
    ],
    "painted": [
        [4.04, 15.14, 22.62],
        [0.78, 0.92, 0.40],
        [0.46, 0.53, 0.63],
        [0.42, 0.26, 0.25],
        [0.41, 0.14, 0.15],
        [0.32, 0.07, 0.38],
    ],
    "uniform": [[1.0, 1.0, 1.0]] * 6,
}
SIGNATURE_SCALE = 0.01
NEARDUP_SCALE = 0.75
NEARDUP_THRESHOLD = 0.1


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dist_l1(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dist_l2(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def dist_chi2(query: Column, item: Column) -> Column:
    """Sum of (q-i)^2/q over non-zero q; not symmetric, the query comes first."""
    return _total(
        F.zip_with(query, item, lambda x, y: F.when(x != 0, (x - y) * (x - y) / x).otherwise(0.0))
    )


def pack_bits(v: Column, word: int = 32) -> Column:
    """Sign bits of an array, ``word`` of them per BIGINT."""
    starts = F.sequence(F.lit(1), F.size(v), F.lit(word))
    return F.transform(
        starts,
        lambda s: F.aggregate(
            F.slice(v, s, F.lit(word)),
            F.lit(0).cast("bigint"),
            lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > 0).cast("bigint")),
        ),
    )


def dist_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed bit arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )


def top_m_signature(v: Column, m: int) -> Column:
    """Signed positions of the m largest |v| after the first element (position 0 follows it)."""
    body = F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
    keyed = F.transform(
        body, lambda x, i: F.struct((-F.abs(x)).alias("k"), i.alias("pos"), F.signum(x).alias("s"))
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, m), lambda e: (e["pos"] * e["s"]).cast("int")
    )


def signature(v: Column, m: int) -> Column:
    """One channel: its average coefficient and its top-m signed positions."""
    return F.struct(F.element_at(v, 1).alias("avg"), top_m_signature(v, m).alias("sig"))


def signature_to_vector(channels: Column) -> Column:
    return F.flatten(
        F.transform(
            channels,
            lambda c: F.concat(F.array(c["avg"] * 255), c["sig"].cast("array<double>")),
        )
    )


def weight_bin(pos: Column, dim: int) -> Column:
    p = F.abs(pos)
    return F.least(F.lit(5), F.greatest(F.floor(p / dim), p % dim)).cast("int")


def bin_weight(pos: Column, dim: int, channel: Column | int = 0, table: str = "painted") -> Column:
    rows = F.array(*[F.array(*map(F.lit, r)) for r in SIGNATURE_WEIGHTS[table]])
    chan = F.lit(channel) if isinstance(channel, int) else channel
    return F.element_at(F.element_at(rows, weight_bin(pos, dim) + 1), chan + 1)


def average_weight(channel: Column | int = 0, table: str = "painted") -> Column:
    first = F.array(*map(F.lit, SIGNATURE_WEIGHTS[table][0]))
    chan = F.lit(channel) if isinstance(channel, int) else channel
    return F.element_at(first, chan + 1)


def signature_diff(a: Column, b: Column, dim: int, table: str = "painted") -> Column:
    """Signed score of two lists of channels; lower is closer."""

    def one(pair: Column, c: Column) -> Column:
        x, y = pair["a"], pair["b"]
        shared = F.zip_with(
            x["sig"],
            y["sig"],
            lambda s, t: F.when((s != 0) & (s == t), bin_weight(s, dim, c, table)).otherwise(0.0),
        )
        shared = F.filter(shared, lambda w: w.isNotNull())
        return F.abs(x["avg"] - y["avg"]) * average_weight(c, table) - _total(shared)

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return _total(F.transform(pairs, one))


def dist_signature(a: Column, b: Column, dim: int, scale: float = SIGNATURE_SCALE,
                   table: str = "painted") -> Column:
    """Normalised signature distance; 0 only for identical signatures."""
    return F.when(a == b, F.lit(0.0)).otherwise(
        unit01(F.lit(scale) * signature_diff(a, b, dim, table))
    )


def dist_signature_sym(a: Column, b: Column, dim: int, table: str = "painted") -> Column:
    both = signature_diff(a, a, dim, table) + signature_diff(b, b, dim, table)
    v = 1 - 2 * signature_diff(a, b, dim, table) / F.nullif(both, F.lit(0.0))
    return F.coalesce(F.least(F.lit(1.0), v * v), F.lit(1.0))


def agreement(a: Column, b: Column) -> Column:
    """Positions at which two sketches hold the same value."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x
    )


# Fixed value: the first prime above 2^32, modulus of the sketch positions.
SKETCH_PRIME = 4294967311


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def ensemble_geo(parts: Column, scale: float = 0.9565) -> Column:
    """Fold sqrt(acc * d) from 1 over an ordered array of distances."""
    return F.lit(scale) * F.aggregate(parts, F.lit(1.0), lambda acc, x: F.sqrt(acc * x))


def ensemble_product(parts: Column, weights: list[float], scale: float = 4.46968) -> Column:
    from simloom.functions.scalars import unit

    w = F.array(*map(F.lit, weights))
    logs = F.zip_with(parts, w, lambda d, x: x * F.ln(F.when(d > 0, d)))
    product = F.exp(_total(logs))
    return F.when(F.exists(parts, lambda d: d == 0), F.lit(0.0)).otherwise(
        unit(F.lit(scale) * product)
    )
