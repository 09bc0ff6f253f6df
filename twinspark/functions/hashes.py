"""64-bit hashes as four 16-bit numbers, distances and vector functions.

A hash is a string of 16 hex digits. It is never cast to one signed number, as
hashes from 2**63 on overflow there.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from _md5 import md5  # Python's own; OpenSSL's takes twice as long for a word
except ImportError:
    from hashlib import md5

CHUNKS = ("phash_c1", "phash_c2", "phash_c3", "phash_c4")


def chunk(phash: Column, k: int) -> Column:
    """The k-th 16 bits, high ones first; NULL unless the hash has 16 hex digits."""
    return F.when(phash.rlike("^[0-9a-fA-F]{16}$"), F.conv(F.substring(phash, 4 * k + 1, 4), 16, 10).cast("int"))


def with_chunks(df, phash: str = "phash"):
    return df.withColumns({c: chunk(F.col(phash), k) for k, c in enumerate(CHUNKS)})


def popcount(x: Column) -> Column:
    return F.coalesce(F.bit_count(x), F.lit(0))


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two hashes given by their chunks."""
    return reduce(lambda x, y: x + y, [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(a, b)])


def hamming_hex(a: Column, b: Column) -> Column:
    return hamming([chunk(a, k) for k in range(4)], [chunk(b, k) for k in range(4)])


def hex_of_bits(bits: Column) -> Column:
    """16 hex digits of an array of 64 booleans, high bit first."""
    digit = lambda k: F.lower(F.hex(reduce(lambda x, y: x + y, [F.when(F.get(bits, 4 * k + j), F.lit(8 >> j)).otherwise(F.lit(0)) for j in range(4)])))
    return F.concat(*[digit(F.lit(k)) for k in range(16)])


#: Bytes of text whose tokens are in memory at a time, tokens that a byte can count, and counts that are summed at a time.
TEXT_BYTES, COUNTED, SUMMED = 4 << 20, 255, 4_096


def _token_hashes(texts: pa.Array) -> list[str | None]:
    """Hashes of some lower-case texts; a token that several of them have is digested once."""
    lists = pc.split_pattern(texts, " ")
    tokens = lists.flatten().dictionary_encode()
    words, codes, row = tokens.dictionary.cast(pa.large_binary()), tokens.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
    some = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)[codes]
    each = np.sort(row[some] * len(words) + codes[some])
    if not len(each):
        return [None] * len(texts)
    each = each[np.diff(each, prepend=-1) != 0]
    row, codes = each // len(words), each % len(words)
    _, ends, raw = words.buffers()
    ends, raw = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1].tolist(), raw.to_pybytes()
    digests = b"".join([md5(raw[i:j], usedforsecurity=False).digest() for i, j in zip(ends, ends[1:])])
    lanes = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16)[:, :8], axis=1).view(np.uint64)  # eight counters of a byte in each of 8 numbers
    first = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(first, append=len(row))
    cuts = np.concatenate([np.arange(at, at + n, COUNTED) for at, n in zip(first, size)])
    edges = [*range(0, len(cuts), SUMMED), len(cuts)]
    starts = np.append(cuts, len(codes))
    ones = np.concatenate([np.add.reduceat(lanes[codes[starts[i] : starts[j]]], cuts[i:j] - cuts[i], axis=0) for i, j in zip(edges, edges[1:])])
    ones = np.add.reduceat(ones.view(np.uint8), np.searchsorted(cuts, first), axis=0, dtype=np.int64)
    text = np.packbits(2 * ones > size[:, None], axis=1).tobytes().hex()
    out: list[str | None] = [None] * len(texts)
    for k, r in enumerate(row[first]):
        out[r] = text[16 * k : 16 * k + 16]
    return out


def token_hash(text: Column) -> Column:
    """16 hex digits: the signs of the summed bits of the md5 of all different tokens of a text (lower case, cut at blanks); NULL without a token."""

    @F.arrow_udf("string")
    def hashed(texts: pa.Array) -> pa.Array:
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // TEXT_BYTES)) + 1), len(texts)]
        return pa.array([h for at, to in zip(cuts, cuts[1:]) if to > at for h in _token_hashes(texts[at:to])], pa.string())

    return hashed.asNondeterministic()(F.lower(text))  # a filter on the hash would compute it twice


def median_hash(v: Column) -> Column:
    """Bits of 64 coefficients: over the lower median or not."""
    bits = F.transform(F.array(F.get(F.sort_array(v), F.lit(31))), lambda m: F.transform(v, lambda x: x > m))
    return F.transform(bits, hex_of_bits)[0]


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))[0]


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 - dot / (norm(a) * norm(b))


def dct_matrix(n: int = 32):
    """The orthonormal DCT-II matrix."""
    k, i = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    out = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def low_frequencies(pixels: Column) -> Column:
    """Of 32 x 32 grey values, row by row, the 8 x 8 lowest DCT coefficients, row by row."""
    @F.pandas_udf("array<double>")
    def transform(s: pd.Series) -> pd.Series:
        c = dct_matrix(32)
        x = np.stack([np.asarray(v, float).reshape(32, 32) for v in s]) if len(s) else np.zeros((0, 32, 32))
        return pd.Series(list((c @ x @ c.T)[:, :8, :8].reshape(len(x), 64)))

    return transform(pixels)


def cubic(x: float, a: float = -0.5) -> float:
    """The cubic convolution kernel (Keys, 1981)."""
    x = abs(x)
    return ((a + 2) * x - (a + 3)) * x * x + 1 if x < 1 else (((x - 5) * x + 8) * x - 4) * a if x < 2 else 0.0


def resampling(n: int, m: int) -> np.ndarray:
    """The m x n matrix that takes n samples to m: cubic, wider by the scale where there are fewer, weights of sum 1."""
    scale = n / m
    wide = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    out = np.array([[cubic((i + 0.5 - c) / wide) for i in range(n)] for c in centre])
    return out / out.sum(1, keepdims=True)


def resized(pixels: Column, size: tuple[int, int], to: tuple[int, int]) -> Column:
    """Values of 0 to 255 of an image of ``size`` (rows, columns), row by row, as one of another size: two matrix products, then whole numbers."""
    (rows, columns), down, across = size, resampling(size[0], to[0]), resampling(size[1], to[1])
    dot = lambda values, weights: F.aggregate(F.zip_with(values, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    matrix = lambda m: F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in m])
    across_all = lambda p: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(matrix(across), lambda w: dot(F.slice(p, r * columns + 1, columns), w)))
    turned = lambda lines: F.transform(F.sequence(F.lit(0), F.lit(to[1] - 1)), lambda c: F.transform(lines, lambda line: F.get(line, c)))
    down_all = lambda each: F.transform(matrix(down), lambda w: F.transform(each, lambda column: dot(column, w)))
    out = once(pixels, lambda p: once(across_all(p), lambda lines: once(turned(lines), down_all)))
    return F.transform(F.flatten(out), lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int"))


#: Weights of red, green and blue in a grey value, in thousandths (fixed values).
LUMA = (299, 587, 114)


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Grey values of three channels, rounded."""
    both = F.arrays_zip(red.alias("r"), green.alias("g"), blue.alias("b"))
    return F.transform(both, lambda p: F.floor((p["r"] * LUMA[0] + p["g"] * LUMA[1] + p["b"] * LUMA[2] + 500) / 1000).cast("int"))


def image_difference(left: list[Column], right: list[Column], size: tuple[int, int], other: tuple[int, int]) -> Column:
    """How two images of three channels differ: the right one in the size of the left, differences by channel, grey, stretched."""
    channels = [pixel_difference(a, resized(b, other, size) if size != other else b) for a, b in zip(left, right)]
    return autocontrast(luma(*channels))


def pixel_difference(a: Column, b: Column) -> Column:
    """Absolute differences of two images of the same size."""
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def autocontrast(v: Column) -> Column:
    """Values stretched to 0 to 255, rounded down; equal values are 0."""
    stretched = lambda v, m: F.transform(v, lambda x: F.when(m["high"] > m["low"], F.floor((x - m["low"]) * 255 / (m["high"] - m["low"]))).otherwise(F.lit(0)).cast("int"))
    return once(v, lambda v: once(F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")), lambda m: stretched(v, m)))
