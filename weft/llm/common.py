"""Helpers shared by the operators: tables, written intermediates and vectorised text work on Arrow batches."""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from weft.session import checkpoint_dir

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{checkpoint_dir(spark)}/weft-tables/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Sent:
    """A value sent once to every executor, its classes included: a plain broadcast names classes of this library, which
    executors need not have."""

    def __init__(self, spark: SparkSession, value):
        self._held, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._held.value)
        return self._value

    def __getstate__(self):
        return {"_held": self._held, "_value": None}

    def unpersist(self) -> None:
        self._held.unpersist()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges (first row, last row + 1) of whole rows with about ``most`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


# -- words -----------------------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64 (kept between calls)."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            out = np.full(n, base & (1 << 64) - 1, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that close inputs give unrelated hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes (modulo 2**64): ``span_hashes`` gets any substring's hash from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


#: Prime moduli and bases of word hashes: two residues of 31 bits, so that products fit in 64 bits. (Modulo 2**64, words made
#: by doubling, such as the Thue-Morse word, agree whatever the base.)
_PRIMES = ((2147483647, 1654615998), (2147483629, 1097412857))
_residues = [np.ones((2, 1), np.uint64) for _ in _PRIMES]


def _residue_powers(n: int) -> list[np.ndarray]:
    """For each prime the first n powers of the base and of its inverse (kept between calls), by doubling."""
    for k, (p, base) in enumerate(_PRIMES):
        while _residues[k].shape[1] < n:
            have = _residues[k].shape[1]
            step = np.array([[pow(base, have, p)], [pow(base, -have, p)]], np.uint64)
            _residues[k] = np.concatenate([_residues[k], _residues[k] * step % np.uint64(p)], axis=1)
    return _residues


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: polynomials modulo two primes, mixed with the length."""
    out = (end - start).astype(np.uint64)
    for (p, _), power in zip(_PRIMES, _residue_powers(len(data) + 1)):
        p = np.uint64(p)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[0, : len(data)] % p, dtype=np.uint64, out=prefix[1:])
        out = mix(out) + (prefix[end] - prefix[start]) % p * power[1, start] % p
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of packed texts, A-Z lower-cased: (64-bit hash, text's number, start byte, end byte)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    space = _SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = space[:-1], space[1:]
    cut = offsets[1:-1]
    before[cut[cut < n]] = True
    after[cut[cut > 0] - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return word_hashes(_LOWER[data], start, end), doc, start, end


def shingles(word: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside each text, with the text's number; a text with fewer words gives one."""
    if len(word) == 0:
        return word, doc
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    left = np.repeat(np.r_[first[1:], len(doc)], np.diff(np.r_[first, len(doc)])) - np.arange(len(doc))  # words from here on
    size = np.diff(np.r_[first, len(doc)])
    h = np.zeros(len(word), np.uint64)
    for i in range(k):
        shifted = np.zeros(len(word), np.uint64)
        shifted[: len(word) - i] = word[i:]
        h = h * np.uint64(_P) + np.where(left > i, shifted, np.uint64(i + 1))
    keep = left >= k
    keep[first[size < k]] = True
    return mix(h[keep]), doc[keep]
