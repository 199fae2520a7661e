"""Shared helpers: tables, scratch tables in the shared folder, and vectorised word hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` but stays columnar and compressed, and a lost
    executor costs nothing: the files live in the folder every executor shares.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the id as text; a null id counts as empty text (0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------------------
# Words are [^\x20\x09-\x0D]+ of the UTF-8 bytes; a word's 64-bit hash is a polynomial over a
# random byte table modulo 2**64, finalised by a bijective mix.

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
CHUNK_BYTES = 1 << 21
HASH_BYTES = 1 << 16  # of words hashed at once, so that memory does not grow with a text


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n (grown by doubling, kept per worker)."""
    if len(_POWERS.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("p", _BASE), ("i", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]`` for many spans at once."""
    p, inv = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=total[1:])
    return (total[end] - total[start]) * inv[start]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word offsets of the texts: text i has words offsets[i]:offsets[i+1])."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    offsets = np.searchsorted(start, bounds)
    h = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):  # a hash does not depend on where its word stands, so pieces do
        last = max(first + 1, int(np.searchsorted(end, start[first] + HASH_BYTES, "right")))
        low = start[first]
        h[first:last] = span_hashes(_BYTES[data[low : end[last - 1]]], start[first:last] - low, end[first:last] - low)
        first = last
    return mix(h + (end - start).astype(np.uint64)), offsets


def chunks(texts: list, sizes: list[int], limit: int = CHUNK_BYTES):
    """Consecutive (from, to) ranges of rows of about ``limit`` bytes; a long row makes its own."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column) -> list[bytes]:
    """The bytes of an Arrow string or binary column; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def parts(batch, name: str, limit: int = CHUNK_BYTES):
    """(rows of the batch, their texts as bytes) in parts of about ``limit`` bytes, one at a time."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
    for a, b in chunks(sizes, sizes, limit):
        rows = batch.slice(a, b - a)
        yield rows, utf8(rows.column(name))


# Fixed rule: lower case where it is one character, white space as a space (positions are kept).
_LOW = np.array([0x20 if chr(c).isspace() else ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(65536)], np.uint32)


def characters(text: str) -> np.ndarray:
    """Code points, lower-cased one to one, white space as a space."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 65536, _LOW[np.minimum(c, 65535)], c).astype(np.uint32)


def sample_share(key: Column | str, share: float) -> Column:
    """A fixed pseudo-random share of the rows, by a hash of ``key``: the same rows on every run."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(c, F.lit(71)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))
