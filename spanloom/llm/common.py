"""What the operators share: table access, lineage cuts, and vectorised token hashing over Arrow buffers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names.

    Only a local session without that setting gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def apply_arrow(grouped: GroupedData, run: Callable, schema: str) -> DataFrame:
    ship(grouped.session)
    return grouped.applyInArrow(run, schema)


def aside(df: DataFrame) -> DataFrame:
    """df with its columns named __c0, __c1, ..., so that no name of theirs meets one of an operator's."""
    return df.toDF(*[f"__c{k}" for k in range(len(df.columns))])


def named(df: DataFrame, column: str) -> str:
    """What aside() calls a column."""
    return f"__c{df.columns.index(column)}"


def back(renamed: DataFrame, df: DataFrame, **instead: Column) -> DataFrame:
    """The columns of df again, from a frame that came from aside(df)."""
    return renamed.select(*[instead.get(c, F.col(f"__c{k}")).alias(c) for k, c in enumerate(df.columns)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- hashing of tokens, a whole chunk of texts at a time ---

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_pows: dict[int, np.ndarray] = {}

_ASCII = np.zeros(256, bool)
_ASCII[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ASCII[128:] = True
_GRAPH = np.ones(256, bool)
_GRAPH[[*range(9, 14), *range(28, 33)]] = False


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n at least."""
    have = _pows.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _pows[base] = np.multiply.accumulate(out)
    return have


def unpowers(n: int) -> np.ndarray:
    """The inverses of powers(n)."""
    return powers(n, _UNBASE)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts in them; a null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if lower:
        column = pc.utf8_lower(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes; a row is never split."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offs: np.ndarray, letters: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each row: (hashes, first token of each row with the total at the end, starts, ends in bytes).

    letters: a token is a maximal run of letters and digits, where any character beyond ASCII counts as a letter unless it is Latin-1
    or general punctuation or a space; otherwise a maximal run of anything but ASCII white space.
    The hash is a polynomial over the bytes, so it is the same wherever the token stands.
    """
    n = len(buf)
    inside = (_ASCII if letters else _GRAPH)[buf]
    if letters and n > 2:
        for lead, low, high, width in ((0xC2, 0xA0, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
            at = np.flatnonzero(buf[: n - width + 1] == lead)
            at = at[(buf[at + 1] >= low) & (buf[at + 1] <= high)]
            for k in range(width):
                inside[at + k] = False
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), empty, empty
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * unpowers(n)[starts])
    return hashes, np.searchsorted(starts, offs), starts, ends


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many tokens, by where it starts; runs may cross rows."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * unpowers(n)[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(n)[: n - width + 1])


def whole(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the runs that grams() gives lie within one row."""
    if n < width:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))
    at = np.arange(n - width + 1)
    return at + width <= end[: n - width + 1]
