"""Shared pieces: tables, written intermediates, native word columns, numpy word hashing."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with over 1/HOT_SHARE of a join's rows is joined by broadcast; fewer than HOT_SHARE keys can be.
HOT_SHARE = 256
#: ASCII white space, the complement of a word character `[^\x20\x09-\x0D]`.
SPACE_CLASS = "[ \\t-\\r]"
SPACES = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch given to Python, and bytes of text that a worker takes at once (one text at least).
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own where unset, as in local tests alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lucera-"))
        base = _own[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * BATCH_BYTES))


def slices(batches, column: str = "text"):
    """The batches' rows, in order, in parts of at most BATCH_BYTES of text; a longer text is a part of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH_BYTES, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


_collecting: list[list[Work]] = []


@contextmanager
def scratch():
    """Collects the Works made inside, to drop what they leave once their result is written."""
    made: list[Work] = []
    _collecting.append(made)
    try:
        yield made
    finally:
        _collecting.remove(made)


class Work:
    """Written intermediates of one query: lineage ends at them, so a lost executor costs a re-read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}
        if _collecting:
            _collecting[-1].append(self)

    def save(self, df: DataFrame, key: str) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{key}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths[key] = path
        # plans that are done let go of their shuffle files when the driver's heap is next collected: now
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keys: str) -> None:
        for key in list(keys):
            remove(self.spark, self.paths.pop(key))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def whole_rows(df: DataFrame) -> DataFrame:
    """Each row as one struct, _row: operators add columns beside it, whatever the row's columns are named."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` as an array; null text: empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def key_hash(*cols: Column) -> Column:
    return F.xxhash64(*cols)


# numpy kernels -----------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True
_PIECE = 1 << 19
_ROOT = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n, _PIECE) + 1
        up, down = np.full(size, _ROOT, np.uint64), np.full(size, pow(_ROOT, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes, never 0, of the spans [s, e) of bytes; s and e ascend."""
    out = np.zeros(len(s), np.uint64)
    lo = 0
    while lo < len(s):  # pieces of bounded length keep the power tables small
        hi = max(lo + 1, int(np.searchsorted(e, s[lo] + _PIECE, "right")))
        a, b = int(s[lo]), int(e[hi - 1])
        up, down = _power_tables(b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[raw[a:b]] * up[: b - a], out=total[1:])
        p, q = s[lo:hi] - a, e[lo:hi] - a
        out[lo:hi] = mix64((total[q] - total[p]) * down[p] + (q - p).astype(np.uint64)) | np.uint64(1)
        lo = hi
    return out


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a text column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - offs[0]


class Words:
    """All words of a batch of texts.

    hashes: 64-bit hash of each word's bytes; start, end: its bytes; first: the index of
    each text's first word (n + 1 entries).
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        parts, total, lo = [], len(raw), 0
        edge = np.zeros(total + 1, bool)
        edge[offs] = True
        while lo < total:
            hi = min(total, lo + _PIECE)
            if hi < total:
                cut = np.flatnonzero(_IS_SPACE[raw[lo:hi]] | edge[lo + 1 : hi + 1])
                while not len(cut) and hi < total:
                    hi = min(total, hi + _PIECE)
                    cut = np.flatnonzero(_IS_SPACE[raw[lo:hi]] | edge[lo + 1 : hi + 1])
                hi = lo + int(cut[-1]) + 1 if len(cut) else total
            parts.append(self._piece(raw[lo:hi], edge[lo : hi + 1], lo))
            lo = hi
        empty = np.zeros(0, np.int64)
        self.start = np.concatenate([p[0] for p in parts]) if parts else empty
        self.end = np.concatenate([p[1] for p in parts]) if parts else empty
        self.hashes = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offs)

    @staticmethod
    def _piece(raw: np.ndarray, edge: np.ndarray, lo: int):
        word = ~_IS_SPACE[raw]
        before = np.empty(len(raw), bool)
        before[0], before[1:] = True, ~word[:-1]
        after = np.empty(len(raw), bool)
        after[-1], after[:-1] = True, ~word[1:]
        s = np.flatnonzero(word & (before | edge[:-1]))
        e = np.flatnonzero(word & (after | edge[1:])) + 1
        up, down = _power_tables(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
        return s + lo, e + lo, mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles, text by text, and the n + 1 offsets; a text of
        1 to k - 1 words has one shingle of all its words, an empty one none."""
        n = self.counts()
        size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        offs = np.concatenate([[0], np.cumsum(size)])
        if not offs[-1]:
            return np.zeros(0, np.uint64), offs
        h = np.concatenate([self.hashes, np.zeros(k, np.uint64)])
        at = np.repeat(self.first[:-1] - offs[:-1], size) + np.arange(offs[-1])
        out = np.zeros(offs[-1], np.uint64)
        short = np.repeat(n, size)
        for j in range(k):
            part = h[at + j] * _STEP[j]
            out += np.where(j < short, part, np.uint64(0)) if len(n) and n.min(initial=k) < k else part
        out += np.minimum(short, k).astype(np.uint64)
        return mix64(out), offs


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
