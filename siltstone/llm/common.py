"""Helpers that the training-data operators share: table access, checkpoints, Arrow text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker works on at once; longer single texts are taken alone.
CHUNK_BYTES = 1 << 20

#: The six bytes that separate words: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own setting: an execution's shuffle files go when it ends, not when the driver's garbage is collected.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Frames made inside free their shuffle files as soon as an action on them ends."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Only on one machine (tests) is one made up where none is named."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the shuffle files that led to it are freed."""
    shared_folder(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same cut by a Parquet table in the shared folder: smaller, and later reads take only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    with freeing(spark):
        df.select("*").write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(*frames: DataFrame) -> None:
    """Delete the checkpoints and stored tables of frames that nothing will read again."""
    for df in frames:
        context, place = df.sparkSession.sparkContext, getattr(df, "stored_at", None)
        if place is None:
            file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            place = file.get() if file.isDefined() else None
        if place is not None:
            path = context._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where the frame has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def counted(df: DataFrame) -> int:
    with freeing(df.sparkSession):
        return df.agg(F.count("*").alias("n")).first()["n"]


def default_tokenizer() -> str:
    """The file of the byte-level BPE vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most `limit` bytes of `column`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_offsets(batch.column(column))[1:].astype(np.int64)
        first = 0
        while first < batch.num_rows:
            base = int(ends[first - 1]) if first else int(text_offsets(batch.column(column))[0])
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
    given_back()


def given_back() -> None:
    """Give what was freed back to the system, where the C library can: workers live on and would hold each task's peak."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def text_offsets(array: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1]


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array in one piece, and the offsets of its rows; null is empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    offsets = text_offsets(array).astype(np.int64)
    held = array.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes not in `between` (by default the words), and for each row its first one's number (with the total last)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    cut = row_start[:n]
    starts = np.flatnonzero(inside & (~before[:n] | cut))
    ending = np.empty(n, bool)
    ending[:-1] = inside[:-1] & (~inside[1:] | row_start[1:n])
    ending[-1] = inside[-1]
    ends = np.flatnonzero(ending) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Roller:
    """Hashes of ranges in a buffer from prefix sums: range hashes cost two lookups each.

    The hash of a range is the sum of `value[byte] * base ** place` modulo 2**64, times the power that moves its
    start to place 0; `value` maps bytes to fixed random odd numbers, and 64-bit tokens stand for themselves. Equal
    ranges have equal hashes wherever they lie.
    """

    BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            small = (CHUNK_BYTES >> 2) + 2
            size = small if n <= small else max(n, CHUNK_BYTES + 2)
            inverse = pow(cls.BASE, -1, 1 << 64)
            for name, base in (("_powers", cls.BASE), ("_inverse", inverse)):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                setattr(cls, name, np.multiply.accumulate(out))

    def __init__(self, data: np.ndarray, value: np.ndarray | None = None):
        self._grow(len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        values = data if data.dtype == np.uint64 else (self.VALUE if value is None else value)[data]
        np.multiply(values, self._powers[: len(data)], out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """The hash of each range of `width` bytes, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self._inverse[:n])


#: Byte values with A-Z as a-z, for hashing without regard to ASCII case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
