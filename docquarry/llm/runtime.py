"""What the operators of this subpackage share: shipping code, written tables, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import functools
import inspect
import io
import os
import re
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a vectorised kernel handles together (a longer text is handled alone).
STEP_BYTES = 2_000_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run; and let unions be dealt anew where they are grouped: a
    union of tables dealt alike would be taken for dealt by their key, whatever their tasks became as they ran."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    place = os.path.join(tempfile.mkdtemp(), "docquarry_code.zip")
    with open(place, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(place)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a master in one process (as in tests) has a local
    one; a cluster is an error, as its machines don't share theirs."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "docquarry-shared")
    path = f"{base.rstrip('/')}/docquarry-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing still to be computed reads."""
    for table in tables:
        spark = table.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written_at)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


# Arrow's own pools keep what was freed; the machine's gets it back
pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    """Give memory that is no longer in use back to the machine: a worker lives on after its task."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def relieved(run):
    """A function of a task's batches, or of a group's table, after which memory is given back."""
    if inspect.isgeneratorfunction(run):

        def over_batches(batches):
            try:
                yield from run(batches)
            finally:
                release()

        return over_batches

    def over_tables(*tables):
        try:
            return run(*tables)
        finally:
            release()

    # Spark tells functions of a group's key and table from those of the table by their parameters
    over_tables.__signature__ = inspect.signature(run)
    return functools.wraps(run)(over_tables)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if n == 0 or where is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, text: int | str, most: int = STEP_BYTES):
    """Slices of a batch whose texts have about `most` bytes together, a longer one alone."""
    column = batch.column(text)
    sizes = np.diff(utf8(column)[1]) if len(column) else np.empty(0, np.int64)
    at = 0
    sums = np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        end = int(np.searchsorted(sums, sums[at] + most, "right")) - 1
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


# Words -------------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _GOLDEN)


_BYTE = _stream(11, 256)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_BASE = int(_stream(12, 1)[0] | np.uint64(1))
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                take = min(done, size - done)
                have[done : done + take] = have[:take] * np.uint64(pow(base, done, 1 << 64))
                done += take
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end (bytes), and for each document where its words start among all words.

    A word is a run of bytes other than space and \\t..\\r; none spans two documents."""
    n = len(data)
    space = np.empty(n + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[data]
    first = ~space[1:-1] & space[:-2]
    last = ~space[1:-1] & space[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    if len(inner):
        first[inner] = ~space[inner + 1]
        last[inner - 1] = ~space[inner]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of words; fold: A-Z count as a-z."""
    if not len(starts):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE_FOLDED if fold else _BYTE)[data] * _power_table(_BASE, len(data)), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power_table(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for each i that has so many; the caller drops those that span documents."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += words[j : j + n]
        return mix(out)


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Among n window starts, those whose k words lie in one document; first: where documents' words start."""
    ok = np.zeros(max(n, 0), bool)
    if n <= 0:
        return ok
    edge = np.zeros(n + 1, np.int32)
    begin, end = first[:-1], np.maximum(first[1:] - k + 1, first[:-1])
    np.add.at(edge, np.minimum(begin, n), 1)
    np.add.at(edge, np.minimum(end, n), -1)
    return np.cumsum(edge[:-1]) > 0


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the index of its document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def arrow_schema(pairs: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in pairs])
