"""Shared helpers of the training-data operators: shared storage, text hashing.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
all executors share; losing an executor therefore loses no intermediate state.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
#: paths and broadcast variables that operators have made and nobody has released
_held: list = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; one of this machine's only where none is set and no other machine takes part."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext.getCheckpointDir()
        path = found.rsplit("/", 1)[0] if found else None
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="veridia-"))
        path = _own_dir[0]
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _held.append(path)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables written by :func:`store` once nothing reads them any more."""
    for df in tables:
        drop_path(df.sparkSession, df.stored_at)
        if df.stored_at in _held:
            _held.remove(df.stored_at)


def send(spark: SparkSession, value):
    """A broadcast variable that :func:`release` destroys."""
    out = spark.sparkContext.broadcast(value)
    _held.append(out)
    return out


def mark() -> int:
    """A point that :func:`release` goes back to."""
    return len(_held)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Remove all tables and broadcast variables made since a :func:`mark`, but for the tables ``keep``.

    For callers that have written what they need: a result that was not written
    may still read them.
    """
    kept = {df.stored_at for df in keep}
    for x in [x for x in _held[since:] if not isinstance(x, str) or x not in kept]:
        _held.remove(x)
        if isinstance(x, str):
            drop_path(spark, x)
        else:
            x.destroy()


def trim() -> None:
    """Give freed memory back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def trim_driver(spark: SparkSession, collect: bool = False) -> bool:
    """As :func:`trim`, in the driver's Python and its JVM; ``collect``: collect the JVM's garbage first, which shrinks its heap.

    Compilers and buffers of the JVM allocate outside its heap, and the
    allocator keeps what they free; over many plans that adds up. False where
    the JVM cannot be asked (no HotSpot, or one older than 17.0.9).
    """
    trim()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        if collect:
            jvm.System.gc()
        # by the interface's own method: the class behind it is not open to the gateway
        named, kinds, values = jvm.java.lang.Class.forName, new(jvm.Class, 4), new(jvm.Object, 4)
        kinds[0], kinds[1], kinds[2], kinds[3] = map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Exception:  # noqa: BLE001  memory is kept, nothing else
        return False
    return True


def few_arenas() -> None:
    """Keep this process's freed memory in one piece: few allocation arenas, large arrays apart."""
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-8, 2)  # arenas
        libc.mallopt(-3, 1 << 24)  # bytes from which an allocation is a mapping of its own; scratch arrays are smaller
    except (AttributeError, OSError):  # another C library than glibc
        pass


def unused(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have in any spelling."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(column) -> list[str | None]:
    """The texts of a string column; bytes that are no UTF-8 read as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


#: rows of a batch between the JVM and Python; texts are long, so the default of 10,000 holds too much memory
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size for Python operators to BATCH_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def frugal(run):
    """A batch function that gives freed memory back to the system when its task ends.

    Python workers live on from task to task; without this each keeps the peak
    of every operator that it has run.
    """

    def wrapped(batches):
        few_arenas()
        yield from run(batches)
        trim()

    return wrapped


# --- vectorised hashing of words -------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: bytes hashed at once; bounds the scratch arrays of a task
SLAB = 1 << 18
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_powers.get("up", ())) < n + 1:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(buf: np.ndarray) -> np.ndarray:
    """ASCII letters A-Z to a-z."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: bytes of text that operators handle at once, but for a single longer text
SLICE_BYTES = 1 << 20


def slices(batch, text, most_rows: int = 256, most_bytes: int = SLICE_BYTES):
    """Slices of a batch whose texts (an array of it) have at most ``most_bytes`` in all, or of one row."""
    if len(text):
        _, offsets = text_buffers(text)
        at = 0
        while at < len(text):
            to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
            to = min(max(to, at + 1), at + most_rows, len(text))
            yield batch.slice(at, to - at)
            at = to


def slabs(raw: np.ndarray, offsets: np.ndarray):
    """(first row, bytes, row offsets) pieces of at most about SLAB bytes.

    Rows are kept together; a row longer than SLAB is cut behind white space
    (or, in a single word longer than SLAB, not at all).
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLAB, "right")) - 1
        if j > i:
            yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
            continue
        at, end = int(offsets[i]), int(offsets[i + 1])
        while at < end:
            to = min(end, at + SLAB)
            if to < end:
                back = np.flatnonzero(SPACE[raw[at:to]])
                if len(back):
                    to = at + int(back[-1]) + 1
                else:
                    ahead = np.flatnonzero(SPACE[raw[to:end]])
                    to = to + int(ahead[0]) + 1 if len(ahead) else end
            yield i, raw[at:to], np.array([0, to - at])
            at = to
        i += 1


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; words never cross rows."""
    word = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[:1] = True
    before[1:] = ~word[:-1]
    after = np.empty(len(buf), bool)
    after[-1:] = True
    after[:-1] = ~word[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, row after row, and words per row."""
    raw, offsets = text_buffers(column)
    counts = np.zeros(len(offsets) - 1, np.int64)
    parts = []
    for first, buf, offs in slabs(raw, offsets):
        starts, ends = word_bounds(buf, offs)
        counts[first : first + len(offs) - 1] += np.searchsorted(starts, offs[1:]) - np.searchsorted(starts, offs[:-1])
        if len(starts):
            up, down = powers(len(buf))
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum((lower(buf).astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
            parts.append(mix((total[ends] - total[starts]) * down[starts]))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def schema_with(df: DataFrame, **extra: str):
    """A new schema: that of ``df`` and the named further columns."""
    from pyspark.sql.types import StructType

    more = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in extra.items()))
    return StructType([*df.schema.fields, *more.fields])
