"""What the operators of this subpackage share: the shared folder, Arrow batches, hashes, bitmaps, components."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

MULTIPLIER = 0x9E3779B97F4A7C15
#: Bits of a presence bitmap: 16 MB, whatever the input. Beyond its capacity it lets more rows pass, never fewer.
BITMAP_BITS = 27
#: The most bits of a bitmap that is sized by its rows: 128 MB.
MOST_BITS = 30


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, a local session gets a folder of its own; on a cluster that is an error, as executors
    would each write to their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            path = jvm_dir.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            path = "file://" + tempfile.mkdtemp(prefix="foliant-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Spark then deletes the shuffle files of a query as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_owners: list[list[Scratch]] = []


@contextmanager
def owned() -> Iterator[None]:
    """Tables that operators write within it are deleted at its end; read no result of theirs afterwards."""
    _owners.append([])
    try:
        yield
    finally:
        for scratch in _owners.pop():
            scratch.drop(scratch.base)


class Scratch:
    """Tables of one operator call in the shared folder; they survive lost executors and cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        if _owners:
            _owners[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """df, written and read again. The shuffles behind it go with the query that writes it."""
        self.n += 1
        path, before = self.path(f"{name}{self.n}"), self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete written tables that nothing reads any more."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to be unlike every column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Return freed memory to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6") if hasattr(ctypes.CDLL("libc.so.6"), "malloc_trim") else None
except OSError:  # another C library
    _libc = None


def frugal(run: Callable) -> Callable:
    """A function over Arrow batches that gives back memory as it ends."""

    @functools.wraps(run)
    def kept_small(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return kept_small


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches laid together up to so many bytes, for work that is done side by side."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and where each row starts (one more than rows)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps for a base (8 MB); longer runs get theirs anew.
_KEPT_POWERS = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        have = np.ones(size, np.uint64)
        have[1] = base
        filled = 2
        while filled < size:
            np.multiply(have[:filled], np.uint64(pow(base, filled, 1 << 64)), out=have[filled : 2 * filled])
            filled *= 2
        if size <= _KEPT_POWERS:
            _powers[base] = have
    return have[:n]


INVERSE = pow(MULTIPLIER, -1, 1 << 64)


#: Spread values of the symbols under 2**16, so that most symbols need a look-up only.
_SPREAD = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i], shifted by span_hash, is the polynomial hash of symbols[i:j]."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    if len(symbols) and symbols.max() >> 16:
        spread = mix(symbols.astype(np.uint64) + np.uint64(1))
    else:
        spread = _SPREAD[symbols]
    np.cumsum(np.multiply(spread, powers(MULTIPLIER, len(symbols)), out=spread), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each full window of so many 32-bit hashes the position of its minimum, the rightmost on ties."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    low = (hashes.astype(np.uint64) << np.uint64(32)) | (np.uint64(n) - np.arange(n, dtype=np.uint64))
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: n - width + 1], low[width - span : width - span + n - width + 1])
    return (np.uint64(n) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def top_bits(key: str, bits: int = BITMAP_BITS):
    return F.shiftrightunsigned(F.col(key), 64 - bits)


def presence(keys: DataFrame, slot, bits: int | None = BITMAP_BITS):
    """A broadcast bitmap with a bit for the slot of every row (a column's top bits, if a name is given): a filter of bounded size without false negatives.

    bits None: 64 bits or more a row of keys, counted first (a written table's count costs next to nothing), but
    never beyond 2**MOST_BITS in all.
    """
    if bits is None:
        bits = min(MOST_BITS, max(20, int(keys.count()).bit_length() + 6))
    slot = top_bits(slot, bits) if isinstance(slot, str) else slot
    got = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits")).collect()
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for row in got:  # at most 2**(bits - 15) rows
        whole[row.page * 4096 : (row.page + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def present(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the top bits of each key, as many as the bitmap has slots for, are in it."""
    return bit_set(bitmap, (keys >> np.uint64(65 - (8 * len(bitmap)).bit_length())).astype(np.int64))


def bit_set(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def components(scratch: Scratch, edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, component: the smallest reachable node for every node but the smallest of an undirected edge table (a, b of one orderable type).

    Alternates large-star and small-star steps, each a grouped minimum and a join; stars replace groups, so
    rows never exceed the edges. Every round is a written table. Ends when a round changes nothing.
    """
    edges, last, written = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), None, None
    for _ in range(limit):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        seen = Observation()
        following = scratch.table(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")), "edges")
        if written is not None:
            scratch.drop(written)
        edges = written = following
        if seen.get == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = seen.get
    raise RuntimeError("components did not settle")


def neighbour_partitions(df: DataFrame, key: str, n: int, wrap: bool = False) -> DataFrame:
    """Deal rows into n key ranges, one a partition, sorted by role_ and key.

    role_ 0 are a range's own rows; -1 the last row before it and 1 the first row after it (after the last
    range: the very first row, if wrap). The key must not be null. The driver gets two keys a range.
    """
    spans = df.select(key).repartitionByRange(n, key).groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    spans = sorted((r.lo, r.hi) for r in spans) or [(None, None)]
    lows, highs = [s[0] for s in spans], [s[1] for s in spans]
    kind = df.schema[key].dataType.simpleString()
    width = max(1, int(len(lows) ** 0.5))
    coarse = F.lit([x for x in lows[::width]]).cast(f"array<{kind}>")
    blocks = F.lit([lows[i : i + width] for i in range(0, len(lows), width)]).cast(f"array<array<{kind}>>")
    block = F.size(F.filter(coarse, lambda x: x <= F.col(key)))
    place = (block - 1) * width + F.size(F.filter(F.get(blocks, block - 1), lambda x: x <= F.col(key))) - 1
    own = df.withColumn("range_", place)
    roles = [F.struct(F.col("range_").alias("range_"), F.lit(0).alias("role_"))]
    array = lambda xs: F.lit(xs).cast(f"array<{kind}>")
    if len(spans) > 1:
        first, last = F.col(key) == F.get(array(lows), F.col("range_")), F.col(key) == F.get(array(highs), F.col("range_"))
        roles.append(F.when(first & (F.col("range_") > 0), F.struct((F.col("range_") - 1).alias("range_"), F.lit(1).alias("role_"))))
        roles.append(F.when(last & (F.col("range_") < len(spans) - 1), F.struct((F.col("range_") + 1).alias("range_"), F.lit(-1).alias("role_"))))
    if wrap and lows[0] is not None:
        roles.append(F.when(F.col(key) == F.lit(lows[0]), F.struct(F.lit(len(spans) - 1).alias("range_"), F.lit(1).alias("role_"))))
    if len(roles) > 1:
        own = own.withColumn("to_", F.explode(F.array_compact(F.array(*roles)))).withColumns({"range_": F.col("to_.range_"), "role_": F.col("to_.role_")}).drop("to_")
    else:
        own = own.withColumn("role_", F.lit(0))
    return own.repartitionById(len(spans), F.col("range_").cast("int")).sortWithinPartitions("role_", key)


def ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
