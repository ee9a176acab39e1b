"""Helpers shared by the corpus operators: table access, tables written to the
shared folder, Arrow row streams, word hashing, a join for skewed keys and
connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.session import ensure_checkpoint_dir, tune

U64 = np.uint64
# Java form of the contracts' word and white-space classes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Rows are handed to numpy in pieces of about this many text bytes.
PIECE_BYTES = 1 << 20
# A key this share of all rows or more counts as hot; so at most 1/share keys do.
HOT_SHARE = 1 / 1000
PLAN_CHARACTERS = 4000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table below ``spark.checkpoint.dir`` (shared by all
    executors) and read it back: cuts lineage and survives lost executors.
    ``options`` go to the writer."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/pagesift-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_written_order(df: DataFrame) -> DataFrame:
    """The rows of a table read from Parquet files, in the order they were
    written in: by number of the part, then by row.  A scan alone sorts files by
    size and joins small ones."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    order = ["_part", "_file", "_at"]
    placed = df.select("*", part.alias("_part"), F.col("_metadata.file_name").alias("_file"),
                       F.col("_metadata.row_index").alias("_at"))
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Arrow row streams ---------------------------------------------------

def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts of a string column as UTF-8; null counts as empty."""
    return [b"" if v is None else v
            for v in column.cast(pa.large_binary()).to_pylist()]


def pieces(texts: list[bytes], size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes together, one row at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=1)
def _trim():
    import ctypes
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: None)


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on for other tasks,
    in one container with the JVM and other workers."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, with ``give_back`` before and after."""
    def wrapped(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()
    return wrapped


def binary_column(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


# --- words ---------------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=4)
def byte_values(lower: bool) -> np.ndarray:
    """A fixed random 64-bit value for each byte; A-Z as a-z if ``lower``."""
    values = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=1)
def space_flags() -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(SPACE_BYTES)] = True
    return flags


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULT, -1, 2**64)
    up, down = np.ones(n, U64), np.ones(n, U64)
    np.multiply.accumulate(np.r_[U64(1), np.full(n - 1, _MULT, U64)], out=up)
    np.multiply.accumulate(np.r_[U64(1), np.full(n - 1, inverse, U64)], out=down)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are no white space."""
    return flag_spans(~space_flags()[buf])


def flag_spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true flags."""
    edge = np.zeros(len(inside) + 2, np.int8)
    edge[1:-1] = inside
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool) -> np.ndarray:
    """64-bit hashes of the ascending, disjoint spans of ``buf``.

    A hash is a polynomial over the span's bytes, taken from prefix sums over
    pieces of bounded size, so memory stays bounded for long texts."""
    out = np.empty(len(starts), U64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + PIECE_BYTES, "right")), first + 1)
        lo, hi = int(starts[first]), int(ends[last - 1])
        size = hi - lo
        up, down = _powers(max(PIECE_BYTES, 1 << (size - 1).bit_length()))
        sums = np.zeros(size + 1, U64)
        np.cumsum(byte_values(lower)[buf[lo:hi]] * up[:size], out=sums[1:])
        s, e = starts[first:last] - lo, ends[first:last] - lo
        out[first:last] = mix((sums[e] - sums[s]) * down[s])
        first = last
    return out


def word_hashes(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``buf`` and their starts."""
    starts, ends = word_spans(buf)
    return span_hashes(buf, starts, ends, lower), starts


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of ``width`` words; of the whole run if shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    acc = words[:n].copy()
    for j in range(1, width):
        acc *= U64(_MULT)
        acc += words[j:j + n]
    return mix(acc)


def batch_words(texts: list[bytes], lower: bool) -> list[np.ndarray]:
    """Word hashes of each text, computed for all of them at once."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    hashes, starts = word_hashes(buf, lower)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    cut = np.searchsorted(starts, at)
    return [hashes[cut[i]:cut[i + 1]] for i in range(len(texts))]


# --- joins and components ------------------------------------------------

def join_skewed(rows: DataFrame, groups: DataFrame, key: str, count: str,
                total: int) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (unique ``key``, ``count`` rows of
    it) where few keys may hold most rows.  Keys with a share of ``HOT_SHARE``
    or more, 1 / HOT_SHARE keys at most, are broadcast; the others are
    shuffled.  Both inputs are read twice: pass stored tables."""
    limit = max(int(total * HOT_SHARE), 1)
    hot = F.broadcast(groups.where(F.col(count) >= limit))
    rest = groups.where(F.col(count) < limit)
    cold_rows = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(cold_rows.join(rest, key))


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Keep the text of plans short in here: the driver holds that of many
    executions, and long jobs of many plans would fill its memory."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PLAN_CHARACTERS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame, a: str = "a", b: str = "b", start: DataFrame | None = None,
               rounds: int | None = None) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (long ids).

    Labels travel along edges and then jump to the label of their label; every
    round is a join and a partial aggregate, its result a stored table, until
    no label changes.  With ``start``, labels (nodes of the same components)
    found over other edges before, the edges join labels, and only those are
    gone through.  After ``rounds`` labels may not be the smallest ones yet, but
    equal labels are of one component."""
    if start is not None:
        x = start.select(F.col("node").alias(a), F.col("label").alias("_x"))
        y = start.select(F.col("node").alias(b), F.col("label").alias("_y"))
        joined = stash(edges.select(a, b).join(x, a, "left").join(y, b, "left").select(
            a, b, F.coalesce("_x", a).alias("_x"), F.coalesce("_y", b).alias("_y")), "joined")
        found = components(joined, "_x", "_y", rounds=rounds).select(F.col("node").alias("label"), F.col("label").alias("_new"))
        new = (joined.select(F.col(a).alias("node")).union(joined.select(b)).distinct()
               .join(start, "node", "left_anti").select("node", F.col("node").alias("label")))
        return stash(start.select("node", "label").unionByName(new).join(found, "label", "left")
                     .select("node", F.coalesce("_new", "label").alias("label")), "labels")
    both = stash(edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
                 .unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst")))
                 .where("src <> dst").distinct(), "edges")
    labels = stash(both.groupBy(F.col("src").alias("node"))
                   .agg(F.min("dst").alias("m"))
                   .select("node", F.least("node", "m").alias("label")), "labels")
    turn = 0
    while True:
        turn += 1
        heard = (both.join(labels, both.dst == labels.node)
                 .groupBy("src").agg(F.min("label").alias("heard")))
        near = (labels.join(heard, labels.node == heard.src)
                .select("node", "label", F.least("label", "heard").alias("next")))
        far = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        new = stash(near.join(far, "next")
                    .select("node", F.least("next", "jump").alias("label"),
                            (F.least("next", "jump") != F.col("label")).alias("changed")),
                    "labels")
        labels = new.select("node", "label")
        if turn == rounds or not new.where("changed").limit(1).count():
            return labels
