"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, are cut into blocks of equal size.
Block j of a source with weight w is released at slot floor(j / w) and due at
slot ceil((j + 1) / w); of the released blocks the one with the earliest
deadline gets the next slot, which keeps every source within one block of its
share at all times.  When a source has no block left, the weights of the others
are scaled up; no document is dropped or repeated.

``exact_slots`` does so for the given weights over the whole input;
``schedule`` is the form that repeats, for weights that are whole parts of a
period.

Sums for each source and the slots of at most about ``MOST_BLOCKS`` blocks pass
through the driver; blocks are found by prefix sums over hash buckets of each
source.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift.llm.common import read_table, shuffle_partitions, stash

PERIOD = 4096         # slots; weights are parts of it
MOST_STREAMS = 1 << 20  # of given weights; without them every source has a stream
BLOCK_SIZE = 1 << 16  # code points
MOST_BLOCKS = 1 << 20  # of the default size; beyond (64 G code points) blocks get larger
TEMPERATURE = 0.5     # of default weights: shares go as size ** TEMPERATURE


class Phase(NamedTuple):
    start: int                  # first slot
    used: dict[int, int]        # blocks that each stream has placed before
    places: dict[int, np.ndarray]  # slots of a stream's blocks in one period


def parts(weights: Mapping[int, float], period: int = PERIOD) -> dict[int, int]:
    """Whole parts of ``period``, one at least, by largest remainders."""
    total, spare = sum(weights.values()), period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    left = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:left]:
        out[s] += 1
    return out


def one_period(share: Mapping[int, int], period: int = PERIOD) -> dict[int, np.ndarray]:
    """The slots of each stream's blocks in a period, by earliest deadline."""
    released: list[list[int]] = [[] for _ in range(period)]
    for s, c in share.items():
        for j in range(c):
            released[j * period // c].append(s)
    ready: list[tuple[int, int]] = []
    given: dict[int, list[int]] = {s: [] for s in share}
    freed = dict.fromkeys(share, 0)
    for slot in range(period):
        for s in released[slot]:
            freed[s] += 1
            heapq.heappush(ready, (-(-freed[s] * period // share[s]), s))
        given[heapq.heappop(ready)[1]].append(slot)
    return {s: np.array(x, np.int64) for s, x in given.items()}


def slot_of(places: np.ndarray, block, period: int = PERIOD):
    """Slot of a stream's block number (from the phase's start)."""
    return block // len(places) * period + places[block % len(places)]


def schedule(blocks: Mapping[int, int], weights: Mapping[int, float],
             period: int = PERIOD) -> list[Phase]:
    """The phases that place all blocks; one ends when a stream runs out."""
    left, used, start, phases = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        places = one_period(parts({s: weights[s] for s in left}, period), period)
        phases.append(Phase(start, dict(used), places))
        length = min(int(slot_of(places[s], n - 1, period)) for s, n in left.items()) + 1
        for s, at in places.items():
            placed = length // period * len(at) + int(np.searchsorted(at, length % period))
            used[s] += placed
            left[s] -= placed
        left = {s: n for s, n in left.items() if n}
        start += length
    return phases


def exact_slots(blocks: Sequence[int], weights: Sequence[float]) -> list[np.ndarray]:
    """The slots of each stream's blocks, within less than one block of the
    streams' shares at all times.

    Shares are those of the given weights, as exact fractions, among the
    streams that are not used up: at time v of a clock that runs by weight,
    stream s has min(v * w_s, blocks_s) and all have T(v) together.  Block j is
    released at slot floor(T(j / w)) and due at slot ceil(T((j + 1) / w)), so
    windows carry over where a stream ends; of the released blocks the one
    with the earliest deadline gets the next slot.  In whole numbers but for
    the search of the streams ended before a block."""
    live = [s for s, n in enumerate(blocks) if n]
    exact = {s: Fraction(weights[s]) for s in live}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * unit) for s, w in exact.items()}
    ends = sorted(live, key=lambda s: Fraction(blocks[s], whole[s]))
    at = np.array([blocks[s] / float(whole[s]) for s in ends])
    gone, rate = [0], [sum(whole.values())]  # blocks and weight of the streams ended, and left
    for s in ends:
        gone.append(gone[-1] + blocks[s])
        rate.append(rate[-1] - whole[s])

    total = gone[-1]
    release, due, stream = (np.empty(total, np.int64) for _ in range(3))
    first, start = {}, 0
    for s in live:
        n, w = blocks[s], whole[s]
        first[s] = start
        # A clock time where a stream ends lies on both sides alike.
        k = np.searchsorted(at, np.arange(n + 1) / float(w), "left").clip(0, len(ends) - 1).tolist()
        span = slice(start, start + n)
        release[span] = [gone[k[j]] + j * rate[k[j]] // w for j in range(n)]
        due[span] = [gone[k[j]] - (-j * rate[k[j]] // w) for j in range(1, n + 1)]
        stream[span] = s
        start += n

    order = np.argsort(release, kind="stable")
    bounds = np.searchsorted(release[order], np.arange(total), "right").tolist()
    slots, ready, freed = np.empty(total, np.int64), [], 0
    for slot in range(total):
        bound = bounds[slot] if bounds[slot] > freed else freed + (not ready)
        if bound > freed:
            for i in order[freed:bound].tolist():
                heapq.heappush(ready, (int(due[i]), i))
            freed = bound
        slots[heapq.heappop(ready)[1]] = slot
    none = np.empty(0, np.int64)
    return [slots[first[s]:first[s] + n] if n else none for s, n in enumerate(blocks)]


def _slots(spark: SparkSession, slots: list[np.ndarray]):
    first = np.cumsum([0] + [len(x) for x in slots])
    shared = spark.sparkContext.broadcast((first, np.concatenate(slots)))

    @F.arrow_udf("long")
    def slot(stream: pa.Array, block: pa.Array) -> pa.Array:
        first, slots = shared.value
        return pa.array(slots[first[stream.to_numpy(zero_copy_only=False)] + block.to_numpy(zero_copy_only=False)])
    return slot


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source",
                doc_id: str = "doc_id", size=None, block_size: int | None = None) -> DataFrame:
    """``docs`` with one more column ``mix``: a struct of stream, block (in
    the stream), slot (of the block in the mixture) and before (size of the
    stream before the row).  Sorting by (mix.slot, mix.before) gives the
    mixture; every row is in it once.

    ``weights`` names target weights by source; others and null share one
    stream with what is left of 1, or 1 / (number of weights + 1) if nothing
    is.  Without weights, every source, null too, has a stream of its own with
    its size to the power ``TEMPERATURE``; one number for each passes through
    the driver.  ``size`` is a column, else the text's length; null sizes
    and texts count as empty, and every row has a size of one more.  Blocks have
    ``block_size``, by default ``BLOCK_SIZE`` or what makes ``MOST_BLOCKS`` of
    all rows if that is more.  Repeated
    rows are placed like others.  A column named ``mix`` is replaced; an empty
    table gives no rows."""
    spark = docs.sparkSession
    size = F.length("text") if size is None else size
    spread = max(4 * shuffle_partitions(spark) - 1, 1).bit_length()
    # By id and content, so that many rows with one id or none spread as well.
    key = F.xxhash64(F.lit(9), F.col(doc_id), size)
    name = F.col(source).cast("string")

    rows = docs.select(name.alias("name"), (F.coalesce(size, F.lit(0)) + 1).cast("long").alias("size"),
                       key.alias("key")).withColumn("bucket", F.shiftrightunsigned("key", 64 - spread))
    sums = stash(rows.groupBy("name", "bucket").agg(F.sum("size").alias("size")), "sums")
    by_name = sums.groupBy("name").agg(F.sum("size").alias("size"))
    if weights is None:
        target = {r["name"]: float(r["size"]) ** TEMPERATURE for r in by_name.where("name is not null").collect()}
    else:
        if len(weights) >= MOST_STREAMS:
            raise ValueError(f"at most {MOST_STREAMS - 1} weights")
        target = {k: float(w) for k, w in weights.items() if w > 0}
    names = sorted(target)
    number = {n: i for i, n in enumerate(names)}
    rest = len(names)
    streams = spark.createDataFrame(list(number.items()), "_name string, _number int")

    def with_stream(table):
        """``table`` with _stream for its _name; other names and null have the last."""
        return (table.join(F.broadcast(streams), "_name", "left")
                .withColumn("_stream", F.coalesce("_number", F.lit(rest))).drop("_name", "_number"))

    buckets = stash(with_stream(sums.withColumnRenamed("name", "_name"))
                    .groupBy("_stream", F.col("bucket").alias("_bucket")).agg(F.sum("size").alias("size")), "buckets")
    totals = {r["_stream"]: int(r["size"])
              for r in buckets.groupBy("_stream").agg(F.sum("size").alias("size")).collect()}
    shares = {number[n]: w for n, w in target.items()}
    if weights is None:
        shares[rest] = float(totals.get(rest, 1)) ** TEMPERATURE
    else:
        spare = 1 - sum(target.values())
        shares[rest] = spare if spare > 0 else 1 / (len(target) + 1)
    block_size = block_size or max(BLOCK_SIZE, -(-sum(totals.values()) // MOST_BLOCKS))
    slots = exact_slots([-(-totals.get(s, 0) // block_size) for s in range(rest + 1)],
                        [shares[s] for s in range(rest + 1)])

    ahead = Window.partitionBy("_stream").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_stream", "_bucket",
                             F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("_offset"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"])
    held = with_stream(docs.select(whole.alias("_row"), name.alias("_name"), key.alias("_key"),
                                   F.shiftrightunsigned(key, 64 - spread).alias("_bucket"),
                                   (F.coalesce(size, F.lit(0)) + 1).cast("long").alias("_size"),
                                   F.col(doc_id).alias("_id")))
    inside = (Window.partitionBy("_stream", "_bucket").orderBy("_key", "_id", "_size")
              .rowsBetween(Window.unboundedPreceding, -1))
    held = (held.join(offsets, ["_stream", "_bucket"])
            .withColumn("_before", F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
            .withColumn("_block", F.floor(F.col("_before") / block_size)))
    slot = _slots(spark, slots)
    return held.select("_row.*", F.struct(
        F.col("_stream").alias("stream"), F.col("_block").alias("block"),
        slot(F.col("_stream").cast("long"), F.col("_block")).alias("slot"),
        F.col("_before").alias("before")).alias("mix"))


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, in the order of their mixture over the
    partitions and inside of them.  A column named ``mix`` is left out; others may
    have any names; cases as in ``mix_sources``."""
    mixed = mix_sources(docs, **options)
    order = [F.col("mix.slot"), F.col("mix.before")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).drop("mix")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", F.length("text").cast("long").alias("chars"))
    return mix_sources(docs, size=F.col("chars")).select(
        "doc_id", "source", "chars", F.col("mix.block").alias("block"), F.col("mix.slot").alias("slot"),
        F.col("mix.before").alias("chars_before"))
