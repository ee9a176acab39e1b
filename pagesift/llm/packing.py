"""Hierarchical packing of token sequences into several context sizes.

A document (or what is left of one after whole longest windows) is routed to
the smallest tier that holds it.  Windows open at the longest document left;
their gaps are filled from shorter ones, the largest that fits first, and a
last gap by cutting the shortest document left.  Each task packs its own rows
in blocks of a bounded number of tokens and carries what does not fill a
window into the next block, so only the last windows of a task can have
padding; those are cut to powers of two.  Windows of a tier are dealt to step
groups of equal token number so that attention costs are balanced.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import read_table, text_bytes, trimmed
from pagesift.llm.tokens import ID, default_vocabulary, encode_all

TIERS = (256, 512, 1024, 2048)
END_ID = 1
LEAST_WINDOW = 64
BLOCK_TOKENS = 1 << 20
STEP_WINDOWS = 16  # windows of the longest tier in a step group
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_tokens long, step_id long")

Piece = tuple[int, int, int]  # length, document, start


def pack_block(items: list[Piece], tiers: tuple[int, ...]) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows that are exactly full at one of ``tiers``, and the pieces left
    over, which fill no window."""
    longest = tiers[-1]
    windows, pool = [], []
    for length, doc, start in items:
        while length > longest:
            windows.append([(longest, doc, start)])
            length, start = length - longest, start + longest
        pool.append((length, doc, start))
    pool.sort()
    while pool:
        window = [pool.pop()]
        gap = next(t for t in tiers if t >= window[0][0]) - window[0][0]
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 0))
            if at:
                piece = pool.pop(at - 1)
            else:
                length, doc, start = pool.pop(0)
                piece = (gap, doc, start)
                insort(pool, (length - gap, doc, start + gap))
            window.append(piece)
            gap -= piece[0]
        if gap:
            return windows, window
        windows.append(window)
    return windows, []


def in_order(windows: list[list[Piece]]) -> list[list[Piece]]:
    """Windows by the place of the document that each was opened with."""
    return sorted(windows, key=lambda w: (w[0][1], w[0][2]))


def cut_rest(items: list[Piece], longest: int) -> list[list[Piece]]:
    """Windows for the last pieces: powers of two from ``longest`` down to
    ``LEAST_WINDOW``, then one shorter window."""
    left, windows = sum(i[0] for i in items), []
    items = items[::-1]
    while left:
        size = min(longest, 1 << left.bit_length() - 1)
        size = size if size >= LEAST_WINDOW else left
        left, room, window = left - size, size, []
        while room:
            length, doc, start = items.pop()
            take = min(length, room)
            window.append((take, doc, start))
            if take < length:
                items.append((length - take, doc, start + take))
            room -= take
        windows.append(window)
    return windows


def step_groups(windows: list[list[Piece]], longest: int) -> list[int]:
    """A group number for each window.  A group has ``STEP_WINDOWS * longest``
    tokens of one window size; windows go from the costliest down, back and
    forth over the groups, cost being the sum of squared piece lengths."""
    sizes: dict[int, list[tuple[int, int]]] = {}
    for i, w in enumerate(windows):
        sizes.setdefault(sum(p[0] for p in w), []).append((sum(p[0] ** 2 for p in w), i))
    out, first = [0] * len(windows), 0
    for size in sorted(sizes):
        costs = sorted(sizes[size], reverse=True)
        groups = -(-len(costs) * size // (STEP_WINDOWS * longest))
        for k, (_, i) in enumerate(costs):
            turn, at = divmod(k, groups)
            out[i] = first + (at if turn % 2 == 0 else groups - 1 - at)
        first += groups
    return out


def _packer(path: str, tiers: tuple[int, ...], with_ids: bool):
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        ids: dict[int, np.ndarray] = {}   # documents that are not yet packed whole
        names: dict[int, int | None] = {}
        items: list[Piece] = []
        held = count = steps = docs = 0

        def emit(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal count, steps
            rows = []
            groups = step_groups(windows, tiers[-1])
            for window, group in zip(windows, groups):
                offset, total = 0, sum(p[0] for p in window)
                for length, doc, start in window:
                    part = ids[doc][start:start + length]
                    rows.append((names[doc], start, length, zlib.crc32(part.tobytes()),
                                 len(ids[doc]), base + count, offset, total,
                                 base + steps + group) + ((part.view(np.int32),) * with_ids))
                    offset += length
                count += 1
            steps += max(groups, default=-1) + 1
            names_, kinds = zip(*[f.split() for f in schema.split(", ")])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.list_(pa.int32()) if k == "array<int>" else pa.int64())
                 for c, k in zip(zip(*rows) if rows else [()] * len(names_), kinds)], names_)

        for batch in batches:
            for name, got in zip(batch.column(0).to_pylist(),
                                 encode_all(path, text_bytes(batch.column(1)))):
                ids[docs] = np.append(got, np.array([END_ID], ID))
                names[docs] = name
                items.append((len(ids[docs]), docs, 0))
                held += len(ids[docs])
                docs += 1
                if held >= BLOCK_TOKENS:
                    windows, items = pack_block(items, tiers)
                    yield emit(in_order(windows))
                    kept = {d for _, d, _ in items}
                    ids = {d: ids[d] for d in kept}
                    names = {d: names[d] for d in kept}
                    held = sum(i[0] for i in items)
        windows, rest = pack_block(items, tiers)
        yield emit(in_order(windows) + cut_rest(rest, tiers[-1]))
    return run, schema


def pack_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id",
                   text: str = "text", tiers: tuple[int, ...] = TIERS,
                   with_ids: bool = True) -> DataFrame:
    """Pack all of ``docs``; one row per piece of a document.

    Columns: doc_id, start (the document's ids before the piece), length,
    ids_crc32, doc_tokens, sequence_id, offset (in its sequence, without
    gaps), sequence_tokens, step_id and, if ``with_ids``, the ids.  ``tiers``
    are ascending powers of two.  A document's ids are those of its text and
    ``END_ID``; null and empty texts have that one id.  Null ids and repeated
    rows are packed like others; further columns are not read; an empty table
    gives no rows.  Rows are packed near the place they have in ``docs``:
    ``sequence_id`` goes up with the partitions and in them with the blocks of
    ``BLOCK_TOKENS``, and inside of a block with the documents that open the
    sequences."""
    run, schema = _packer(path or default_vocabulary(), tuple(tiers), with_ids)
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(trimmed(run), schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), with_ids=False)
