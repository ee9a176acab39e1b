"""Ranked lexical search: an inverted index in shards of documents, and a
hybrid of term-at-a-time and document-at-a-time evaluation.

A scan cuts the documents into shards of about a million terms each; a shard is
one row of the index table, with the posting lists of all its terms in binary
columns.  Nothing is shuffled.  A search takes the items in blocks of a bounded
number of terms: one pass over the shards' dictionaries counts the documents of
the block's terms, a second one ranks.

In a shard the short lists of an item are added up term by term; the sums are
then one more iterator with a bound, beside those of the long lists.  Documents
are visited in order, a window at a time.  By the largest score that each
iterator has in the window, iterators that can't lift a document to the item's
threshold together are not walked, only asked for the documents that the others
have, from the largest bound down, while these can still reach it; windows that
can't reach it at all are skipped.  A task carries the thresholds from shard to
shard; its best documents of each item are merged by a window function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift.llm.common import U64, flag_spans, pieces, read_table, span_hashes, stash, text_bytes

TOP = 10
SHARD_TERMS = 1 << 21     # occurrences that a task gathers for a shard, one document at least
BLOCK_TERMS = 1 << 18     # of items searched for at once; an item with more is alone
SHORT_SHARE = 1 / 64      # of a shard's documents that a short list has at most
WINDOW = 512              # documents visited together
# Rows of the index are large: row groups are closed by size after every row.
WRITER = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1",
          "parquet.block.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
FOUND = "item_id long, doc_id long, score long"
INDEX = "ids array<long>, sizes binary, n_docs long, n_terms long, terms binary, ends binary, docs binary, tfs binary"


@lru_cache(maxsize=1)
def _term_flags() -> np.ndarray:
    flags = np.zeros(256, bool)
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        flags[a:b] = True
    return flags


def text_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of all texts in turn (A-Z as a-z), and how
    many each text has."""
    found, sizes = [np.zeros(0, U64)], []
    for a, b in pieces(texts):
        buf = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
        starts, ends = flag_spans(_term_flags()[buf])
        found.append(span_hashes(buf, starts, ends, lower=True))
        at = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        sizes.append(np.diff(np.searchsorted(starts, at)))
    return np.concatenate(found), np.concatenate([np.zeros(0, np.int64), *sizes])


# --- index ------------------------------------------------------------------

def _shard(ids: list, terms: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(terms, kind="stable")
    t, d = terms[order], np.repeat(np.arange(len(sizes), dtype="<i4"), sizes)[order]
    new_term = np.r_[True, t[1:] != t[:-1]][:len(t)]
    first = np.flatnonzero(new_term | np.r_[True, d[1:] != d[:-1]][:len(t)])
    tfs = np.diff(np.r_[first, len(t)]).astype("<i4")
    start = np.flatnonzero(new_term[first])
    ends = np.r_[start[1:], len(first)][:len(start)].astype("<i4")
    blobs = (t[first][start], ends, d[first], tfs)
    return pa.RecordBatch.from_pydict({
        "ids": pa.array([ids], pa.list_(pa.int64())),
        "sizes": pa.array([sizes.astype("<i8").tobytes()], pa.binary()),
        "n_docs": pa.array([int((sizes > 0).sum())], pa.int64()),
        "n_terms": pa.array([len(terms)], pa.int64()),
        **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("terms", "ends", "docs", "tfs"), blobs)}})


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, terms, sizes, held = [], [], [], 0
    for batch in batches:
        texts, names = text_bytes(batch.column(1)), batch.column(0).to_pylist()
        for a, b in pieces(texts):
            t, n = text_terms(texts[a:b])
            ids += names[a:b]
            terms.append(t)
            sizes.append(n)
            held += len(t)
            if held >= SHARD_TERMS:
                yield _shard(ids, np.concatenate(terms), np.concatenate(sizes))
                ids, terms, sizes, held = [], [], [], 0
    if ids:
        yield _shard(ids, np.concatenate(terms), np.concatenate(sizes))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents, as a stored table of shards.  Null text has
    no terms; null and repeated ids are kept; an empty table has no shards."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    return stash(rows.mapInArrow(_index, INDEX), "index", **WRITER)


# --- items ------------------------------------------------------------------

@dataclass
class Items:
    """A block of items: for each its id and its terms (places in ``terms``)
    with how often it has them; each term's weight."""
    ids: list
    terms: np.ndarray
    places: list[np.ndarray]
    repeats: list[np.ndarray]
    weights: np.ndarray
    n_docs: int = 0
    n_terms: int = 0


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, sizes = text_terms(text_bytes(batch.column(1)))
        parts = np.split(terms, np.cumsum(sizes)[:-1]) if len(sizes) else []
        yield pa.RecordBatch.from_pydict({
            "item_id": batch.column(0), "terms": pa.array([p.tobytes() for p in parts], pa.binary())})


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The items in blocks of about BLOCK_TERMS terms."""
    rows = items.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(
        _item_terms, "item_id long, terms binary")
    ids, found, held = [], [], 0
    for row in rows.toLocalIterator():
        terms = np.frombuffer(bytes(row["terms"]), U64)
        if found and held + len(terms) > BLOCK_TERMS:
            yield _block(ids, found)
            ids, found, held = [], [], 0
        ids.append(row["item_id"])
        found.append(terms)
        held += len(terms)
    if found:
        yield _block(ids, found)


def _block(ids: list, found: list[np.ndarray]) -> Items:
    own = [np.unique(t, return_counts=True) for t in found]
    terms = np.unique(np.concatenate(found))
    return Items(ids, terms, [np.searchsorted(terms, t) for t, _ in own], [n.astype(np.int64) for _, n in own],
                 np.zeros(len(terms), np.int64))


def _places(wanted: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted ``wanted`` are in the sorted ``terms``, and where."""
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    here = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, np.int64)
    return here, at[here]


def _count_documents(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, ends in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                here, at = _places(wanted, np.frombuffer(terms, U64))
                df[here] += np.diff(np.r_[0, np.frombuffer(ends, "<i4")])[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"place": pa.array(some, pa.int64()), "df": pa.array(df[some])})
    return run


def set_weights(index: DataFrame, block: Items) -> None:
    """Counts over all documents, and the weights of the block's terms."""
    shared = index.sparkSession.sparkContext.broadcast(block.terms)
    counted = (index.select("terms", "ends").mapInArrow(_count_documents(shared), "place long, df long")
               .groupBy("place").agg(F.sum("df").alias("df")))
    for row in counted.toLocalIterator():  # a row for each of the block's terms at most
        block.weights[row["place"]] = math.floor(
            1000 * math.log((2 * block.n_docs + 2) / (2 * row["df"] + 1)))
    shared.destroy()


# --- ranking ----------------------------------------------------------------

@dataclass
class Walk:
    """A list of documents with their scores, and for each window where it
    begins and its largest score."""
    docs: np.ndarray
    scores: np.ndarray
    cuts: list[int]
    most: np.ndarray

    @classmethod
    def over(cls, docs: np.ndarray, scores: np.ndarray, n_docs: int) -> "Walk":
        cuts = np.searchsorted(docs, np.arange(0, n_docs + WINDOW, WINDOW))
        most = np.zeros(len(cuts) - 1, np.int64)
        filled = np.flatnonzero(np.diff(cuts))
        if len(filled):
            most[filled] = np.maximum.reduceat(scores, cuts[filled])
        return cls(docs, scores, cuts.tolist(), most)


class Best:
    """The best documents of an item so far; null ids come last among ties."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """What a document has to reach (one of equal score may win by its id)."""
        return max(int(self.scores[-1]) if len(self.scores) == self.top else 0, 1)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        s, i, n = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.none, none)))
        order = np.lexsort((i, n, -s))[:self.top]
        self.scores, self.ids, self.none = s[order], i[order], n[order]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the documents of some lists and their summed scores."""
    docs, scores = (np.concatenate(x) for x in zip(*lists))
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    return docs[first], np.add.reduceat(scores, first)


def walk_windows(walks: list[Walk], n_docs: int, best: Best, ids: np.ndarray, none: np.ndarray) -> None:
    """Document at a time, by windows: put what reaches the threshold in ``best``."""
    most = np.stack([w.most for w in walks])
    total = most.sum(0)
    sums = np.zeros(WINDOW, np.int64)
    for k in np.flatnonzero(total).tolist():
        threshold = best.threshold
        if total[k] < threshold:
            continue
        order = np.argsort(most[:, k], kind="stable")
        reach = np.cumsum(most[order, k])   # of the iterators up to each one
        walked = int(np.searchsorted(reach, threshold))
        sums[:] = 0
        for j in order[walked:].tolist():
            w = walks[j]
            a, b = w.cuts[k], w.cuts[k + 1]
            sums[w.docs[a:b] - k * WINDOW] += w.scores[a:b]
        found = np.flatnonzero(sums)
        for i in range(walked - 1, -1, -1):
            found = found[sums[found] + reach[i] >= threshold]
            if not len(found):
                break
            w = walks[order[i]]
            a, b = w.cuts[k], w.cuts[k + 1]
            if a == b:
                continue
            docs = w.docs[a:b]
            at = np.minimum(np.searchsorted(docs, found + k * WINDOW), b - a - 1)
            has = docs[at] == found + k * WINDOW
            sums[found[has]] += w.scores[a:b][at[has]]
        found = found[sums[found] >= threshold]
        if len(found):
            at = found + k * WINDOW
            best.add(sums[found], ids[at], none[at])


def search_shard(block: Items, best: list[Best], ids: pa.Array, sizes: np.ndarray, terms: np.ndarray,
                 ends: np.ndarray, docs: np.ndarray, tfs: np.ndarray) -> None:
    """Rank the documents of a shard for all items of the block."""
    n_docs = len(sizes)
    none = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    here, at = _places(block.terms, terms)
    m = 25 + 75 * sizes * block.n_docs // max(block.n_terms, 1)
    starts = np.r_[0, ends]
    lists: dict[int, tuple[np.ndarray, np.ndarray] | Walk] = {}
    for place, a, b in zip(here.tolist(), starts[at].tolist(), ends[at].tolist()):
        d, tf = docs[a:b], tfs[a:b].astype(np.int64)
        scores = block.weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[d]))
        lists[place] = (d, scores) if len(d) <= SHORT_SHARE * n_docs else Walk.over(d, scores, n_docs)
    for item, (places, repeats) in enumerate(zip(block.places, block.repeats)):
        short, walks = [], []
        for place, n in zip(places.tolist(), repeats.tolist()):
            found = lists.get(place)
            if isinstance(found, Walk):
                walks.append(found if n == 1 else Walk(found.docs, found.scores * n, found.cuts, found.most * n))
            elif found is not None:
                short.append((found[0], found[1] * n))
        if short:
            walks.append(Walk.over(*accumulate(short), n_docs))
        if walks:
            walk_windows(walks, n_docs, best[item], ids, none)


def _search(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = shared.value
        best = [Best(top) for _ in block.ids]
        for batch in batches:
            for i in range(len(batch)):
                sizes, terms, ends, docs, tfs = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                    for c, kind in enumerate(("<i8", U64, "<i4", "<i4", "<i4"), 1))
                search_shard(block, best, batch.column(0)[i].values, sizes, terms, ends, docs, tfs)
        for item, found in enumerate(best):
            if len(found.scores):
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array([item] * len(found.scores), pa.int32()),
                    "item_id": pa.array([block.ids[item]] * len(found.scores), pa.int64()),
                    "doc_id": pa.array(found.ids, pa.int64(), mask=found.none),
                    "score": pa.array(found.scores, pa.int64())})
    return run


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text",
           top: int = TOP) -> DataFrame:
    """The ``top`` documents of the index for each row of ``items``: item_id,
    rank (from 1), doc_id, score; scores above 0, equal ones by ascending
    doc_id (null last).

    Null or empty item texts, and items whose terms no document has, give no
    rows.  Rows that repeat an item are ranked each; rows of documents that
    repeat an id rank each.  Other columns are not read.  Terms are told apart
    by 64-bit hashes.  An empty index or an empty table of items gives no rows."""
    spark = index.sparkSession
    total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    found = []
    for block in item_blocks(items, item_id, text):
        block.n_docs, block.n_terms = total["docs"] or 0, total["terms"] or 0
        if not block.n_terms:
            continue
        set_weights(index, block)
        shared = spark.sparkContext.broadcast(block)
        ranked = index.select("ids", "sizes", "terms", "ends", "docs", "tfs").mapInArrow(
            _search(shared, top), f"item int, {FOUND}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found.append(stash(ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
                           .select("item_id", "rank", "doc_id", "score"), "ranked"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"rank int, {FOUND}").select(
        "item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(read_table(spark, sf_dir, "documents"))
    return search(index, read_table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
LEXICAL_SEARCH_SQL = f"""
with t as (select row_number() over () as d, doc_id, {_TERMS} as terms from documents where text is not null),
docs as (select d, doc_id, terms, len(terms) as n from t where len(terms) > 0),
total as (select count(*) as n_docs, sum(n)::bigint as n_terms from docs),
q as (select item, item_id, term, count(*) as n
      from (select row_number() over () as item, item_id, unnest({_TERMS}) as term from benchmark)
      group by all),
tf as (select d, term, count(*) as tf from (select d, unnest(terms) as term from docs)
       where term in (select term from q) group by all),
weight as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w
           from tf, total group by term, n_docs),
score as (select item, item_id, d, doc_id,
                 sum(q.n * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * docs.n * n_docs) // n_terms)))
                    )::bigint as score
          from q join weight using (term) join tf using (term) join docs using (d), total
          group by all),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id, d)::integer as rank
           from score where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {TOP}
"""
