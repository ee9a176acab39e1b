"""Near duplicates: a Jaccard join on word shingles with adaptive prefixes.

Two documents can only reach the threshold if, in one order of all shingles,
the first ``n - ceil(t * n) + l`` shingles of both share at least ``l``.  The
order puts rare shingles first: a bounded table holds the heaviest ones with
their counts, all others come before them by hash.  ``l`` begins at a twentieth
of the set; a document whose prefix would still meet long lists, by those
counts, lengthens it to its whole set and asks for as many more shared shingles.
A pair needs the smaller ``l`` of the two.

Equal sets count as one class.  Lists of few classes give all of their pairs.
For long lists components grow in rounds: every class is held against leaders
of the lists it is in, others each round, as long as that joins components; so
copies by the thousand cost stars, not all of their pairs.  At last the long
lists whose classes are still in different components are joined, but for the
longest ones of each class, of which it can do without as many as it needs
shared shingles less one, and all pairs that share enough are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift.llm.bits import filter_bits, has_bits, longs, set_bits, tester
from pagesift.llm.common import (U64, batch_words, components, give_back, join_skewed, mix, pieces,
                                 read_table, shingle_hashes, short_plans, shuffle_partitions, stash, text_bytes,
                                 trimmed)

WIDTH = 5
PERCENT = 75
HEAVY_SHINGLES = 1 << 19   # of the order's table, which is broadcast (8 MB)
BASE_EXTRA = 20            # l is 1 and a shingle for each so many, or all that it can be
SHORT_LIST = 8             # classes of a list that gives all of its pairs
MOST_ROUNDS = 10           # of leaders, before the rest is joined
STAR_ROUNDS = 2            # of labels along the links of such a round
LEADERS = 4                # of a list in a round, and that a class tries
BLUR = 0.2                 # of the order of leaders, for other ones each round
LEAST_YIELD = 0.02         # links of a round for each pair it tried, else it is the last
RATIOS = (1.007, 1.02, 1.06, 1.15, 1.34)  # bands of two sizes' ratio; the last holds all that fit
BLOCK_SHINGLES = 1 << 20   # that a task gathers before it counts them
BLOCK_ENTRIES = 1 << 18    # that a task gathers before it passes them on
MET_CLASSES = 1 << 16      # that a task remembers, so that it passes on no copy of them
# A shingle's 48 bits after those of its bucket, in two fields.
ENTRY = np.dtype([("high", "<u4"), ("low", "<u2"), ("cls", "<i8"), ("size", "<u4"), ("extra", "<u4")])


def bucket_bits(spark: SparkSession) -> int:
    """Shingles are dealt by their highest bits into about four buckets for
    each shuffle partition."""
    return max(4 * shuffle_partitions(spark) - 1, 1).bit_length()


def text_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for a, b in pieces(texts):
        for words in batch_words(texts[a:b], lower=True):
            yield np.unique(shingle_hashes(words, WIDTH))


def set_class(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit sums that stand for a set."""
    a = mix(shingles ^ U64((0xA5A5A5A5A5A5A5A5 + seed * 0x632BE59BD9B4E019) % 2**64)).sum(dtype=U64)
    b = mix(shingles ^ U64(0x3C6EF372FE94F82B)).sum(dtype=U64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _by_bucket(sorted_high: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) over ascending buckets of sorted shingles."""
    cut = np.searchsorted(sorted_high >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        yield k, int(cut[k]), int(cut[k + 1])


# --- first pass: sets and heavy shingles ----------------------------------

SEEN = "doc_id long, size long, cls long, twin long, bucket int, shingles binary, counts binary"


def _survey(bits: int, seed: int):
    names = [f.split()[0] for f in SEEN.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.binary()]

    def rows(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def flush(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not gathered:
            return
        shingles, counts = np.unique(np.concatenate(gathered), return_counts=True)
        shingles, counts = shingles[counts > 1], counts[counts > 1].astype("<u4")
        cuts = list(_by_bucket(shingles, bits))
        none = [None] * len(cuts)
        yield rows([none, none, none, none, [k for k, _, _ in cuts],
                    [shingles[a:b].tobytes() for _, a, b in cuts],
                    [counts[a:b].tobytes() for _, a, b in cuts]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held, met = [], 0, set()
        for batch in batches:
            sizes, classes = [], []
            for s in text_sets(text_bytes(batch.column(1))):
                sizes.append(len(s))
                classes.append(set_class(s, seed))
                if len(s) and classes[-1][0] not in met:
                    met.add(classes[-1][0])
                    gathered.append(s)
                    held += len(s)
            none = [None] * len(sizes)
            yield rows([batch.column(0), sizes, [c[0] for c in classes], [c[1] for c in classes],
                        none, none, none])
            if held >= BLOCK_SHINGLES:
                yield from flush(gathered)
                gathered, held, met = [], 0, set()
        yield from flush(gathered)
    return run


def _heaviest(most: int):
    """Sum the counts of a bucket's shingles and keep the ``most`` largest."""
    def run(table: pa.Table) -> pa.Table:
        shingles = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in table["shingles"]])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table["counts"]])
        order = np.argsort(shingles, kind="stable")
        shingles, counts = shingles[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]][:len(shingles)])
        shingles, counts = shingles[first], np.add.reduceat(counts, first) if len(first) else counts
        top = np.sort(np.lexsort((shingles, -counts))[:most])
        return pa.table({"shingles": pa.array([shingles[top].tobytes()], pa.binary()),
                         "counts": pa.array([counts[top].astype("<i8").tobytes()], pa.binary())})
    return run


def heavy_shingles(seen: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The heaviest shingles, ascending, and their counts.  Counts cover all
    documents, without shingles that a block of a task has met only once."""
    most = max(HEAVY_SHINGLES >> bits, 1)
    found = (seen.where("bucket is not null").select("bucket", "shingles", "counts")
             .groupBy("bucket").applyInArrow(_heaviest(most), "shingles binary, counts binary"))
    got = [(np.frombuffer(r.shingles, U64), np.frombuffer(r.counts, "<i8"))
           for r in found.toLocalIterator()]
    if not got:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    shingles, counts = (np.concatenate(x) for x in zip(*got))
    order = np.argsort(shingles)
    return shingles[order], counts[order]


# --- second pass: prefixes -------------------------------------------------

def prefix(shingles: np.ndarray, heavy: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set and its ``l``."""
    n = len(shingles)
    least = -(-PERCENT * n // 100)
    weight = np.zeros(n, np.int64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)
        weight = np.where(heavy[at] == shingles, counts[at], 0)
    ordered = shingles
    if weight.any():
        order = np.lexsort((shingles, weight))
        ordered, weight = shingles[order], weight[order]
    base = min(1 + n // BASE_EXTRA, least)
    # The heaviest shingle is the prefix's last: if its list is long, the whole
    # set is taken, as every shorter prefix would read such lists as well.
    extra = least if n and weight[n - least + base - 1] > SHORT_LIST else base
    return ordered[:n - least + extra], extra


def _post(bits: int, seed: int, shared):
    def flush(entries: list) -> Iterator[pa.RecordBatch]:
        if not entries:
            return
        shingles = np.concatenate([e[0] for e in entries])
        sizes = [len(e[0]) for e in entries]
        order = np.argsort(shingles)
        out = np.empty(len(shingles), ENTRY)
        rest = shingles[order] << U64(bits)
        out["high"], out["low"] = rest >> U64(32), (rest >> U64(16)) & U64(0xFFFF)
        for k, name in enumerate(("cls", "size", "extra"), 1):
            out[name] = np.repeat(np.array([e[k] for e in entries], ENTRY[name]), sizes)[order]
        cuts = list(_by_bucket(shingles[order], bits))
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array([k for k, _, _ in cuts], pa.int32()),
            "entries": pa.array([out[a:b].tobytes() for _, a, b in cuts], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, counts = shared.value
        entries, held, met = [], 0, set()
        for batch in batches:
            for s in text_sets(text_bytes(batch.column(0))):
                cls = set_class(s, seed)[0]
                if not len(s) or cls in met:
                    continue
                met.add(cls)
                chosen, extra = prefix(s, heavy, counts)
                entries.append((chosen.copy(), cls, len(s), extra))  # a view would hold the whole set
                held += len(chosen)
                if held >= BLOCK_ENTRIES:
                    yield from flush(entries)
                    entries, held = [], 0
            if len(met) >= MET_CLASSES:
                met = set()
        yield from flush(entries)
    return run


MET = ("shingle long, cls long, size long, extra long, "
       "b_cls long, b_size long, b_extra long, shared long")


def _lists(bits: int):
    """Entries of the long lists, and the pairs of all short ones that two
    classes or more have, with the number of lists they share."""
    names = [f.split()[0] for f in MET.split(", ")]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in table["entries"]])
        rest = (e["high"].astype(U64) << U64(16)) | e["low"]
        order = np.lexsort((e["cls"], rest))
        e, rest = e[order], rest[order]
        new = np.r_[True, rest[1:] != rest[:-1]]
        other = new | np.r_[True, e["cls"][1:] != e["cls"][:-1]]
        e, new, rest = e[other], new[other], rest[other]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(e)])
        here = np.repeat(size, size)
        long = e[here > SHORT_LIST]
        shingle = mix(rest[here > SHORT_LIST] ^ mix(np.array([key[0].as_py()], U64))).view(np.int64)
        x, y = [], []
        for n in range(2, SHORT_LIST + 1):
            at = first[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    x.append(at + i)
                    y.append(at + j)
        x, y = e[np.concatenate(x)], e[np.concatenate(y)]
        fit = 100 * np.minimum(x["size"], y["size"]).astype(np.int64) >= \
            PERCENT * np.maximum(x["size"], y["size"]).astype(np.int64)
        x, y = x[fit], y[fit]
        order = np.lexsort((y["cls"], x["cls"]))
        x, y = x[order], y[order]
        start = np.flatnonzero(np.r_[True, (x["cls"][1:] != x["cls"][:-1]) | (y["cls"][1:] != y["cls"][:-1])]
                               [:len(x)])
        shared = np.diff(np.r_[start, len(x)])
        x, y = x[start], y[start]
        fields = ("cls", "size", "extra")
        paired = np.arange(len(long) + len(x)) >= len(long)
        before, after = np.zeros(len(long), np.int64), np.zeros(len(x), np.int64)
        columns = ([pa.array(np.r_[shingle, after], mask=paired)]
                   + [pa.array(np.concatenate([long[f], x[f]]).astype(np.int64)) for f in fields]
                   + [pa.array(np.r_[before, c.astype(np.int64)], mask=~paired) for c in (*(y[f] for f in fields), shared)])
        return pa.table(columns, names)
    return run


# --- verification -----------------------------------------------------------

def _chosen_sets(seed: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(has_bits(shared.value, ids))) if len(ids) else batch
            sets = [s for s in text_sets(text_bytes(batch.column(1))) if len(s)]
            yield pa.RecordBatch.from_pydict({
                "cls": pa.array([set_class(s, seed)[0] for s in sets], pa.int64()),
                "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are near enough."""
    x = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return (pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
            .mapInArrow(trimmed(_linked), "a long, b long"))


def _fits(a: str, b: str):
    """Sizes of which the one is at least PERCENT of the other."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _need(other: str):
    """Prefix shingles that two documents must share.  Of the two prefixes the
    one that ends first misses no shared shingle up to its end, so what it
    leaves out bounds the rest of the overlap."""
    size, extra = F.col("size"), F.col("extra")
    size2, extra2 = F.col(f"{other}size"), F.col(f"{other}extra")
    overlap = F.ceil((size + size2) * PERCENT / F.lit(100 + PERCENT))
    left = [F.ceil(n * PERCENT / F.lit(100)) - x for n, x in ((size, extra), (size2, extra2))]
    return F.greatest(F.least(extra, extra2), overlap - F.greatest(*left))


def _sets(texts: DataFrame, wanted: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """(cls, shingles) of the classes ``wanted``.  Their first documents are
    found by a Bloom filter of ids; only those sets are shuffled."""
    wanted = stash(wanted.join(classes, "cls").select("cls", F.coalesce("first", F.lit(0)).alias("first")),
                   "wanted")
    chosen = texts.sparkSession.sparkContext.broadcast(
        set_bits(wanted.select("first"), filter_bits(wanted.count())))
    sets = stash(texts.mapInArrow(trimmed(_chosen_sets(seed, chosen)), "cls long, shingles binary")
                 .join(wanted.select("cls"), "cls", "left_semi")
                 .groupBy("cls").agg(F.first("shingles").alias("shingles")), "sets")
    chosen.destroy()
    return sets


def _least_shared() -> Column:
    """The smallest ``l`` of any document that is large enough to be linked."""
    return F.floor(F.ceil(F.col("size") * PERCENT / F.lit(100)) / BASE_EXTRA) + 1


def _in_play(met: DataFrame) -> DataFrame:
    """Entries of classes that are in as many lists as they need, in lists that
    have two of them."""
    enough = (met.groupBy("cls").agg(F.count("*").alias("n"), F.max(_least_shared()).alias("least"))
              .where("n >= least").select("cls"))
    met = stash(met.join(enough, "cls", "left_semi"), "enough")
    pairs = met.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    return stash(met.join(pairs, "shingle", "left_semi"), "played")


def _split(told: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries (with label) of the lists with two labels or more."""
    if labels is not None:
        told = told.join(labels.select(F.col("node").alias("cls"), F.col("label").alias("_new")), "cls", "left")
        told = told.withColumn("label", F.coalesce("_new", "label")).drop("_new")
    told = stash(told, "told")
    mixed = (told.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
             .where("low <> high").select("shingle"))
    return stash(told.join(mixed, "shingle", "left_semi"), "split")


def _close_pairs(met: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a short list, and could share enough with the
    long lists that both are in."""
    pairs = (met.where("shingle is null")
             .groupBy("cls", "b_cls").agg(F.sum("shared").alias("shared"), F.max(_need("b_")).alias("need")))
    x = lists.select(F.col("cls"), F.col("lists").alias("x"))
    y = lists.select(F.col("cls").alias("b_cls"), F.col("lists").alias("y"))
    more = F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))
    return stash(pairs.join(x, "cls", "left").join(y, "b_cls", "left")
                 .where(F.col("shared") + more >= F.col("need"))
                 .select(F.least("cls", "b_cls").alias("a"), F.greatest("cls", "b_cls").alias("b")), "close")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``pairs`` that are in different components."""
    x = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    y = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    return (pairs.join(x, "a", "left").join(y, "b", "left")
            .where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b"))


def _stars(told: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of classes and leaders of other components.  The leaders
    of a list are in its most frequent component, so small components try to
    join large ones.  They are the classes with the largest part of their
    prefix in lists, blurred by a hash of the turn: an original comes before
    its altered copies, which have shingles of their own."""
    part = (told.groupBy("cls").agg(F.count("*").alias("n"), F.max("size").alias("s"), F.max("extra").alias("e"))
            .select("cls", (F.col("n") / (F.col("s") - F.ceil(F.col("s") * PERCENT / F.lit(100)) + F.col("e")))
                    .alias("part")))
    told = told.join(part, "cls")
    me = F.struct(F.col("cls").alias("lead"), F.col("size").alias("lead_size"), F.col("extra").alias("lead_extra"))
    keys = [F.col("part") * (1 - BLUR * F.pmod(F.xxhash64("cls", F.lit(turn * LEADERS + i)), F.lit(1024)) / 1024)
            for i in range(LEADERS)]
    best = F.array(*[F.max(F.struct(k.alias("k"), me.alias("me"))) for k in keys])
    by_label = told.groupBy("shingle", "label").agg(F.count("*").alias("n"), best.alias("best"))
    lead = F.array(*[F.max(F.struct("n", F.col("best")[i]["k"].alias("k"), F.struct(
        F.col("label").alias("lead_label"), F.col("best")[i]["me"].alias("me")).alias("l")))["l"]
        for i in range(LEADERS)])
    leads = (by_label.groupBy("shingle").agg(lead.alias("leads"))
             .select("shingle", F.explode(F.array_distinct("leads")).alias("l"))
             .select("shingle", "l.lead_label", "l.me.*"))
    fit = (told.join(leads, "shingle").where("label <> lead_label").where(_fits("size", "lead_size"))
           .groupBy("cls", "lead").agg(F.count("*").alias("shared"), F.max(_need("lead_")).alias("need"))
           .where("2 * shared >= need"))
    most = Window.partitionBy("cls").orderBy(F.desc("shared"), "lead")
    return (fit.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= LEADERS)
            .select(F.col("cls").alias("a"), F.col("lead").alias("b")))


def _need_floor(ratio: float, whole: bool) -> Column:
    """No partner whose size is within ``ratio`` can do with fewer shared
    prefix shingles.  If both prefixes are ``whole`` sets, they share the
    overlap itself.  Else the bound of ``_need`` is taken apart: what does not
    depend on the partner's prefix grows with its size, so it is least for the
    smallest one; what a partner's base prefix leaves out takes most just below
    a multiple of BASE_EXTRA near the largest size, and one more by rounding."""
    size, extra = F.col("size"), F.col("extra")
    ratio = min(ratio, 100 / PERCENT)
    low, high = F.ceil(size / ratio - 1e-6), F.floor(size * ratio + 1e-6)

    def overlap(other):
        return F.ceil((size + other) * PERCENT / F.lit(100 + PERCENT))

    def part(n):
        return F.ceil(n * PERCENT / F.lit(100))
    if whole:
        return F.greatest(overlap(low), _least_shared())
    last = F.floor((high + 1) / BASE_EXTRA) * BASE_EXTRA - 1
    left = [overlap(n) - part(n) + F.floor(n / BASE_EXTRA) + 1 for n in (high, last)]
    bound = F.least(overlap(low) - part(size) + extra, F.least(*left) - 1)
    return F.greatest(F.least(extra, F.floor(low / BASE_EXTRA) + 1), bound, _least_shared())


def _pairs(told: DataFrame) -> DataFrame:
    """All pairs (a, b) of classes of different components that may be linked.

    Lists are ordered by the pairs of different components in them; two classes
    that share ``m`` of them share one that is not among the last ``m - 1`` of either, and no more than those are
    missing from their count.  ``m`` is larger the nearer the two sizes are, so
    pairs are joined band by band of their ratio, and apart for two prefixes
    that are whole sets."""
    length = (told.groupBy("shingle", "label").agg(F.count("*").alias("n")).groupBy("shingle")
              .agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("n")))
    last = Window.partitionBy("cls").orderBy(F.desc("n"), "shingle")
    told = told.join(length, "shingle").withColumn("rank", F.row_number().over(last)).withColumn(
        "whole", F.col("extra") >= F.ceil(F.col("size") * PERCENT / F.lit(100)))
    told = stash(told, "ranked")
    bands, low = [], 0.0
    for ratio in RATIOS:
        for whole in (True, False):
            kept = told.withColumn("least", _need_floor(ratio, whole)).where("rank >= least").select(
                "shingle", "cls", "size", "extra", "label", "whole", "least")
            x = kept.where("whole" if whole else "not whole")
            y = (x if whole else kept).select(
                "shingle", *[F.col(c).alias(f"b_{c}") for c in kept.columns[1:]])
            once = "cls < b_cls" if whole else "cls < b_cls or b_whole"
            wide = F.greatest("size", "b_size") / F.least("size", "b_size")
            bands.append(stash(
                x.join(y, "shingle").where("label <> b_label").where(once)
                .where((wide > low) & (wide <= ratio)).where(_fits("size", "b_size"))
                .groupBy(F.least("cls", "b_cls").alias("a"), F.greatest("cls", "b_cls").alias("b"))
                .agg(F.count("*").alias("shared"),
                     F.max(_need("b_") - F.greatest("least", "b_least") + 1).alias("need"))
                .where("shared >= need").select("a", "b"), "band"))
        low = ratio
    return _union(bands)


@dataclass
class Links:
    """Documents with their classes (doc_id, size, cls, twin), classes (cls,
    first, n, clash), verified links between classes (a, b), labels found so far
    (node, label; equal ones are of one component), and the seed of class ids.
    The links join the classes of each component; not every link is among them."""
    members: DataFrame
    classes: DataFrame
    links: DataFrame
    labels: DataFrame
    seed: int


def near_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Links:
    """Classes of equal sets, and links that join the classes of each component."""
    spark = docs.sparkSession
    bits = bucket_bits(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seed = 0
    while True:
        seen = stash(texts.mapInArrow(trimmed(_survey(bits, seed)), SEEN), "seen")
        members = seen.where("bucket is null").select("doc_id", "size", "cls", "twin")
        classes = stash(members.where("size > 0").groupBy("cls").agg(
            F.min("doc_id").alias("first"), F.count("*").alias("n"),
            (F.min("twin") != F.max("twin")).alias("clash")), "classes")
        if not classes.where("clash").limit(1).count():
            break
        seed += 1  # two sets got one class id: choose other ids
    order = spark.sparkContext.broadcast(heavy_shingles(seen, bits))
    met = stash(texts.select("text").mapInArrow(trimmed(_post(bits, seed, order)), "bucket int, entries binary")
                .groupBy("bucket").applyInArrow(_lists(bits), MET), "met")
    order.destroy()
    entries = met.where("shingle is not null").select("shingle", "cls", "size", "extra")
    lists = stash(entries.groupBy("cls").agg(F.count("*").alias("lists")), "lists")
    close = _close_pairs(met, lists)
    told = _in_play(entries).withColumn("label", F.col("cls"))
    wanted = told.select("cls").union(close.select("a")).union(close.select("b")).distinct()
    sets = _sets(texts, wanted, classes, seed)

    tried, links, labels = [], [], None
    for turn in range(MOST_ROUNDS):
        told = _split(told, labels)
        stars = _stars(told, turn).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if tried:
            stars = stars.join(_union(tried), ["a", "b"], "left_anti")
        stars = stash(stars.distinct(), "stars")
        tried.append(stars)
        links.append(stash(_links(stars, sets), "links"))
        # classes and leaders are a step apart: labels need not be exact to go on
        labels = components(links[-1], start=labels, rounds=STAR_ROUNDS)
        if links[-1].count() <= LEAST_YIELD * stars.count():
            break
    tried = _union(tried)
    links.append(stash(_links(_apart(close, labels).join(tried, ["a", "b"], "left_anti"), sets), "links"))
    labels = components(_union(links), start=labels)
    told = _split(told, labels)
    tried = tried.unionByName(close.select("a", "b"))
    pairs = stash(_pairs(told).join(tried, ["a", "b"], "left_anti"), "pairs")
    links.append(stash(_links(pairs, sets), "links"))
    return Links(members, classes, _union(links), labels, seed)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _joined(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """The result of ``ngram_join``, and the seed of its class ids."""
    with short_plans(docs.sparkSession):
        found = near_links(docs, doc_id, text)
        # components go by classes, which have no null; then by their smallest id
        labels = components(found.links, start=found.labels)
        placed = found.classes.join(labels, found.classes["cls"] == labels["node"], "left").select(
            "cls", "n", "first", F.coalesce("label", "cls").alias("label"))
        placed = stash(placed, "placed")
        smallest = placed.groupBy("label").agg(F.min("first").alias("component_id"))
        named = stash(placed.join(smallest, "label").select("cls", "n", "component_id", "label"), "named")
        total = found.members.count()
    met = join_skewed(found.members.where("size > 0").select("doc_id", "size", "cls"), named, "cls", "n", total)
    alone = found.members.where("size = 0").select(
        "doc_id", "size", "cls", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("component_id"),
        F.lit(None).cast("long").alias("label"))
    return met.unionByName(alone).select(
        "doc_id", F.col("size").alias("n_shingles"), F.col("cls").alias("class_id"), "component_id",
        F.col("label").alias("group_id")), found.seed


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id,
    group_id.

    ``component_id`` is the smallest doc_id that links reach.  Null text,
    empty text and text without words have no shingles and no links.  Equal
    sets are linked; repeated rows too.  Links go by sets, so documents with a
    null id link like others and a repeated id does not join its rows: among
    null ids and others, the smallest id that is not null names the component; a
    component of null ids only has a null name.  ``group_id`` tells components
    apart whatever their ids, null for documents without shingles.  Columns but
    the two named ones are not read; an empty table gives no rows."""
    return _joined(docs, doc_id, text)[0]


def _asked(seed: int, shared):
    """Column function of an id and a text: are all bits of the id set, and, if
    so, the class id of the text, null without shingles.  One function for both,
    so that a task has one worker; not to be evaluated again in a filter."""
    @F.arrow_udf("maybe boolean, cls long")
    def asked(ids: pa.Array, texts: pa.Array) -> pa.Array:
        maybe = has_bits(shared.value, longs(ids))
        sets = text_sets(text_bytes(texts.filter(pa.array(maybe, pa.bool_()))))
        classes = (set_class(s, seed)[0] if len(s) else None for s in sets)
        cls = pa.array([next(classes) if m else None for m in maybe.tolist()], pa.int64())
        give_back()
        return pa.StructArray.from_arrays([pa.array(maybe, pa.bool_()), cls], ["maybe", "cls"])
    return asked.asNondeterministic()


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of each component one row of
    the smallest doc_id (null ids last, then by class id), and all documents
    without shingles.  Rows are told apart by id and set, so another text under
    a repeated id is a document of its own.  Other cases as in ``ngram_join``.
    Only documents of components of more than one row, and few others that a
    Bloom filter of ids lets through, are written with their class ids and
    shuffled with their texts."""
    found, seed = _joined(docs, doc_id, text)
    found = stash(found, "joined")
    linked = found.where("group_id is not null").select("doc_id", F.col("class_id").alias("cls"), "group_id")
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("keep")
    sizes = stash(linked.groupBy("group_id").agg(F.count("*").alias("n"), keeper).where("n > 1"), "sizes")
    near = stash(join_skewed(linked, sizes, "group_id", "n", found.count())
                 .select("doc_id", "cls", "group_id", (F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
                                                       & (F.col("cls") == F.col("keep.cls"))).alias("stays")), "near")
    asked_ids = near.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"))
    packed = set_bits(asked_ids, filter_bits(near.count()))
    maybe, shared = tester(docs.sparkSession, packed), docs.sparkSession.sparkContext.broadcast(packed)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    ids = F.col(doc_id).cast("long").alias("_id")
    others = docs.select(ids, whole.alias("_row")).where(~maybe(F.coalesce("_id", F.lit(0))))
    asked = docs.select(ids, F.col(text).alias("_text"), whole.alias("_row")).select(
        "_id", _asked(seed, shared)("_id", "_text").alias("_asked"), "_row")
    asked = stash(asked.where("_asked.maybe").select("_id", F.col("_asked.cls").alias("_cls"), "_row"), "asked")
    shared.destroy()
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_cls") == F.col("cls"))
    chosen = (asked.join(near.where("stays").select("doc_id", "cls").distinct(), same)
              .groupBy("_id", "_cls").agg(F.first("_row").alias("_row")))
    unlinked = asked.join(near.select("doc_id", "cls"), same, "left_anti")
    return (others.select("_row.*").unionByName(chosen.select("_row.*"))
            .unionByName(unlinked.select("_row.*")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"))
