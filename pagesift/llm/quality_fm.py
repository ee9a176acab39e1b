"""Document quality by a factorisation machine.

Inputs are hashed words, statistics of a text's structure and its size as
metadata, never its id, language, source or labels.  Pairwise terms come from
vectors of a low rank, by (sum of squares identity): the sum over pairs of
<v_i, v_j> x_i x_j is half of the squared sum of v_i x_i less the sum of their
squares, so a score takes time linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import U64, give_back, pieces, read_table, span_hashes, text_bytes, word_spans

WORD_BITS = 14
BINS = 16
STATS = ("upper", "symbols", "marks", "bars", "digits", "same", "distinct", "word_size",
         "line_words", "line_repeats", "stops", "chars", "lines")
SIZE = (1 << WORD_BITS) + BINS * len(STATS)
RANK = 8
SAMPLE = 6_000       # labelled documents that a model is fitted on, at most
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.02, 1e-4
THRESHOLD = 0.7


class Model(NamedTuple):
    bias: float
    weights: np.ndarray   # SIZE
    vectors: np.ndarray   # SIZE x RANK


def _table(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_UPPER = _table(bytes(range(65, 91)))
_SYMBOLS = _table(b"#*$%&<>@^~=_\\{}[]")
_MARKS, _BARS, _STOPS = _table(b"!?"), _table(b"|"), _table(b".,;:")
_DIGITS, _LINES = _table(b"0123456789"), _table(b"\n")
_CHARS = np.arange(256) & 0xC0 != 0x80


def _share_bins(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bin 0 for none, then finer for small shares than for large ones."""
    share = part / np.maximum(whole, 1)
    return np.where(part == 0, 0, np.clip(np.ceil(BINS - 1 + 1.5 * np.log2(np.maximum(share, 1e-9))), 1, BINS - 1)).astype(np.int64)


def _size_bins(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + n), BINS - 1).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of each text's features, their places and values.  A text's words
    have a length of one together, each statistic a value of one."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    docs = len(texts)
    if not len(buf):
        buf = np.full(1, 0x20, np.uint8)  # one empty text

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[at[1:] - 1] - total[at[:-1]]

    starts, ends = word_spans(buf)
    hashes = span_hashes(buf, starts, ends, lower=True)
    cut = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(docs), np.diff(cut))
    n_words = np.diff(cut)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])][:len(hashes)]
    key = np.unique((doc << WORD_BITS) | (hashes & U64((1 << WORD_BITS) - 1)).astype(np.int64))
    word_doc = key >> WORD_BITS
    distinct = np.bincount(word_doc, minlength=docs)

    line_at = np.flatnonzero(_LINES[buf])
    lines = np.searchsorted(line_at, at[1:] - 1) - np.searchsorted(line_at, at[:-1]) + 1
    repeats = np.array([len(x) - len(set(x)) for x in (t.split(b"\n") for t in texts)])
    chars = per_text(_CHARS[buf])
    letters = np.maximum(chars - per_text(~_CHARS[buf]), 1)
    bins = np.stack([
        _share_bins(per_text(_UPPER[buf]), letters),
        _share_bins(per_text(_SYMBOLS[buf]), n_words), _share_bins(per_text(_MARKS[buf]), n_words),
        _share_bins(per_text(_BARS[buf]), n_words), _share_bins(per_text(_DIGITS[buf]), chars),
        _share_bins(np.bincount(doc[same], minlength=docs), n_words),
        _share_bins(distinct, n_words), _size_bins(chars / np.maximum(n_words, 1)),
        _size_bins(n_words / lines), _share_bins(repeats, lines),
        _share_bins(per_text(_STOPS[buf]), n_words), _size_bins(chars), _size_bins(lines)], axis=1)
    stats = (1 << WORD_BITS) + np.arange(len(STATS)) * BINS + bins

    place = np.concatenate([key & ((1 << WORD_BITS) - 1), stats.ravel()])
    value = np.concatenate([1 / np.sqrt(np.maximum(distinct, 1))[word_doc], np.ones(stats.size)])
    owner = np.concatenate([word_doc, np.repeat(np.arange(docs), len(STATS))])
    order = np.argsort(owner, kind="stable")
    return np.cumsum(distinct + len(STATS)), place[order], value[order]


def margins(model: Model, ends: np.ndarray, place: np.ndarray, value: np.ndarray):
    """Log odds of each text, and its sums of v_i x_i."""
    first = np.r_[0, ends[:-1]]
    vx = model.vectors[place] * value[:, None]
    sums = np.add.reduceat(vx, first)
    pairs = 0.5 * (sums ** 2 - np.add.reduceat(vx ** 2, first)).sum(axis=1)
    return model.bias + np.add.reduceat(model.weights[place] * value, first) + pairs, sums


def fit(ends: np.ndarray, place: np.ndarray, value: np.ndarray, label: np.ndarray,
        seed: int = 7) -> Model:
    """Logistic loss by Adagrad over small batches in a seeded order."""
    rng = np.random.default_rng(seed)
    rate = np.clip(label.mean(), 0.01, 0.99)
    model = Model(float(np.log(rate / (1 - rate))), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    bias, seen_w, seen_v = model.bias, np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6)
    first = np.r_[0, ends[:-1]]
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for i in range(0, len(order), BATCH):
            rows = order[i:i + BATCH]
            size = ends[rows] - first[rows]
            stop = np.cumsum(size)
            take = np.arange(stop[-1]) + np.repeat(first[rows] - (stop - size), size)
            p, x = place[take], value[take]
            margin, sums = margins(model._replace(bias=bias), stop, p, x)
            slope = (1 / (1 + np.exp(-margin)) - label[rows]) / len(rows)
            own = np.repeat(slope, size) * x
            used, back = np.unique(p, return_inverse=True)
            grad_w = np.bincount(back, own, len(used)) + DECAY * model.weights[used]
            each = own[:, None] * (np.repeat(sums, size, axis=0) - model.vectors[p] * x[:, None])
            grad_v = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(RANK)], axis=1)
            grad_v += DECAY * model.vectors[used]
            seen_w[used] += grad_w ** 2
            seen_v[used] += grad_v ** 2
            model.weights[used] -= 5 * RATE * grad_w / np.sqrt(seen_w[used])
            model.vectors[used] -= RATE * grad_v / np.sqrt(seen_v[used])
            bias -= RATE * slope.sum()
    return model._replace(bias=bias)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _features_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, place, value = text_bytes(batch.column(2)), [], []
        for a, b in pieces(texts):
            ends, p, x = features(texts[a:b])
            place += np.split(p.astype("<i4"), ends[:-1])
            value += np.split(x, ends[:-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([p.tobytes() for p in place], pa.binary()),
             pa.array([x.tobytes() for x in value], pa.binary())], ["id", "label", "place", "value"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled documents outside the held-out
    fold, chosen by a hash of the id; None if there are none.  Rows with a null
    id or label are not used; of an id's labels the smallest counts."""
    known = (labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
             .where("id is not null and label is not null").where(~held_out(F.col("id")))
             .groupBy("id").agg(F.min("label").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = (texts.join(F.broadcast(known), "id").select("id", "label", "text")
            .mapInArrow(_features_arrow, "id long, label int, place binary, value binary")
            .collect())
    if not rows:
        return None
    rows.sort(key=lambda r: (r.id, bytes(r.place)))
    place = [np.frombuffer(r.place, "<i4") for r in rows]
    return fit(np.cumsum([len(p) for p in place]), np.concatenate(place).astype(np.int64),
               np.concatenate([np.frombuffer(r.value, np.float64) for r in rows]),
               np.array([r.label for r in rows], float))


def scorer(spark: SparkSession, model: Model | None):
    """Column function: the score of a text, 0 to 1.  Without a model it is 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        if shared.value is None:
            return pa.array([1.0] * len(column), pa.float64())
        texts, out = text_bytes(column), [np.zeros(0)]
        for a, b in pieces(texts):
            out.append(1 / (1 + np.exp(-margins(shared.value, *features(texts[a:b]))[0])))
        give_back()
        return pa.array(np.concatenate(out))
    return score


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                  text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  Null text
    counts as empty; empty texts are scored by their size; a null id is not
    held out; repeated rows get equal scores; columns but the two named ones
    are not read; an empty table gives no rows."""
    score = scorer(docs.sparkSession, train(docs, labels, doc_id, text))
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                      score(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                 text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, unchanged; cases
    as in ``score_quality``."""
    score = scorer(docs.sparkSession, train(docs, labels, doc_id, text))
    return docs.where(score(F.col(text)) >= threshold)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
