"""Multinomial naive Bayes over block token bags (M3/M4, A1-A5, K1/K2).

Training is a sparse long table ``(page_id, pos, label, token, cnt)`` and a
partial + final hash aggregate per token; the term matrix is never built.
Prediction sums ``cnt * ln p`` inside each page row, so it needs no label, no
key and no shuffle, and runs unchanged on a stream: the model's tokens go to
the workers in a broadcast whose bytes are checked.  A model beyond ``BROADCAST_BYTES`` is joined by token instead, on a row number
of a written copy of the pages; the scores are the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.text import remove_markers, token_bag
from pagesift.session import ensure_checkpoint_dir

# Greatest size of the model's tokens and numbers for the broadcast.
BROADCAST_BYTES = 256 << 20
_PAIR = "array<struct<sp:double,sn:double>>"


def css_long(df: DataFrame, keys=("page_id",), label: bool = True) -> DataFrame:
    """Blocks to ``(keys, pos, label, token, cnt)``, one row per bag entry;
    without ``label`` for pages that have none."""
    fields = ("pos", "label", "css") if label else ("pos", "css")
    # outer generator + null filter: see ``segment.explode_blocks``
    blocks = df.select(*keys, F.inline_outer(F.transform(
        "blocks", lambda b: F.struct(*[b[f].alias(f) for f in fields])))).filter(F.col("pos").isNotNull())
    return blocks.select(*keys, *fields[:-1], F.explode("css").alias("token", "cnt"))


def with_text_bags(df: DataFrame) -> DataFrame:
    """Blocks whose bag holds the words of their own unmarked text, lower-cased,
    in place of class and id tokens."""
    words = lambda b: F.filter(
        F.split(F.lower(remove_markers(b["text"])), r"\s+"), lambda t: t != "")
    return df.withColumn("blocks", F.transform(
        "blocks", lambda b: b.withField("css", token_bag(words(b)))))


def bags_only(df: DataFrame, *keys: str) -> DataFrame:
    """Pages with what a model is fitted on and scores: bags and labels, no text;
    ``keys`` are kept beside the page_id."""
    return df.select("page_id", *keys, F.transform("blocks", lambda b: F.struct(
        *[b[f].alias(f) for f in ("pos", "css", "label")])).alias("blocks"))


def block_count(df: DataFrame) -> DataFrame:
    """One row: number of blocks and of positive blocks."""
    return df.select(F.explode_outer("blocks").alias("b")).filter(F.col("b").isNotNull()).agg(
        F.count("*").alias("n_blocks"),
        F.count_if(F.col("b.label") == 1).alias("n_positive"))


def nb_vocab(df: DataFrame) -> DataFrame:
    """Distinct tokens over the training blocks."""
    return css_long(df).select("token").distinct()


def nb_counts(df: DataFrame) -> DataFrame:
    """A3: Laplace-smoothed token counts per class."""
    long = css_long(df)
    return long.groupBy("token").agg(
        (F.sum(F.col("cnt") * F.col("label")) + 1).cast("double").alias("pos_cnt"),
        (F.sum(F.col("cnt") * (1 - F.col("label"))) + 1).cast("double").alias("neg_cnt"))


@dataclass
class NBModel:
    """Fitted model: per-token table plus scalars (bounded: two sums, a prior)."""
    table: DataFrame          # token, pos_cnt, neg_cnt, pos_prob, neg_prob
    prior: float              # share of positive training blocks
    n_blocks: int
    n_tokens: int
    nnz: int

    @property
    def sparseness(self) -> float:
        cells = self.n_blocks * self.n_tokens
        return 1.0 - self.nnz / cells if cells else 0.0


def _bag_stats(df: DataFrame, *keys: str) -> DataFrame:
    """Blocks, positive blocks and non-zero cells in one pass over page rows."""
    return df.groupBy(*keys).agg(
        F.sum(F.size("blocks")).alias("n_blocks"),
        F.sum(F.size(F.filter("blocks", lambda b: b["label"] == 1))).alias("n_positive"),
        F.sum(F.aggregate("blocks", F.lit(0), lambda acc, b: acc + F.size(b["css"]))).alias("nnz"))


def _model(counts: DataFrame, n_blocks: int, n_positive: int, nnz: int) -> NBModel:
    """A model from its smoothed counts (token, pos_cnt, neg_cnt)."""
    sums = counts.agg(F.count("*").alias("n"), F.sum("pos_cnt").alias("sp"),
                      F.sum("neg_cnt").alias("sn")).first()
    table = counts.select(
        "token", "pos_cnt", "neg_cnt",
        (F.col("pos_cnt") / F.lit(float(sums["sp"] or 1.0))).alias("pos_prob"),
        (F.col("neg_cnt") / F.lit(float(sums["sn"] or 1.0))).alias("neg_prob"))
    return NBModel(table, n_positive / n_blocks if n_blocks else 0.0, n_blocks,
                   int(sums["n"] or 0), nnz)


def nb_fit(df: DataFrame) -> NBModel:
    """M3/A2-A5: fit on labelled pages (``blocks`` with ``label``, ``css``).

    The prior is a real ratio (the reference's integer division is a bug).
    """
    ensure_checkpoint_dir(df.sparkSession)
    counts = nb_counts(df).checkpoint(eager=True)
    stats = _bag_stats(df).first()
    return _model(counts, *[int(stats[c] or 0) for c in ("n_blocks", "n_positive", "nnz")])


def nb_fit_folds(df: DataFrame, k: int) -> list[NBModel]:
    """M5: the models of ``k`` rounds, each fitted on the pages whose ``fold``
    is not the round's (pages without a fold train in all).  Tokens are
    counted once by fold; a round's counts are sums over the other folds."""
    ensure_checkpoint_dir(df.sparkSession)
    long = css_long(df, keys=("fold",))
    counts = long.groupBy("fold", "token").agg(
        F.sum(F.col("cnt") * F.col("label")).alias("pos"),
        F.sum(F.col("cnt") * (1 - F.col("label"))).alias("neg")).checkpoint(eager=True)
    stats = _bag_stats(df, "fold").collect()
    models = []
    for i in range(k):
        rest = counts.where(F.col("fold").isNull() | (F.col("fold") != i)).groupBy("token").agg(
            (F.sum("pos") + 1).cast("double").alias("pos_cnt"),
            (F.sum("neg") + 1).cast("double").alias("neg_cnt"))
        train = [r for r in stats if r["fold"] != i]
        models.append(_model(rest, *[sum(int(r[c] or 0) for r in train)
                                     for c in ("n_blocks", "n_positive", "nnz")]))
    return models


def _ln(p: float) -> float:
    return math.log(p) if p > 0 else float("-inf")


def nb_predict(df: DataFrame, model: NBModel, out: str = "prediction",
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``out`` (1 iff positive score >= negative score) and the two
    scores to every block.  Out-of-vocabulary tokens add nothing; a block
    without tokens is decided by the prior alone.  Rows are scored one by one,
    so copies of a page stay apart, and need no label."""
    size = model.table.agg(F.sum(F.octet_length("token") + 64).alias("n")).first()["n"] or 0
    bags = F.transform("blocks", lambda b: b["css"])
    if size <= broadcast_bytes:
        # a generator of one row keeps the bags, and what Python made of the
        # page before, in a projection of their own below this UDF
        bagged = df.select("*", F.explode(F.array(bags)).alias("_bags"))
        scored = bagged.withColumn("_nbs", _bag_scorer(model)(F.col("_bags"))).drop("_bags")
    elif df.isStreaming:
        raise ValueError("score a stream with a model of this size batch by batch (foreachBatch)")
    else:
        scored = _scored_by_join(df, model)
    ln_prior, ln_rest = _ln(model.prior), _ln(1.0 - model.prior)

    def decide(b, s):
        pos, neg = s["sp"] + F.lit(ln_prior), s["sn"] + F.lit(ln_rest)
        return (b.withField("nb_pos", pos).withField("nb_neg", neg)
                 .withField(out, F.when(pos >= neg, F.lit(1)).otherwise(F.lit(0))))
    # read by position in a lambda, so the optimizer keeps the UDF's projection apart
    return scored.withColumn("blocks", F.transform(
        "blocks", lambda b, i: decide(b, F.get(F.col("_nbs"), i)))).drop("_nbs")


def for_tokens_of(few: DataFrame, model: NBModel) -> NBModel:
    """``model`` with the tokens of ``few`` pages alone, which it scores as
    before: the tokens of those pages are sent to every task, not the model's."""
    met = F.broadcast(css_long(few, label=False).select("token").distinct())
    return replace(model, table=model.table.join(met, "token", "left_semi"))


def _bag_scorer(model: NBModel):
    """Column function: the score sums of each bag in an array of bags."""
    rows = model.table.select("token", "pos_prob", "neg_prob").toArrow().to_pydict()
    table = {t: (math.log(p), math.log(n)) for t, p, n in
             zip(rows["token"], rows["pos_prob"], rows["neg_prob"])}
    shared = model.table.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(_PAIR)
    def score(bags: pa.Array) -> pa.Array:
        known, none = shared.value, (0.0, 0.0)
        out = []
        for page in bags.to_pylist():
            sums = []
            for bag in page or ():
                sp = sn = 0.0
                for token, cnt in bag or ():
                    lp, ln = known.get(token, none)
                    sp += cnt * lp
                    sn += cnt * ln
                sums.append({"sp": sp, "sn": sn})
            out.append(None if page is None else sums)
        return pa.array(out, pa.list_(pa.struct([("sp", pa.float64()), ("sn", pa.float64())])))
    return score


def _scored_by_join(df: DataFrame, model: NBModel) -> DataFrame:
    """The same sums for a model of any size: bags are exploded, joined by
    token and summed by row and block.  The pages are written once with a row
    number, so both sides of the last join see the same rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
    side = model.table.select("token", F.ln("pos_prob").alias("lp"), F.ln("neg_prob").alias("ln"))
    long = rows.select("_row", F.posexplode("blocks").alias("_i", "b")).select(
        "_row", "_i", F.explode("b.css").alias("token", "cnt"))
    sums = (long.join(side, "token").groupBy("_row", "_i")
                .agg(F.sum(F.col("cnt") * F.col("lp")).alias("sp"),
                     F.sum(F.col("cnt") * F.col("ln")).alias("sn"))
                .groupBy("_row").agg(F.map_from_entries(F.collect_list(
                    F.struct("_i", F.struct("sp", "sn")))).alias("_sums")))
    joined = rows.join(sums, "_row", "left")
    zero = F.struct(F.lit(0.0).alias("sp"), F.lit(0.0).alias("sn"))
    return joined.withColumn("_nbs", F.transform("blocks", lambda b, i: F.coalesce(
        F.element_at("_sums", i), zero))).drop("_row", "_sums")


def nb_oov(df: DataFrame, model: NBModel) -> DataFrame:
    """J2 report: tokens of ``df``'s blocks missing from the vocabulary,
    with their block counts."""
    counts = css_long(df, label=False).groupBy("token").agg(F.count("*").cast("bigint").alias("n_blocks"))
    # counted first: what is joined grows with the words, not with their uses
    return counts.join(model.table.select("token"), "token", "left_anti")


def nb_indicative(model: NBModel, n: int = 10) -> DataFrame:
    """K1: top ``n`` tokens by ``ln(p_pos / p_neg)`` (kind 'positive',
    descending) and bottom ``n`` (kind 'negative', ascending); ties by token."""
    s = model.table.select("token", F.ln(F.col("pos_prob") / F.col("neg_prob")).alias("score"))
    pos = s.orderBy(F.col("score").desc(), "token").limit(n)
    neg = s.orderBy(F.col("score").asc(), "token").limit(n)
    return _ranked(pos, "positive", desc=True).unionByName(_ranked(neg, "negative", desc=False))


def nb_weighted_negative(model: NBModel, n: int = 10) -> DataFrame:
    """K2: top ``n`` tokens by ``ln(p_neg / p_pos) * neg_cnt``; ties by token."""
    s = model.table.select(
        "token", (F.ln(F.col("neg_prob") / F.col("pos_prob")) * F.col("neg_cnt")).alias("score"))
    return _ranked(s.orderBy(F.col("score").desc(), "token").limit(n),
                   "weighted_negative", desc=True)


def _ranked(top: DataFrame, kind: str, desc: bool) -> DataFrame:
    # ``top`` holds at most n rows (TakeOrderedAndProject), so ranking it in
    # one task is bounded by the parameter, not by the data
    order = F.col("score").desc() if desc else F.col("score").asc()
    w = Window.orderBy(order, F.col("token"))
    return top.select(F.lit(kind).alias("kind"), F.row_number().over(w).cast("int").alias("rank"),
                      "token", "score")


def learned_tokens(model: NBModel, n: int = 10) -> list[str]:
    """The ``n`` weighted-negative tokens, in rank order (at most n)."""
    rows = nb_weighted_negative(model, n).orderBy("rank").collect()
    return [r["token"] for r in rows]


def learned_tokens_folds(df: DataFrame, k: int, n: int = 10) -> list[list[str]]:
    """M10 for the ``k`` rounds of a cross validation: tokens are counted once
    by fold; one plan sums them for every round and ranks the round's tokens
    (``k * n`` rows reach the driver)."""
    counts = css_long(df, keys=("fold",)).groupBy("fold", "token").agg(
        F.sum(F.col("cnt") * F.col("label")).alias("pos"), F.sum(F.col("cnt") * (1 - F.col("label"))).alias("neg"))
    rounds = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.col("fold").isNull() | (i != F.col("fold")))
    by_round = (counts.select(F.explode(rounds).alias("round"), "token", "pos", "neg").groupBy("round", "token")
                .agg((F.sum("pos") + 1).cast("double").alias("pos"), (F.sum("neg") + 1).cast("double").alias("neg")))
    totals = by_round.groupBy("round").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))  # k rows
    p_pos, p_neg = F.col("pos") / F.col("sp"), F.col("neg") / F.col("sn")
    scored = by_round.join(F.broadcast(totals), "round").select("round", "token", (F.ln(p_neg / p_pos) * F.col("neg")).alias("score"))
    best = Window.partitionBy("round").orderBy(F.col("score").desc(), "token")
    rows = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).collect()
    return [[r["token"] for r in sorted(rows, key=lambda r: r["rank"]) if r["round"] == i] for i in range(k)]
