"""End-to-end jobs: corpus preparation, model training, prediction and the
reference's evaluation protocols (holdout, resubstitution, K-fold CV on
documents, 10-fold CV on blocks, naive-Bayes report).

Pages stay one row each with nested blocks through features, prediction and
evaluation; only model fitting works on the long example table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators.ablation import ablation, subsets_of
from pagesift.operators.blocks import block_labels, extract_article, with_gold_predictions
from pagesift.operators.evaluate import eval_report, evaluate
from pagesift.operators.features import (INDICATIVE_TOKENS, RELATIVE_POSITION, SHALLOW_TEXT,
                                         SHALLOW_TEXT_FEATURES,
                                         feature_dim, feature_vectors, training_examples,
                                         unique_examples)
from pagesift.operators.curve import score_curve
from pagesift.operators.nb import learned_tokens, learned_tokens_folds, nb_fit, nb_fit_folds, nb_predict
from pagesift.operators.segment import segment_blocks
from pagesift.operators.split import holdout_split, kfold_assign, sample_docs, stratified_folds
from pagesift.operators.svm import (SVMModel, fold_udf, fold_weights, stored_examples, svm_fit,
                                    svm_fit_folds, svm_predict_blocks, svm_predict_folds)
from pagesift.sources.corpus import gold_key, read_table
from pagesift.sources.tables import stored
from pagesift.functions.text import normalize_text, strip_xml_decl

FULL_SPEC = (SHALLOW_TEXT, RELATIVE_POSITION, (INDICATIVE_TOKENS, 10))


def page_blocks(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Segment pages first (narrow, on the scan), then attach gold text.

    Joining after segmentation shuffles block text instead of raw HTML; the
    gold side has one row per document, so a hot document only skews the
    page side, which AQE's skew join splits.
    """
    keyed = pages.select("page_id", gold_key("url").alias("doc_id"),
                         strip_xml_decl("html").alias("html"))
    seg = segment_blocks(keyed)
    gold = documents.select("doc_id", normalize_text("text").alias("gold"))
    return seg.join(gold, "doc_id", "inner")


def labelled_pages(spark: SparkSession, sf_dir: str, only: tuple | None = None) -> DataFrame:
    """Pages with ``blocks[pos, text, css, label]``, ``body_text``, ``gold``;
    with ``only`` the rows of that (page_id, doc_id), picked by the scans of
    both tables before anything is segmented or normalized."""
    pages, documents = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents")
    if only:
        pages = pages.where(F.col("page_id").eqNullSafe(F.lit(only[0])))
        documents = documents.where(F.col("doc_id") == F.lit(only[1]))
    return block_labels(page_blocks(pages, documents))


def materialize_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write labelled pages (nested blocks, gold, body text) as a parquet
    table and read it back.  The Python walk then runs once per corpus; model
    fitting, CV rounds and evaluations read the table, and the written table
    also cuts the lineage (a lost executor re-reads files, it does not
    re-segment).  ``path`` should be on the cluster's shared storage."""
    pages.write.mode(mode).parquet(path)
    return pages.sparkSession.read.parquet(path)


@dataclass
class ContentModel:
    spec: tuple
    tokens: list[str] | None
    svm: SVMModel


def train_content_model(train: DataFrame, spec: Sequence = (SHALLOW_TEXT,),
                        unique: bool = True, components: int = 128,
                        seed: int = 42) -> ContentModel:
    """Learn indicative tokens when selected, build features,
    optionally de-duplicate examples, then fit scaler + SVM."""
    spec = tuple(spec)
    tokens = None
    for item in spec:
        if isinstance(item, tuple) and item[0] == INDICATIVE_TOKENS:
            tokens = learned_tokens(nb_fit(train), int(item[1]))
    feats = feature_vectors(train, spec, tokens)
    examples = training_examples(feats)
    if unique:
        examples = unique_examples(examples)
    svm = svm_fit(examples, feature_dim(spec), components=components, seed=seed)
    return ContentModel(spec, tokens, svm)


def predict_pages(model: ContentModel, pages: DataFrame) -> DataFrame:
    """M2: per-block ``prediction`` for every page (no shuffle)."""
    feats = feature_vectors(pages, model.spec, model.tokens)
    return svm_predict_blocks(feats, model.svm)


def score_pages(predicted: DataFrame, lcs: bool = True) -> DataFrame:
    """P17 + A10/A11: rebuild each page's article and score it."""
    art = extract_article(predicted, "prediction")
    return evaluate(art, "extracted", "gold", keys=("page_id",), lcs=lcs)


def holdout_eval(pages: DataFrame, spec: Sequence = (SHALLOW_TEXT,), ratio: float = 0.7,
                 unique: bool = False, limit: int = 0) -> DataFrame:
    """M7: train on the first ``int(n * ratio)`` pages (page_id order), score
    the rest; returns the one-round report.  ``limit`` > 0 takes a sample of
    as many pages first (K3), here and in the other protocols."""
    split = holdout_split(sample_docs(stored(pages), limit), ratio)
    model = train_content_model(split.filter("split = 'train'").drop("split"), spec, unique)
    test = split.filter("split = 'test'").drop("split")
    metrics = score_pages(predict_pages(model, test)).withColumn("round", F.lit(0))
    return eval_report(metrics)


def resub_eval(pages: DataFrame, spec: Sequence = (SHALLOW_TEXT,),
               unique: bool = False, limit: int = 0) -> DataFrame:
    """M8: train and test on all pages; per-page metrics."""
    pages = sample_docs(stored(pages), limit)
    model = train_content_model(pages, spec, unique)
    return score_pages(predict_pages(model, pages))


def resub_curve(pages: DataFrame, spec: Sequence = (SHALLOW_TEXT,), unique: bool = False,
                limit: int = 0) -> DataFrame:
    """M8 into A16: the cumulative curve of the resubstitution F1."""
    return score_curve(resub_eval(pages, spec, unique, limit), "f1")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cv_eval(pages: DataFrame, k: int = 5, spec: Sequence = FULL_SPEC,
            unique: bool = True, limit: int = 0) -> DataFrame:
    """M5: contiguous K-fold CV over pages; remainder pages only train.
    Returns per-round and final averages.  The models of all rounds are fitted
    together, and every page is scored once, by the model of its fold."""
    spec = tuple(spec)
    folded = kfold_assign(sample_docs(stored(pages), limit), k)
    variants, examples = _variants(folded, spec, k), []
    for tokens, rounds in variants:
        rows = training_examples(feature_vectors(folded, spec, tokens), ("page_id", "fold"))
        weights = F.transform(fold_weights(k), lambda w, i: F.when(
            F.array_contains(F.array(*[F.lit(r) for r in rounds]), i), F.least(w, F.lit(1.0)) if unique else w
        ).otherwise(0.0))
        examples.append(rows.groupBy("label", "f").agg(weights.alias("w")))
    models = svm_fit_folds(stored_examples(_union(examples)), feature_dim(spec), k)
    scored = []
    for tokens, rounds in variants:
        test = folded.where(F.col("fold").isin(rounds))
        predicted = svm_predict_folds(feature_vectors(test, spec, tokens), models)
        art = extract_article(predicted, "prediction")
        scored.append(evaluate(art.withColumn("round", F.col("fold")), "extracted", "gold", keys=("page_id", "round")))
    return eval_report(_union(scored))


def _variants(folded: DataFrame, spec: tuple, k: int) -> list[tuple[list[str] | None, list[int]]]:
    """The lists of learned tokens that rounds use, with their rounds; one
    without tokens if ``spec`` asks for none."""
    n = [int(item[1]) for item in spec if isinstance(item, tuple) and item[0] == INDICATIVE_TOKENS]
    if not n:
        return [(None, list(range(k)))]
    by_list: dict = {}
    for i, tokens in enumerate(learned_tokens_folds(folded, k, n[-1])):
        by_list.setdefault(tuple(tokens), []).append(i)
    return [(list(tokens), rounds) for tokens, rounds in by_list.items()]


def nb_cv_eval(pages: DataFrame, k: int = 5, lcs: bool = False, limit: int = 0) -> DataFrame:
    """M5 with the naive-Bayes block classifier (fully SQL-expressible when
    ``lcs`` is off): per-page metrics with their ``round``.  The counts of all
    rounds come from one aggregate."""
    folded = kfold_assign(sample_docs(stored(pages), limit), k)
    models = nb_fit_folds(folded, k)
    return _union([
        score_pages(nb_predict(folded.filter(F.col("fold") == i).drop("fold"), model), lcs=lcs)
        .withColumn("round", F.lit(i)) for i, model in enumerate(models)])


# Scores of block predictions from (label, prediction); a score without a
# denominator is 0.
def _tp():
    return F.sum(F.col("label") * F.col("prediction"))


_SCORES = {
    "accuracy": lambda: F.avg((F.col("label") == F.col("prediction")).cast("double")),
    "precision": lambda: F.coalesce(_tp() / F.nullif(F.sum("prediction"), F.lit(0)), F.lit(0.0)),
    "recall": lambda: F.coalesce(_tp() / F.nullif(F.sum("label"), F.lit(0)), F.lit(0.0)),
    "f1": lambda: F.coalesce(2 * _tp() / F.nullif(F.sum("prediction") + F.sum("label"), F.lit(0)),
                             F.lit(0.0)),
}


def block_folds(pages: DataFrame, folds: int = 10, seed: int = 42) -> DataFrame:
    """(page_id, pos, label, fold): the stratified folds of all blocks."""
    blocks = training_examples(feature_vectors(pages, (SHALLOW_TEXT,)))
    return stratified_folds(stored(blocks.select("page_id", "pos", "label"), "labels"), folds, seed=seed)


def block_cv(pages: DataFrame, folds: int = 10, spec: Sequence = (SHALLOW_TEXT,),
             unique: bool = False, seed: int = 42, scoring: str = "accuracy",
             limit: int = 0) -> DataFrame:
    """M6: block-level CV with stratified folds (seeded order within each
    class); the scaler is fitted inside each fold.  ``scoring`` is one of
    accuracy, precision, recall, f1.  Returns ``(fold, <scoring>)`` rows."""
    feats = feature_vectors(sample_docs(pages, limit), spec)
    examples = training_examples(feats)
    if unique:
        examples = unique_examples(examples)
    examples = stratified_folds(stored(examples, "examples"), folds, "label",
                                cols=("f",) if unique else ("page_id", "pos"), seed=seed)
    dim = feature_dim(spec)
    weighted = examples.groupBy("label", "f").agg(fold_weights(folds).alias("w"))
    models = svm_fit_folds(stored_examples(weighted), dim, folds, seed=seed)
    # a block is scored as a one-block page, by the model of its fold
    scored = (examples.select("label", "fold", F.explode(F.array(F.array("f"))).alias("_f"))
              .withColumn("prediction", fold_udf(models)(F.col("_f"), F.col("fold"))[0]))
    return scored.groupBy("fold").agg(_SCORES[scoring]().alias(scoring))


def ablation_examples(pages: DataFrame, k: int = 5, spec: Sequence = FULL_SPEC, limit: int = 0):
    """(written examples (fold, label, f), number of columns, subsets of columns
    for each round) for ``operators.ablation``: the columns of all extractors of
    ``spec``, indicative tokens once each whichever rounds have learned them."""
    folded = kfold_assign(sample_docs(stored(pages), limit), k)
    variants = _variants(folded, tuple(spec), k)
    tokens = list(dict.fromkeys(t for learned, _ in variants for t in learned or ()))
    plain = tuple(item for item in spec if not isinstance(item, tuple))
    full = plain + (((INDICATIVE_TOKENS, len(tokens)),) if tokens else ())
    rows = training_examples(feature_vectors(folded, full, tokens), ("page_id", "fold")).select("fold", "label", "f")
    subsets: list = [None] * k
    for learned, rounds in variants:
        groups, features, at = {}, {}, 0
        for name in plain:
            width = feature_dim((name,))
            groups[name] = range(at, at + width)
            named = SHALLOW_TEXT_FEATURES if name == SHALLOW_TEXT else [name] * width
            features.update({n: at + i for i, n in enumerate(named)})
            at += width
        if learned:
            groups[INDICATIVE_TOKENS] = [at + tokens.index(t) for t in learned]
        for i in rounds:
            subsets[i] = subsets_of(groups, features)
    return stored(rows, "examples"), feature_dim(full), subsets


def feature_ablation(pages: DataFrame, k: int = 5, spec: Sequence = FULL_SPEC, limit: int = 0) -> DataFrame:
    """M9: every join of extractors, and all columns but one, under K-fold CV."""
    return ablation(*ablation_examples(pages, k, spec, limit))


def evaluate_external(predictions: DataFrame, pages: DataFrame, lcs: bool = True,
                      round_col: str | None = None) -> DataFrame:
    """Score a text-predicting extractor.  ``predictions`` holds
    ``(page_id, extracted)`` (e.g. output of a pre-trained extractor run
    elsewhere); it is joined to the pages' gold text on ``page_id`` and
    scored exactly like an article rebuilt from blocks.  With ``round_col``
    the per-page metrics keep that column for ``eval_report``."""
    keys = ("page_id",) + ((round_col,) if round_col else ())
    joined = predictions.select(*keys, "extracted").join(
        pages.select("page_id", "gold"), "page_id", "inner")
    return evaluate(joined, "extracted", "gold", keys=keys, lcs=lcs)


def gold_article(pages: DataFrame) -> DataFrame:
    """Article rebuilt from gold labels: the upper bound of block selection."""
    return extract_article(with_gold_predictions(pages), "prediction")
