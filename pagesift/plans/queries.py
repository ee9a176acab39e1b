"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the survey's inventory, each over the whole given tables.

Doubles are rounded to 6 places and integer widths fixed so the results
compare value-for-value with the DuckDB oracles in ``plans.oracle_sql``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import (anchor_text, css_tokens, normalize_text,
                                     remove_markers, strip_xml_decl, token_bag)
from pagesift.operators import nb as nbm
from pagesift.operators.ablation import fold_moments, moments_table
from pagesift.operators.blocks import block_labels, extract_article, with_gold_predictions
from pagesift.operators.evaluate import (diagnostics, eval_lcs, eval_report, eval_tokens,
                                         lcs_inclusion)
from pagesift.operators.features import (INDICATIVE_TOKENS, RELATIVE_POSITION,
                                         SHALLOW_TEXT, SHALLOW_TEXT_FEATURES, block_features,
                                         block_features_window,
                                         feature_dim, feature_vectors,
                                         relative_position, training_examples,
                                         unique_examples)
from pagesift.operators.nb_updates import NBState
from pagesift.operators.observed import stored_with_diagnostics
from pagesift.operators.scale import scale, scaler_factors, scaler_fit
from pagesift.operators.svm import FourierMap, SVMModel, svm_predict_blocks
from pagesift.operators.split import holdout_split, kfold_assign, sample_docs
from pagesift.operators.curve import score_curve, score_summary, cv_summary
from pagesift.plans import jobs
from pagesift.session import tune
from pagesift.sources.corpus import gold_key, load_pairs, pages_without_gold, read_table
from pagesift.sources.sinks import libsvm_lines
from pagesift.sources.files import decode_bytes, gold_from_spans
from pagesift.sources.tables import fresh_path

K_FOLDS = 5
HOLDOUT_RATIO = 0.7
TOP_N = 10
SAMPLE_SIZE = 100
IND_SPEC = (SHALLOW_TEXT, RELATIVE_POSITION, (INDICATIVE_TOKENS, TOP_N))


def _r(c):
    return F.round(c, 6)


def _pages(spark, sf, only=None):
    tune(spark)
    return jobs.labelled_pages(spark, sf, only)


def _long(df, *fields):
    # outer generator + explicit null filter: an inner one makes the optimizer
    # infer ``size(blocks) > 0`` and push it below the segmentation UDF,
    # evaluating the UDF twice
    rows = df.select("page_id", F.inline_outer(F.transform(
        "blocks", lambda b: F.struct(F.lit(True).alias("_row"), *[b[f].alias(f) for f in fields]))))
    return rows.filter(F.col("_row").isNotNull()).select("page_id", *fields)


# -- sources / joins -------------------------------------------------------
def q_load_pairs(spark, sf):
    pairs = load_pairs(read_table(spark, sf, "pages"), read_table(spark, sf, "documents"))
    return pairs.select("page_id", "doc_id",
                        F.length("html").cast("bigint").alias("n_html_chars"), "gold")


def q_strip_xml_decl(spark, sf):
    # the given pages have no declaration: every page gets one, after some
    # white space and in either case
    p = read_table(spark, sf, "pages")
    declared = F.concat(
        F.expr("repeat(' ', cast(page_id % 3 as int))"),
        F.when(F.col("page_id") % 2 == 0, '<?xml version="1.0" encoding="utf-8"?>')
        .otherwise('<?XML version="1.0"?>'), "html")
    return p.select("page_id", strip_xml_decl(declared).alias("html"))


def q_pages_without_gold(spark, sf):
    return pages_without_gold(read_table(spark, sf, "pages"),
                              read_table(spark, sf, "documents")).select("page_id", "url")


def q_decode_pages(spark, sf):
    p = read_table(spark, sf, "pages")
    raw = p.select("page_id", F.encode("html", "UTF-8").alias("raw"))
    dec = raw.select("page_id", decode_bytes("raw").alias("text"))
    return dec.select("page_id", F.length("text").cast("bigint").alias("n_chars"))


def q_gold_from_spans(spark, sf):
    # the given pages have no annotations: the lines of the documents are
    # annotated by turns as a gold span, a gold span around a density span, and
    # a span of another class, with text between them
    d = read_table(spark, sf, "documents")
    plain = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def annotated(line, i):
        gold = F.concat(F.lit('<span class="x-nc-sel2">'), line, F.lit("</span>"))
        nested = F.concat(F.lit('<span class="x-nc-sel2"><span x-text-density="1">'), line,
                          F.lit("</span></span>"))
        other = F.concat(F.lit('<span class="x-nc-sel2 z">'), line, F.lit("</span>"))
        return F.concat(F.when(i % 3 == 0, gold).when(i % 3 == 1, nested).otherwise(other),
                        F.lit("<p>between</p>"))
    html = F.array_join(F.transform(F.split(plain, "\n"), annotated), "")
    return d.select("doc_id", html.alias("html")).select("doc_id", gold_from_spans("html").alias("gold"))


# -- text functions --------------------------------------------------------
def q_normalize_text(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", normalize_text("text").alias("text"))


def q_segment_blocks(spark, sf):
    return _long(_pages(spark, sf), "pos", "text")


def q_block_css(spark, sf, source=_pages):
    b = _long(source(spark, sf), "pos", "css")
    return b.select("page_id", "pos", F.explode("css").alias("token", "cnt"))


def q_anchor_text(spark, sf):
    b = _long(_pages(spark, sf), "pos", "text")
    return b.select("page_id", "pos", anchor_text("text").alias("anchor"))


def q_plain_blocks(spark, sf):
    b = _long(_pages(spark, sf), "pos", "text")
    return b.select("page_id", "pos", remove_markers("text").alias("plain"))


def _css_sources(spark, sf):
    part = read_table(spark, sf, "part")
    cust = read_table(spark, sf, "customer")
    pages = read_table(spark, sf, "pages")
    return (part.select(F.lit("p_name").alias("source"), F.col("p_partkey").alias("id"),
                        F.col("p_name").alias("s"))
            .unionByName(part.select(F.lit("p_brand").alias("source"),
                                     F.col("p_partkey").alias("id"), F.col("p_brand").alias("s")))
            .unionByName(cust.select(F.lit("c_name").alias("source"),
                                     F.col("c_custkey").alias("id"), F.col("c_name").alias("s")))
            .unionByName(pages.select(F.lit("url").alias("source"),
                                      F.col("page_id").alias("id"), F.col("url").alias("s"))))


def q_css_tokens(spark, sf):
    src = _css_sources(spark, sf)
    return src.select("source", "id", F.posexplode_outer(css_tokens("s")).alias("idx", "token")) \
              .filter(F.col("idx").isNotNull()) \
              .select("source", "id", F.col("idx").cast("int").alias("idx"), "token")


def q_css_token_counts(spark, sf):
    src = _css_sources(spark, sf)
    return src.select("source", "id", F.explode_outer(token_bag(css_tokens("s"))).alias("token", "cnt")) \
              .filter(F.col("token").isNotNull()) \
              .select("source", "id", "token", F.col("cnt").cast("int").alias("cnt"))


# -- labels, features, articles -------------------------------------------
def q_block_labels(spark, sf):
    return _long(_pages(spark, sf), "pos", "label")


def q_block_features(spark, sf):
    b = _long(block_features(_pages(spark, sf)), "pos", *SHALLOW_TEXT_FEATURES)
    return b.select("page_id", "pos", *[_r(F.col(c)).alias(c) for c in SHALLOW_TEXT_FEATURES])


def q_block_features_window(spark, sf):
    blocks = _long(_pages(spark, sf), "pos", "text")
    b = block_features_window(blocks)
    return b.select("page_id", "pos", *[_r(F.col(c)).alias(c) for c in SHALLOW_TEXT_FEATURES])


def q_relative_position(spark, sf):
    b = _long(relative_position(_pages(spark, sf)), "pos", "rel_pos")
    return b.select("page_id", "pos", "rel_pos")


def _indicative_model(pages):
    return nbm.learned_tokens(nbm.nb_fit(pages), TOP_N)


def q_feature_vectors(spark, sf):
    pages = jobs.stored(_pages(spark, sf))
    feats = feature_vectors(pages, IND_SPEC, _indicative_model(pages))
    b = _long(feats, "pos", "f")
    dim = feature_dim(IND_SPEC)
    return b.select("page_id", "pos", *[_r(F.get("f", k)).alias(f"f{k:02d}") for k in range(dim)])


def q_indicative_features(spark, sf, source=_pages):
    pages = jobs.stored(nbm.bags_only(source(spark, sf)), "bags")
    feats = feature_vectors(pages, ((INDICATIVE_TOKENS, TOP_N),), _indicative_model(pages))
    b = _long(feats, "pos", "f")
    return b.select("page_id", "pos", *[F.get("f", k).alias(f"i{k:02d}") for k in range(TOP_N)])


def _shallow_examples(spark, sf):
    return training_examples(feature_vectors(_pages(spark, sf), (SHALLOW_TEXT,)))


def q_label_stats(spark, sf):
    # one hash aggregate on (label, f) gives both the plain and the
    # de-duplicated counts, then a global aggregate of that
    groups = _shallow_examples(spark, sf).groupBy("label", "f").agg(F.count("*").alias("c"))
    return groups.agg(
        F.sum("c").cast("bigint").alias("n_examples"),
        F.sum(F.when(F.col("label") == 1, F.col("c")).otherwise(0)).cast("bigint")
        .alias("n_positive"),
        F.count("*").cast("bigint").alias("n_unique"),
        F.count_if(F.col("label") == 1).cast("bigint").alias("n_unique_positive"))


def q_unique_examples(spark, sf):
    u = unique_examples(_shallow_examples(spark, sf))
    return u.select("label", *[_r(F.get("f", k)).alias(f"f{k}") for k in range(7)])


_SCALE_SPEC = (SHALLOW_TEXT, RELATIVE_POSITION)


def q_scaler_fit(spark, sf):
    ex = training_examples(feature_vectors(_pages(spark, sf), _SCALE_SPEC))
    fac = scaler_factors(ex, feature_dim(_SCALE_SPEC))
    return fac.select("idx", "non_negative", *[_r(F.col(c)).alias(c)
                                               for c in ("min", "max", "range", "max_abs")])


def q_scaled_features(spark, sf):
    ex = jobs.stored(training_examples(feature_vectors(_pages(spark, sf), _SCALE_SPEC)), "examples")
    dim = feature_dim(_SCALE_SPEC)
    sc = scale(ex, scaler_fit(ex, dim))
    return sc.select("page_id", "pos", *[_r(F.get("f", k)).alias(f"s{k}") for k in range(dim)])


def q_libsvm_lines(spark, sf):
    ex = jobs.stored(training_examples(feature_vectors(_pages(spark, sf), (SHALLOW_TEXT,))), "examples")
    sc = scale(ex, scaler_fit(ex, 7))
    return libsvm_lines(sc).select("page_id", "pos", "line")


def _gold_articles(spark, sf):
    return extract_article(with_gold_predictions(_pages(spark, sf)), "prediction")


def q_extract_article(spark, sf):
    return _gold_articles(spark, sf).select("page_id", "extracted", "fallback")


def q_eval_tokens(spark, sf):
    m = eval_tokens(_gold_articles(spark, sf))
    return m.select("page_id", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def q_eval_lcs(spark, sf):
    m = eval_lcs(_gold_articles(spark, sf))
    return m.select("page_id", *[_r(F.col(c)).alias(c)
                                 for c in ("lcs_precision", "lcs_recall", "lcs_f1")])


def q_lcs_flags(spark, sf):
    return lcs_inclusion(_gold_articles(spark, sf))


def _fold_metrics(spark, sf):
    art = kfold_assign(_gold_articles(spark, sf), K_FOLDS)
    m = eval_tokens(art, keys=("page_id", "fold"))
    return m.filter(F.col("fold").isNotNull()).withColumnRenamed("fold", "round")


def q_eval_report(spark, sf):
    rep = eval_report(_fold_metrics(spark, sf))
    return rep.select("scope", "round", "n_docs", "n_skipped",
                      *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def q_eval_external(spark, sf):
    pages = _pages(spark, sf)
    # a text-predicting extractor's output, scored like an article rebuilt
    # from blocks; here the extractor is "whole-body text"
    predictions = pages.select("page_id", F.col("body_text").alias("extracted"))
    m = jobs.evaluate_external(predictions, pages, lcs=False)
    return m.select("page_id", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def q_diagnostics(spark, sf):
    art = jobs.stored(block_features(_gold_articles(spark, sf)))
    base = diagnostics(_long(art, "words_raw", "wps_raw"), art)
    # model warnings: out-of-vocabulary tokens met on held-out pages, and how
    # many of the requested indicative tokens the vocabulary cannot supply
    split = holdout_split(art, HOLDOUT_RATIO)
    model = nbm.nb_fit(split.filter("split = 'train'").drop("split"))
    oov = nbm.nb_oov(split.filter("split = 'test'").drop("split"), model).agg(
        F.lit("oov_block_tokens").alias("metric"),
        F.coalesce(F.sum("n_blocks"), F.lit(0)).cast("bigint").alias("value"))
    full = nbm.nb_fit(art)
    short = nbm.nb_weighted_negative(full, TOP_N).agg(
        F.lit("indicative_token_shortfall").alias("metric"),
        (F.lit(TOP_N) - F.count("*")).cast("bigint").alias("value"))
    return base.unionByName(oov).unionByName(short)


def q_score_summary(spark, sf):
    m = eval_tokens(_gold_articles(spark, sf))
    s = score_summary(m, "f1")
    return s.select("n", _r(F.col("mean")).alias("mean"), _r(F.col("median")).alias("median"))


def q_score_curve(spark, sf):
    m = eval_tokens(_gold_articles(spark, sf))
    c = score_curve(m, "f1")
    return c.select("x", _r(F.col("y")).alias("y"))


def q_cv_summary(spark, sf):
    rep = eval_report(_fold_metrics(spark, sf)).filter("scope = 'round'")
    s = cv_summary(rep, "f1")
    return s.select("n_folds", _r(F.col("mean")).alias("mean"),
                    _r(F.col("two_std")).alias("two_std"))


# -- splits ----------------------------------------------------------------
def q_kfold_assign(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id")
    return kfold_assign(p, K_FOLDS).select("page_id", "fold")


def q_holdout_split(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id")
    return holdout_split(p, HOLDOUT_RATIO).select("page_id", "split")


def q_sample_docs(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url")
    return sample_docs(p, SAMPLE_SIZE)


# -- naive Bayes -----------------------------------------------------------
def _text_pages(spark, sf, only=None):
    """Pages whose bags hold the words of the blocks' own text: thousands of
    tokens, where the class and id bags of the given pages have one."""
    return nbm.with_text_bags(_pages(spark, sf, only))


def _with_text(fn):
    """The query over word bags."""
    def run(spark, sf):
        return fn(spark, sf, _text_pages)
    run.__name__, run.__doc__ = fn.__name__ + "_text", fn.__doc__
    return run


def _nb(spark, sf, source=_pages):
    pages = jobs.stored(source(spark, sf))
    return pages, nbm.nb_fit(pages)


def _nb_bags(spark, sf, source=_pages):
    """As ``_nb``, for queries that read no text of the pages: only the bags are
    written, and read by each pass."""
    pages = jobs.stored(nbm.bags_only(source(spark, sf)), "bags")
    return pages, nbm.nb_fit(pages)


def q_nb_vocab(spark, sf, source=_pages):
    return nbm.nb_vocab(source(spark, sf))


def q_nb_prior(spark, sf):
    b = nbm.block_count(_pages(spark, sf))
    return b.select(F.col("n_blocks").cast("bigint"), F.col("n_positive").cast("bigint"),
                    _r(F.col("n_positive") / F.col("n_blocks")).alias("prior"))


def q_nb_model(spark, sf, source=_pages):
    _, model = _nb_bags(spark, sf, source)
    return model.table.select("token", *[_r(F.col(c)).alias(c) for c in
                                         ("pos_cnt", "neg_cnt", "pos_prob", "neg_prob")])


def q_nb_sparseness(spark, sf, source=_pages):
    pages = source(spark, sf)
    # one row per block and bag entry; a token-less block keeps one NULL row
    cells = pages.select(F.explode_outer("blocks").alias("b")).filter(
        F.col("b").isNotNull()).select(
        F.posexplode_outer("b.css").alias("k", "token", "cnt"))
    one = cells.agg(F.count_if(F.col("k").isNull() | (F.col("k") == 0)).alias("n_blocks"),
                    F.count_distinct("token").alias("n_tokens"),
                    F.count("token").alias("nnz"))
    n_cells = F.col("n_blocks") * F.col("n_tokens")
    return one.select(F.col("n_blocks").cast("bigint"), F.col("n_tokens").cast("bigint"),
                      F.col("nnz").cast("bigint"),
                      _r(F.when(n_cells > 0, 1 - F.col("nnz") / n_cells).otherwise(0.0))
                      .alias("sparseness"))


def q_nb_predict(spark, sf, source=_pages):
    pages, model = _nb_bags(spark, sf, source)
    b = _long(nbm.nb_predict(pages, model), "pos", "prediction", "nb_pos", "nb_neg")
    return b.select("page_id", "pos", F.col("prediction").cast("int"),
                    _r(F.col("nb_pos")).alias("nb_pos"), _r(F.col("nb_neg")).alias("nb_neg"))


def q_nb_oov(spark, sf, source=_pages):
    split = holdout_split(jobs.stored(nbm.bags_only(source(spark, sf)), "bags"), HOLDOUT_RATIO)
    model = nbm.nb_fit(split.filter("split = 'train'").drop("split"))
    return nbm.nb_oov(split.filter("split = 'test'").drop("split"), model)


def q_nb_indicative(spark, sf, source=_pages):
    _, model = _nb_bags(spark, sf, source)
    return nbm.nb_indicative(model, TOP_N).select("kind", "rank", "token",
                                                   _r(F.col("score")).alias("score"))


def q_nb_weighted_negative(spark, sf, source=_pages):
    _, model = _nb_bags(spark, sf, source)
    return nbm.nb_weighted_negative(model, TOP_N).select("kind", "rank", "token",
                                                          _r(F.col("score")).alias("score"))


def q_nb_report(spark, sf, source=_pages):
    # the model needs bags only; the one page whose article is asked for is
    # found by its keys and read again with its texts
    bags = jobs.stored(nbm.bags_only(source(spark, sf), "doc_id"), "bags")
    model = nbm.nb_fit(bags)
    keys = bags.select("page_id", "doc_id").orderBy("page_id", "doc_id").limit(1).collect()
    first = source(spark, sf, only=tuple(keys[0])) if keys else source(spark, sf)
    return nb_report(jobs.stored(first.limit(1), "first"), model, TOP_N)


def nb_report(pages: DataFrame, model, n: int) -> DataFrame:
    """Vocabulary size, top tokens both ways, and the article the model
    extracts from the first page (lowest page_id)."""
    head = F.lit(0).cast("int")
    size = model.table.agg(F.count("*").cast("double").alias("value")).select(
        F.lit("n_tokens").alias("section"), head.alias("rank"),
        F.lit(None).cast("string").alias("token"), "value",
        F.lit(None).cast("string").alias("text"))
    top = nbm.nb_indicative(model, n).select(
        F.col("kind").alias("section"), "rank", "token", _r(F.col("score")).alias("value"),
        F.lit(None).cast("string").alias("text"))
    first = pages.orderBy("page_id").limit(1)
    art = extract_article(nbm.nb_predict(first, nbm.for_tokens_of(first, model)), "prediction").select(
        F.lit("article").alias("section"), head.alias("rank"),
        F.lit(None).cast("string").alias("token"),
        F.col("page_id").cast("double").alias("value"), F.col("extracted").alias("text"))
    return size.unionByName(top).unionByName(art)


# -- models (rows-only checks) ---------------------------------------------
def q_svm_score(spark, sf):
    pages = jobs.stored(_pages(spark, sf))
    model = jobs.train_content_model(pages, (SHALLOW_TEXT,), unique=False)
    return _long(jobs.predict_pages(model, pages), "pos", "label", "prediction")


def q_holdout_eval(spark, sf):
    return jobs.holdout_eval(_pages(spark, sf), (SHALLOW_TEXT,), HOLDOUT_RATIO)


def q_resub_eval(spark, sf):
    return jobs.resub_eval(_pages(spark, sf), (SHALLOW_TEXT,))


def q_cv_eval(spark, sf):
    return jobs.cv_eval(_pages(spark, sf), K_FOLDS, IND_SPEC, unique=True)


def q_nb_cv_eval(spark, sf):
    return eval_report(jobs.nb_cv_eval(_pages(spark, sf), K_FOLDS, lcs=True))


def q_nb_cv_tokens(spark, sf):
    rep = eval_report(jobs.nb_cv_eval(_pages(spark, sf), K_FOLDS, lcs=False))
    return rep.select("scope", "round", "n_docs", "n_skipped",
                      *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def q_block_cv(spark, sf):
    return jobs.block_cv(_pages(spark, sf), 10, (SHALLOW_TEXT,))


def q_block_cv_f1(spark, sf):
    return jobs.block_cv(_pages(spark, sf), 10, (SHALLOW_TEXT,), scoring="f1")


def q_block_folds(spark, sf):
    return jobs.block_folds(_pages(spark, sf), 10).select(
        "page_id", "pos", F.col("label").cast("int").alias("label"), "fold")


def q_resub_curve(spark, sf):
    c = jobs.resub_curve(_pages(spark, sf), (SHALLOW_TEXT,))
    return c.select("x", _r(F.col("y")).alias("y"))


def q_feature_moments(spark, sf):
    """M9: the sums that the ablation solves from, over scaled columns."""
    folded = kfold_assign(jobs.stored(_pages(spark, sf)), K_FOLDS)
    ex = jobs.stored(training_examples(feature_vectors(folded, _SCALE_SPEC), ("page_id", "fold")), "examples")
    dim = feature_dim(_SCALE_SPEC)
    found = moments_table(spark, fold_moments(scale(ex, scaler_fit(ex, dim)), dim))
    return found.withColumn("mean", _r(F.col("mean")))


def q_feature_ablation(spark, sf):
    return jobs.feature_ablation(_pages(spark, sf), K_FOLDS, IND_SPEC)


def page_changes(pages: DataFrame) -> list[DataFrame]:
    """Deliveries of versions of the pages: all as they are; then every third
    one with its odd blocks only; then every fifth one withdrawn, together with
    what is stale or was delivered before."""
    versioned = pages.withColumn("version", F.lit(1))
    changed = pages.where("page_id % 3 = 0").withColumn("version", F.lit(2)).withColumn(
        "blocks", F.filter("blocks", lambda b: b["pos"] % 2 == 1))
    none = F.lit(None).cast(pages.schema["blocks"].dataType)
    gone = pages.where("page_id % 5 = 1").withColumn("version", F.lit(3)).withColumn("blocks", none)
    stale = pages.where("page_id % 2 = 0").withColumn("version", F.lit(0))
    return [versioned, changed, gone.unionByName(stale).unionByName(changed)]


def q_nb_incremental(spark, sf):
    """A3/M3: the model after updates, from signed deltas."""
    pages = jobs.stored(_text_pages(spark, sf))
    state = NBState(spark, fresh_path(spark, "nb-state"))
    for changes in page_changes(pages):
        state.update(changes)
    return state.model().table.select("token", *[_r(F.col(c)).alias(c) for c in
                                                 ("pos_cnt", "neg_cnt", "pos_prob", "neg_prob")])


# Fixed numbers in place of fitted ones: what a model computes from them is
# checked against SQL.
FIXED_MAP = [[((7 * j + i) % 5 - 2) / 2 for i in range(7)] for j in range(4)]
FIXED_OFFSETS = [0.0, 0.5, 1.0, 1.5]
FIXED_COEFFICIENTS, FIXED_INTERCEPT = [1.0, -1.0, 0.5, -0.5], 0.1


def q_svm_decision(spark, sf):
    """M2 for fixed weights: scaling, Fourier map and the sign of the margin."""
    pages = jobs.stored(feature_vectors(_pages(spark, sf), (SHALLOW_TEXT,)))
    model = SVMModel(scaler_fit(training_examples(pages), 7),
                     FourierMap(np.array(FIXED_MAP), np.array(FIXED_OFFSETS)),
                     np.array(FIXED_COEFFICIENTS), FIXED_INTERCEPT)
    return _long(svm_predict_blocks(pages, model), "pos", "prediction")


def q_svm_saved(spark, sf):
    """2.9: the model of ``svm_decision``, saved and loaded as a stage."""
    from pagesift.operators.content_classifier import ContentClassifierModel
    pages = jobs.stored(_pages(spark, sf))
    scaler = scaler_fit(training_examples(feature_vectors(pages, (SHALLOW_TEXT,))), 7)
    svm = SVMModel(scaler, FourierMap(np.array(FIXED_MAP), np.array(FIXED_OFFSETS)),
                   np.array(FIXED_COEFFICIENTS), FIXED_INTERCEPT)
    path = fresh_path(spark, "content-model")
    ContentClassifierModel(jobs.ContentModel((SHALLOW_TEXT,), None, svm)).write().save(path)
    return _long(ContentClassifierModel.load(path).transform(pages), "pos", "prediction")


def q_block_table(spark, sf):
    """P5 as a table function under a lateral join."""
    from pagesift.functions.block_table import register_block_table
    pairs = load_pairs(read_table(spark, sf, "pages"), read_table(spark, sf, "documents"))
    return spark.sql(f"SELECT p.page_id, b.pos, b.text FROM {{pairs}} p, "
                     f"LATERAL {register_block_table(spark)}(p.html) b", pairs=pairs.select("page_id", "html"))


def q_observed_diagnostics(spark, sf):
    """A18 counted while the articles are written."""
    return stored_with_diagnostics(block_features(_gold_articles(spark, sf)))[1]


def _streamed_scores(spark, sf):
    """Articles of a stream of the pages, scored in five rounds."""
    from pagesift.streaming.evaluation import EvaluationState, evaluate_stream
    from pagesift.streaming.scoring import page_stream
    documents = read_table(spark, sf, "documents")

    def score(batch):
        pages = block_labels(jobs.page_blocks(batch, documents))
        return eval_tokens(jobs.gold_article(pages)).withColumn("round", (F.col("page_id") % K_FOLDS).cast("int"))
    state = EvaluationState(spark, fresh_path(spark, "stream-eval"))
    return evaluate_stream(page_stream(spark, f"{sf}/pages.parquet"), score, state)


def q_stream_eval(spark, sf):
    """A13/A14 on a stream."""
    return _streamed_scores(spark, sf).report().select(
        "scope", "round", "n_docs", "n_skipped", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def q_stream_curve(spark, sf):
    """A16 on a stream."""
    return _streamed_scores(spark, sf).curve().select("x", _r(F.col("y")).alias("y"))


def q_stream_pairs(spark, sf):
    """J1/S1 on a stream: a page arrives in its document's minute, the gold of
    half of the documents after the half hour that pages wait."""
    from pagesift.streaming.pairs import run_pairs
    from pagesift.streaming.scoring import page_stream
    pages = page_stream(spark, f"{sf}/pages.parquet")
    pages = pages.withColumn("arrived", F.timestamp_seconds(F.coalesce(gold_key("url"), "page_id") * 60))
    gold = spark.readStream.schema("doc_id BIGINT, text STRING").parquet(f"{sf}/{{documents.parquet}}")
    gold = gold.withColumn("arrived", F.timestamp_seconds(F.col("doc_id") * 60 + F.col("doc_id") % 4 * 1200))
    return run_pairs(pages, gold).select("page_id", "doc_id", "gold", "without_gold")


def q_stream_extract(spark, sf):
    """Pages streamed from the pages table through segmentation, a batch-fitted
    naive-Bayes model and article assembly (availableNow trigger)."""
    from pagesift.streaming.scoring import page_stream, run_to_table, score_new_pages
    _, model = _nb(spark, sf)
    path = run_to_table(page_stream(spark, f"{sf}/pages.parquet"),
                        lambda batch: score_new_pages(batch, model))
    return spark.read.parquet(path).select("page_id", "extracted", "fallback")


def q_block_cv_summary(spark, sf):
    return cv_summary(q_block_cv(spark, sf), "accuracy")


_REGISTRY = {
    "load_pairs": q_load_pairs,
    "strip_xml_decl": q_strip_xml_decl,
    "pages_without_gold": q_pages_without_gold,
    "decode_pages": q_decode_pages,
    "gold_from_spans": q_gold_from_spans,
    "normalize_text": q_normalize_text,
    "segment_blocks": q_segment_blocks,
    "block_css": q_block_css,
    "anchor_text": q_anchor_text,
    "plain_blocks": q_plain_blocks,
    "css_tokens": q_css_tokens,
    "css_token_counts": q_css_token_counts,
    "block_labels": q_block_labels,
    "block_features": q_block_features,
    "block_features_window": q_block_features_window,
    "relative_position": q_relative_position,
    "feature_vectors": q_feature_vectors,
    "indicative_features": q_indicative_features,
    "label_stats": q_label_stats,
    "unique_examples": q_unique_examples,
    "scaler_fit": q_scaler_fit,
    "scaled_features": q_scaled_features,
    "libsvm_lines": q_libsvm_lines,
    "extract_article": q_extract_article,
    "eval_tokens": q_eval_tokens,
    "eval_lcs": q_eval_lcs,
    "lcs_flags": q_lcs_flags,
    "eval_report": q_eval_report,
    "eval_external": q_eval_external,
    "diagnostics": q_diagnostics,
    "score_summary": q_score_summary,
    "score_curve": q_score_curve,
    "cv_summary": q_cv_summary,
    "kfold_assign": q_kfold_assign,
    "holdout_split": q_holdout_split,
    "sample_docs": q_sample_docs,
    "nb_vocab": q_nb_vocab,
    "nb_prior": q_nb_prior,
    "nb_model": q_nb_model,
    "nb_sparseness": q_nb_sparseness,
    "nb_predict": q_nb_predict,
    "nb_oov": q_nb_oov,
    "nb_indicative": q_nb_indicative,
    "nb_weighted_negative": q_nb_weighted_negative,
    "nb_report": q_nb_report,
    "text_bags": _with_text(q_block_css),
    "nb_text_vocab": _with_text(q_nb_vocab),
    "nb_text_model": _with_text(q_nb_model),
    "nb_text_sparseness": _with_text(q_nb_sparseness),
    "nb_text_predict": _with_text(q_nb_predict),
    "nb_text_oov": _with_text(q_nb_oov),
    "nb_text_indicative": _with_text(q_nb_indicative),
    "nb_text_weighted_negative": _with_text(q_nb_weighted_negative),
    "nb_text_report": _with_text(q_nb_report),
    "indicative_text_features": _with_text(q_indicative_features),
    "svm_decision": q_svm_decision,
    "block_folds": q_block_folds,
    "block_cv_f1": q_block_cv_f1,
    "resub_curve": q_resub_curve,
    "svm_score": q_svm_score,
    "holdout_eval": q_holdout_eval,
    "resub_eval": q_resub_eval,
    "cv_eval": q_cv_eval,
    "nb_cv_eval": q_nb_cv_eval,
    "nb_cv_tokens": q_nb_cv_tokens,
    "block_cv": q_block_cv,
    "block_cv_summary": q_block_cv_summary,
    "stream_extract": q_stream_extract,
    "feature_moments": q_feature_moments,
    "feature_ablation": q_feature_ablation,
    "nb_incremental": q_nb_incremental,
    "svm_saved": q_svm_saved,
    "block_table": q_block_table,
    "observed_diagnostics": q_observed_diagnostics,
    "stream_eval": q_stream_eval,
    "stream_curve": q_stream_curve,
    "stream_pairs": q_stream_pairs,
}


def _tuned(fn):
    def run(spark, sf_dir):
        tune(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES = {name: _tuned(fn) for name, fn in _REGISTRY.items()}
