"""The pipeline's stages, each against brute force on its own input."""
import random
from collections import Counter

import corpus_pipeline
import pytest

from pagesift.llm import mixing, packing, quality_fm
from pagesift.llm.common import in_written_order, read_table, stash
from conftest import ODD, prose
from test_exact_dedup import brute as exact_brute
from test_ngram_join import brute as near_brute


@pytest.fixture(scope="module")
def run(spark, sf_small):
    docs = read_table(spark, sf_small, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stash(stage(spark, out[-1], sf_small), name))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_and_columns(run):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_copies", "near_copies", "mixture", "packing"]
    assert all(df.columns == run[0].columns for df in run[1:5])


def test_quality(spark, sf_small, run):
    labels = read_table(spark, sf_small, "labels")
    scored = quality_fm.score_quality(run[0], labels).where("score >= 0.7").collect()
    assert sorted(i for i, _ in rows(run[1])) == sorted(r["doc_id"] for r in scored)
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(bad & {i for i, _ in rows(run[1])}) <= len(bad) * 0.2


def test_exact_copies(run):
    assert sorted(i for i, _ in rows(run[2])) == sorted({r[1] for r in exact_brute(rows(run[1]))})


def test_near_copies(run):
    want = sorted(i for i, n, c in near_brute(rows(run[2])) if n == 0 or i == c)
    assert sorted(i for i, _ in rows(run[3])) == want


def test_mixture_and_packing(run, spark, sf_small):
    assert sorted(rows(run[4])) == sorted(rows(run[3]))
    pieces = run[5].collect()
    assert {p["doc_id"] for p in pieces} == {i for i, _ in rows(run[4])}
    size = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert sum(p["length"] for p in pieces) == sum(size.values())
    whole = corpus_pipeline.run(spark, sf_small)
    assert whole.columns == run[5].columns and whole.agg({"length": "sum"}).first()[0] == sum(size.values())


def test_sequences_follow_the_mixture(spark, docs_of, monkeypatch):
    """Each stretch of sequences has the target shares, whatever the sizes of
    the files that the mixture is written to."""
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 4096)
    monkeypatch.setattr(mixing, "BLOCK_SIZE", 400)
    rng = random.Random(5)
    rows = [(i, " ".join(prose(rng, rng.choice([2, 30, 60, 120]))), "ab"[i % 4 == 0]) for i in range(3000)]
    size, total = {}, {"a": 0, "b": 0}
    for i, t, s in rows:
        size[i] = len(t) + 1
        total[s] += len(t) + 1
    w = {s: n ** 0.5 for s, n in total.items()}
    mixed = stash(mixing.in_mixed_order(docs_of(rows).repartition(3)), "mixture")
    mixed = spark.read.schema(mixed.schema).parquet(mixed.inputFiles()[0].rpartition("/")[0])
    place = {r["doc_id"]: k for k, r in enumerate(in_written_order(mixed).collect())}
    want = mixing.mix_sources(docs_of(rows)).select("doc_id", "mix.slot", "mix.before").collect()
    assert [r["doc_id"] for r in sorted(want, key=lambda r: (r["slot"], r["before"]))] == sorted(place, key=place.get)
    pieces = sorted(corpus_pipeline.packing(spark, mixed, "").collect(), key=lambda p: (p["sequence_id"], p["offset"]))
    assert sorted({p["doc_id"] for p in pieces}) == sorted(size)
    source = {i: s for i, _, s in rows}
    # until the source that ends first: every tenth has nearly the target shares
    last = {s: max(place[i] for i in source if source[i] == s) for s in "ab"}
    used = [p for p in pieces if place[p["doc_id"]] < min(last.values())]
    used = used[:len(used) * 9 // 10]
    for k in range(10):
        part = used[len(used) * k // 10:len(used) * (k + 1) // 10]
        tokens = {s: sum(p["length"] for p in part if source[p["doc_id"]] == s) for s in "ab"}
        assert abs(tokens["a"] / sum(tokens.values()) - w["a"] / sum(w.values())) < 0.08
    off = [abs(place[p["doc_id"]] - k) for k, p in enumerate({p["doc_id"]: p for p in pieces}.values())]
    assert sum(off) / len(off) < 0.03 * len(rows)


def test_odd_rows_and_empty_tables(spark, docs_of, sf_small):
    """Nulls, empty and very long texts, repeated ids with equal and other texts,
    clashing columns: every stage on its own; then the whole chain, also of no rows."""
    text = " ".join(prose(random.Random(6), 60))
    given = ODD + [(30, text), (31, text + " "), (30, "quite another text under the same id as before"), (None, text)]
    docs = docs_of(given).drop("mix")  # the one name that the mixture keeps for itself
    stages = dict(corpus_pipeline.STAGES)
    got = {n: stages[n](spark, docs, sf_small) for n in list(stages)[:-1]}
    assert all(df.columns == docs.columns for df in got.values())
    whole = Counter(given)
    assert not Counter(rows(got["quality"])) - whole
    assert Counter(rows(got["mixture"])) == whole
    bare = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    exact = rows(got["exact_copies"])
    assert sorted(bare(t) for _, t in exact) == sorted({bare(t) for _, t in given}) and not Counter(exact) - whole
    near = rows(got["near_copies"])
    assert not Counter(near) - whole and len([t for _, t in near if bare(t) == bare(text)]) == 1
    assert (30, text) in near and (30, "quite another text under the same id as before") in near
    assert len([t for _, t in near if not bare(t)]) == 3
    pieces = stages["packing"](spark, stash(docs, "given"), sf_small).collect()  # reads written tables
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(i for i, _ in given)
    for table in (docs, docs.limit(0)):
        left = table
        for name, stage in corpus_pipeline.STAGES:
            left = stash(stage(spark, left, sf_small), name)
        assert (left.count() > 0) == (table is docs)
