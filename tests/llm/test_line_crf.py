"""Line labelling: base counts, decoding and fitting against brute force."""
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagesift.llm import line_crf as C
from conftest import LONG, ODD, prose, words


def base(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(words(line)) and line in seen
        seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated))


def texts():
    rng = random.Random(5)
    out = [t for _, t in ODD] + [LONG]
    for _ in range(60):
        lines = [" ".join(prose(rng, rng.randint(0, 9))) for _ in range(rng.randint(0, 8))]
        lines += rng.choices(lines or [""], k=rng.randint(0, 4)) + [rng.choice(["a | b |", "WOW!!", "x###", " "])]
        out.append(rng.choice(["\n", "\n\n", "\r\n"]).join(lines))
    return out


def test_base_counts(docs_of):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in C.label_lines(docs_of(rows), None).collect()}
    for i, t in rows:
        r, b = got[i], base(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == b
        assert r["base_failed"] == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert r["kept"] == (not r["base_failed"])  # without a chain all lines are content


@pytest.fixture(scope="module")
def chain():
    rng = np.random.default_rng(1)
    return C.Chain(rng.normal(0, 2, C.BINS * len(C.FIELDS)), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))


def path_score(chain, lines, k, path):
    at = range(lines.first[k], lines.first[k] + lines.count[k])
    total = chain.start[path[0]]
    for i, y in zip(at, path):
        total += chain.emit[lines.features[i]].sum() * (y == C.BOILERPLATE)
    return total + sum(chain.move[a, b] for a, b in zip(path, path[1:]))


def test_decoding_is_the_best_of_all_paths(chain):
    few = [t for t in texts() if (t or "").count("\n") < 9]
    _, lines = C.read_lines([(t or "").encode() for t in few])
    got = C.viterbi(chain, lines)
    assert lines.count.max() > 4
    for k, n in enumerate(lines.count):
        if n:
            own = got[lines.first[k]:lines.first[k] + n]
            best = max(path_score(chain, lines, k, p) for p in itertools.product((0, 1), repeat=int(n)))
            assert path_score(chain, lines, k, own.tolist()) == pytest.approx(best)


def test_fitting_raises_the_likelihood():
    good = ["A line of prose here.\nAnother line that goes on.\nEnd."] * 4
    bad = ["menu | home | about |\nBUY!! NOW!!\nx### y### z###"] * 4
    _, lines = C.read_lines([t.encode() for t in good + bad])
    label = np.repeat([0] * 4 + [1] * 4, lines.count)
    assert (C.viterbi(C.fit(lines, label), lines) == label).all()


def test_forward_backward_is_the_sum_over_all_paths(chain):
    few = [t for t in texts() if (t or "").count("\n") < 7]
    _, lines = C.read_lines([(t or "").encode() for t in few])
    rng = np.random.default_rng(2)
    bias = rng.normal(0, 1, len(lines.words))
    got, moves, starts = C.posterior(chain, lines, bias)
    all_moves, all_starts = np.zeros((2, 2)), np.zeros(2)
    for k, n in enumerate(lines.count):
        if not n:
            continue
        at = slice(lines.first[k], lines.first[k] + n)
        paths = np.array(list(itertools.product((0, 1), repeat=int(n))))
        score = np.array([path_score(chain, lines, k, p.tolist()) + (bias[at] * p).sum() for p in paths])
        chance = np.exp(score - np.logaddexp.reduce(score))
        assert got[at] == pytest.approx(chance @ paths, abs=1e-9)
        all_starts += np.bincount(paths[:, 0], chance, 2)
        for p, c in zip(paths, chance):
            np.add.at(all_moves, (p[:-1], p[1:]), c)
    assert moves == pytest.approx(all_moves) and starts == pytest.approx(all_starts)


def test_common_lines_have_different_neighbours():
    texts = [f"Own {i}.\nShared by all.\nOther {i}." for i in range(4)] + ["A b.\nC d.\nE f."] * 5
    _, lines = C.read_lines([t.encode() for t in texts])
    got = C.common_lines(lines.hashes, np.repeat(np.arange(len(texts)), lines.count))
    assert got.tolist() == [lines.hashes[1]]


def labelled(spark, sf):
    rows = (spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
            .where("text is not null").orderBy("doc_id").collect())
    return [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]


def test_lines_of_joined_documents(spark, sf_small):
    """Held-out good and bad documents end to end: the lines keep their labels."""
    sf = sf_small.replace("sf0.001", "sf0.01")
    model = C.train(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    rows = labelled(spark, sf)
    good = [r["text"] for r in rows if r["quality"] == 1 and len(words(r["text"])) >= 10]
    bad = [r["text"] for r in rows if r["quality"] == 0 and len(words(r["text"])) >= 10]
    rng = random.Random(8)
    hits = {0: [], 1: []}
    shares = []
    for _ in range(150):
        parts = [(0, rng.choice(good)), (1, rng.choice(bad)), (0, rng.choice(good))][:rng.randint(2, 3)]
        rng.shuffle(parts)
        _, lines = C.read_lines(["\n".join(t for _, t in parts).encode()], model.common)
        truth = np.concatenate([np.full(sum(1 for x in t.split("\n") if words(x)), y) for y, t in parts])
        got = C.viterbi(model, lines)
        for y in (0, 1):
            hits[y] += (got[truth == y] == y).tolist()
        shares.append((lines.words * (got == 0)).sum() / lines.words.sum())
    assert np.mean(hits[0]) >= 0.9 and np.mean(hits[1]) >= 0.9, {y: np.mean(h) for y, h in hits.items()}
    assert np.mean([0 < s < 1 for s in shares]) > 0.95


def test_shares_are_mixed_on_the_given_table(spark, sf_small):
    rows = C.op4_quality_rules(spark, sf_small.replace("sf0.001", "sf0.01")).collect()
    assert sum(0 < r["content_share"] < 1 for r in rows) >= 10


def test_training_keeps_to_its_lines(spark, docs_of):
    rows = [(i, "One line of prose goes here.\n" * 5) for i in range(1, 40)] * 3
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    assert C.train(docs_of(rows), labels, most_lines=20) is not None
    assert C.train(docs_of(rows), labels, most_lines=5) is None


def test_odd_rows_labels_and_empty_tables(spark, docs_of, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 0), (9, 0, 0), (None, 1, 0), (8, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = C.train(odd_docs, labels)
    assert model is not None and C.label_lines(odd_docs, model).count() == len(ODD)
    assert C.train(docs_of([]), labels) is None and C.train(odd_docs, labels.limit(0)) is None
    assert C.label_lines(docs_of([]), model).count() == 0


def test_held_out_documents(spark, sf_small):
    sf = sf_small.replace("sf0.001", "sf0.01")
    rows = C.op4_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
