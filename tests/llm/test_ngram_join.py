"""The similarity join against all pairs."""
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagesift.llm import ngram_join as N
from conftest import ODD, prose, words


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    common = Counter((a, b) for ks in where.values() for i, a in enumerate(ks) for b in ks[i + 1:])
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def altered(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "".join(prose(rng, 1))
    return " ".join(w)


def test_odd_rows(odd_docs):
    assert found(N.ngram_join(odd_docs)) == brute(ODD)


def test_groups_passages_and_thresholds(docs_of):
    rng = random.Random(11)
    rows, passage = [], " ".join(prose(rng, 60))
    base = " ".join(prose(rng, 150))
    rows += [(i, altered(rng, base, rng.randint(0, 9))) for i in range(150)]     # one large group
    rows += [(200 + i, base) for i in range(40)]                                # exact copies
    rows += [(300 + i, " ".join(prose(rng, 70)) + " " + passage + " " + " ".join(prose(rng, 60)))
             for i in range(80)]                                                # a shared passage
    for i in range(60):                                                         # pairs and triples
        t = " ".join(prose(rng, rng.randint(3, 80)))
        rows += [(400 + 3 * i + j, altered(rng, t, j * rng.randint(0, 2)).upper() if j == 1 else t + " x" * j)
                 for j in range(3)]
    rng.shuffle(rows)
    want = brute(rows)
    assert found(N.ngram_join(docs_of(rows).repartition(5))) == want
    assert len({c for _, n, c in want if n}) < len(want) - 150


@pytest.mark.parametrize("short", [2, 3])
def test_long_lists_alone_find_the_same(docs_of, monkeypatch, short):
    rng = random.Random(short)
    monkeypatch.setattr(N, "MOST_ROUNDS", 1)
    rows = []
    for g in range(12):
        t = " ".join(prose(rng, rng.randint(20, 120)))
        rows += [(100 * g + i, altered(rng, t, rng.randint(0, 6))) for i in range(25)]
    assert found(N.ngram_join(docs_of(rows))) == brute(rows)


def test_prefixes_of_any_order_share_enough():
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        pool = np.unique(rng.integers(1, 2**62, 400, dtype=np.uint64))
        a = np.sort(rng.choice(pool, n, replace=False))
        b = np.unique(np.r_[rng.choice(a, max(1, n - int(rng.integers(0, n // 4 + 1))), replace=False),
                            rng.choice(pool, int(rng.integers(0, n // 4 + 2)), replace=False)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        heavy = np.sort(rng.choice(pool, 60, replace=False))
        counts = rng.integers(1, 40, 60)
        (p, x), (q, y) = N.prefix(a, heavy, counts), N.prefix(b, heavy, counts)
        assert len(np.intersect1d(p, q)) >= min(x, y)


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(N.op7_ngram_jaccard_join(spark, sf_small)) == brute(rows)


def test_one_of_each_group_stays(docs_of):
    rng = random.Random(8)
    t = " ".join(prose(rng, 60))
    rows = [(i, altered(rng, t, i % 2)) for i in range(30)] + [(40, "alone " + t[:50]), (41, None), (42, ""),
                                                              (3, altered(rng, t, 0)), (None, t)]
    docs = docs_of(rows)
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns
    component = {i: c for i, _, c in brute([r for r in rows if r[0] is not None])}
    want = sorted({i for i, c in component.items() if i == c} | {41, 42})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want


def test_empty_table(docs_of):
    assert N.ngram_join(docs_of([])).count() == 0 and N.drop_near_copies(docs_of([])).count() == 0


def test_a_repeated_id_does_not_join_texts(docs_of):
    """(2, other) is a document of its own, whatever else has its id."""
    rng = random.Random(3)
    t, other = " ".join(prose(rng, 40)), " ".join(prose(rng, 40))
    rows = [(1, t), (2, t), (2, other), (5, altered(rng, other, 1)), (5, altered(rng, other, 1)), (7, t), (2, "x y")]
    kept = Counter((r["doc_id"], r["text"]) for r in N.drop_near_copies(docs_of(rows)).collect())
    assert kept == Counter([(1, t), (2, other), (2, "x y")])


def test_linked_null_ids(docs_of):
    """x and y meet only over a document without an id."""
    words_ = prose(random.Random(5), 100)
    m = " ".join(words_)
    x, y = " ".join(["q"] * 6 + words_[6:]), " ".join(words_[:-7] + ["z"] * 7)
    rows = [(None, m), (10, x), (11, y), (None, "a b c d e f g"), (None, "a b c d e f g")]
    assert found(N.ngram_join(docs_of(rows))) == brute(rows)
    assert {r[2] for r in brute(rows)[:2]} == {10}
    kept = Counter((r["doc_id"], r["text"]) for r in N.drop_near_copies(docs_of(rows)).collect())
    assert kept == Counter([(10, x), (None, "a b c d e f g")])


@pytest.mark.parametrize("band", range(len(N.RATIOS)))
def test_no_pair_needs_less_than_the_floor(spark, band):
    """For all sizes to 5,000 and both kinds of prefixes."""
    most, ratio = 5000, N.RATIOS[band]
    n = np.arange(1, most + 1)
    whole = -(-N.PERCENT * n // 100)
    base = np.minimum(1 + n // N.BASE_EXTRA, whole)
    frame = spark.range(1, most + 1).selectExpr("id as size", "ceil(id * 75 / 100) as w").selectExpr(
        "size", "w", f"least(1 + floor(size / {N.BASE_EXTRA}), w) as b")
    floors = {}
    for name, both in (("b", False), ("w", False), ("w", True)):
        rows = frame.selectExpr("size", f"{name} as extra").select("size", N._need_floor(ratio, both).alias("f"))
        floors[name, both] = np.array([r["f"] for r in rows.orderBy("size").collect()])

    def need(s, e, s2, e2):
        overlap = -(-(s + s2) * N.PERCENT // (100 + N.PERCENT))
        left = np.maximum(-(-N.PERCENT * s // 100) - e, -(-N.PERCENT * s2 // 100) - e2)
        return np.maximum(np.minimum(e, e2), overlap - left)

    for s in range(1, most + 1):
        near = n[(np.maximum(n, s) / np.minimum(n, s) <= ratio) & (np.minimum(n, s) * 100 >= np.maximum(n, s) * N.PERCENT)]
        b, w = base[s - 1], whole[s - 1]
        partner_b, partner_w = base[near - 1], whole[near - 1]
        assert floors["b", False][s - 1] <= min(need(s, b, near, partner_b).min(), need(s, b, near, partner_w).min())
        assert floors["w", False][s - 1] <= need(s, w, near, partner_b).min()
        assert floors["w", True][s - 1] <= need(s, w, near, partner_w).min()


def test_posted_blocks_are_small_and_hold_no_copy_twice(monkeypatch):
    """pipeline, near_copies: a worker passes on its entries by small blocks,
    within a batch too, and a class that it has met not again."""
    import pyarrow as pa

    class Shared:
        value = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rng = random.Random(9)
    texts = [" ".join(prose(rng, 300)) for _ in range(40)]
    monkeypatch.setattr(N, "BLOCK_ENTRIES", 1000)
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts)}) for _ in range(3)]
    blocks = [np.concatenate([np.frombuffer(x.as_buffer(), N.ENTRY) for x in b.column(1)])
              for b in N._post(3, 0, Shared)(iter(batches))]
    assert len(blocks) > 2 and max(map(len, blocks)) < 1000 + 300
    entries = np.concatenate(blocks)
    assert len(set(entries["cls"].tolist())) == 40
    sets = [s for s in N.text_sets([t.encode() for t in texts])]
    assert len(entries) == sum(len(N.prefix(s, *Shared.value)[0]) for s in sets)


def test_a_task_that_keeps_rows_has_one_python_worker(docs_of):
    """pipeline, near_copies: the test of ids and the class ids were two Python
    nodes one above the other, so each task that wrote rows held two workers."""
    text = " ".join(prose(random.Random(4), 60))
    docs = docs_of([(1, text), (2, text + " more"), (3, None), (None, text), (4, "other words")])
    kept = N.drop_near_copies(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_workers_do_not_load_pandas():
    """Each Python worker kept 24 MB of a library that no task needs."""
    import subprocess
    import sys
    code = "import sys, pagesift.llm.queries; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).returncode == 0
