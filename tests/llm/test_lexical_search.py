import math
import random
import re
from collections import Counter

import pytest

from pagesift.llm import lexical_search as L

from conftest import ODD, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=L.TOP):
    """Rows (item place, rank, doc_id, score) by scoring every document."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for place, (_, text) in enumerate(items):
        scored = []
        for i, bag, n in bags:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(place, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return out


def found(spark, docs_of, docs, items, **options):
    index = L.build_index(docs_of(docs))
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, score string, rank long")
    return [tuple(r) for r in L.search(index, asked, **options).collect()]


def check(spark, docs_of, docs, items, **options):
    got = found(spark, docs_of, docs, items, **options)
    want = [(items[p][0], *rest) for p, *rest in brute(docs, items, **options)]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(L, "WINDOW", 4)
    monkeypatch.setattr(L, "SHORT_SHARE", 1 / 8)


def corpus(seed, n):
    """Words of very different frequency, a third of the documents alike."""
    rng = random.Random(seed)
    vocabulary = prose(rng, 300)
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=rng.randint(0, 60))))
            for i in range(n)]
    docs += [(n + i, "Common common words, the same for all of them") for i in range(n // 2)]
    rng.shuffle(docs)
    items = [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 15))) + " common" * (i % 3)) for i in range(25)]
    return docs, items


def test_against_all_documents(spark, docs_of, small_shards):
    docs, items = corpus(1, 400)
    got = check(spark, docs_of, docs, items)
    assert len(got) == 250


def test_in_this_process_with_many_shards(small_shards):
    """Thresholds go from shard to shard, and from block to block."""
    docs, items = corpus(2, 300)
    L_block = L._block([i for i, _ in items], [L.text_terms([t.encode()])[0] for _, t in items])
    shards = []
    for a in range(0, len(docs), 30):
        t, n = L.text_terms([x.encode() for _, x in docs[a:a + 30]])
        shards.append(L._shard([i for i, _ in docs[a:a + 30]], t, n))
    L_block.n_docs = sum(s.column("n_docs")[0].as_py() for s in shards)
    L_block.n_terms = sum(s.column("n_terms")[0].as_py() for s in shards)
    df = Counter(t for _, x in docs for t in {*terms(x)})
    by_hash = {int(L.text_terms([t.encode()])[0][0]): n for t, n in df.items()}
    for k, h in enumerate(L_block.terms.tolist()):
        if h in by_hash:
            L_block.weights[k] = math.floor(1000 * math.log((2 * L_block.n_docs + 2) / (2 * by_hash[h] + 1)))

    class Shared:
        value = L_block

    import pyarrow as pa
    columns = ["ids", "sizes", "terms", "ends", "docs", "tfs"]
    batches = [pa.RecordBatch.from_pydict({c: s.column(c) for c in columns}) for s in shards]
    got = []
    for out in L._search(Shared, 10)(iter(batches)):
        rows = out.to_pydict()
        got += [(i, k, d, s) for k, (i, d, s) in enumerate(zip(rows["item"], rows["doc_id"], rows["score"]), 1)]
    assert sorted(got) == sorted(brute(docs, items))


def test_odd_documents_and_items(spark, docs_of):
    items = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "word1 OTHER3 word1"), (4, "nowhere zzzz"),
             (5, "x é ß 日本語 ÉTÉ"), (6, ". , \x00")]
    check(spark, docs_of, [(i, t) for i, t, *_ in ODD], items)


def test_ties_by_id_and_null_last(spark, docs_of):
    docs = [(i, "same words here") for i in (30, None, 5, 12, 5)] + [(7, "other")]
    got = check(spark, docs_of, docs, [(1, "same here")], top=4)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [5, 5, 12, 30]


def test_blocks_of_items(spark, docs_of, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_TERMS", 12)
    docs, items = corpus(3, 60)
    check(spark, docs_of, docs, items)


def test_empty_tables(spark, docs_of):
    assert found(spark, docs_of, [], [(1, "a")]) == []
    assert found(spark, docs_of, [(1, "a")], []) == []
    assert found(spark, docs_of, [(1, None), (2, "...")], [(1, "a")]) == []
    # one document: its words weigh floor(1000 ln(4 / 3))
    assert len(found(spark, docs_of, [(1, "a")], [(1, "a")])) == 1
