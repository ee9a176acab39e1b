"""Packing: an exact round trip to the tokenizer's ids."""
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pagesift.llm import packing as P
from pagesift.llm.tokens import ID, default_vocabulary, encode_all
from conftest import LONG, ODD


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(default_vocabulary())


def reference(model, text):
    return model.encode(text or "", add_special_tokens=False).ids + [P.END_ID]


def check(rows, model, texts):
    """rows of one table; texts by id."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048 and {r["sequence_tokens"] for r in parts} == {at}
    for i, text in texts.items():
        ids = reference(model, text)
        parts = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        assert sum(r["length"] for r in parts) == len(ids) and {r["doc_tokens"] for r in parts} == {len(ids)}
        for r in parts:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, ID).tobytes())
            assert "ids" not in r.asDict() or r["ids"] == part
    return sequences


def test_odd_rows(odd_docs, model):
    rows = P.pack_documents(odd_docs).collect()
    texts = {i: t for i, t in ODD if i not in (5,)}
    check(rows, model, texts)
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 2 * len(reference(model, "a b c d e f"))


def test_whole_table_has_little_padding(spark, sf_small, model):
    rows = P.op1_packing(spark, sf_small).collect()
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    sequences = check(rows, model, {d["doc_id"]: d["text"] for d in docs})
    sizes = [sum(r["length"] for r in s) for s in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding <= 2048
    steps = {}
    for r in {r["sequence_id"]: r for r in rows}.values():
        steps.setdefault(r["step_id"], []).append(r["sequence_tokens"])
    assert all(len(set(s)) == 1 and sum(s) <= P.STEP_WINDOWS * 2048 for s in steps.values())


def test_empty_table(docs_of):
    assert P.pack_documents(docs_of([])).count() == 0


def test_step_groups_balance_costs():
    windows = [[(256, i, 0)] if i % 2 else [(128, i, 0), (128, -i, 0)] for i in range(256)]
    groups = P.step_groups(windows, 2048)
    cost = {}
    for w, g in zip(windows, groups):
        cost[g] = cost.get(g, 0) + sum(p[0] ** 2 for p in w)
    assert len(cost) == 2 and max(cost.values()) == min(cost.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40))
def test_blocks_lose_nothing(lengths):
    windows, rest = P.pack_block([(n, i, 0) for i, n in enumerate(lengths)], P.TIERS)
    assert all(sum(p[0] for p in w) in P.TIERS for w in windows)
    assert sum(p[0] for p in rest) < 2048
    windows += P.cut_rest(rest, 2048)
    spans = sorted((d, s, n) for w in windows for n, d, s in w)
    for i, n in enumerate(lengths):
        own = [(s, k) for d, s, k in spans if d == i]
        assert [s for s, _ in own] == list(np.cumsum([0] + [k for _, k in own])[:-1])
        assert sum(k for _, k in own) == n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAZ é.ß'’s-!?|<>0９9\n\t ̸́=日́İΣ\x1c\x85"), max_size=40),
                max_size=6))
def test_words_by_memory_equal_the_tokenizer(texts):
    model = Tokenizer.from_file(default_vocabulary())
    texts += ["<|endoftext|>x <|ENDOFTEXT|>", LONG[:3000]]
    got = encode_all(default_vocabulary(), [t.encode() for t in texts])
    assert [g.tolist() for g in got] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_packing_task_hands_its_memory_back(spark, monkeypatch):
    # the worker lives on beside the JVM and later stages' workers
    from pagesift.llm import packing
    wrapped = []
    monkeypatch.setattr(packing, "trimmed", lambda run: wrapped.append(run) or run)
    packing.pack_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert len(wrapped) == 1
