"""Pfair mixing: the schedule, and whole rows in its order."""
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import mixing as M
from conftest import ODD


def slots(blocks, weights, period):
    """The stream of each slot, by phase."""
    phases, out = M.schedule(blocks, weights, period), []
    total = sum(blocks.values())
    for k, phase in enumerate(phases):
        end = phases[k + 1].start if k + 1 < len(phases) else total
        seq = [None] * (end - phase.start)
        for s, places in phase.places.items():
            at = M.slot_of(places, np.arange(blocks[s] - phase.used[s]), period)
            for slot in at[at < len(seq)]:
                assert seq[slot] is None
                seq[slot] = s
        out.append((phase, seq))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_every_block_once_and_less_than_one_block_off(seed):
    rng = random.Random(seed)
    n, period = rng.randint(1, 9), rng.choice([16, 60, 4096])
    blocks = {i: rng.randint(0, 900) for i in range(n)}
    weights = {i: rng.random() ** 2 + 1e-4 for i in range(n)}
    given = dict.fromkeys(blocks, 0)
    for phase, seq in slots(blocks, weights, period):
        assert None not in seq
        share = {s: len(p) for s, p in phase.places.items()}
        assert sum(share.values()) == period
        count = dict.fromkeys(share, 0)
        for t, s in enumerate(seq, 1):
            count[s] += 1
            assert all(abs(count[u] - c * t / period) < 1 for u, c in share.items())
        for s, c in count.items():
            given[s] += c
    assert given == blocks


def mixed(df, **options):
    return M.mix_sources(df, **options).select("doc_id", "text", "source", "mix.*").collect()


def test_blocks_are_prefix_sums_of_each_stream(docs_of):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 60), rng.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(700)]
    got = mixed(docs_of(rows), block_size=500)
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((i, t) for i, t, _ in rows)
    streams = {}
    for r in got:
        streams.setdefault(r["stream"], []).append(r)
    assert len(streams) == 4
    for rs in streams.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["before"]):
            assert (r["before"], r["block"]) == (at, at // 500)
            at += len(r["text"]) + 1
    slot = {(r["stream"], r["block"]): r["slot"] for r in got}
    assert len(set(slot.values())) == len(slot)


def test_target_weights_hold_until_a_source_ends(docs_of):
    rows = [(i, "x" * 9, "ab"[i % 2]) for i in range(4000)]
    got = mixed(docs_of(rows), weights={"a": 0.75, "b": 0.25}, block_size=100)
    first = [r["source"] for r in sorted(got, key=lambda r: (r["slot"], r["before"]))][:2000]
    assert abs(first.count("a") / 2000 - 0.75) < 0.01


def test_order_of_the_written_mixture(docs_of):
    rows = [(i, "x" * (i % 40), f"s{i % 3}") for i in range(900)]
    docs = docs_of(rows)
    out = M.in_mixed_order(docs, block_size=300)
    assert out.columns == [c for c in docs.columns if c != "mix"]
    place = {r["doc_id"]: (r["slot"], r["before"]) for r in mixed(docs, block_size=300)}
    got = [place[r["doc_id"]] for r in out.withColumn("p", F.spark_partition_id()).collect()]
    assert got == sorted(got)


def test_odd_rows_and_empty_table(docs_of):
    rows = [(*r, None if k % 3 else "s") for k, r in enumerate(ODD)]
    got = mixed(docs_of(rows))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t in ODD)
    assert M.mix_sources(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        M.mix_sources(docs_of(rows), weights={str(i): 1 for i in range(M.MOST_STREAMS)})


def test_query(spark, sf_small):
    rows = M.op9_mixing(spark, sf_small).collect()
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs)
    for s in {r["source"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: r["chars_before"]):
            assert r["chars_before"] == at and r["block"] == at // M.BLOCK_SIZE
            at += r["chars"] + 1


def furthest_from_fluid(blocks, weights):
    """The greatest distance of a stream's blocks from its exact share, which
    is taken slot by slot, over the whole mixture."""
    placed = M.exact_slots(blocks, weights)
    owner = np.full(sum(blocks), -1)
    for s, at in enumerate(placed):
        assert len(at) == blocks[s] and (np.diff(at) > 0).all()
        owner[at] = s
    assert (owner >= 0).all()
    left, exact, count = np.array(blocks, float), np.zeros(len(blocks)), np.zeros(len(blocks))
    worst, w = 0.0, np.array([float(x) for x in weights])
    for s in owner:
        time = 1.0
        while time > 1e-12 and (live := left > 1e-9).any():
            rate = w * live / (w * live).sum()
            step = min(time, (left[live] / rate[live]).min())
            left, exact, time = left - rate * step, exact + rate * step, time - step
        count[s] += 1
        worst = max(worst, np.abs(count - exact).max())
    return worst


@pytest.mark.parametrize("blocks, weights", [
    ([1000] * 20, [1.0] * 20), ([20_000] + [2_105] * 19, [Fraction(1, 3)] + [Fraction(2, 57)] * 19),
    ([10_000] + [60] * 199, [0.5] + [0.5 / 199] * 199), ([3, 0, 7, 900], [0.1, 0.5, 1e-3, 7.0]), ([1], [0.3]), ([], []),
    ([1 + i % 9 for i in range(700)], [(1 + i % 9) ** 0.5 for i in range(700)])])
def test_exact_slots_stay_less_than_one_block_off_the_given_weights(blocks, weights):
    assert not blocks or furthest_from_fluid(blocks, weights) < 1 + 1e-6


@pytest.mark.parametrize("seed", range(10))
def test_exact_slots_of_random_weights(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 200)
    blocks = [rng.randint(0, 40) for _ in range(n)]
    assert furthest_from_fluid(blocks, [rng.random() ** 3 + 1e-3 for _ in range(n)]) < 1 + 1e-6


def test_mixture_follows_the_given_weights_over_many_periods(docs_of):
    rows = [(i, "x" * 9, f"s{i % 20}") for i in range(20_000)]  # one block each
    got = mixed(docs_of(rows), weights={f"s{i}": 0.05 for i in range(20)}, block_size=10)
    count = np.zeros(20)
    for t, r in enumerate(sorted(got, key=lambda r: r["slot"]), 1):
        count[int(r["source"][1:])] += 1
        assert np.abs(count - t / 20).max() < 1


def test_every_source_has_its_own_weight(docs_of):
    rng = random.Random(3)
    rows = [(i, "x" * 9, None if i % 301 == 300 else f"s{i % 301}") for i in range(301 * 12)]
    rows += [(-i, "x" * 9, "s7") for i in range(1, 200)]
    rng.shuffle(rows)
    got = mixed(docs_of(rows), block_size=10)  # one block each
    streams = {}
    for r in got:
        streams.setdefault(r["stream"], set()).add(r["source"])
    assert len(streams) == 301 and all(len(s) == 1 for s in streams.values())
    sizes = {s: 10 * sum(r["source"] == s for r in got) for s in {r["source"] for r in got}}
    total, count = sum(n ** 0.5 for n in sizes.values()), dict.fromkeys(sizes, 0)
    for t, r in enumerate(sorted(got, key=lambda r: r["slot"])[:3600], 1):
        count[r["source"]] += 1
        assert abs(count[r["source"]] - t * sizes[r["source"]] ** 0.5 / total) < 1 or t > 12 * total / 120 ** 0.5
