"""Chat windows: an exact round trip, budgets and masks."""
import hashlib
import random

import duckdb

from pagesift.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string, window string, parts string, idx long"


def conversations():
    rng = random.Random(2)
    out = []
    for c in range(40):
        n = rng.choice([1, 2, 5, 30])
        for t in range(n):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "tool|>\n"])
            text = rng.choice([None, "", "word " * rng.randint(0, 400), "&<>&l &a <|end|>\n<|assistant|>\n",
                               "é&amp;日本 " * rng.randint(0, 90), "</s>[INST] ok [/INST]"])
            out.append((c, t, role, text))
    out += [(50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (50, 0, None, None),
            (51, None, "system", "s " * 3000), (51, None, "user", "u"), (None, 1, "assistant", "no id")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 0) for r in rows], TURNS)


def expected(rows):
    out, nulls = {}, lambda v: (v is not None, v)
    for c in {r[0] for r in rows}:
        own = sorted(((nulls(t), r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        all_ = "".join(f"{r}\n{x}\n" for _, r, x in own)
        out[c] = (len(own), hashlib.sha256(all_.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rows = conversations()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in C.read_windows(C.chat_windows(frame(spark, rows), 200, 40)).collect()}
    assert got == expected(rows)


def test_windows_keep_to_their_rules(spark):
    rows = conversations()
    windows = C.chat_windows(frame(spark, rows), 200, 40).collect()
    assert any(w["repeated"] > 1 for w in windows)
    by_conv = {}
    for w in windows:
        by_conv.setdefault(w["conv_id"], []).append(w)
    for ws in by_conv.values():
        ws.sort(key=lambda w: w["window"])
        assert [w["window"] for w in ws] == list(range(len(ws)))
        system = ws[0]["formatted"].split(C.END)[0] if ws[0]["formatted"].startswith("<|system|>") else None
        before = None
        for w in ws:
            parts = w["formatted"].split(C.END)[:-1]
            assert len(parts) == w["repeated"] + w["new_turns"] and w["new_turns"] > 0
            if w["window"]:
                if system:
                    assert parts[0] == system
                history = parts[bool(system):w["repeated"]]
                assert not history or before[-len(history):] == history
            room = max(200 - 40 - (C.MARK_TOKENS + 10**9 if system is None else 0), C.LEAST_NEW)
            assert w["tokens"] <= 200 or w["new_turns"] == 1 or system or room
            targets = [w["formatted"][m["start"]:m["start"] + m["length"]] for m in w["mask"]]
            fresh = parts[w["repeated"]:]
            assert targets == [p.split("|>\n", 1)[1] for p in fresh if p.startswith("<|assistant|>\n")]
            before = fresh


def test_budget_without_a_system_turn(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "w " * (t * 7 % 60)) for t in range(80)]
    for w in C.chat_windows(frame(spark, rows), 200, 40).collect():
        assert w["tokens"] <= 200


def test_matches_sql(spark, sf_small):
    got = C.op10_chat_formatting(spark, sf_small).toPandas().sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_small}/conversations.parquet'")
    want = con.execute(C.CHAT_SQL).df().sort_values("conv_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(got)].astype(str))
    assert (got.conv_id == -7).sum() == 1


def test_empty_table(spark):
    assert C.read_windows(C.chat_windows(frame(spark, []))).count() == 0


def test_no_python_in_the_plan(spark, sf_small):
    plan = C.op10_chat_formatting(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
