"""Edit-aware counts equal those of the whole edited text."""
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pagesift.llm import edit_counts as E
from pagesift.llm.tokens import default_vocabulary, encode_all
from conftest import LONG, ODD

TEXT = st.text(st.sampled_from("ab .,é'\n<|>"), max_size=60)
EDIT = st.tuples(st.integers(0, 900), st.sampled_from([0, 1, 7, 300, 2000]), TEXT)


def count(parts):
    return [len(x) for x in encode_all(default_vocabulary(), [p.encode() for p in parts])]


def whole(text):
    return len(Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    for at, n, new in edits:
        at = min(at, len(text))
        text = text[:at] + new + text[at + n:]
    return text


@settings(max_examples=150, deadline=None)
@given(st.one_of(TEXT, st.sampled_from(["", " " * 700 + "b", "x" * 600, LONG[:900], LONG[:3000]])),
       st.lists(EDIT, max_size=8), st.integers(0, 3))
def test_tree_follows_any_edits(text, edits, every):
    leaves = E.cut_leaves(text)
    assert "".join(leaves) == text
    tree = E.CountTree(leaves, count(leaves))
    for k, (at, n, new) in enumerate(edits):
        tree.edit(at, n, new)
        if every and k % every == 0:
            tree.set_tokens(count(tree.stale_texts()))
    tree.set_tokens(count(tree.stale_texts()))
    text = edited(text, edits)
    assert "".join(tree.leaves) == text
    assert (tree.chars[1], tree.tokens[1]) == (len(text), whole(text))
    for i in range(1, tree.width):
        assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]


def test_only_touched_leaves_are_encoded():
    leaves = E.cut_leaves(LONG)
    tree = E.CountTree(leaves, count(leaves))
    tree.edit(len(LONG) // 2, 3, "new words here")
    assert len("".join(tree.stale_texts())) < 4 * E.LEAF_CHARS


def test_jobs_on_odd_rows(spark, odd_docs):
    state = E.build_counts(odd_docs)
    edits = spark.createDataFrame(
        [(4, 2, 0, 1, None), (4, 1, 2, 2, "new "), (7, 1, None, None, "é"), (8, 1, 100_000, 50, " cut "),
         (2, 1, 99, 5, "from nothing"), (10, 1, 2500, 1, " ")],
        "doc_id long, seq int, at long, n_delete long, insert string")
    rows = E.apply_edits(E.gather_edits(state, edits)).collect()
    assert len(rows) == len(ODD)
    want = {4: edited("a b c d e f", [(2, 2, "new "), (0, 1, "")]),
            7: "é" + dict(ODD)[7], 8: edited(LONG, [(100_000, 50, " cut ")]), 2: "from nothing",
            10: edited("x" * 5000, [(2500, 1, " ")])}
    for r in rows:
        text = want.get(r["doc_id"], dict(ODD)[r["doc_id"]] or "")
        assert "".join(r["leaves"]) == text
        assert (r["n_tokens"], r["n_chars"]) == (whole(text), len(text))
        assert r["old_tokens"] == whole(dict(ODD)[r["doc_id"]] or "")
        assert sum(r["leaf_tokens"]) == r["n_tokens"]


def test_empty_table(docs_of):
    state = E.build_counts(docs_of([]))
    assert E.apply_edits(state.selectExpr("*", f"cast(null as {E.EDITS}) edits")).count() == 0


def test_query(spark, sf_small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    state = E.build_counts(spark.read.parquet(f"{sf_small}/documents.parquet"))
    made = {r["doc_id"]: [(e["at"], e["n_delete"], e["insert"]) for e in r["edits"]] for r in state.select(
        "doc_id", E.derived_edits(state["leaves"], state["doc_id"]).alias("edits")).collect()}
    rows = E.op3_token_counts(spark, sf_small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        new = edited(texts[r["doc_id"]], made[r["doc_id"]])
        assert (r["old_tokens"], r["new_tokens"], r["n_chars"]) == (
            whole(texts[r["doc_id"]]), whole(new), len(new))
