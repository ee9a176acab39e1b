import __spark_entry__ as entry


def test_every_operator_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert {n for n in entry.oracle_sql() if n.startswith("op")} == {
        "op5_exact_dedup", "op10_chat_formatting", "op13_lexical_search"}
