"""Exact dedup against its SQL and against brute force."""
import hashlib
import re

import duckdb
import numpy as np
import pytest

from pagesift.llm import exact_dedup as X
from pagesift.llm.bits import has_bits, set_bits
from conftest import ODD


def brute(rows):
    groups = {}
    for i, t in rows:
        clean = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(clean, []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for i, t in rows:
        clean = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[clean])[3]
        out.append((i, keep, len(groups[clean]), i == keep, hashlib.sha256(clean.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd_docs):
    got = sorted(map(tuple, X.exact_dedup(odd_docs).collect()), key=str)
    assert got == brute(ODD)


def test_matches_sql(spark, sf_small):
    got = X.op5_exact_dedup(spark, sf_small).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_small}/documents.parquet'")
    want = con.execute(X.EXACT_DEDUP_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(got)].astype(str))
    assert (got.group_size > 1).any()


def test_a_full_filter_changes_nothing(docs_of, monkeypatch):
    rows = [(i, f"text {i % 300}") for i in range(500)]
    monkeypatch.setattr(X, "set_bits", lambda *a, **k: np.full(1 << 13, 255, np.uint8))
    got = sorted(map(tuple, X.exact_dedup(docs_of(rows)).collect()), key=str)
    assert got == brute(rows)


def test_drop_copies_keeps_columns_and_one_of_each(odd_docs):
    kept = X.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    want = {r[1] for r in brute(ODD)}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(docs_of):
    empty = docs_of([])
    assert X.exact_dedup(empty).count() == 0 and X.drop_copies(empty).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_filter_has_no_false_negatives(spark, repeated):
    df = spark.range(0, 4000, 1, 7).selectExpr("xxhash64(id % 3000) as h")
    packed = set_bits(df, 1 << 16, repeated=repeated)
    h = np.array([r.h for r in df.distinct().collect()], np.int64)
    twice = {r.h for r in df.groupBy("h").count().where("count > 1").collect()}
    hit = has_bits(packed, h)
    assert hit[[x in twice for x in h.tolist()]].all()
    assert hit.all() if not repeated else hit.sum() < len(twice) + 300
