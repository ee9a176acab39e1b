"""Css token extraction: the reference's own unit vectors plus our extras."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagesift.functions.text import css_tokens, token_bag

# (input, expected bag) -- the reference's vectors, then our additions
VECTORS = [
    ("  ", {}),
    ("3bae1be298abe9389b6e9789a", {"<LONG>": 1}),
    (" content ", {"content": 1}),
    ("page-nav", {"page": 1, "nav": 1}),
    ("PageNav", {"page": 1, "nav": 1}),
    ("page_nav", {"page": 1, "nav": 1}),
    ("123", {"<DIGITS>": 1}),
    ("pageNav", {"page": 1, "nav": 1}),
    ("page:nav", {"page": 1, "nav": 1}),
    ("PageBody main-content post-123",
     {"page": 1, "body": 1, "main": 1, "content": 1, "post": 1, "<DIGITS>": 1}),
    ("pageBody_main-content page-post_123",
     {"page": 2, "body": 1, "main": 1, "content": 1, "post": 1, "<DIGITS>": 1}),
    ("XMLHttpRequest Post123 HTML5Video",
     {"xml": 1, "http": 1, "request": 1, "post": 1, "<DIGITS>": 1, "html5": 1, "video": 1}),
    ("", {}),
    ("a__b--c::d", {"a": 1, "b": 1, "c": 1, "d": 1}),
]


def test_css_token_vectors(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(VECTORS)], "i int, s string")
    got = {r["i"]: dict(r["bag"]) for r in
           df.select("i", token_bag(css_tokens("s")).alias("bag")).collect()}
    for i, (_, want) in enumerate(VECTORS):
        assert got[i] == want, VECTORS[i][0]


def test_token_bag_counts(spark):
    df = spark.createDataFrame([(["a", "b", "a", "a"],)], "t array<string>")
    assert dict(df.select(token_bag("t").alias("m")).first()["m"]) == {"a": 3, "b": 1}


def test_post123_splits_digits(spark):
    # camel-case split keeps 'Post' separate from the digits
    df = spark.createDataFrame([("Post123",)], "s string")
    assert Counter(df.select(css_tokens("s").alias("t")).first()["t"]) == {"post": 1, "<DIGITS>": 1}


def test_token_bag_evaluates_its_array_once(spark):
    # a bag of words: the split may not be run again for each different word
    words = [f"w{i * 7919 % 997}" for i in range(5000)] + ["é", "é", ""]
    df = spark.createDataFrame([(" ".join(words), words), (None, None), ("", [])], "s string, t array<string>")
    plan = df.select(token_bag(F.split("s", " ")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1
    got = [r["m"] for r in df.select(token_bag("t").alias("m")).collect()]
    assert got == [dict(Counter(words)), None, {}]
