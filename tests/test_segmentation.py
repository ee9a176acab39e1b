"""Block segmentation rules (walker and Spark operator) and gold labels."""
import pytest
from pyspark.sql import functions as F

from pagesift.functions.html_blocks import segment_page
from pagesift.functions.spans import read_gold_spans
from pagesift.operators.blocks import block_labels
from pagesift.operators.segment import segment_blocks

CASES = {
    "F1": ('<div><p>one two three four</p><style>x</style>lost tail<p>five</p></div>',
           [("one two three four", {}), ("five", {})]),
    "F2": ('<div class="Main"><p>alpha <a href="#">beta gamma</a> delta</p></div>',
           [("alpha <<LINK<<beta gamma>>LINK>> delta", {"main": 1})]),
    "F3": ('<div>intro text here now<div class="ad">x</div></div>',
           [("intro text here now", {"ad": 1}), ("x", {"ad": 1})]),
    "F4": ('<p>a b<br>c d</p>', [("a b", {}), ("c d", {})]),
    "F5": ('<p>foo<b>bar</b>baz</p>', [("foo bar baz", {})]),
    "F6": ('<div><p>k <a> </a></p><p><a> </a></p></div>',
           [("k <<LINK<<>>LINK>>", {}), ("<<LINK<<>>LINK>>", {})]),
    "F7": ('<p><a><b>x y</b> z</a></p>', [("x y z", {})]),
    "F8": ('<div class="a1"><div class="b1"><div class="c1"><div class="d1"><div class="e1">'
           '<div class="f1">deep</div></div></div></div></div></div>',
           [("deep", {"b1": 1, "c1": 1, "d1": 1, "e1": 1, "f1": 1})]),
    "F9": ('<p>word <span class="hot">in span</span> end</p>', [("word in span end", {})]),
    "F10": ('<div class="page-nav post-123"><ul id="pageNav"><li>Home</li></ul></div>',
            [("Home", {"page": 2, "nav": 2, "post": 1, "<DIGITS>": 1})]),
    "comment_and_script_glue_text": ('<p>foo<!-- c -->bar<script>x</script>baz</p>',
                                     [("foobarbaz", {})]),
    "unwrapped_object_keeps_text": ('<p>a<object>b</object>c</p>', [("abc", {})]),
    "noscript_dropped_with_tail": ('<p>x<noscript>y</noscript>gone<b>z</b></p>', [("x z", {})]),
    "entities": ('<p>&copy; a &amp; b &amp c</p>', [("© a & b & c", {})]),
    "unclosed_p_and_b": ('<p><b>one two<br><p>three</p>', [("one two", {}), ("three", {})]),
}


def _page(body):
    return "<!DOCTYPE html><html><head><title>t</title><script>var t='</p>';</script></head><body>" \
        + body + "</body></html>"


@pytest.mark.parametrize("name", sorted(CASES))
def test_walker_rules(name):
    body, want = CASES[name]
    blocks, _ = segment_page(_page(body))
    assert [t for t, _ in blocks] == [t for t, _ in want]


def test_spark_segment_matches_fixtures(spark):
    rows = [(i, _page(body)) for i, (body, _) in enumerate(CASES.values())]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r["page_id"]: [(b["text"], dict(b["css"])) for b in r["blocks"]]
           for r in segment_blocks(df).collect()}
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert got[i] == want, name


def test_positions_are_one_based_and_ordered(spark):
    df = spark.createDataFrame([(1, _page("<p>a</p><p>b</p><p>c</p>"))], "page_id long, html string")
    blocks = segment_blocks(df).first()["blocks"]
    assert [b["pos"] for b in blocks] == [1, 2, 3]


def test_body_text_is_plain_concatenation():
    _, body = segment_page(_page("<ul><li>The</li><li>and</li></ul><style>p{}</style>"))
    assert body == "Theandp{}"


def test_one_udf_evaluation_in_plan(spark):
    df = spark.createDataFrame([(1, _page("<p>a b c d</p>"))], "page_id long, html string")
    plan = segment_blocks(df)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_labels(spark):
    df = spark.createDataFrame(
        [(1, _page(CASES["F1"][0]), "one two three four five"),
         (2, _page(CASES["F1"][0]), "One two three four")],
        "page_id long, html string, gold string")
    got = {r["page_id"]: [b["label"] for b in r["blocks"]]
           for r in block_labels(segment_blocks(df)).collect()}
    assert got == {1: [1, 0], 2: [0, 0]}


def test_gold_spans():
    html = ('<html><body><span class="x-nc-sel2"> a b </span>'
            '<span class="x-nc-sel2"><span x-text-density="1">c d</span></span>'
            '<span class="x-nc-sel2 z">no</span>'
            '<span class="x-nc-sel2"><b>p</b><i>q</i></span></body></html>')
    assert read_gold_spans(html) == "a b c d"


@pytest.mark.parametrize("html, blocks, body", [
    ("<html><body><p>one</p></body><p>after the end</p></html>tail", ["one", "after the end", "tail"],
     "oneafter the endtail"),
    ("<head><title>t</title><div>main text of the page</div>", ["main text of the page"],
     "main text of the page"),
    ("bare text only", ["bare text only"], "bare text only"),
    ("<title>t</title>bare text<p>b</p>", ["bare text", "b"], "bare textb"),
    ("<body><p>a</p></body><body class='x'><p>b</p></body>", ["a", "b"], "ab"),
    ("<html><head><meta charset='x'><style>p {}</style></head><p>no body tag</p></html>",
     ["no body tag"], "no body tag"),
    ("", [], ""),
])
def test_no_content_is_lost_around_head_and_body(html, blocks, body):
    got, text = segment_page(html)
    assert [t for t, _ in got] == blocks
    assert text == body


def test_normalize_leaves_single_blanks_alone():
    """a text without longer runs of white space is not rewritten."""
    import re

    from pagesift.functions.html_blocks import normalize
    plain = "one two\xa0three\x1c four"
    assert normalize(plain) is plain
    for text in ("", " ", "a  b", "\ta\n b ", "a\x0bb\x0cc\rd", "a\x85 b ", "a \n", "\xa0a\r\nb"):
        assert normalize(text) == re.sub(r"\s+", " ", text, flags=re.ASCII).strip()
