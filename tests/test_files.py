"""Binary-file corpus layouts, charset cascade and annotated gold spans."""
import os

from pagesift.sources.files import _decode_one, missing_gold, read_layout


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_charset_cascade():
    assert _decode_one("café".encode("utf-8")) == "café"
    assert _decode_one("ab".encode("utf-16")) == "ab"
    # odd length, invalid utf-8 and utf-16: windows-1252
    assert _decode_one(b"caf\xe9!") == "café!"
    # undefined in windows-1252 -> iso-8859-1
    assert _decode_one(b"a\x81b") == "a\x81b"


def test_plain_text_layout(spark, tmp_path):
    base = str(tmp_path / "corpus")
    _write(f"{base}/HTML/a.html", b'<?xml version="1.0"?><html><body><p>one two</p></body></html>')
    _write(f"{base}/Corrected/a.html.corrected.txt", b"  one\n two  ")
    _write(f"{base}/HTML/b.html", b"<html><body><p>x</p></body></html>")
    rows = read_layout(spark, base, "plain_text").collect()
    assert [(r["name"], r["gold"]) for r in rows] == [("a.html", "one two")]
    assert rows[0]["html"].startswith("<html>")
    assert [r["name"] for r in missing_gold(spark, base, "plain_text").collect()] == ["b.html"]


def test_span_layout(spark, tmp_path):
    base = str(tmp_path / "spans")
    _write(f"{base}/original/p1", b"<html><body><p>alpha beta</p></body></html>")
    _write(f"{base}/annotated/p1",
           b'<html><body><span class="x-nc-sel2"> alpha </span>'
           b'<span class="x-nc-sel2"><span x-text-density="2">beta</span></span></body></html>')
    rows = read_layout(spark, base, "span_annotations").collect()
    assert [(r["name"], r["gold"]) for r in rows] == [("p1", "alpha beta")]


def test_decode_column_fast_path_and_cascade(spark):
    from pagesift.sources.files import decode_bytes
    rows = [(1, "café".encode("utf-8")), (2, b"caf\xe9!"), (3, None)]
    df = spark.createDataFrame(rows, "id int, raw binary")
    got = {r["id"]: r["t"] for r in df.select("id", decode_bytes("raw").alias("t")).collect()}
    assert got == {1: "café", 2: "café!", 3: None}
