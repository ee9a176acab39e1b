import hashlib
import random

import numpy as np
import pytest

from pagesift.llm import byte_bpe as B

from conftest import ODD


@pytest.fixture(scope="module")
def bpe():
    return B.ByteBPE(B.default_ranks(), B.default_pattern())


@pytest.fixture(scope="module")
def library(bpe):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=B.default_pattern(), mergeable_ranks=bpe.ranks, special_tokens={})


def as_ids(numbers):
    return np.array(numbers, "<u4").tobytes()


def odd_texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield from ("", " ", "a", "x" * 5000, "the" * 900, "ab" * 3000, "日本語" * 400, "=" * 999, " " * 500 + "a",
                "1" * 1000, "it's  I'll\n\n x <|endoftext|> \x00\x1c\x85　é")
    yield "".join(rng.choice(letters) for _ in range(1500))           # one long word
    yield "".join(rng.choice("aeiou") for _ in range(1500))
    yield "".join(chr(rng.choice([97, 233, 0x4E00 + rng.randint(0, 200), 0x1F600 + rng.randint(0, 9)]))
                  for _ in range(800))
    yield "".join(chr(c) for c in range(0xD800) if c % 3 == 0)[:6000]
    yield " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 70))) for _ in range(300))


def test_ids_are_those_of_the_library(bpe, library):
    texts = list(odd_texts())
    got = bpe.encode(texts)
    assert got == [as_ids(library.encode_ordinary(t)) for t in texts]
    assert bpe.decode(got) == [t.encode() for t in texts]


def test_turns_are_taken_up_again(bpe, library, monkeypatch):
    monkeypatch.setattr(B, "TURN_ROWS", 500)   # long words: a few turns a query
    bpe.known.clear()
    texts = ["".join(random.Random(s).choice("abc") for _ in range(300)) for s in range(3)]
    assert bpe.encode(texts) == [as_ids(library.encode_ordinary(t)) for t in texts]


def test_known_words_are_forgotten_and_chunks_are_cut(bpe, library, monkeypatch):
    monkeypatch.setattr(B, "KEPT_WORDS", 10)
    monkeypatch.setattr(B, "CHUNK_BYTES", 40)
    monkeypatch.setattr(B, "CHUNK_IDS", 7)
    texts = [f"zqx{i}vw qqz{i}xy plain words" for i in range(40)]
    for part in (texts[:20], texts[20:]):
        got = bpe.encode(part)
        assert got == [as_ids(library.encode_ordinary(t)) for t in part]
        assert bpe.decode(got) == [t.encode() for t in part]


def test_a_lower_rank_made_by_a_merge_goes_first(tmp_path):
    """Entries whose parts have higher ranks than they: the order of one place
    a turn decides, for short and for long words."""
    import base64
    entries = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"bcb", b"cbc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(entries)))
    bpe = B.ByteBPE(str(path), r"\S+|\s+")

    def brute(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            ranked = [(bpe.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in bpe.ranks]
            if not ranked:
                return [bpe.ranks[p] for p in parts]
            i = min(ranked)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (3, 5, 9, 20, 60, 65, 100, 200) for _ in range(5)]
    assert bpe.encode(words) == [as_ids(brute(w.encode()) if w.encode() not in bpe.ranks else
                                        [bpe.ranks[w.encode()]]) for w in words]


def test_documents(spark, odd_docs, library):
    got = {}
    for r in B.bpe_decode(B.bpe_encode(odd_docs)).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, bytes(r.bytes)))
    want = {}
    for doc_id, text, *_ in ODD:
        ids = library.encode_ordinary(text or "")
        want.setdefault(doc_id, []).append((len(ids), hashlib.sha256(as_ids(ids)).hexdigest(), (text or "").encode()))
    assert got == want


def test_empty_table_and_unknown_ids(spark, docs_of):
    assert B.bpe_decode(B.bpe_encode(docs_of([]))).collect() == []
    rows = spark.createDataFrame([(1, bytearray(as_ids([64, 4_000_000_000, 65]))), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: r for r in B.bpe_decode(rows).collect()}
    assert got[2].n_tokens == 0 and bytes(got[2].bytes) == b""
    assert got[1].n_tokens == 3 and len(got[1].bytes) == 2


def test_given_documents(spark, sf_small, library):
    import __spark_entry__ as entry
    out = entry.queries()["op11_byte_bpe"](spark, sf_small)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(as_ids(ids)).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want
