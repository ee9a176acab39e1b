import random
import re

import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, "
        "kept string, sha string, cls string, label string, maybe string, mix string, rank string")


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with further columns whose names the operators use inside."""
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, *["x"] * 7) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


LONG = " ".join(f"word{i % 977} other{i % 31}." for i in range(30_000))
#: null and empty texts, white space only, ties, repeated rows, a null id, a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"),
       (6, "a b c d e f "), (7, "One two three four five six seven. Été ß 日本語"), (8, LONG),
       (None, "an id that is null, five words"), (9, "x"), (10, "x" * 5000), (11, "\x00 \x1c\x85 odd")]


@pytest.fixture
def odd_docs(docs_of):
    return docs_of(ODD)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n)]
