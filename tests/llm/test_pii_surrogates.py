"""Surrogates: format, distinctness, coreference, collisions."""
import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st

from pagesift.llm import pii_surrogates as P
from pagesift.llm.name_lists import GIVEN
from conftest import ODD

KEY = b"test key"
TEXT = ("Call +1 (377) 555-0271 or +13775550271, mail Und.34@Mail7.example.com and "
        "und.34@mail7.example.com, ip 148.9.179.169 and 192.168.1.7, card 2390409500648960 and "
        "4111 1111 1111 1111, key = \"9f99a9aaa9a9a99aa9999999a9a99aa999a9999a\". Mr. John Smith met "
        "Frau Anna Müller-Lüd; Mrs. Smith, Иван Петров. v 1.2.3.4.5 and 300.1.1.1 and x@y stay")


def surrogates(text):
    return [(m.kind, text[m.start:m.end], P.written(m.kind, text[m.start:m.end], P.surrogate(m.kind, m.value, KEY)))
            for m in P.detect(text)]


def test_types_formats_and_coreference():
    got = surrogates(TEXT)
    by_text = {t: s for _, t, s in got}
    assert [k for k, _, _ in got] == ["phone", "phone", "email", "email", "ip", "ip", "card", "card", "secret",
                                      "given", "surname", "given", "surname", "surname", "given", "surname"]
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(by_text["+1 (377) 555-0271"]) == digits(by_text["+13775550271"])
    assert by_text["+1 (377) 555-0271"].startswith("+1 (") and by_text["+1 (377) 555-0271"][7:9] == ") "
    assert by_text["Und.34@Mail7.example.com"].lower() == by_text["und.34@mail7.example.com"]
    assert by_text["und.34@mail7.example.com"].endswith(".example.com")
    assert by_text["192.168.1.7"].startswith("192.168.")
    card = digits(by_text["4111 1111 1111 1111"])
    assert P.luhn(card[:-1]) == int(card[-1]) and card[0] == "4"
    assert by_text["John"] in GIVEN["latin", "m"] and by_text["Anna"] in GIVEN["latin", "f"]
    assert by_text["Иван"] in GIVEN["cyrillic", "m"]
    for t, s in by_text.items():
        assert s != t and len(s) == len(t) or t[0].isdigit() or t in GIVEN["latin", "m"] + GIVEN["latin", "f"] \
            + GIVEN["cyrillic", "m"]
        if P.SURNAME in [k for k, x, _ in got if x == t]:
            assert [c.isupper() for c in s] == [c.isupper() for c in t]


@pytest.mark.parametrize("kind, values", [
    ("phone", [f"4930{i:04d}" for i in range(3000)]), ("card", [f"4{i:014d}" for i in range(3000)]),
    ("surname", ["".join(x) for x in itertools.product("bcß", "aeé", "xyz", "ou")]),
    ("email", [f"a{i}.b@mail{j}.example.com" for i in range(60) for j in range(10)]),
    ("ip", [f"10.{i}.{j}.9" for i in range(20) for j in range(50)] + [f"172.16.{i}.1" for i in range(99)]),
    ("national", [f"{i:09d}" for i in range(3000)]), ("ip6", [f"2001:0db8::{i:x}:1:2" for i in range(1, 900)]),
    ("iban", [f"DE{98 - P._iban_rest(f'{i:018d}', 'DE'):02d}{i:018d}" for i in range(900)]),
    ("secret", [f"AKIA{i:016d}" for i in range(500)]),
    ("secret", [f"{i:05d}abcdefghijklmnopqrstuvwxyzABC" for i in range(500)]),
    *[("given", [f"{s}|{g}|{n}" for n in names]) for (s, g), names in GIVEN.items()]])
def test_distinct_values_have_distinct_surrogates(kind, values):
    assert len({P.surrogate(kind, v, KEY) for v in values}) == len(set(values))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 36), st.integers(1, 3), st.binary(min_size=1, max_size=8))
def test_permutation_of_all_numbers(radix, length, key):
    n = radix ** length
    if n <= 5000:
        assert sorted(P.permute_number(x, radix, length, key, "t") for x in range(n)) == list(range(n))


def test_another_key_gives_other_surrogates():
    assert P.surrogate("phone", "13775550271", b"a") != P.surrogate("phone", "13775550271", b"b")


def test_collisions_with_real_values_are_resolved(docs_of):
    first = "13775550271"
    real = P.surrogate("phone", first, KEY)             # a real value that is a surrogate too
    again = P.surrogate("phone", first, KEY, 1)
    show = lambda d: f"+{d[0]} ({d[1:4]}) {d[4:7]}-{d[7:]}"
    docs = docs_of([(1, f"call {show(first)} now"), (2, f"or {show(real)} and {show(first)}"),
                    (3, f"and {show(again)}"), (4, "nothing here")])
    mentions = P.find_mentions(docs)
    odd = {(r["value"]): r["attempt"] for r in P.exceptions(mentions, KEY).collect()}
    assert odd[first] >= 2 and set(odd) <= {first, real, again}
    rows = {r["doc_id"]: r for r in P.replace_pii(docs, KEY).collect()}
    new = {v: P.surrogate("phone", v, KEY, odd.get(v, 0)) for v in (first, real, again)}
    assert len(set(new.values()) | set(new)) == 6
    assert rows[1]["text"] == f"call {show(new[first])} now"
    assert rows[2]["text"] == f"or {show(new[real])} and {show(new[first])}"
    assert rows[4]["text"] == "nothing here" and rows[4]["n_entities"] == 0


def test_odd_rows_and_empty_table(docs_of):
    rows = ODD + [(20, TEXT), (20, TEXT), (None, TEXT)]
    got = P.replace_pii(docs_of(rows), KEY).collect()
    assert len(got) == len(rows)
    want = {i: t for i, t in ODD if i is not None}
    assert all(r["text"] == want[r["doc_id"]] for r in got if r["doc_id"] in want)
    assert len({r["text"] for r in got if r["n_entities"] == 16}) == 1
    assert P.replace_pii(docs_of([]), KEY).count() == 0


def test_whole_table_by_brute_force(spark, sf_small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    real = {(m.kind, m.value) for t in docs.values() for m in P.detect(t)}
    seen = {}
    for r in P.op8_pii(spark, sf_small).collect():
        old, new = docs[r["doc_id"]], r["text"]
        a, b = P.detect(old), P.detect(new)
        assert r["n_entities"] == len(a) and len(new) - len(old) == sum(
            (y.end - y.start) - (x.end - x.start) for x, y in zip(a, b))
        for x, y in zip(a, b):
            assert x.kind == y.kind and seen.setdefault((x.kind, x.value), y.value) == y.value
            assert (y.kind, y.value) not in real
    assert len({(k, s) for (k, _), s in seen.items()}) == len(seen) > 5


CARDS = ["7536784127813050", "5500 0055 5555 5559", "4111-1111-1111-1111", "378282246310005", "3782 822463 10005",
         "41 11 11 11 11 11 11 11"]
PHONES = ["+1 (826) 555-4081", "+18265554081", "(555) 123-4567", "555-123-4567", "+7 495 123-45-67",
          "+44 20 7946 0958"]


def test_entities_side_by_side():
    found = lambda text: [(m.kind, text[m.start:m.end]) for m in P.detect(text)]
    planted = [("card", c) for c in CARDS[:-1]] + [("phone", p) for p in PHONES]
    planted += [("ip", "190.137.223.204")]
    for (a, x), (b, y) in itertools.product(planted, planted):
        assert found(f"see {x} {y} there") == [(a, x), (b, y)], (x, y)
        assert found(f"{x}  {y} {x}") == [(a, x), (b, y), (a, x)], (x, y)
    for kind, x in planted:
        for n in ("12", "2024"):
            assert found(f"{x} {n}") == [(kind, x)] and found(f"no {n} {x} {n}") == [(kind, x)], (x, n)
    for x in CARDS + PHONES:
        assert [t for _, t in found(f"a {x}, b")] == [x]
    assert found("4111 1111 1111 1111 123") == [("card", "4111 1111 1111 1111")]
    assert found("+49 30 1234567 555-123-4567") == [("phone", "+49 30 1234567"), ("phone", "555-123-4567")]
    assert found("12 34 56, 2024-01-15 12.30 and 1.2.3.4.5.6.7") == []


def test_adjacent_entities_of_the_given_tables(docs_of):
    text = "7536784127813050 4845168114407329 +1 (826) 555-4081 190.137.223.204"
    row, = P.replace_pii(docs_of([(1, text)]), KEY).collect()
    assert row["n_entities"] == 4
    assert all(x not in row["text"] for x in ("7536784127813050", "4845168114407329", "555-4081", "190.137"))


def replaced(docs_of, kind, texts):
    """Old and new values of ``kind``, as in the texts that come out."""
    docs = docs_of(list(enumerate(texts)))
    new = {r["doc_id"]: r["text"] for r in P.replace_pii(docs, KEY).collect()}
    values = lambda t: [m.value for m in P.detect(t) if m.kind == kind]
    return {a: b for i, t in enumerate(texts) for a, b in zip(values(t), values(new[i]), strict=True)}


def test_short_shapes_are_checked_and_widened_where_all_values_are_real(docs_of):
    short = [c + v for c in P.GROUPS[2] for v in P.GROUPS[1]]           # all of two letters
    fixed = [n for shape in itertools.product((1, 2), repeat=3) for x in itertools.product(*(P.GROUPS[g] for g in shape))
             if P.surrogate("surname", n := "".join(x), KEY) == n]  # the first surrogate is the name itself
    names = short + fixed + ["հակոբյան", "ñß"]
    got = replaced(docs_of, "surname", [f"then Mr. {n.capitalize()} said" for n in names])
    assert sorted(got) == sorted(names) and len(set(got.values())) == len(names)
    assert fixed and not set(got.values()) & set(names)
    assert not set(got["հակոբյան"]) & set("abcdefghijklmnopqrstuvwxyz")
    assert len([1 for n in short if len(got[n]) > 2]) == len(short) and all(len(got[n]) == 3 for n in fixed)
    mails = [f"{a}@x.example.com" for a in P.GROUPS[1]] + ["ab.1@x.example.com"]
    got = replaced(docs_of, "email", [f"to {m} now" for m in mails])
    assert len(set(got.values()) | set(mails)) == 2 * len(mails)


def test_a_private_net_whose_addresses_are_all_real(docs_of):
    nets = [f"192.168.{i}.{j}" for i in range(256) for j in range(256)]
    got = replaced(docs_of, "ip", [", ".join(nets[i:i + 4096]) for i in range(0, 65536, 4096)])
    assert len(set(got.values()) | set(nets)) == 2 * 65536
    assert all(v.startswith("10.") for v in got.values())


def found(text):
    return [(m.kind, text[m.start:m.end]) for m in P.detect(text)]


def test_later_mentions_of_a_name_are_replaced(docs_of):
    text = "Mary Johnson came home. Later Johnson left, Mary stayed and johnny slept. JOHNSON'S hat, Mary-Ann."
    assert found(text) == [("given", "Mary"), ("surname", "Johnson"), ("surname", "Johnson"), ("given", "Mary"),
                           ("surname", "JOHNSON")]
    row, = P.replace_pii(docs_of([(1, text)]), KEY).collect()
    assert "ohnson" not in row["text"] and "JOHNSON" not in row["text"] and "Mary " not in row["text"]
    new = dict(zip([t for _, t in found(text)], [t for _, t in found(row["text"])]))
    assert row["text"].count(new["Johnson"]) == 2 and row["text"].count(new["Mary"] + " ") == 2
    # A surname that the text has in small letters too is left where only its capital tells.
    assert found("Mrs Brown saw a brown dog. Brown is a colour.") == [("surname", "Brown")]


def made(rng):
    """Entities of the types with values, and names that no list has, in their usual places."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    name = lambda: letters(1, "BCDFGKLMT") + letters(rng.randint(3, 7), "aeiourtvz")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    body = digits(18)
    uk = letters(4, upper) + digits(14)
    number = f"DE{98 - P._iban_rest(body, 'DE'):02d}{body}"
    group = ":".join(f"{rng.randrange(1, 1 << 16):x}" for _ in range(4))
    yield "national", f"{digits(3)}-{digits(2)}-{digits(4)}", "the id {} was given"
    yield "phone", f"0{rng.randint(1, 9)}{digits(1)} {digits(7)}", "call {} today"
    yield "phone", f"0{rng.randint(1, 9)}{digits(2)}-{digits(3)} {digits(4)}", "call {}, please"
    yield "iban", number, "to {} at once"
    yield "iban", " ".join(number[i:i + 4] for i in range(0, 22, 4)), "to {} at once"
    yield "iban", f"GB{98 - P._iban_rest(uk, 'GB'):02d}{uk}", "pay to {}."
    yield "ip6", f"2001:db8:{group}:1:2", "host {} is up"
    yield "ip6", f"fe80::{group}", "host {} is up"
    yield "secret", "AKIA" + letters(14, upper) + digits(2), "with {} set"
    yield "secret", "ghp_" + letters(34, lower) + digits(2), "with {} set"
    yield "secret", letters(16, upper) + digits(5) + letters(16, lower), "token {} here"
    yield "email", f"{letters(4, lower)}@bücher{digits(1)}.example.de", "mail {} now"
    for place in ("Name: {} of the firm", "it went.\nBest regards,\n{}\n", "then Dr {} said", "and Prof. {} said"):
        yield "surname", f"{name()} {name()}", place


def test_planted_recall_by_type():
    rng = random.Random(4)
    hits = {}
    for _ in range(60):
        for kind, value, place in made(rng):
            got = [t for k, t in found("so " + place.format(value)) if k == kind]
            hits.setdefault(kind, []).append((" ".join(got) if kind == "surname" else "".join(got)) == value)
    assert {k: sum(h) / len(h) for k, h in hits.items() if sum(h) < 0.9 * len(h)} == {} and len(hits) == 7


def test_clean_texts_stay():
    for text in ("At 12:30:45 on 2024-01-15T12:30:45 the ratio was 3:2:1.", "std::vector a::b face::dead::beef add::c",
                 "GB82 WEST 1234 5698 7654 33 has wrong check digits, as AB12 has.", "ISBN 978-3-16-148410-0 x",
                 "sha 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08", "Name: unknown. name:",
                 "See New York. New York is large. The New York Times.", "the 0 1 2 3, 0.5 and 1,000,000 or 007"):
        assert [x for x in found(text) if x[0] not in ("card",)] == [], text
