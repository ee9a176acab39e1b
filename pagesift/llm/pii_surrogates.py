"""Surrogates for personal data: keyed, of the same type and format.

Every entity is replaced through a keyed permutation of the values of its type
and shape (a Feistel network over its digits and letters; a keyed cycle over
the listed given names of its script and gender).  A permutation keeps distinct
values distinct, and the same value gets the same surrogate in all documents.
A check over all entities but given names finds surrogates that are real
values of the corpus (so also a value that is its own) or meet another
surrogate; such entities go to the permutation of a further key, and where
their shape is used up to one of a wider shape, until none is left.  Only they
are sent to the documents that hold them; all others are computed in place.
Given names follow each other in a cycle, so none is its own surrogate.

Names are found by listed given names, titles, labels and closing lines; once
found, each part of a name is replaced wherever the text writes it again.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from ipaddress import AddressValueError, IPv6Address
from itertools import count
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.bits import filter_bits, set_bits, tester
from pagesift.llm.common import read_table, stash
from pagesift.llm.name_lists import GIVEN, TITLES

ROUNDS = 10           # of the Feistel network
OWN_SHAPE = 4         # attempts before the shape is widened, by one letter more each time

EMAIL, PHONE, CARD, IP, IP6, IBAN, NATIONAL, SECRET, GIVEN_NAME, SURNAME = (
    "email", "phone", "card", "ip", "ip6", "iban", "national", "secret", "given", "surname")

# Letters are replaced within their group, so script, case, vowels and
# consonants stay; other characters are kept.
GROUPS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
          "àáâäãèéêëìíîïòóôöõùúûü", "ÀÁÂÄÃÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜ",
          "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
          "αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩΆΈΉΊΌΎΏ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
GROUP_OF = {c: g for g, chars in enumerate(GROUPS) for c in chars}
GROUPED_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
LONGER = {"LATIN": "nare", "CYRILLIC": "нару", "GREEK": "ναρε"}  # letters that widen a shape


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0] if c.isalpha() else ""


@lru_cache(maxsize=1 << 10)
def _alphabet(script: str, category: str, block: int) -> str:
    """The letters of a script and category in 128 code points that have no group."""
    chars = map(chr, range(block << 7, block + 1 << 7))
    return "".join(c for c in chars if c not in GROUP_OF and _script(c) == script
                   and unicodedata.category(c) == category and c.lower().upper().lower() == c.lower())


@lru_cache(maxsize=1 << 16)
def _letters(c: str, wide: bool) -> str:
    """The characters that ``c`` may become; itself alone if it is kept."""
    if c in GROUP_OF:
        return GROUPS[GROUP_OF[c]]
    script = _script(c)
    if script and (wide or script not in GROUPED_SCRIPTS):
        chars = _alphabet(script, unicodedata.category(c), ord(c) >> 7)
        return chars if c in chars else c
    return c


# --- detection ---------------------------------------------------------------

class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    value: str   # what all mentions of one entity have in common


_EMAIL = re.compile(r"[\w.%+-]+@[^\W_](?:[\w-]*\.)+[^\W\d_]{2,}")
_NUMBER = re.compile(r"\+?\(?\d(?:[ ().-]{0,2}\d){6,}")
# Bounded patterns inside of a run of numbers; each ends where a group of digits does.
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ .-]{1,2})\d{4}\1\d{4}\1\d{4}(\1\d{3})?"
                   r"|\d{4}([ .-]{1,2})\d{6}\3\d{4,5})(?!\d)")
_FOURS = re.compile(r"\d{4}(?:[ .-]{1,2}\d{4})*(?!\d)")
_LOCAL = re.compile(r"(?<!\d)\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?!\d)")
_TRUNK = re.compile(r"(?<!\d)\(?0[1-9]\d{1,3}\)?[ -](?:\d{6,8}|\d{3,4}[ -]\d{3,4})(?!\d)")  # inland, with its zero
_SOCIAL = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
                   r"(?![A-Za-z0-9])")
_HEXES = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{6,39}(?![\w:])")
# Countries whose numbers have one length.
_COUNTRY = re.compile(r"\+\(?(?:[17](?:[ ().-]{0,2}\d){10}|3[34](?:[ ().-]{0,2}\d){9}"
                      r"|(?:44|91)(?:[ ().-]{0,2}\d){10}|86(?:[ ().-]{0,2}\d){11})(?!\d)")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)")
_SECRET = re.compile(r"(?<=[\"'])[A-Za-z0-9+/_-]{32,}(?=[\"'])")
# Published prefixes of access keys (fixed values).
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "sk-", "AIza", "glpat-")
_PREFIX = re.compile("|".join(_PREFIXES))
_PREFIXED = re.compile(rf"(?<![A-Za-z0-9])(?:{_PREFIX.pattern})[A-Za-z0-9_-]{{16,}}")
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?![A-Za-z0-9])")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’](?![sS]\b)[^\W\d_]+)*")
_NAME = re.compile(r" ([^\W\d_][^\W\d_]+(?:[-'’](?![sS]\b)[^\W\d_]+)*)")
# A name follows a label, or the closing line of a letter (fixed values).
_LABELS = ("name:", "Name:", "NAME:", "egards", "incerely", "est wishes")
_LABEL = re.compile(r"\b(?:(?:[Nn]ame|NAME):|(?:[Rr]egards|[Ss]incerely|[Bb]est wishes),?[ \t]*\r?\n)(?=[ \t]*)")
_SPACES = re.compile(r"[ \t]*")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick
    words = ahocorasick.Automaton()
    for (script, gender), names in GIVEN.items():
        for name in names:
            words.add_word(name, (len(name), f"{script}|{gender}|{name}"))
    for title in TITLES:
        words.add_word(title, (len(title), ""))
    words.make_automaton()
    return words


def _names(text: str) -> Iterator[Mention]:
    """Listed given names before a capitalised word, and names after a title."""
    for end, (size, value) in _automaton().iter(text):
        start, end = end + 1 - size, end + 1
        if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
            continue
        if not value:
            end += text[end:end + 1] == "."
            if value := _given(text, end):
                continue  # the listed name is met by itself
            after = _NAME.match(text, end)
            if after and after[1][0].isupper():
                yield Mention(after.start(1), after.end(1), SURNAME, after[1].lower())
                end = after.end(1)
                after = _NAME.match(text, end)
                if after and after[1][0].isupper():
                    yield Mention(after.start(1), after.end(1), SURNAME, after[1].lower())
            continue
        after = _NAME.match(text, end)
        if after and after[1][0].isupper():
            yield Mention(start, end, GIVEN_NAME, value)
            yield Mention(after.start(1), after.end(1), SURNAME, after[1].lower())


def _given(text: str, at: int) -> bool:
    """Does a listed given name with a surname follow?"""
    first = _NAME.match(text, at)
    return bool(first and any(first[1] in names for names in GIVEN.values())
                and (after := _NAME.match(text, first.end())) and after[1][0].isupper())


def _labelled(text: str) -> Iterator[Mention]:
    """Two or three capitalised words behind a label or a closing line."""
    for label in _LABEL.finditer(text):
        at, parts = _SPACES.match(text, label.end()).end(), []
        while len(parts) < 3 and (m := _WORD.match(text, at)) and m[0][0].isupper() and len(m[0]) > 1:
            parts.append(Mention(*m.span(), SURNAME, m[0].lower()))
            if text[m.end():m.end() + 1] != " ":
                break
            at = m.end() + 1
        if len(parts) > 1:
            yield from parts


def _later(text: str, found: list[Mention]) -> Iterator[Mention]:
    """Further places of the names in ``found``: a given name as it was written, a
    surname in capitals unless the text has the word in small letters as well."""
    given = {text[m.start:m.end]: m.value for m in found if m.kind == GIVEN_NAME}
    surnames = {m.value for m in found if m.kind == SURNAME}
    if not surnames:
        return
    words = list(_WORD.finditer(text))
    surnames -= {w[0] for w in words if w[0] in surnames}
    for w in words:
        if w[0] in given:
            yield Mention(*w.span(), GIVEN_NAME, given[w[0]])
        elif w[0][0].isupper() and w[0].lower() in surnames:
            yield Mention(*w.span(), SURNAME, w[0].lower())


def _iban_rest(body: str, country: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _ibans(text: str) -> Iterator[Mention]:
    """Account numbers whose check digits are right; a match may run into a word behind."""
    for m in _IBAN.finditer(text):
        end = m.end()
        while end - m.start() >= 15:
            value = text[m.start():end].replace(" ", "")
            if (sum(c.isdigit() for c in value) > 7 and
                    98 - _iban_rest(value[4:], value[:2]) == int(value[2:4])):
                yield Mention(m.start(), end, IBAN, value)
                break
            end = text.rfind(" ", m.start(), end)


def _addresses6(text: str) -> Iterator[Mention]:
    for m in _HEXES.finditer(text):
        if m[0].count(":") > 1 and any(c.isdigit() for c in m[0]):
            try:
                value = IPv6Address(m[0]).exploded
            except AddressValueError:
                continue
            if sum(part != "0000" for part in value.split(":")) > 2:
                yield Mention(*m.span(), IP6, value)


def _secrets(text: str) -> Iterator[Mention]:
    """Quoted tokens, tokens with a known prefix, long ones of small and capital
    letters with digits."""
    if '"' in text or "'" in text:
        for m in _SECRET.finditer(text):
            if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
                yield Mention(*m.span(), SECRET, m[0])
    for pattern in ([_PREFIXED] if any(p in text for p in _PREFIXES) else []) + [_MIXED]:
        for m in pattern.finditer(text):
            token = m[0]
            if pattern is _PREFIXED and any(c.isdigit() for c in token) or (
                    sum(c.isdigit() for c in token) > 2 and not token.islower() and not token.isupper()
                    and sum(c.isalpha() for c in token) > 8 and "/" not in token[:1]
                    and token.count("-") + token.count("/") + token.count("_") < 4):
                yield Mention(*m.span(), SECRET, token)


def luhn(digits: str) -> int:
    """The digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _numbers(text: str, runs: list[re.Match], taken: list[tuple[int, int]]) -> Iterator[Mention]:
    """Cards, phones and national numbers in the runs outside of ``taken`` (ascending)."""
    first = 0
    for run in runs:
        at = run.start()
        while first < len(taken) and taken[first][1] <= at:
            first += 1
        k = first
        while k < len(taken) and taken[k][0] < run.end():
            if text[taken[k][0] - 1:taken[k][0]] != "+":  # a phone with dots is no address
                yield from _cut(text, at, taken[k][0])
                at = max(at, taken[k][1])
            k += 1
        yield from _cut(text, at, run.end())


def _cut(text: str, at: int, end: int) -> Iterator[Mention]:
    """The entities of one run: what has a bounded pattern, and each part
    between such that is a number by its count of digits."""
    rest = at
    while at < end:
        if text[at] == "+":
            stop = _phone_end(text, at, end)
            if stop:
                yield from _whole(text, rest, at)
                yield Mention(at, stop, PHONE, _digits(text[at:stop]))
                at = rest = stop
                continue
        elif text[at] == "(" or text[at].isdigit() and not text[at - 1:at].isdigit():
            m = _CARD.match(text, at, end)
            if m and m[1] and not _valid(_digits(m[0])[:16]) and not _valid(_digits(m[0])):
                later = _CARD.match(text, m.end(1), end)  # a number of four digits before a card?
                if later and later[1] and _valid(_digits(later[0])[:16]) and _FOURS.match(text, at, end)[0].count(
                        m[1]) % 4 != 3:
                    at = m.end(1)
                    continue
            kind, m = (CARD, m) if m else (PHONE, _LOCAL.match(text, at, end) or _TRUNK.match(text, at, end))
            if not m:
                kind, m = NATIONAL, _SOCIAL.match(text, at, end)
            if m:
                stop = m.end()
                if kind == CARD and m[2] and _valid(_digits(m[0])[:16]) and not _valid(_digits(m[0])):
                    stop = m.start(2)  # a number of three digits after a card of 16
                yield from _whole(text, rest, at)
                yield Mention(at, stop, kind, _digits(text[at:stop]))
                at = rest = stop
                continue
        at += 1
    yield from _whole(text, rest, end)


def _phone_end(text: str, at: int, end: int) -> int:
    """Where the phone that begins with the + at ``at`` ends; 0 if none does.
    The longest one after which the run ends or another entity begins, else
    the longest."""
    if m := _COUNTRY.match(text, at, end):
        return m.end()
    ends, count, i = [], 0, at + 1
    while i < end and count <= 15:
        count += text[i].isdigit()
        i += 1
        if text[i - 1].isdigit() and (i == end or not text[i].isdigit()) and 8 <= count <= 15:
            ends.append(i)
    for stop in reversed(ends):
        after = stop
        while after < end and text[after] in " .-)":
            after += 1
        if after == end or _CARD.match(text, after, end) or _LOCAL.match(text, after, end):
            return stop
    return ends[-1] if ends else 0


def _valid(digits: str) -> bool:
    return luhn(digits[:-1]) == int(digits[-1])


def _whole(text: str, start: int, end: int) -> Iterator[Mention]:
    """A part of a run that is a card in groups of any size."""
    while start < end and not (text[start].isdigit() or text[start] in "+("):
        start += 1
    while start < end and not text[end - 1].isdigit():
        end -= 1
    digits = _digits(text[start:end])
    if 13 <= len(digits) <= 19:
        yield Mention(start, end, CARD, digits)


def _apart(found: list[Mention]) -> list[Mention]:
    """The mentions in order, none over another."""
    rank = {k: i for i, k in enumerate((EMAIL, SECRET, IBAN, IP6, IP, CARD, PHONE, NATIONAL, GIVEN_NAME, SURNAME))}
    out: list[Mention] = []
    for m in sorted(found, key=lambda m: (m.start, rank[m.kind], -m.end)):
        if not out or m.start >= out[-1].end:
            out.append(m)
    return out


def detect(text: str) -> list[Mention]:
    """The entities of a text, in order; none over another."""
    found: list[Mention] = []
    if "@" in text:
        found += [Mention(m.start(), m.end(), EMAIL, m[0].lower()) for m in _EMAIL.finditer(text)]
    found += _secrets(text)
    found += [Mention(m.start(), m.end(), IP, m[0]) for m in _IP.finditer(text)]
    if text.count(":") > 2:
        found += _addresses6(text)
    if runs := list(_NUMBER.finditer(text)):
        found += _ibans(text)
        found += _numbers(text, runs, sorted((m.start, m.end) for m in found))
    found += _names(text)
    if any(label in text for label in _LABELS):
        found += _labelled(text)
    found = _apart(found)
    starts = [m.start for m in found]

    def free(m: Mention) -> bool:
        k = bisect_right(starts, m.start)
        return (not k or found[k - 1].end <= m.start) and (k == len(found) or m.end <= starts[k])
    if more := [m for m in _later(text, found) if free(m)]:
        found = sorted(found + more)
    return found


# --- keyed permutations ------------------------------------------------------

def _number(key: bytes, *parts) -> int:
    data = b"\0".join(str(p).encode() for p in parts)
    return int.from_bytes(blake2b(data, key=key, digest_size=32).digest(), "big")


def permute_number(x: int, radix: int, length: int, key: bytes, tweak: str) -> int:
    """A permutation of the numbers of ``length`` digits to the base ``radix``."""
    if length == 1:
        return (x + _number(key, tweak)) % radix
    low = length // 2
    sizes = (radix ** (length - low), radix ** low)
    half = [x // sizes[1], x % sizes[1]]
    for i in range(ROUNDS):
        a, b = i % 2, 1 - i % 2
        half[a] = (half[a] + _number(key, tweak, i, half[b])) % sizes[a]
    return half[0] * sizes[1] + half[1]


def permute_text(text: str, key: bytes, tweak: str, wide: bool = False) -> str:
    """A permutation of the texts of one shape; characters stay in their group.
    ``wide`` replaces letters without a group within their script as well."""
    sets = [_letters(c, wide) for c in text]
    shape = [GROUP_OF.get(c, c if len(chars) == 1 else chars) for c, chars in zip(text, sets)]
    out, tweak = list(text), f"{tweak}|{shape}"
    for chars in sorted({x for x in sets if len(x) > 1}, key=lambda x: (GROUP_OF.get(x[0], len(GROUPS)), x)):
        at, x = [i for i, own in enumerate(sets) if own == chars], 0
        for i in at:
            x = x * len(chars) + chars.index(text[i])
        tweak = f"{tweak}|{x}"
        own = tweak.rpartition("|")[0]  # depends on the groups before, not on this one
        x = permute_number(x, len(chars), len(at), key, own)
        for i in reversed(at):
            x, c = divmod(x, len(chars))
            out[i] = chars[c]
    return "".join(out)


def _longer(text: str, letters: int) -> str:
    """``text`` with so many letters of its script more."""
    script = next((s for c in reversed(text) if (s := _script(c))), "")
    last = next((c for c in reversed(text) if _script(c)), "")
    more = LONGER.get(script) or (_letters(last, True)[:4] if len(_letters(last, True)) > 1 else LONGER["LATIN"])
    return text + (more * letters)[:letters]


def _net(x: int) -> tuple[int, int]:
    """(kept high bits, free low bits): private ranges are kept."""
    for bits, net in ((8, 10), (8, 127), (12, (172 << 4) + 1), (16, (192 << 8) + 168)):
        if x >> (32 - bits) == net:
            return net, 32 - bits
    return -1, 32


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of an entity's value.  For a fixed attempt a permutation
    of the values of each shape; from ``OWN_SHAPE`` on into a wider one: more
    letters, all digits, or the largest private net."""
    tweak = f"{kind}|{attempt}"
    more = max(attempt - OWN_SHAPE + 1, 0)
    if kind == IBAN:
        body = permute_text(value[4:], key, f"{tweak}|{value[:2]}")
        return f"{value[:2]}{98 - _iban_rest(body, value[:2]):02d}{body}"
    if kind == IP6:
        x = int(IPv6Address(value))
        low = permute_number(x & ((1 << 112) - 1), 2, 112, key, f"{tweak}|{x >> 112}")
        return IPv6Address((x >> 112 << 112) + low).exploded
    if kind == SECRET and not more and (known := _PREFIX.match(value)):
        return known[0] + permute_text(value[known.end():], key, f"{tweak}|{known[0]}")
    if more and kind in (EMAIL, SECRET, SURNAME):
        name, sign, domain = value.rpartition("@") if kind == EMAIL else (value, "", "")
        new = permute_text(_longer(name, more), key, tweak, wide=True)
        return f"{new}@{surrogate(EMAIL, value, key).rpartition('@')[2]}" if sign else new
    if kind == EMAIL:
        name, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        kept = ".example" if host.endswith(".example") else ""
        host = host[:len(host) - len(kept)] if kept else "" if host == "example" else host
        kept = kept or ("example" if not host else "")
        return f"{permute_text(name, key, tweak)}@{permute_text(host, key, kind)}{kept}.{top}"
    if kind == PHONE:
        kept = 0 if more else max(len(value) - 10, 2 if value[0] == "0" else 1)
        return value[:kept] + permute_text(value[kept:], key, f"{tweak}|{value[:kept]}")
    if kind == CARD:
        if more:
            body = permute_text(value[:-1], key, f"{tweak}|{len(value)}")
            return body + str((luhn(body) + int(value[-1]) - luhn(value[:-1])) % 10)
        body = value[0] + permute_text(value[1:-1], key, f"{tweak}|{value[0]}|{len(value)}")
        return body + str((luhn(body) + int(value[-1]) - luhn(value[:-1])) % 10)
    if kind == IP:
        x = 0
        for part in value.split("."):
            x = x * 256 + int(part)
        net, free = _net(x)
        low = x & ((1 << free) - 1)
        if more and 0 <= net and free < 24:  # into 10.0.0.0/8
            low = permute_number(low, 2, 24, key, f"{tweak}|{net}")
            return ".".join(str((10 << 24) + low >> s & 255) for s in (24, 16, 8, 0))
        while True:
            low = permute_number(low, 2, free, key, f"{tweak}|{net}")
            y = low if net < 0 else (net << free) + low
            if _net(y)[0] == net:
                return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))
    if kind == GIVEN_NAME:
        script, gender, name = value.split("|")
        order = _cycle(script, gender, key)
        return f"{script}|{gender}|{order[name]}"
    return permute_text(value, key, tweak)


@lru_cache(maxsize=64)
def _cycle(script: str, gender: str, key: bytes) -> dict[str, str]:
    """Each listed name's follower in a keyed cycle over all of them."""
    names = sorted(GIVEN[script, gender], key=lambda n: _number(key, GIVEN_NAME, n))
    return dict(zip(names, names[1:] + names[:1]))


def written(kind: str, text: str, value: str) -> str:
    """A surrogate value in the form of the mention that it replaces."""
    if kind == IBAN:
        letters = iter(value)
        return "".join(c if c == " " else next(letters) for c in text)
    if kind == IP6:
        short = value if len(text) == len(value) else str(IPv6Address(value))
        return short.upper() if text.upper() == text else short
    if kind in (PHONE, CARD, NATIONAL):
        digits = iter(value)
        return "".join(next(digits) if c.isdigit() else c for c in text)
    if kind == GIVEN_NAME:
        return value.rpartition("|")[2]
    if kind == SURNAME or kind == EMAIL and len(value) == len(text):
        cased = text + (text[-1] if text.isupper() else "x") * (len(value) - len(text))
        return "".join(v.upper() if c.isupper() and len(v.upper()) == 1 else v for c, v in zip(cased, value))
    return value


# --- jobs ----------------------------------------------------------------------

def find_mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, value of every mention."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, m.kind, m.value) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if t for m in detect(t)]
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "kind", "value"])
    return (docs.select(F.col(doc_id).cast("long"), F.col(text))
            .mapInArrow(run, "doc_id long, kind string, value string"))


def _surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``entities`` (kind, value, attempt) with their surrogate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([surrogate(k, v, key, a) for k, v, a in rows], pa.string())],
                ["kind", "value", "attempt", "surrogate"])
    return (entities.select("kind", "value", "attempt")
            .mapInArrow(run, "kind string, value string, attempt int, surrogate string"))


def exceptions(mentions: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt of the entities whose first surrogate can't be
    used.  All shapes are checked; given names are a closed list, whose names
    are real ones anyway, in a cycle."""
    table = stash(_surrogates(mentions.select("kind", "value").where(F.col("kind") != GIVEN_NAME).distinct()
                              .withColumn("attempt", F.lit(0)), key), "entities")
    real = table.select("kind", F.col("value").alias("surrogate"))
    new = table
    for attempt in count(1):  # shapes grow with every attempt, so it ends
        # What was settled before can only meet one of the new surrogates.
        hit = real if new is table else real.join(new, ["kind", "surrogate"], "left_semi")
        met = new.join(hit, ["kind", "surrogate"], "left_semi").select("kind", "value")
        near = table if new is table else table.join(
            new.select("kind", "surrogate").distinct(), ["kind", "surrogate"], "left_semi")
        first = near.groupBy("kind", "surrogate").agg(F.min("value").alias("keeps"), F.count("*").alias("n"))
        twice = (near.join(first.where("n > 1"), ["kind", "surrogate"]).where("value <> keeps")
                 .select("kind", "value"))
        bad = stash(met.unionByName(twice).distinct(), "bad")
        if not bad.limit(1).count():
            break
        new = stash(_surrogates(bad.withColumn("attempt", F.lit(attempt)), key), "again")
        table = stash(table.join(bad, ["kind", "value"], "left_anti").unionByName(new), "entities")
    return table.where("attempt > 0").select("kind", "value", "attempt")


def replace_pii(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities.

    Null text stays null and has no entities; null ids and repeated rows are
    treated like others; columns but the two named ones are not read; an empty
    table gives no rows.  Documents without an exception are not shuffled."""
    mentions = stash(find_mentions(docs, doc_id, text), "mentions")
    odd = stash(exceptions(mentions, key), "exceptions")
    by_doc = stash(mentions.join(odd, ["kind", "value"]).groupBy("doc_id").agg(
        F.collect_set(F.struct("kind", "value", "attempt")).alias("odd")), "odd")
    maybe = tester(docs.sparkSession, set_bits(by_doc.select("doc_id"), filter_bits(by_doc.count())))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("maybe", maybe(F.coalesce("doc_id", F.lit(0))))
    held = rows.where("maybe").join(by_doc, rows["doc_id"].eqNullSafe(by_doc["doc_id"]), "left")
    none = F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>").alias("odd")
    rows = (rows.where("not maybe").select("doc_id", "text", none)
            .unionByName(held.select(rows["doc_id"], "text", "odd")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for t, odd in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                attempts = {(o["kind"], o["value"]): o["attempt"] for o in odd or ()}
                found, parts, at = detect(t) if t else [], [], 0
                for m in found:
                    new = surrogate(m.kind, m.value, key, attempts.get((m.kind, m.value), 0))
                    parts += [t[at:m.start], written(m.kind, t[m.start:m.end], new)]
                    at = m.end
                out.append(t if t is None else "".join(parts) + t[at:])
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int64())],
                ["doc_id", "text", "n_entities"])
    return rows.mapInArrow(run, "doc_id long, text string, n_entities long")


QUERY_KEY = b"pagesift query key"  # a real run passes its own secret


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(read_table(spark, sf_dir, "documents"), QUERY_KEY)
