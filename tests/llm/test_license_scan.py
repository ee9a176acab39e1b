"""Licence scans against all passages of small texts."""
import random
import re
from collections import Counter

import numpy as np

from pagesift.llm import license_scan as S
from pagesift.llm.license_texts import TEMPLATES
from conftest import ODD, prose


def norm(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def dice(a, b):
    a, b = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def brute(text, templates, threshold):
    w, found = norm(text), []
    for name, t in templates.items():
        t = norm(t)
        for i in range(len(w)):
            ends = [(dice(w[i:j], t), i - j) for j in range(i + 2, min(len(w), i + 3 * len(t)) + 1)]
            if ends and max(ends)[0] >= threshold:
                d, n = max(ends)
                found.append((-d, n, i, name))
    found.sort()
    taken, out = set(), []
    for d, n, i, name in found:
        if not taken & set(range(i, i - n)):
            taken |= set(range(i, i - n))
            out.append((i, -n, name, -d))
    return sorted(out)


def test_against_all_passages(docs_of):
    rng = random.Random(3)
    templates = {k: TEMPLATES[k] for k in ("MIT-short", "Apache-2.0-short", "GPL-3.0-short",
                                           "all-rights-reserved", "CC-BY-NC-4.0-short")}
    rows = []
    for i in range(40):
        parts = prose(rng, rng.randint(0, 12))
        for name in rng.sample(sorted(templates), rng.randint(0, 3)):
            t = templates[name].split()
            if rng.random() < 0.4:
                t[rng.randrange(len(t))] = "changed"
            parts += [x.upper() if rng.random() < 0.2 else x for x in t] + prose(rng, rng.randint(0, 5))
        rows.append((i, rng.choice([" ", "\n", " - "]).join(parts)))
    got = {}
    for r in S.scan_licenses(docs_of(rows), templates).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["n_words"], r["license_id"], r["dice"]))
    for i, text in rows:
        assert sorted(got.get(i, [])) == brute(text, templates, S.THRESHOLD), text


def test_long_notice_across_lines(docs_of):
    mit = TEMPLATES["MIT"].replace("WITHOUT WARRANTY OF ANY KIND", "WITH NO WARRANTY AT ALL")
    text = "Some words first.\n" + mit.replace(" ", "\n", 40) + "\nand more prose after it"
    (r,) = S.scan_licenses(docs_of([(1, text)])).collect()
    assert r["license_id"] == "MIT" and 0.9 < r["dice"] < 1 and r["start_word"] == 3


def test_odd_rows_and_empty_table(docs_of):
    rows = ODD + [(20, TEMPLATES["ISC"])] * 2 + [(None, TEMPLATES["Zlib"])]
    got = [(r["doc_id"], r["license_id"], r["dice"]) for r in S.scan_licenses(docs_of(rows)).collect()]
    assert sorted(got, key=str) == [(20, "ISC", 1.0), (20, "ISC", 1.0), (None, "Zlib", 1.0)]
    assert S.scan_licenses(docs_of([])).count() == 0


def test_each_template_yields_its_own_id(docs_of):
    names = sorted(TEMPLATES)
    rows = [(i, f"first words here {TEMPLATES[n]} last words there") for i, n in enumerate(names)]
    got = {}
    for r in S.scan_licenses(docs_of(rows)).collect():
        if r["start_word"] == 3:
            got[names[r["doc_id"]]] = (r["license_id"], r["dice"], r["or_license_id"])
    assert got == {n: (n, 1.0, None) for n in names}


def test_near_ties_are_told(docs_of):
    text = ("alpha beta gamma delta " * 3).split()
    a, b = " ".join(text + ["one"]), " ".join(text + ["two"])
    got = S.scan_licenses(docs_of([(1, a), (2, " ".join(text)), (3, b)]), {"A": a, "B": b}).collect()
    assert [(r["doc_id"], r["license_id"], r["or_license_id"]) for r in got] == [
        (1, "A", None), (2, "A", "B"), (3, "B", None)]


def test_size_bounds_prune_long_templates():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    template = " ".join(rng.choices(vocabulary, k=1001))
    t, = S.compiled({"long": template}, S.THRESHOLD)
    assert t.size == 1000 and (t.least, t.most, t.shared) == (600, 1666, 600)

    def hits(words):
        hashes = S.words_of(np.frombuffer(" ".join(words).encode(), np.uint8))[0]
        grams = S.shingle_hashes(hashes, 2).tolist()
        return [i for i, g in enumerate(grams) if g in t.bigrams]
    other = hits(rng.choices(vocabulary, k=20_000))     # a fifth of its bigrams are the template's
    assert len(other) > 3_000 and not list(S.candidates(other, t))
    near = hits(rng.choices(vocabulary, k=5_000) + template.split() + rng.choices(vocabulary, k=5_000))
    starts = [near[i] for i, _ in S.candidates(near, t)]
    assert starts and 5_000 - t.most <= min(starts) and max(starts) < 6_001
