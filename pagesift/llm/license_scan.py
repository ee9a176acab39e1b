"""Licence scans: passages of a text against templates, by the Dice coefficient
of their word bigrams.

Text and templates are normalised alike: ASCII letters in lower case, words cut
at ASCII punctuation and white space.  A passage of a given size can only reach
the threshold with templates within size bounds, and a best passage begins and
ends at a bigram of its template; so only places where a template's bigrams are
dense enough are compared.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import U64, pieces, read_table, shingle_hashes, span_hashes, text_bytes
from pagesift.llm.license_texts import TEMPLATES

THRESHOLD = 0.75
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
NEAR_TIE = 0.02
SCHEMA = "doc_id long, license_id string, start_word long, n_words long, dice double, or_license_id string"


class Template(NamedTuple):
    name: str
    size: int              # bigrams
    bigrams: dict[int, int]
    least: int             # bigrams of a passage
    most: int
    shared: int            # least shared bigrams of the smallest passage


class Match(NamedTuple):
    dice: float
    size: int              # bigrams of the passage
    start: int             # word
    name: str


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the normalised words of ``buf``."""
    step = np.diff(np.r_[0, _WORD[buf], 0].astype(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return span_hashes(buf, starts, ends, lower=True), starts


def compiled(templates: Mapping[str, str], threshold: float) -> list[Template]:
    """Templates with two words or more, with the bounds of their passages."""
    out = []
    for name in sorted(templates):
        words = words_of(np.frombuffer(templates[name].encode() or b" ", np.uint8))[0]
        if len(words) > 1:
            bigrams = Counter(shingle_hashes(words, 2).tolist())
            size = len(words) - 1
            least = ceil(size * threshold / (2 - threshold) - 1e-9)
            most = int(size * (2 - threshold) / threshold + 1e-9)
            out.append(Template(name, size, bigrams, least, most,
                                ceil(threshold * (size + least) / 2 - 1e-9)))
    return out


def candidates(places: list[int], t: Template) -> Iterator[tuple[int, int]]:
    """Where a passage may start, by the size bounds: the places with enough
    others in reach of the largest passage, and the end of that reach."""
    for i, start in enumerate(places):
        stop = bisect_right(places, start + t.most - 1)
        if stop - i >= t.shared:
            yield i, stop


def passages(places: list[int], grams: list[int], t: Template, threshold: float) -> Iterator[Match]:
    """For each place where a passage may start the nearest one of it;
    ``places`` are those of the text's bigrams that the template has."""
    for i, stop in candidates(places, t):
        start = places[i]
        used: Counter[int] = Counter()
        shared, best = 0, None
        for k in range(i, stop):
            g = grams[k]
            used[g] += 1
            if used[g] > t.bigrams[g]:
                continue
            shared += 1
            size = places[k] - start + 1
            dice = 2 * shared / (size + t.size)
            if dice >= threshold and (best is None or dice > best.dice):
                best = Match(dice, size, start, t.name)
        if best:
            yield best


def scan(hashes: np.ndarray, templates: list[Template], index: dict[int, list[int]],
         known: np.ndarray, threshold: float) -> list[tuple[Match, str | None]]:
    """The matches in a text of word ``hashes``, none over another, each with the
    nearest other template that comes within ``NEAR_TIE`` on half of its words."""
    if len(hashes) < 2:
        return []
    grams = shingle_hashes(hashes, 2)
    hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams)
    by_template: dict[int, tuple[list[int], list[int]]] = {}
    for place, g in zip(hits.tolist(), grams[hits].tolist()):
        for k in index[g]:
            p, q = by_template.setdefault(k, ([], []))
            p.append(place)
            q.append(g)
    found = [m for k, (p, q) in by_template.items() if len(p) >= templates[k].shared
             for m in passages(p, q, templates[k], threshold)]
    found.sort(key=lambda m: (-m.dice, -m.size, m.start, m.name))
    taken, out = np.zeros(len(hashes), bool), []
    for m in found:
        span = slice(m.start, m.start + m.size + 1)
        if not taken[span].any():
            taken[span] = True
            out.append(m)
    return [(m, _rival(m, found)) for m in sorted(out, key=lambda m: m.start)]


def _rival(m: Match, found: list[Match]) -> str | None:
    for other in found:  # best first
        if other.dice < m.dice - NEAR_TIE:
            return None
        over = min(m.start + m.size, other.start + other.size) - max(m.start, other.start)
        if other.name != m.name and 2 * over >= max(m.size, other.size):
            return other.name
    return None


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None,
                  threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage of two words or more that reaches ``threshold`` with
    a template: doc_id, license_id, start_word, n_words, dice, or_license_id (the
    next template if it is hardly less near, so that the passage is ambiguous).

    Passages of a text do not overlap: the nearest to its template goes first,
    then the longest, the first, the one of the first name.  Null and empty
    texts have none; null ids are kept; repeated rows get equal rows; columns
    but the two named ones are not read; an empty table gives no rows."""
    plan = docs.sparkSession.sparkContext.broadcast(compiled(templates or TEMPLATES, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_templates = plan.value
        index: dict[int, list[int]] = {}
        for k, t in enumerate(known_templates):
            for g in t.bigrams:
                index.setdefault(g, []).append(k)
        known = np.array(sorted(index), U64)
        for batch in batches:
            rows = []
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in pieces(texts):
                buf = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
                hashes, starts = words_of(buf)
                cut = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts[a:b]]))
                for i in range(a, b):
                    rows += [(ids[i], m.name, m.start, m.size + 1, m.dice, rival) for m, rival in
                             scan(hashes[cut[i - a]:cut[i - a + 1]], known_templates, index, known, threshold)]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(),
                                                          pa.int64(), pa.float64(), pa.string()))],
                [f.split()[0] for f in SCHEMA.split(", ")])
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, SCHEMA)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
