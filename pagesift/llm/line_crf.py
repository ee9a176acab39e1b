"""Quality rules over lines: a linear-chain CRF marks each line as content or
boilerplate by Viterbi decoding, and the share of content words decides.

A text's lines that hold a word are the sequence.  Base counts (words, symbols,
repeated lines and five-word windows) reject texts before the labels are asked.
All is computed over pieces of many texts at once; decoding walks the lines of
all texts of a piece in step.

Nobody labels lines, only documents.  The lines' labels are latent: expectation
maximisation by forward-backward finds them under the constraint that a good
document is mostly content and a bad one mostly boilerplate.  Lines that a text
repeats, and lines that several documents hold between different neighbours,
start as likely boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import (U64, mix, pieces, read_table, shingle_hashes, space_flags,
                                 span_hashes, stash, text_bytes, word_spans)
from pagesift.llm.quality_fm import held_out

WINDOW = 5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
CONTENT_SHARE = 0.25    # a short text between headers and footers stays
SAMPLE = 2_500          # labelled documents that the model is fitted on, at most
SAMPLE_LINES = 100_000  # their lines together, at most; documents beyond it are not used
STRETCH = 64            # lines of a training sequence, over documents end to end
STEPS, RATE, DECAY = 80, 0.2, 1e-5
ROUNDS = 3              # of expectation maximisation after the first fit
MOSTLY = 0.75           # least expected share of a document's own label
COMMON_IN = 3           # different neighbours on both sides that make a line a common one
COMMON_ODDS = 0.9       # first guess that a repeated or common line is boilerplate
BINS = 8
FIELDS = ("upper", "symbols", "marks", "bars", "digits", "same", "words", "repeat", "stop", "edge", "common")
BOILERPLATE = 1         # label 0 is content


class Chain(NamedTuple):
    emit: np.ndarray    # of each feature towards boilerplate
    move: np.ndarray    # from label to label
    start: np.ndarray
    common: np.ndarray = np.zeros(0, U64)  # sorted hashes of the common lines


class Lines(NamedTuple):
    """The lines with a word of some texts, end to end."""
    first: np.ndarray   # of each text
    count: np.ndarray
    words: np.ndarray   # of each line
    features: np.ndarray  # lines x FIELDS
    hashes: np.ndarray  # of each line


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(chars)] = 1
    return out


_UPPER, _DIGITS = _flags(bytes(range(65, 91))), _flags(b"0123456789")
_SYMBOLS, _MARKS, _BARS, _STOPS = _flags(b"#*$%&|<>"), _flags(b"!?"), _flags(b"|"), _flags(b".!?:;")
_CHARS = (np.arange(256) & 0xC0 != 0x80).astype(np.int8)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    share = part / np.maximum(whole, 1)
    fine = np.ceil(BINS - 1 + np.log2(np.maximum(share, 1e-9)))
    return np.where(part == 0, 0, np.clip(fine, 1, BINS - 1)).astype(np.int64)


def is_among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` the sorted array ``known`` has."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def read_lines(texts: list[bytes], common: np.ndarray = np.zeros(0, U64),
               ) -> tuple[dict[str, np.ndarray], Lines]:
    """Base counts of each text, and its lines; ``common`` are hashes of common lines."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    docs = len(texts)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    breaks = np.flatnonzero(buf == 10)
    line_at, line_end = np.r_[0, breaks + 1], np.r_[breaks, len(buf)]
    starts, ends = word_spans(buf)
    hashes = span_hashes(buf, starts, ends, lower=False)
    word_cut = np.searchsorted(starts, at)
    n_words = np.diff(word_cut)
    doc = np.repeat(np.arange(docs), n_words)

    def total(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[b] - sums[a]

    # Words in five-word windows that the text has twice or more.
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= WINDOW:
        gram = shingle_hashes(hashes, WINDOW)
        own = np.flatnonzero(doc[WINDOW - 1:] == doc[:len(gram)])
        key = gram[own] ^ mix(doc[own].astype(U64) + U64(1))
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        twice = own[n[back] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    repeated = np.cumsum(covered)[:-1] > 0

    word_line = np.searchsorted(line_at, starts, "right") - 1
    line_words = np.bincount(word_line, minlength=len(line_at))
    line_doc = np.searchsorted(at, line_at, "right") - 1
    full = np.flatnonzero(line_words)
    line_at, line_end, line_words, line_doc = (x[full] for x in (line_at, line_end, line_words, line_doc))
    line_hash = span_hashes(buf, line_at, line_end, lower=False) ^ (line_end - line_at).astype(U64)
    order = np.lexsort((np.arange(len(full)), line_hash, line_doc))
    again = np.zeros(len(full), bool)
    again[order[1:]] = ((line_hash[order][1:] == line_hash[order][:-1])
                        & (line_doc[order][1:] == line_doc[order][:-1]))
    word_bytes = ~space_flags()[buf] & (_CHARS[buf] > 0)
    symbols = _SYMBOLS[buf]
    base = {
        "n_words": n_words, "word_chars": total(word_bytes, at[:-1], at[1:] - 1),
        "n_symbols": total(symbols, at[:-1], at[1:] - 1),
        "n_dup_lines": np.bincount(line_doc[again], minlength=docs),
        "n_repeat_words": np.bincount(doc[repeated], minlength=docs)}

    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])][:len(hashes)]
    same = np.bincount(word_line[same], minlength=full[-1] + 1 if len(full) else 0)[full]
    chars = total(word_bytes, line_at, line_end)
    last_word = np.searchsorted(starts, line_end) - 1
    count = np.bincount(line_doc, minlength=docs)
    first = np.cumsum(count) - count
    here = np.arange(len(full)) - first[line_doc]
    features = np.stack([
        _share(total(_UPPER[buf], line_at, line_end), chars),
        _share(total(symbols, line_at, line_end), line_words),
        _share(total(_MARKS[buf], line_at, line_end), line_words),
        _share(total(_BARS[buf], line_at, line_end), line_words),
        _share(total(_DIGITS[buf], line_at, line_end), chars),
        _share(same, line_words),
        np.minimum(np.log2(line_words), BINS - 1).astype(np.int64), again.astype(np.int64),
        (_STOPS[buf[ends[last_word] - 1]] if len(full) else np.zeros(0)).astype(np.int64),
        (here == 0) + 2 * (here == count[line_doc] - 1), is_among(line_hash, common).astype(np.int64),
    ], axis=1) if len(full) else np.zeros((0, len(FIELDS)), np.int64)
    return base, Lines(first, count, line_words, features + BINS * np.arange(len(FIELDS)), line_hash)


def _scores(chain: Chain, lines: Lines) -> np.ndarray:
    """Score of each line for each label, but for the moves."""
    out = np.zeros((len(lines.words), 2))
    out[:, BOILERPLATE] = chain.emit[lines.features].sum(axis=1)
    out[lines.first[lines.count > 0]] += chain.start
    return out


def _in_step(lines: Lines, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step the lines at hand and the ones just before them (behind
    them if ``backwards``), over all texts that are long enough."""
    order = np.argsort(-lines.count, kind="stable")
    count = lines.count[order]
    ends = lines.first[order] + (count - 1 if backwards else 0)
    sign = -1 if backwards else 1
    for t in range(1, count[0] if len(count) else 0):
        here = ends[:np.searchsorted(-count, -t, "left")] + sign * t
        yield here, here - sign


def viterbi(chain: Chain, lines: Lines) -> np.ndarray:
    """The likeliest labels of each text's lines."""
    best = _scores(chain, lines)
    source = np.zeros(best.shape, np.int8)
    for here, before in _in_step(lines):
        way = best[before][:, :, None] + chain.move
        source[here] = way.argmax(axis=1)
        best[here] += way.max(axis=1)
    label = best.argmax(axis=1)  # right for last lines; the others follow back from them
    for here, behind in _in_step(lines, backwards=True):
        label[here] = source[behind, label[behind]]
    return label


def posterior(chain: Chain, lines: Lines, bias: np.ndarray | float = 0.0,
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward-backward: each line's chance to be boilerplate, and the expected
    numbers of moves and of first labels; ``bias`` is added to a line's score
    for boilerplate."""
    own = _scores(chain, lines)
    own[:, BOILERPLATE] += bias
    ahead, back = own.copy(), np.zeros(own.shape)
    behind_of = []
    for here, before in _in_step(lines):
        ahead[here] += np.logaddexp.reduce(ahead[before][:, :, None] + chain.move, axis=1)
        behind_of.append(here)
    for here, behind in _in_step(lines, backwards=True):
        back[here] = np.logaddexp.reduce((own[behind] + back[behind])[:, None, :] + chain.move, axis=2)
    has = lines.count > 0
    firsts, lasts = lines.first[has], (lines.first + lines.count - 1)[has]
    norm = np.zeros(len(own))
    norm[firsts] = np.logaddexp.reduce(ahead[lasts], axis=1)
    norm = norm[np.repeat(firsts, lines.count[has])]
    p = np.exp(ahead + back - norm[:, None])
    both = np.concatenate(behind_of) if behind_of else np.zeros(0, np.int64)
    moves = np.exp(ahead[both - 1][:, :, None] + chain.move
                   + (own + back)[both][:, None, :] - norm[both][:, None, None]).sum(axis=0)
    return p[:, BOILERPLATE], moves, p[firsts].sum(axis=0)


def expected(lines: Lines, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The form of ``posterior`` for lines that are independent with chances ``p``."""
    both = np.stack([1 - p, p], axis=1)
    has = lines.count > 0
    after = np.ones(len(p), bool)
    after[lines.first[has]] = False
    at = np.flatnonzero(after)
    return p, both[at - 1].T @ both[at], both[lines.first[has]].sum(axis=0)


def climb(lines: Lines, goal: tuple[np.ndarray, np.ndarray, np.ndarray], chain: Chain | None = None,
          width: int = BINS * len(FIELDS)) -> Chain:
    """Expected conditional likelihood under ``goal`` by gradient steps (Adam), from ``chain``."""
    theta = np.zeros(width + 6) if chain is None else np.concatenate(
        [chain.emit, chain.move.ravel(), chain.start])

    def as_chain() -> Chain:
        return Chain(theta[:width], theta[width:width + 4].reshape(2, 2), theta[width + 4:])
    m, v = np.zeros(width + 6), np.zeros(width + 6)
    for step in range(1, STEPS + 1):
        p, moves, starts = posterior(as_chain(), lines)
        grad = np.concatenate([
            np.bincount(lines.features.ravel(), np.repeat(goal[0] - p, lines.features.shape[1]), width),
            (goal[1] - moves).ravel(), goal[2] - starts]) / len(p) - DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return as_chain()


def fit(lines: Lines, label: np.ndarray) -> Chain:
    """A chain for lines of known ``label``."""
    return climb(lines, expected(lines, label.astype(float)))


def constrained(chain: Chain, lines: Lines, doc: np.ndarray, bad: np.ndarray,
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``posterior`` with the least push on each document's lines that makes its own
    label hold ``MOSTLY`` of its words; ``doc`` of each line, ``bad`` of each document."""
    words = np.bincount(doc, lines.words, len(bad))
    side = np.where(bad, 1.0, -1.0)
    low, high = np.zeros(len(bad)), np.full(len(bad), 20.0)
    for turn in range(13):
        push = low if turn == 0 else (low + high) / 2
        p = posterior(chain, lines, (push * side)[doc])[0]
        share = np.bincount(doc, lines.words * p, len(bad)) / words
        enough = np.where(bad, share, 1 - share) >= MOSTLY
        high = np.where(enough, push, high)
        low = np.where(enough, low, push)
    return posterior(chain, lines, (high * side)[doc])


def common_lines(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sorted hashes of the lines with ``COMMON_IN`` different neighbours before and
    behind.  A copied text has the same neighbours, so its lines are not common."""
    edge = np.diff(doc) != 0
    outside = mix(doc.astype(U64) + U64(1))  # a text's ends differ from those of others
    before = np.r_[outside[:1], np.where(edge, outside[1:], hashes[:-1])]
    behind = np.r_[np.where(edge, outside[:-1], hashes[1:]), outside[-1:]]
    found = []
    for side in (before, behind):
        pairs = np.unique(np.stack([hashes, side]), axis=1)[0]
        line, n = np.unique(pairs, return_counts=True)
        found.append(line[n >= COMMON_IN])
    return np.intersect1d(*found)


def fit_latent(docs: Lines, bad: np.ndarray) -> Chain:
    """A chain from documents that are good or ``bad`` as a whole."""
    doc = np.repeat(np.arange(len(bad)), docs.count)
    total = len(doc)
    common = common_lines(docs.hashes, doc)
    features = docs.features.copy()
    column = FIELDS.index("common")
    features[:, column] = BINS * column + is_among(docs.hashes, common)
    first = np.arange(0, total, STRETCH)
    lines = Lines(first, np.minimum(STRETCH, total - first), docs.words, features, docs.hashes)
    repeat = FIELDS.index("repeat")
    likely = (features[:, column] > BINS * column) | (features[:, repeat] > BINS * repeat)
    chain = climb(lines, expected(lines, np.where(likely, np.maximum(bad[doc], COMMON_ODDS), bad[doc])))
    for _ in range(ROUNDS):
        chain = climb(lines, constrained(chain, lines, doc, bad), chain)
    return chain._replace(common=common)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = SAMPLE, most_lines: int = SAMPLE_LINES) -> Chain | None:
    """A chain fitted on at most ``sample`` labelled documents outside the held-out
    fold, chosen by a hash of the id, those that fit into ``most_lines`` lines in
    this order.  None without any.  Null ids and labels are not used; of an id's
    labels the smallest counts, of its rows the last text by code points."""
    known = (labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
             .where("id is not null and label is not null").where(~held_out(F.col("id")))
             .groupBy("id").agg(F.min("label").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    chosen = stash(texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.max("text").alias("text")),
                   "labelled_texts")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    sizes = chosen.where("text is not null").select("id", breaks.alias("n")).orderBy(F.xxhash64("id"), "id")
    room, ids = most_lines, []
    for row in sizes.collect():  # ``sample`` rows at most
        if row["n"] <= room:
            room -= row["n"]
            ids.append(row["id"])
    rows = (chosen.where(F.col("id").isin(ids)).select("id", "label", "text")
            .mapInArrow(_lines_arrow, LINES_OUT).collect())
    rows = [r for r in rows if len(r["words"])]
    rows.sort(key=lambda r: int(mix(np.array([r["id"]]).astype(U64))[0]))
    if not rows:
        return None

    def column(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(r[name], kind) for r in rows])
    words = column("words", np.int64)
    count = np.array([len(r["words"]) // 8 for r in rows])
    features = column("features", np.int16).reshape(-1, len(FIELDS)).astype(np.int64)
    lines = Lines(np.cumsum(count) - count, count, words, features, column("hashes", U64))
    return fit_latent(lines, np.array([float(r["label"] == 0) for r in rows]))


LINES_OUT = "id long, label int, words binary, features binary, hashes binary"


def _lines_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, words, features, hashes = text_bytes(batch.column(2)), [], [], []
        for a, b in pieces(texts):
            _, lines = read_lines(texts[a:b])
            words += np.split(lines.words.astype(np.int64), lines.first[1:])
            features += np.split(lines.features.astype(np.int16), lines.first[1:])
            hashes += np.split(lines.hashes, lines.first[1:])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([w.tobytes() for w in words], pa.binary()),
             pa.array([f.tobytes() for f in features], pa.binary()),
             pa.array([h.tobytes() for h in hashes], pa.binary())],
            ["id", "label", "words", "features", "hashes"])


OUT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
       "n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def judge(chain: Chain | None, texts: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of ``OUT`` after the first."""
    out, lines = read_lines(texts) if chain is None else read_lines(texts, chain.common)
    n = out["n_words"]
    out["base_failed"] = (n < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * n)
    content = lines.words if chain is None else np.where(
        viterbi(chain, lines) == BOILERPLATE, 0, lines.words)
    owner = np.repeat(np.arange(len(texts)), lines.count)
    out["content_share"] = np.bincount(owner, content, len(texts)) / np.maximum(n, 1)
    out["kept"] = ~out["base_failed"] & (out["content_share"] >= CONTENT_SHARE)
    return out


def label_lines(docs: DataFrame, chain: Chain | None, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One row per document: ``OUT``.  Null text counts as empty and has no
    words, so it fails; without a chain (no labelled document) every line is
    content; null ids and repeated rows are judged like others; columns but
    the two named ones are not read; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f.split()[0] for f in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = text_bytes(batch.column(1)), 0
            for a, b in pieces(texts):
                got = judge(shared.value, texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, b - a)] + [pa.array(got[c]) for c in names[1:]], names)
                at = b
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, OUT)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return label_lines(docs, train(docs, read_table(spark, sf_dir, "labels")))
