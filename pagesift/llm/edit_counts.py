"""Edit-aware token counts.

A document's text is cut into leaves that begin at a word; a binary tree over
the leaves holds the sums of their characters and tokens.  An edit finds its
leaves by descending the tree; only the leaves it touches, and those beside them
that are no longer parted by white space, are encoded again, and the sums above
them are updated.  The vocabulary joins nothing across white space, so the counts
equal those of encoding the whole text.

``build_counts`` makes the trees, ``apply_edits`` applies lists of edits to
them; both keep the state in columns, so it can be stored between the two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import SPACE_BYTES, read_table
from pagesift.llm.tokens import default_vocabulary, encode_all

LEAF_CHARS = 256
SPACES = "".join(map(chr, SPACE_BYTES))
_START = re.compile(rf"(?<=[{SPACES}])[^{SPACES}]")


def cut_leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Parts of about ``size`` characters, each but the first beginning at a
    word after white space; a longer word is in one part."""
    out, at = [], 0
    while at < len(text):
        found = _START.search(text, at + size)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


class CountTree:
    """Sums of characters and tokens over a document's leaves, as arrays of a
    complete binary tree: node 1 is the root, the children of i are 2i, 2i+1.

    ``edit`` changes texts and character sums and notes the leaves that it
    touches; ``set_tokens`` takes the counts of those leaves, so a leaf that
    several edits touch is encoded once."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.stale: set[int] = set()
        self._grow(leaves, tokens)

    def _grow(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = list(leaves)
        self.width = 1 << (len(leaves) - 1).bit_length()
        pad = [0] * (self.width - len(leaves))
        self.chars = [0] * self.width + [len(x) for x in leaves] + pad
        self.tokens = [0] * self.width + list(tokens) + pad
        for sums in (self.chars, self.tokens):
            for i in range(self.width - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    def leaf_tokens(self) -> list[int]:
        return self.tokens[self.width:self.width + len(self.leaves)]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and its place there; the end
        of the text is in the last leaf that is not empty."""
        i = 1
        while i < self.width:
            left = self.chars[2 * i]
            if at < left or at == left and not self.chars[2 * i + 1]:
                i = 2 * i
            else:
                at, i = at - left, 2 * i + 1
        return min(i - self.width, len(self.leaves) - 1), at

    def _set(self, leaf: int, text: str) -> None:
        i = self.width + leaf
        change = len(text) - self.chars[i]
        self.leaves[leaf] = text
        self.stale.add(leaf)
        while i:
            self.chars[i] += change
            i //= 2

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters from ``at``; both are cut to the text."""
        at = max(0, min(at, self.chars[1]))
        delete = max(0, min(delete, self.chars[1] - at))
        lo, a = self.find(at)
        hi, b = self.find(at + delete) if delete else (lo, a)
        text = self.leaves[lo][:a] + insert + self.leaves[hi][b:]
        # Leaves beside the edit, as far as no white space parts them from it.
        while lo > 0 and not (text and text[0] in SPACES):
            before = self.leaves[lo - 1]
            if text and before and before[-1] in SPACES:
                break
            lo, text = lo - 1, before + text
        while hi < len(self.leaves) - 1:
            after = self.leaves[hi + 1]
            if after and (not text or text[-1] in SPACES or after[0] in SPACES):
                break
            hi, text = hi + 1, text + after
        parts = cut_leaves(text)
        if len(parts) > hi - lo + 1:  # the last leaf takes what is left
            parts = parts[:hi - lo] + ["".join(parts[hi - lo:])]
        for leaf in range(lo, hi + 1):
            self._set(leaf, parts[leaf - lo] if leaf - lo < len(parts) else "")
        if len(parts[-1]) > 8 * LEAF_CHARS:
            self._cut_anew(lo + len(parts) - 1)

    def _cut_anew(self, leaf: int) -> None:
        """Give a long leaf's parts leaves of their own."""
        parts, tokens = cut_leaves(self.leaves[leaf]), self.leaf_tokens()
        more = len(parts) - 1
        self.stale = ({x if x < leaf else x + more for x in self.stale if x != leaf}
                      | set(range(leaf, leaf + more + 1)))
        self._grow(self.leaves[:leaf] + parts + self.leaves[leaf + 1:],
                   tokens[:leaf] + [0] * len(parts) + tokens[leaf + 1:])

    def stale_texts(self) -> list[str]:
        """The leaves that have to be encoded again."""
        return [self.leaves[x] for x in sorted(self.stale)]

    def set_tokens(self, counts: list[int]) -> None:
        """Take the counts of ``stale_texts`` and update the sums above them."""
        for leaf, n in zip(sorted(self.stale), counts):
            i = self.width + leaf
            change = n - self.tokens[i]
            while i:
                self.tokens[i] += change
                i //= 2
        self.stale = set()


STATE = "doc_id long, leaves array<string>, leaf_tokens array<long>, n_tokens long"


def build_counts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per document: doc_id, leaves, leaf_tokens, n_tokens.  Null text
    counts as empty and has one empty leaf; null ids and repeated rows are
    counted like others; columns but the two named ones are not read; an empty
    table gives no rows."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [cut_leaves(t or "") for t in batch.column(1).to_pylist()]
            ids = encode_all(path, [x.encode() for ls in leaves for x in ls])
            sizes, tokens = iter([len(x) for x in ids]), []
            for ls in leaves:
                tokens.append([next(sizes) for _ in ls])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(leaves, pa.list_(pa.string())),
                 pa.array(tokens, pa.list_(pa.int64())), pa.array([sum(t) for t in tokens], pa.int64())],
                ["doc_id", "leaves", "leaf_tokens", "n_tokens"])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, STATE)


EDITED = (STATE + ", old_tokens long, n_edits long, n_chars long, encoded_chars long")
EDITS = "array<struct<at:bigint,n_delete:bigint,insert:string>>"


def apply_edits(state: DataFrame, path: str | None = None, edits: str = "edits") -> DataFrame:
    """Apply the column ``edits``, an array of (at, n_delete, insert), to each
    row of ``state`` in turn; every edit's place counts in the text as the
    edits before have left it.  Returns the new state, old_tokens, n_edits,
    n_chars, encoded_chars (of leaves that were encoded again).  Null edits
    change nothing, nulls inside an edit count as 0 and empty, and places
    beyond the text as its end."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, todo, rows = [], [], batch.to_pylist()
            for row in rows:
                tree = CountTree(row["leaves"] or [""], row["leaf_tokens"] or [0])
                todo.append([e for e in row["_edits"] or [] if e is not None])
                for e in todo[-1]:
                    tree.edit(e["at"] or 0, e["n_delete"] or 0, e["insert"] or "")
                trees.append(tree)
            stale = [tree.stale_texts() for tree in trees]
            counts = iter([len(x) for x in encode_all(path, [x.encode() for part in stale for x in part])])
            out = []
            for row, tree, edits_, part in zip(rows, trees, todo, stale):
                tree.set_tokens([next(counts) for _ in part])
                out.append((row["doc_id"], tree.leaves, tree.leaf_tokens(), tree.tokens[1],
                            row["n_tokens"], len(edits_), tree.chars[1], sum(map(len, part))))
            rows = out
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             [f.split()[0] for f in EDITED.split(", ")])
    return (state.select("doc_id", "leaves", "leaf_tokens", "n_tokens",
                         F.col(edits).cast(EDITS).alias("_edits")).mapInArrow(run, EDITED))


def gather_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """``state`` with the rows of ``edits`` (doc_id, seq, at, n_delete, insert)
    as the column ``edits``, in the order of seq.  The edits of one document
    are one list."""
    lists = edits.groupBy("doc_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "at", "n_delete", "insert"))),
        lambda e: F.struct(e["at"].alias("at"), e["n_delete"].alias("n_delete"),
                           e["insert"].alias("insert"))).alias("edits"))
    return state.join(lists, "doc_id", "left")


EDITS_PER_DOC = 3


def derived_edits(leaves: Column, doc_id: Column) -> Column:
    """Three edits at hashed places of a document: words from its first leaf
    inserted, a stretch deleted, and a stretch replaced."""
    size = F.aggregate(leaves, F.lit(0).cast("long"), lambda a, x: a + F.length(x))

    def edit(at: int, n_delete: Column, insert: Column) -> Column:
        return F.struct(F.pmod(F.xxhash64(doc_id, F.lit(at)), size + 1).alias("at"),
                        n_delete.cast("long").alias("n_delete"), insert.alias("insert"))

    words = F.substring(leaves[0], 1, 40)
    return F.array(edit(1, F.lit(0), words),
                   edit(2, F.pmod(F.xxhash64(doc_id, F.lit(4)), F.lit(60)), F.lit("")),
                   edit(3, F.lit(7), F.reverse(words)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = build_counts(read_table(spark, sf_dir, "documents"))
    edited = apply_edits(state.withColumn("edits", derived_edits(F.col("leaves"), F.col("doc_id"))))
    return edited.select("doc_id", "old_tokens", "n_edits", F.col("n_tokens").alias("new_tokens"),
                         "n_chars", "encoded_chars")
