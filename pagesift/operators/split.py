"""Document sampling and splits.

A split into contiguous ranges of an order is given by the keys at its cuts.
Those few keys are found by radix selection over the narrow key column
(``selection.keys_at``: some aggregates, nothing sorted, numbered or written);
every row then finds its part by comparing its own key with them, so the rows
are neither joined nor shuffled, and copies of a document share one part.
The frame is scanned once a pass, so jobs write what is dear to compute first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.operators.selection import keys_at, ordered

DEFAULT_SEED = 42
DIGEST_STEP = 3   # hex digits of a digest that a pass looks at


def _cut_keys(df: DataFrame, key: Column, positions, **options) -> list:
    """The distinct values of ``key`` at the positions that ``positions``
    (function of their number) asks for, in order; fewer if it has fewer."""
    found = keys_at(df, key, positions, distinct=True, **options).get(None, {})
    return [found[p] for p in sorted(found)]


def _cuts_passed(key: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at or before ``key``."""
    passed = F.lit(0)
    for i, cut in enumerate(cuts, 1):
        passed = F.when(key >= F.lit(cut), F.lit(i)).otherwise(passed)
    return passed


def _digest(seed: int, *cols: str) -> Column:
    """Hex MD5 of ``'<seed>:<col>:<col>...'``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_docs(df: DataFrame, limit: int, key: str = "page_id",
                seed: int = DEFAULT_SEED) -> DataFrame:
    """K3: ``limit`` documents without replacement in a seeded hash order
    (hex MD5 of ``'<seed>:<key>'``); ``limit <= 0`` keeps all, a limit above
    the count keeps all.  Copies of a document stay or go together."""
    if limit <= 0:
        return df
    digest = _digest(seed, key)
    cut = _cut_keys(df, digest, lambda n: [limit], step=DIGEST_STEP)
    return df.where(digest < F.lit(cut[0])) if cut else df


def holdout_split(df: DataFrame, ratio: float = 0.7, key: str = "page_id") -> DataFrame:
    """K4: the first ``int(n * ratio)`` documents in ``key`` order train, the
    rest test.  Adds ``split`` ('train' / 'test')."""
    cut = _cut_keys(df, F.col(key), lambda n: [int(n * float(ratio))])
    passed = _cuts_passed(ordered(df, F.col(key)), cut)
    return df.withColumn("split", F.when(passed == 0, "train").otherwise("test"))


def kfold_assign(df: DataFrame, k: int = 5, key: str = "page_id") -> DataFrame:
    """Contiguous folds in ``key`` order, ``round_size = n div k``;
    fold ``i`` holds positions ``[i*round_size, (i+1)*round_size)`` and the
    remainder documents get ``fold`` NULL (they only ever train).  With fewer
    documents than folds all of them are remainder."""
    if k < 1:
        raise ValueError("k must be positive")
    cuts = _cut_keys(df, F.col(key), lambda n: [i * (n // k) for i in range(k + 1)] if n >= k else [])
    if not cuts:
        return df.withColumn("fold", F.lit(None).cast("int"))
    fold = F.when(F.col(key).isNotNull(), _cuts_passed(ordered(df, F.col(key)), cuts) - 1)
    return df.withColumn("fold", F.when(fold < k, fold).cast("int"))


def stratified_folds(df: DataFrame, k: int = 10, label: str = "label",
                     cols=("page_id", "pos"), seed: int = DEFAULT_SEED) -> DataFrame:
    """M6: stratified folds.  The rows of a class are ranked by the seeded MD5
    of ``cols``; fold ``i`` holds the ranks from ``i*n/k`` up to ``(i+1)*n/k``,
    so every fold has floor or ceil of ``n/k`` rows of each class.  Rows with
    equal ``cols`` share a fold.  Adds ``fold``."""
    digest = _digest(seed, *cols)
    sizes: dict = {}

    def firsts(n: int) -> list[int]:
        return [-(-i * n // k) for i in range(1, k)]
    found = keys_at(df, digest, firsts, group=F.col(label), step=DIGEST_STEP, totals=sizes)
    fold = F.lit(0)
    for c, keys in found.items():
        # a cut at the class's end lies behind all of its rows
        cuts = [keys.get(p, "~") for p in firsts(sizes[c])]
        fold = F.when(F.col(label).eqNullSafe(F.lit(c)), _cuts_passed(digest, cuts)).otherwise(fold)
    return df.withColumn("fold", fold.cast("int"))
