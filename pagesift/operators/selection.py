"""Keys at given positions of a global order, by distributed radix selection.

No sort and no numbering of rows: an aggregate counts the keys of each bucket
of an order-preserving map, the driver finds the bucket of every position asked
for, and the next aggregate looks into those buckets only, cut anew between
their smallest and largest key.  A bucket of a single key is the answer; once
few keys are left they are counted one by one.  Each pass is a scan of the
narrow key column with a partial aggregate, so a key that a third of all rows
share is one row in the shuffle.  The driver gets at most ``BUCKETS`` rows (a
pair of characters each for strings) for each open bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
STRING_STEP = 2        # characters that a pass looks at beyond the common ones
FEW_KEYS = 10_000      # left in all open buckets: counted one by one

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def ordered(df: DataFrame, key: Column) -> Column:
    """``key`` as a long, a number or a string of the same order."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    if isinstance(kind, T.StringType) or isinstance(kind, _REAL):
        return key
    if isinstance(kind, _WHOLE):
        return key.cast("long")
    if isinstance(kind, T.BooleanType):
        return key.cast("int").cast("long")
    if isinstance(kind, T.BinaryType):
        return F.hex(key)
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key)
    raise TypeError(f"no order-preserving map for {kind.simpleString()}")


@dataclass
class _Open:
    """A bucket that holds positions asked for: its group, its smallest and
    largest key, the rows before it, and the positions."""
    group: object
    low: object
    high: object
    before: int
    wanted: list[int] = field(default_factory=list)


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _bucket(kind: T.DataType, low, high, step: int) -> Column:
    """An order-preserving map that parts ``low`` and ``high``."""
    k = F.col("k")
    if isinstance(kind, T.StringType):
        return F.substring(k, 1, _common(low, high) + step)
    if isinstance(kind, T.LongType):
        width = (high - low) // BUCKETS + 1
        off = k - F.lit(low) if high - low < 2**63 else k.cast("double") - F.lit(float(low))
        return F.floor(off / F.lit(width)).cast("long")
    if isinstance(kind, T.DecimalType):
        return F.floor((k - F.lit(low)).cast("double") / F.lit(float(high - low)) * BUCKETS).cast("long")
    wide = high * 0.5 - low * 0.5   # halves, as the difference may be beyond a double
    if wide == 0:
        return F.when(k == F.lit(low), 0).otherwise(1).cast("long")
    return F.floor((k * 0.5 - F.lit(low * 0.5)) / F.lit(wide) * BUCKETS).cast("long")


def keys_at(df: DataFrame, key: Column, positions: Callable[[int], list[int]], *, distinct: bool = False,
            group: Column | None = None, weight: Column | None = None, step: int = STRING_STEP,
            totals: dict | None = None) -> dict:
    """{group: {position: key}} for the 0-based ``positions`` (a function of a
    group's number of rows, a bounded list) in the order of ``key``.

    NULL keys have no position.  With ``distinct`` equal keys have one position
    together; with ``weight`` a row stands for as many rows.  Without ``group``
    the only group is None.  Positions beyond the last key are left out; an
    empty frame has no groups.  ``df`` is read once a pass, three to five times
    as a rule: pass a written table or a cheap scan.  ``totals`` takes up the
    number of rows of each group."""
    key = ordered(df, key)
    narrow = df.select((F.lit(None).cast("string") if group is None else group).alias("g"), key.alias("k"),
                       (F.lit(1) if weight is None else weight).cast("long").alias("c")).where("k is not null")
    kind = narrow.schema["k"].dataType
    number = F.count_distinct("k") if distinct else F.sum("c")

    def counted(rows: DataFrame, *keys: str):
        return rows.groupBy(*keys).agg(number.alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect()

    first = F.substring("k", 1, step) if isinstance(kind, T.StringType) else F.lit(0).cast("long")
    rows = counted(narrow.withColumn("b", first), "g", "b")
    totals = {} if totals is None else totals
    for r in rows:
        totals[r["g"]] = totals.get(r["g"], 0) + r["n"]
    found: dict = {g: {} for g in totals}
    whole = [_Open(g, None, None, 0, sorted({p for p in positions(n) if 0 <= p < n})) for g, n in totals.items()]
    by_open = {i: [r for r in rows if r["g"] == o.group] for i, o in enumerate(whole)}
    left = whole
    while left:
        left, size = _narrowed(left, by_open, found)
        if not left:
            break
        few = size <= FEW_KEYS
        which, bucket = F.lit(None).cast("int"), F.lit(None)
        for i, o in enumerate(left):
            here = F.col("g").eqNullSafe(F.lit(o.group)) & F.col("k").between(F.lit(o.low), F.lit(o.high))
            which = F.when(here, F.lit(i)).otherwise(which)
            if not few:
                bucket = F.when(here, _bucket(kind, o.low, o.high, step)).otherwise(bucket)
        if few:
            bucket = F.col("k")
        rows = counted(narrow.select("k", "c", which.alias("i"), bucket.alias("b")).where("i is not null"), "i", "b")
        by_open = {i: [r for r in rows if r["i"] == i] for i in range(len(left))}
    return found


def _narrowed(left: list[_Open], by_open: dict[int, list], found: dict) -> tuple[list[_Open], int]:
    """The next open buckets and the rows in them; buckets of one key go to
    ``found``."""
    out, size = [], 0
    for i, o in enumerate(left):
        wanted, before = list(o.wanted), o.before
        for r in sorted(by_open[i], key=lambda r: r["low"]):
            here = [p for p in wanted if p < before + r["n"]]
            wanted = wanted[len(here):]
            if here and r["low"] == r["high"]:
                found[o.group].update(dict.fromkeys(here, r["low"]))
            elif here:
                out.append(_Open(o.group, r["low"], r["high"], before, here))
                size += r["n"]
            before += r["n"]
            if not wanted:
                break
    return out, size
