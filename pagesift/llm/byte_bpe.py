"""Byte-level BPE by recursive queries of an embedded DuckDB in every task.

A vocabulary of ranks gives the merge table: (left id, right id) to the id of
both together, for every way to cut an entry into two entries.  Texts are cut
into pre-tokens by a pattern; every new pre-token that is no entry itself
becomes rows (word, position, id), one a byte.  A turn of the recursion joins
neighbours with the merge table and contracts, in each word, the leftmost pair
of the lowest rank; words without such a pair drop out.  Long words contract
all places of their lowest pair in one turn, up to the first one whose merged
id forms a pair of still lower rank with a neighbour, which is what one place a
turn would give.  Their turns are cut at a number of rows and taken up again.

Decoding joins the ids with the vocabulary and puts the bytes of a text
together in the order of positions.  A worker keeps the ids of pre-tokens that
it has met, up to a bound; a database holds the rows of one chunk only, in memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagesift.llm.common import read_table, text_bytes

KEPT_WORDS = 500_000
TEXT_BYTES = 4 << 20       # gathered before new words are looked at
CHUNK_BYTES = 160_000      # of words in one recursive query
SHORT_WORD = 64            # bytes; longer words contract many places a turn
TURN_ROWS = 2_000_000      # of a query on long words, before it starts again
CHUNK_IDS = 500_000        # of texts decoded in one query
MEMORY = "350MB"
ID = np.dtype("<u4")

# A row's key k is its word's number and its position, 32 bits each; it carries
# the rank of the pair that begins at it, null if there is none.
_SHORT = """
with recursive step as (
  select s.k, s.tok, m.rank, 0 as turn
  from (select k, tok, case when lead(k) over o >> 32 = k >> 32 then tok::bigint << 32 | lead(tok) over o end as pair
        from start window o as (order by k)) s
  left join merges m using (pair)
  union all
  (with low as (
     select k >> 32 as w, min(rank::bigint << 32 | (k & 4294967295)) as low
     from step where rank is not null group by all),
   seen as (
     select k, tok, rank, turn, low >> 32 as best, w << 32 | (low & 4294967295) as spot, lag(k) over o as before,
            lead(k) over o as next, lead(k, 2) over o as second, lead(tok, 2) over o as after
     from step join low on step.k >> 32 = w window o as (order by k)),
   cut as (
     select k, turn + 1 as turn, case when k = spot then best else tok end as tok,
            case when k = spot and second >> 32 = k >> 32 then best << 32 | after
                 when next = spot and next >> 32 = k >> 32 then tok::bigint << 32 | best end as pair,
            case when k <> spot and next is distinct from spot then rank end as rank
     from seen where before is distinct from spot)
   select k, tok::integer as tok, coalesce(cut.rank, m.rank) as rank, turn
   from cut left join merges m on cut.pair = m.pair)
)
select k, tok, rank, turn from step
"""
_LONG = """
with recursive step as (
  select s.w, s.p, s.tok, m.rank, 0 as turn
  from (select k >> 32 as w, k & 4294967295 as p, tok,
               tok::bigint << 32 | lead(tok) over (partition by k >> 32 order by k) as pair from start) s
  left join merges m using (pair)
  union all
  (with seen as (
     select *, min(rank) over (partition by w) as best, row_number() over o as place
     from step where turn < $turns window o as (partition by w order by p)),
   runs as (
     select *, place - row_number() over (partition by w, rank is not distinct from best order by p) as run
     from seen where best is not null),
   taken as (
     select *, rank is not distinct from best and
            row_number() over (partition by w, rank is not distinct from best, run order by p) % 2 = 1 as take
     from runs),
   sides as (
     select *, lag(take, 1, false) over o as gone,
            (case when lag(take, 2, false) over o then best else lag(tok) over o end)::bigint << 32 | best as l,
            best::bigint << 32 | lead(tok, 2) over o as r
     from taken window o as (partition by w order by p)),
   lowered as (
     select s.*, min(case when take and (a.rank < best or b.rank < best) then p end) over (partition by w) as last
     from sides s left join merges a on s.l = a.pair left join merges b on s.r = b.pair),
   cut as (
     select w, p, turn + 1 as turn, case when take and p <= coalesce(last, p) then best else tok end as tok
     from (select *, lag(p) over (partition by w order by p) as before from lowered)
     where not (gone and before <= coalesce(last, before))),
   paired as (
     select *, tok::bigint << 32 | lead(tok) over (partition by w order by p) as pair from cut)
   select w, p, tok, m.rank, turn from paired left join merges m using (pair))
)
select w << 32 | p as k, tok, rank, turn from step
"""
_DECODE = """
select text, string_agg(bytes, '' order by place) as bytes
from ids join vocabulary using (id) group by text
"""


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(pair, rank): left id * 2**32 + right id of every cut of an entry."""
    pair, rank = [], []
    for token, merged in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pair.append(left << 32 | right)
                rank.append(merged)
    return pa.table({"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int32())})


class ByteBPE:
    """Encoder and decoder of a worker for one file of ranks and one pattern.
    Every single byte has to be an entry."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex
        self.ranks = read_ranks(path)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect()
        for setting in ("threads = 1", f"memory_limit = '{MEMORY}'", "temp_directory = ''"):
            self.db.execute(f"set {setting}")
        self._table("merges", merge_table(self.ranks))
        self._table("vocabulary", pa.table({
            "id": pa.array(list(self.ranks.values()), pa.int64()),
            "bytes": pa.array([token.hex() for token in self.ranks], pa.string())}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def _rows(self, query: str, name: str, rows: pa.Table, values: dict | None = None) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(query, params=values).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of ``words``, all short ones or all long ones."""
        sizes = np.array([len(x) for x in words])
        w = np.repeat(np.arange(len(words)), sizes)
        k = w << 32 | (np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        tok = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        done = []
        while len(k):
            start = pa.table({"k": k, "tok": tok})
            if sizes.max() <= SHORT_WORD:
                rows = self._rows(_SHORT, "start", start)
            else:
                rows = self._rows(_LONG, "start", start, {"turns": max(TURN_ROWS // len(k), 1)})
            k, tok, turn = (rows[c].to_numpy() for c in ("k", "tok", "turn"))
            w = k >> 32
            last = np.full(len(words), -1, turn.dtype)
            np.maximum.at(last, w, turn)
            end = turn == last[w]
            unfinished = np.zeros(len(words), bool)
            unfinished[w[end & ~rows["rank"].is_null().to_numpy()]] = True
            more = end & unfinished[w]
            done.append([x[end & ~more] for x in (k, tok)])
            k, tok = k[more], tok[more]
        k, tok = (np.concatenate(x) for x in zip(*done))
        ids = tok[np.argsort(k)].astype(ID)
        return [x.tobytes() for x in np.split(ids, np.cumsum(np.bincount(k >> 32, minlength=len(words)))[:-1])]

    def _learn(self, words: Iterable[str]) -> None:
        """Ids of new pre-tokens: entries as they are, others by contraction."""
        groups: dict[bool, list[str]] = {True: [], False: []}
        for word in words:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[word] = whole.to_bytes(4, "little")
            else:
                groups[len(raw) <= SHORT_WORD].append(word)
        for group in groups.values():
            raw = [word.encode() for word in group]
            chunk = np.cumsum([len(x) for x in raw]) // CHUNK_BYTES if raw else np.zeros(0)
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(raw)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    self.known.update(zip(group[a:b], self._contract(raw[a:b])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, unsigned 32-bit little-endian."""
        words = [self.find(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new: dict[str, None] = {}
        for found in words:
            new.update(dict.fromkeys(found))
        self._learn([w for w in new if w not in self.known])
        return [b"".join(map(self.known.__getitem__, found)) for found in words]

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids; ids that are no entry stand for nothing."""
        out = [b""] * len(texts)
        sizes = np.array([len(t) // ID.itemsize for t in texts], np.int64)
        chunk = np.cumsum(sizes) // CHUNK_IDS
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            ids = np.frombuffer(b"".join(texts[a:b]), ID).astype(np.int64)
            rows = pa.table({"text": np.repeat(np.arange(a, b), sizes[a:b]),
                             "place": np.arange(len(ids)), "id": ids})
            found = self._rows(_DECODE, "ids", rows)
            for text, raw in zip(found["text"].to_pylist(), found["bytes"].to_pylist()):
                out[text] = bytes.fromhex(raw)
        return out


@lru_cache(maxsize=2)
def worker_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about TEXT_BYTES; a batch stays whole."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= TEXT_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _encode_all(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_bpe(path, pattern)
        for table in _gathered(batches):
            ids = model.encode([t or "" for t in table.column(1).to_pylist()])
            yield from pa.table({"doc_id": table.column(0), "ids": pa.array(ids, pa.binary())}).to_batches()
    return run


def _decode_all(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_bpe(path, pattern)
        for batch in batches:
            ids = text_bytes(batch.column(1))
            texts = model.decode(ids)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_tokens": pa.array([len(x) // ID.itemsize for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "bytes": pa.array(texts, pa.binary())})
    return run


def bpe_encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
               pattern: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (binary, unsigned 32-bit little-endian).

    Null and empty texts have no ids.  Null and repeated ids and repeated texts
    give a row each; columns but the two named ones are not read; an empty
    table gives no rows.  Every text is encoded whole, without special tokens;
    time of a pre-token grows with its length times the number of its distinct
    merges."""
    return docs.select(doc_id, text).toDF("doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        _encode_all(path or default_ranks(), pattern or default_pattern()), "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of (doc_id, ids): doc_id, n_tokens, ids_sha256, bytes.
    Null ids count as an empty list; ids that are no entry stand for nothing."""
    return encoded.select("doc_id", "ids").mapInArrow(
        _decode_all(path or default_ranks(), pattern or default_pattern()),
        "doc_id long, n_tokens long, ids_sha256 string, bytes binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe_decode(bpe_encode(read_table(spark, sf_dir, "documents")))
    return decoded.selectExpr("doc_id", "n_tokens", "ids_sha256", "sha2(bytes, 256) as decoded_sha256")
