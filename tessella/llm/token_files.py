"""Token files compressed by Re-Pair grammars.

Documents are range-sorted by doc_id and cut into shards of a bounded number of
ids. In a shard, the frequent adjacent pairs of ids are counted exactly and replaced
by new nonterminals, round after round, until no pair is frequent; the file keeps the rules, the number of ids
that each nonterminal expands to, and where each document's symbols begin, so
that any document is decoded without those before it. No pair reaches over the
end of a document. Files are written by Spark's committer, a shard to a row, so
that lost or repeated tasks leave nothing behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, remove, running_sums, scratch, slices
from .tokens import encoder

MAGIC = b"RPG2"
SHARD_IDS = 1 << 19
#: How often a pair must occur for a rule to pay.
LEAST = 16
#: Slots of the counts that rule rare pairs out.
SLOT_BITS = 20


def _frequent(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the pairs that occur ``least`` times, most frequent first, their places in ``pairs``, the number of each place's pair).

    Pairs that share a slot are counted together first, which is never too few; what is left is counted exactly.
    """
    slot = (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    may = np.flatnonzero(np.bincount(slot, minlength=1 << SLOT_BITS)[slot] >= least)
    order = np.argsort(pairs[may])
    may = may[order]
    own = pairs[may]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(own)))
    found = np.flatnonzero(counts >= least)
    found = found[np.argsort(-counts[found], kind="stable")]
    number = np.full(len(first), -1, np.int32)
    number[found] = np.arange(len(found))
    number = np.repeat(number, counts)
    kept = np.flatnonzero(number >= 0)
    return own[first[found]], may[kept], number[kept]


def compress(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, where each document's symbols begin and the end, rules as pairs, the first nonterminal).

    Each round counts pairs exactly and gives every pair that occurs ``least`` times a
    nonterminal; of overlapping ones, which both can't be replaced, every second from the
    left is. Rounds go on until no pair occurs ``least`` times, or no symbol is left for a
    rule (the most frequent pairs come first then). Counts of pairs only fall, so a pair that
    was rare is not counted again: a round looks at places beside new symbols, and at those
    whose frequent pair was not replaced.
    """
    first = int(ids.max()) + 1 if len(ids) else 1
    room = max(0, (1 << 16) - first) or (1 << 20)  # symbols of two bytes where ids have two
    symbols, starts, rules, made = ids.astype(np.uint32), bounds.astype(np.int64), [], 0
    last = np.zeros(len(symbols), bool)
    last[starts[1:][starts[1:] > 0] - 1] = True  # a document's last symbol begins no pair
    live = ~last
    while made < room:
        at = np.flatnonzero(live[:-1])
        kinds, where, number = _frequent(symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1], least)
        if not len(kinds):
            break
        where = at[where]
        live[:] = False
        live[where] = True
        kinds = kinds[: room - made]
        chosen = np.full(len(symbols), -1, np.int32)
        chosen[where] = np.where(number < len(kinds), number, -1)
        hits = np.flatnonzero(chosen >= 0)
        # In a run of hits every second one is replaced, from its start on: replaced pairs don't overlap.
        new = np.ones(len(hits), bool)
        new[1:] = np.diff(hits) > 1
        hits = hits[(hits - hits[new][np.cumsum(new) - 1]) % 2 == 0]
        symbols[hits] = chosen[hits] + np.uint32(first + made)
        live[hits] = live[np.maximum(hits - 1, 0)] = True
        last[hits] = last[hits + 1]
        kept = np.ones(len(symbols), bool)
        kept[hits + 1] = False
        starts = starts - np.searchsorted(hits, starts)
        symbols, live, last = symbols[kept], live[kept], last[kept]
        live &= ~last
        rules.append(kinds)
        made += len(kinds)
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return symbols, starts, np.column_stack((flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF))).astype("<u4"), first


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of ids of each nonterminal. Rules refer to earlier ones only."""
    sizes: list[int] = []
    for a, b in rules.tolist():
        sizes.append((sizes[a - first] if a >= first else 1) + (sizes[b - first] if b >= first else 1))
    return np.array(sizes, "<u4")


def expanded(symbols: np.ndarray, size: np.ndarray, place: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The ids of symbols, end to end; symbol x has ``size[x]`` ids from ``place[x]`` on in ``table``."""
    own = size[symbols]
    ends = np.cumsum(own)
    return table[np.repeat(place[symbols] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)]


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, place, table) of all symbols, as expanded() takes them; rules that only need what is laid out are laid out together."""
    size = np.concatenate((np.ones(first, np.int64), lengths(rules, first).astype(np.int64)))
    place = np.cumsum(size) - size
    table = np.empty(int(size.sum()), "<u4")
    table[:first] = np.arange(first)
    at = 0
    while at < len(rules):
        # The next rules up to the first one that refers to one of them.
        later = np.flatnonzero((rules[at:] >= first + at).any(1))
        to = at + int(later[0]) if len(later) else len(rules)
        a, b = place[first + at], place[first + to - 1] + size[first + to - 1]
        table[a:b] = expanded(rules[at:to].reshape(-1), size, place, table)
        at = to
    return size, place, table


def encode_shard(doc_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray, nulls: int = 0) -> bytes:
    """Header, then doc_ids, ids and symbols by document, rules, expansion lengths, symbols. The first ``nulls`` doc_ids are null."""
    symbols, starts, rules, first = compress(ids, bounds)
    wide = first + len(rules) > 1 << 16
    head = np.array([len(doc_ids), len(rules), first, len(symbols), wide, nulls], "<u8").tobytes()
    parts = [doc_ids.astype("<i8"), np.diff(bounds).astype("<u4"), np.diff(starts).astype("<u4"), rules, lengths(rules, first), symbols.astype("<u4" if wide else "<u2")]
    return MAGIC + head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard read from its bytes; ``ids(k)`` decodes its k-th document alone."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        n, r, self.first, m, wide, self.nulls = map(int, np.frombuffer(data, "<u8", 6, 4))
        at = 52

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, count, at)
            at += part.nbytes
            return part

        self.doc_ids, self.sizes, own = read("<i8", n), read("<u4", n), read("<u4", n)
        self.rules, self.lengths = read("<u4", 2 * r).reshape(-1, 2), read("<u4", r)
        self.symbols = read("<u4" if wide else "<u2", m)
        self.starts = np.concatenate(([0], np.cumsum(own, dtype=np.int64)))
        self.size, self.place, self.table = expansions(self.rules, self.first)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return expanded(symbols, self.size, self.place, self.table)

    def ids(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[self.starts[k] : self.starts[k + 1]])

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of every text, ``end_id`` after each, to ``folder`` in ascending order of ids.

    Null ids come first, null texts are empty; rows that share an id stand side by
    side. A text longer than a shard has a shard of its own. Other columns are ignored.
    No rows: an empty table.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def out() -> pa.RecordBatch:
            doc_ids, ids, counts, nulls = (np.concatenate(x) for x in zip(*held))
            data = encode_shard(doc_ids, ids, np.concatenate(([0], np.cumsum(counts))), int(nulls.sum()))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["shard", "n_docs", "n_ids", "data"])

        for part in slices(batches, 12 << 20):
            doc_ids = part.column(0)
            ids, bounds = encoder(vocabulary).encode(part.column(1))
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            counts = np.diff(bounds) + 1
            nulls = doc_ids.is_null().to_numpy(zero_copy_only=False)
            doc_ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            ends = np.cumsum(counts)
            while at < len(counts):
                room = shard_ids - size + (int(ends[at - 1]) if at else 0)
                to = max(int(np.searchsorted(ends, room, "right")), at + (not held))
                if to > at:
                    a, b = int(ends[at - 1]) if at else 0, int(ends[to - 1])
                    held.append((doc_ids[at:to], ids[a:b], counts[at:to], nulls[at:to]))
                    size, at = size + b - a, to
                if at < len(counts):
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(shards, "shard long, n_docs long, n_ids long, data binary").write.option("compression", "none").parquet(folder)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard = Shard(data.as_py())
            ids = shard.all_ids()
            view, ends = memoryview(ids.tobytes()), np.cumsum(shard.sizes, dtype=np.int64)
            starts = ends - shard.sizes
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            doc_ids = pa.array(shard.doc_ids, mask=np.arange(len(crc)) < shard.nulls)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(crc), number)), doc_ids, pa.array(starts), pa.array(shard.sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ``start`` counts all ids before it.

    A row for each row written, null ids (which come first) and repeated ones too. An empty table: no rows.
    """
    files = spark.read.parquet(folder)
    starts = running_sums(files.select("shard", "n_ids"), [], ["shard"], before="n_ids").select("shard", "before")
    rows = files.select("shard", "data").mapInArrow(_decoded, "shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark)
    try:
        write(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
        return cut(read_back(spark, folder))
    finally:
        remove(spark, folder)


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
