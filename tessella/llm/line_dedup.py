"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

The reference table holds one posting for each document and distinct long line:
(fingerprint of the line's key, doc_id). Documents come by adding their postings
and go by taking them away, so every state can be undone. The keys that enough
documents hold are kept in cuckoo filters, one for each shard of fingerprints,
which take keys in and out as their counts cross the limit. A pass over the
documents asks the filters which lines may go; only those lines are counted by
their content, so that neither a fingerprint nor a filter decides anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, documents, pieces, sendable

#: Bytes of filters that may be sent to every executor; to larger ones, lines are dealt by shard.
MOST_SENT = 64 << 20
#: Keys of a filter, and tasks that ask a filter where lines are dealt.
SHARD_KEYS, SALTS = 500_000, 16


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets to a key; grows when full.

    ``keys`` are 64-bit; inserting a key twice takes deleting it twice. Growing needs
    the keys again, so an insertion that finds no place reports False and leaves the
    filter as it was.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, 4), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(len(keys), 1) / 4 / 0.85))))
        while True:
            made = cls(buckets)
            if all(made.insert(int(k)) for k in keys):
                return made
            buckets *= 2

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, 4).copy()
        return cls(len(table), table)

    def bytes(self) -> bytes:
        return self.table.tobytes()

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _places(self, key: int) -> tuple[int, int, int]:
        key &= (1 << 64) - 1
        mark = (key >> 48) or 1
        bucket = key & (self.buckets - 1)
        return mark, bucket, self._other(bucket, mark)

    def insert(self, key: int) -> bool:
        mark, *both = self._places(key)
        moves = []
        for bucket in both:
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = both[1]
        for turn in range(500):
            slot = turn % 4
            moves.append((bucket, slot, int(self.table[bucket, slot])))
            self.table[bucket, slot], mark = mark, int(self.table[bucket, slot])
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        for bucket, slot, was in reversed(moves):
            self.table[bucket, slot] = was
        return False

    def delete(self, key: int) -> bool:
        mark, *both = self._places(key)
        for bucket in both:
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be in the filter; those that are always are found."""
        keys = keys.astype(np.uint64)
        mark = np.maximum(keys >> np.uint64(48), np.uint64(1))
        one = keys & np.uint64(self.buckets - 1)
        two = (one ^ (mark * np.uint64(0x5BD1E995))) & np.uint64(self.buckets - 1)
        mark = mark.astype(np.uint16)[:, None]
        return (self.table[one.astype(np.int64)] == mark).any(1) | (self.table[two.astype(np.int64)] == mark).any(1)


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased (bytes methods change ASCII alone)."""
    return line.strip().lower()


def _long_keys(text: str, least: int) -> list[bytes]:
    keys = [line_key(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
    return [k for k in dict.fromkeys(keys) if len(k) >= least and (len(k) >= 4 * least or len(k.decode("utf-8", "surrogatepass")) >= least)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(fp, doc_id) for each document and each of its distinct keys of ``least`` code points or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            found = [(i, _signed(xxh3_64_intdigest(k))) for i, t in zip(ids.to_pylist(), texts) for k in _long_keys(t, least)]
            yield pa.RecordBatch.from_arrays([pa.array([f for _, f in found], pa.int64()), pa.array([i for i, _ in found], pa.int64())], ["fp", "doc_id"])

    return _narrow(docs, id_col, text_col).mapInArrow(rows, "fp long, doc_id long")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def add_documents(table: DataFrame, docs: DataFrame, **columns) -> DataFrame:
    """The reference table with the documents in; one that is in stays as it is."""
    new = postings(docs.join(table.select(F.col("doc_id").alias(columns.get("id_col", "doc_id"))).distinct(), columns.get("id_col", "doc_id"), "left_anti"), **columns)
    return table.unionByName(new)


def remove_documents(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The reference table without the documents whose doc_id is in ``ids``."""
    return table.join(ids.select("doc_id"), "doc_id", "left_anti").select("fp", "doc_id")


def references(table: DataFrame) -> DataFrame:
    """(fp, n_docs): exact counts, summed in each task before they meet."""
    return table.where("doc_id is not null").groupBy("fp").agg(F.count("*").alias("n_docs"))


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright("fp", 20), F.lit(shards)).cast("int")


def filters(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, filter bytes) over the column ``fp``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"][:1], "filter": [CuckooFilter.of(pdf["fp"].to_numpy()).bytes()]})

    return frequent.select("fp", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(held: DataFrame, entering: DataFrame, leaving: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The filters after the keys ``entering`` (fp) came in and ``leaving`` (fp) went.

    ``current`` (fp) are all keys after the change: a shard that is full is built anew from its own.
    """

    def change(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(old) and not len(new):
            return pd.DataFrame({"shard": pd.Series(dtype="int32"), "filter": pd.Series(dtype=object)})
        shard = int((old if len(old) else new)["shard"].iloc[0])
        made = CuckooFilter.read(old["filter"].iloc[0]) if len(old) else None
        fps, what = new["fp"].to_numpy(), new["what"].to_numpy()
        if made is not None:
            for k in fps[what == -1]:
                made.delete(int(k))
        if made is None or not all([made.insert(int(k)) for k in fps[what == 1]]):
            made = CuckooFilter.of(fps[what >= 0])
        return pd.DataFrame({"shard": [shard], "filter": [made.bytes()]})

    what = current.join(entering, "fp", "left_anti").select("fp", F.lit(0).alias("what")).union(entering.select("fp", F.lit(1))).union(leaving.select("fp", F.lit(-1)))
    what = what.withColumn("shard", _shard(shards))
    return held.groupBy("shard").cogroup(what.groupBy("shard")).applyInPandas(change, "shard int, filter binary")


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list, np.ndarray]]:
    """((doc_id, key) of the distinct long lines, their fingerprints) by slices; rows without an id have none."""
    for ids, texts in pieces(batches):
        found = [(i, k) for i, t in zip(ids.to_pylist(), texts) if i is not None for k in _long_keys(t, least)]
        yield found, np.array([xxh3_64_intdigest(k) for _, k in found], np.uint64)


def _candidates(docs: DataFrame, held: dict[int, bytes], shards: int, least: int) -> DataFrame:
    """(doc_id, key) of the distinct long lines that the filters, which are sent to the documents, may hold."""
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {shard: CuckooFilter.read(data) for shard, data in sent.value.items()}
        for found, fps in _lines(batches, least):
            shard = (fps.astype(np.int64) >> 20) % shards
            may = np.zeros(len(found), bool)
            for s in np.unique(shard):
                if s in own:
                    may[shard == s] = own[s].holds(fps[shard == s])
            kept = [found[i] for i in np.flatnonzero(may)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int64()), pa.array([k for _, k in kept], pa.binary())], ["doc_id", "key"])

    return docs.mapInArrow(rows, "doc_id long, key binary")


def _dealt(docs: DataFrame, held: DataFrame, shards: int, least: int) -> DataFrame:
    """The same where filters are too large to send: lines are dealt to them by shard.

    A task streams its lines past the filters that are dealt to it, and holds one at a
    time. A shard's lines go to SALTS tasks, each with a copy of its filter, so that no
    line's documents meet in one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, fps in _lines(batches, least):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([k for _, k in found], pa.binary()), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "key", "fp"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = -1, None
        for batch in batches:
            shard_of, fps = batch.column(0).to_numpy(), batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
            may = np.zeros(batch.num_rows, bool)
            # A filter's row comes before the lines of its shard.
            heads = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False)).tolist()
            for start, end in zip([-1, *heads], [*heads, batch.num_rows]):
                if start >= 0:
                    shard, own = int(shard_of[start]), CuckooFilter.read(batch.column(1)[start].as_py())
                here = np.arange(start + 1, end)
                here = here[shard_of[here] == shard]
                if own is not None and len(here):
                    may[here] = own.holds(fps[here].view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3)], ["doc_id", "key"]).filter(pa.array(may))

    lines = docs.mapInArrow(rows, "doc_id long, key binary, fp long").select(_shard(shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), F.lit(None).cast("binary").alias("filter"), "doc_id", "key", "fp")
    filters_ = held.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), "filter", F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(None).cast("long"))
    together = lines.union(filters_).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    return together.select("shard", "filter", "doc_id", "key", "fp").mapInArrow(asked, "doc_id long, key binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, most: int = 2, table: DataFrame | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): lines that more than ``most`` documents hold stay in the last one only.

    A line's key has at least ``least`` code points; all lines with such a key go, but
    for those in the largest doc_id that holds it. ``table`` is a reference table that
    has the postings of ``docs`` (made here if none is given). A null or empty text is
    one empty line. Every row gives a row: those with a null id hold nothing and keep all
    lines; those that share an id count as one document. Other columns are ignored. No
    rows: no rows. Filters of at most ``most_sent`` bytes are sent to the documents; to
    larger ones, lines are dealt by shard.
    """
    own = _narrow(docs, id_col, text_col)
    counts = references(postings(own, least=least).distinct() if table is None else table)
    frequent = cut(counts.where(F.col("n_docs") > most).select("fp"))
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    held = cut(filters(frequent, shards))
    if (held.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= most_sent:
        may = _candidates(own, {r["shard"]: bytes(r["filter"]) for r in held.collect()}, shards, least)
    else:
        may = _dealt(own, held, shards, least)
    may = cut(may.distinct())
    # The counts by content decide.
    exact = cut(may.groupBy("key").agg(F.count("*").alias("_n"), F.max("doc_id").alias("_last")).where(F.col("_n") > most))
    # Both sides are shuffled for the join, so that the skew join can split a hot line.
    gone = cut(may.join(exact, "key").where("doc_id <> _last").groupBy("doc_id").agg(F.collect_list("key").alias("gone")))
    # Documents that lose nothing stay where they are; the others meet their lists.
    ids = sendable(gone.select("doc_id"))
    losing, rest = own.join(ids, "doc_id", "left_semi").join(gone, "doc_id"), own.join(ids, "doc_id", "left_anti").withColumn("gone", F.lit(None).cast("array<binary>"))
    schema = "doc_id long, n_lines long, n_dropped long, kept_text string"
    return losing.mapInArrow(_kept, schema).union(rest.mapInArrow(_kept, schema))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            rows = []
            for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                lines = (text or "").split("\n")
                out = lines
                if gone:
                    gone = set(gone)
                    out = [x for x in lines if line_key(x.encode("utf-8", "surrogatepass")) not in gone]
                rows.append((len(lines), len(lines) - len(out), "\n".join(out)))
            counts = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts[0], pa.int64()), pa.array(counts[1], pa.int64()), pa.array(counts[2], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {
    "op8_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i AS pos, parts[i] AS line,
                   translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
        common AS (
            SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id <> c.last AS gone
            FROM lines l LEFT JOIN common c ON l.key = c.key)
        SELECT doc_id, count(*) AS n_lines, cast(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id"""
}
