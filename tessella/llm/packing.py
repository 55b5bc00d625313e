"""Packing by non-negative least squares over shallow length combinations.

Texts are tokenized once and cut into pieces of a full window and a remainder.
The remainders' histogram, which has no more bins than a window has tokens, goes
to the driver. There every combination of up to three lengths that fills a
window exactly is a column of a least-squares problem, whose non-negative
solution says how often to repeat it. Repeats are rounded, cut down to what is
left of each length, and topped up greedily. Pieces of a length are numbered by
distributed prefix sums and look up their place by number. What no combination
takes is packed greedily end to end, cut where a window ends; the last window is
cut into sequences of powers of two, so that nothing at all is padded.
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
from .tokens import KEPT, encoder

WINDOW = 2048
SWEEPS = 30
#: Pieces to be cut that may be sent to every executor; more meet their ids by a join of both sides.
MOST_SENT = 500_000

_PIECES = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())])


def tokenize(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """The pieces of every text with their ids, written to ``folder`` and read again.

    A text's ids and ``end_id`` are cut every ``window`` ids. Null texts are empty and
    have the end alone; ids may be null or repeat; other columns are ignored. Workers
    remember the ids of twice ``kept`` words; fewer cost time and spare memory.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for part in slices(batches, max(1, min(8, kept // 30_000)) << 20):
            doc_ids = part.column(0)
            ids, bounds = encoder(vocabulary, kept).encode(part.column(1))
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(len(bounds))
            counts = np.diff(bounds)
            n = -(-counts // window)  # pieces of each text, one at least
            owner = np.repeat(np.arange(len(counts)), n)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, counts[owner] - start)
            whole, wide = memoryview(ids.tobytes()), bool(len(ids)) and int(ids.max()) >> 16 > 0
            stored, each = memoryview(ids.astype("<u4" if wide else "<u2").tobytes()), 4 if wide else 2
            a = bounds[:-1][owner] + start
            spans = list(zip(a.tolist(), (a + length).tolist()))
            yield pa.RecordBatch.from_arrays([
                pa.array(uid + np.arange(len(owner))), doc_ids.take(pa.array(owner)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(counts[owner]),
                pa.array([zlib.crc32(whole[4 * i : 4 * j]) for i, j in spans], pa.int64()), pa.array(np.full(len(owner), wide)), pa.array([bytes(stored[each * i : each * j]) for i, j in spans], pa.binary()),
            ], schema=_PIECES)
            uid += len(owner)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = narrow.mapInArrow(rows, "uid long, doc_id long, start long, length int, doc_tokens long, ids_crc32 long, wide boolean, ids binary")
    made.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def solve(counts: np.ndarray, window: int = WINDOW, sweeps: int = SWEEPS) -> dict[tuple[int, ...], float]:
    """Repeats of the combinations of two or three lengths that fill a window: least squares, none negative.

    ``counts[n]`` pieces have length n. Coordinate descent: each sweep moves, for each
    shortest length, the combination with the steepest gradient, and then those in use.
    """
    left = counts.astype(float)
    x: dict[tuple[int, ...], float] = {}
    column: dict[tuple[int, ...], list[tuple[int, int]]] = {}

    def move(combo: tuple[int, ...]) -> None:
        own = column.setdefault(combo, [(n, combo.count(n)) for n in set(combo)])
        step = sum(k * left[n] for n, k in own) / sum(k * k for _, k in own)
        now = x.get(combo, 0.0)
        step = max(step, -now)
        if step:
            x[combo] = now + step
            for n, k in own:
                left[n] -= k * step

    present = np.flatnonzero(counts)
    for _ in range(sweeps):
        for a in present[present <= window // 2].tolist():
            best, value = (a, window - a), (left[a] + left[window - a]) / 2**0.5 if counts[window - a] else -np.inf
            b = np.arange(a, (window - a) // 2 + 1)
            if len(b):
                gain = np.where((counts[b] > 0) & (counts[window - a - b] > 0), left[b] + left[window - a - b], -np.inf)
                k = int(np.argmax(gain))
                if (left[a] + gain[k]) / 3**0.5 > value:
                    best = (a, int(b[k]), window - a - int(b[k]))
            if all(counts[n] for n in best):
                move(best)
        for combo in [c for c, v in x.items() if v > 0]:
            move(combo)
    return {c: v for c, v in x.items() if v > 0}


def repeats(counts: np.ndarray, window: int = WINDOW, sweeps: int = SWEEPS) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(combination, times) for whole windows, and the pieces of each length that are left."""
    left = counts.astype(np.int64)
    made: dict[tuple[int, ...], int] = {}

    def take(combo: tuple[int, ...], most: int) -> None:
        times = min([most, *(int(left[n]) // combo.count(n) for n in set(combo))])
        if times > 0:
            made[combo] = made.get(combo, 0) + times
            for n in combo:
                left[n] -= times

    if left[window]:
        take((window,), int(left[window]))
    for combo, value in sorted(solve(counts, window, sweeps).items(), key=lambda v: (-v[1], v[0])):
        take(combo, round(value))
    for a in range(window - 1, 0, -1):  # what rounding left, the longest first
        if left[a]:
            take((a, window - a), int(left[a]))
        b = np.arange(1, (window - a) // 2 + 1)
        for k in b[(left[b] > 0) & (left[window - a - b] > 0)].tolist() if left[a] else ():
            take(tuple(sorted((a, k, window - a - k))), int(left[a]))
    return list(made.items()), left


class Places:
    """Where the piece with a length and a number goes: arrays of intervals of numbers, sorted by length."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        rows, used, base = [], {}, 0
        for combo, times in plan:
            at = 0
            for n in sorted(set(combo)):
                k = combo.count(n)
                lo = used.get(n, 0)
                used[n] = lo + k * times
                rows.append(((n << 48) + lo, (n << 48) + used[n], base, k, at, n))
                at += k * n
            base += times
        self.sequences = base
        self.low, self.high, self.base, self.k, self.at, self.n = np.array(sorted(rows), np.int64).reshape(-1, 6).T

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset); -1 for what is left over."""
        if not len(self.low):
            return np.full(len(length), -1), np.full(len(length), -1)
        key = (length.astype(np.int64) << 48) + number
        i = np.maximum(np.searchsorted(self.low, key, "right") - 1, 0)
        inside = (self.low[i] <= key) & (key < self.high[i])
        step = key - self.low[i]
        return np.where(inside, self.base[i] + step // self.k[i], -1), np.where(inside, self.at[i] + step % self.k[i] * self.n[i], -1)


def _ends(total: int, window: int) -> list[int]:
    """Ends of the last sequences of ``total`` tokens laid end to end, after the whole windows: powers of two."""
    at, out = total // window * window, []
    for bit in reversed(range((window - 1).bit_length() + 1)):
        if (total - at) >> bit:
            at += 1 << bit
            out.append(at)
    return out


def pack(table: DataFrame, window: int = WINDOW, sweeps: int = SWEEPS, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, uid) of every piece, cut ones in parts.

    ``table`` is what tokenize() wrote. Pieces in a sequence follow one another without
    gaps. No pieces: no rows.
    """
    slim = table.select("uid", "doc_id", "start", "length", "doc_tokens", "ids_crc32", F.lit(1).alias("one"))
    counts = np.zeros(window + 1, np.int64)
    for length, count in slim.groupBy("length").count().collect():  # at most a row for each length
        counts[length] = count
    plan, left = repeats(counts, window, sweeps)
    places = Places(plan)
    sent = table.sparkSession.sparkContext.broadcast(places)  # as large as the window allows, however many pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = sent.value.of(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    numbered = running_sums(slim, ["length"], ["doc_id", "start", "uid"], number="one").drop("one")
    placed = numbered.mapInArrow(place, "uid long, doc_id long, start long, length int, doc_tokens long, ids_crc32 long, number long, sequence_id long, offset long")
    total = int((left * np.arange(window + 1)).sum())
    columns = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset", "uid"]
    done = placed.where("sequence_id >= 0").select(columns)
    if not total:
        return done
    # What is left, end to end.
    laid = cut(running_sums(placed.where("sequence_id < 0").drop("sequence_id", "offset"), [], ["length", "number"], at="length"))
    full, ends = total // window * window, _ends(total, window)
    last = F.col("at") + F.col("length") - 1
    inside = (last < full) & (F.floor(F.col("at") / window) == F.floor(last / window))
    whole = laid.where(inside).withColumn("sequence_id", F.floor(F.col("at") / window) + places.sequences).withColumn("offset", F.col("at") % window)
    split = cut(laid.where(~inside).select("uid", "doc_id", "start", "doc_tokens", "at"))
    first = places.sequences

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uid, doc_id, start, tokens, at, wide, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(data, "<u4" if wide else "<u2").astype("<u4")
                done = 0
                while done < len(ids):
                    here = at + done
                    if here < full:
                        begin, end, sequence = here // window * window, (here // window + 1) * window, here // window
                    else:
                        k = next(i for i, e in enumerate(ends) if here < e)
                        begin, end, sequence = (ends[k - 1] if k else full), ends[k], full // window + k
                    n = min(end - here, len(ids) - done)
                    out.append((doc_id, start + done, n, zlib.crc32(ids[done : done + n].tobytes()), tokens, first + sequence, here - begin, uid))
                    done += n
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "uid"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 8, names)

    side = F.broadcast(split) if split.count() <= most_sent else split
    cut_ids = table.select("uid", "wide", "ids").join(side, "uid").select("uid", "doc_id", "start", "doc_tokens", "at", "wide", "ids")
    made = cut_ids.mapInArrow(parts, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, uid long")
    return done.union(whole.select(columns)).union(made)


def sequences(table: DataFrame, packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, input_ids, doc_ids, n_tokens): the packed sequences themselves, one to a row."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(d, "<u4" if w else "<u2")[k : k + n].astype(np.int32) for d, w, k, n in zip(*(c.to_pylist() for c in batch.columns[3:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.list_(pa.int32()))], ["sequence_id", "offset", "doc_id", "own"])

    met = packed.join(table.select("uid", F.col("start").alias("_from"), "wide", "ids"), "uid")
    met = met.select("sequence_id", "offset", "doc_id", "ids", "wide", (F.col("start") - F.col("_from")).alias("skip"), "length")
    rows = met.mapInArrow(unpacked, "sequence_id long, offset long, doc_id long, own array<int>")
    grouped = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "own"))).alias("p"))
    return grouped.select("sequence_id", F.flatten("p.own").alias("input_ids"), F.col("p.doc_id").alias("doc_ids"), F.size(F.flatten("p.own")).alias("n_tokens"))


def packed_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, kept: int = KEPT) -> DataFrame:
    """tokenize() and pack(), with the ids dropped again."""
    folder = scratch(docs.sparkSession)
    try:
        return cut(pack(tokenize(docs, folder, vocabulary, window=window, kept=kept), window).drop("uid"))
    finally:
        remove(docs.sparkSession, folder)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
