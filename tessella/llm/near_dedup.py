"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

A document is the set of its word shingles. The sketch throws every shingle into
one of t bins by the hash of a round, with a value that grows with the round and
is random within it; a bin keeps its least value. Rounds go on until all bins
are filled, after t rounds with shingles sent to the bins one by one, so that
every coordinate fills and agreements concentrate around the Jaccard similarity.

Documents with equal sets fold into one representative; the sets of a fold are
compared whole. Bands of the sketch put representatives into buckets, and a
bucket proposes its pivot to every member. Each member meets first the pivot that
most of its buckets propose; what that leaves unconnected meets the other pivots
and, in small buckets, each other. Of large buckets that still hold more than one
component, members go that share too few shingles with other components to link
to any, and the rest is compared in blocks, inside tasks
that hold the full sets of two blocks and give back links only. So rows grow with
the members of a bucket, not with their pairs. Every link is verified on full
sets; none is drawn from the sketch.

Sets hold 64-bit hashes of shingles. Two shingles of a text of 20,000 words share
one with a probability of 1e-11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import components, cut, documents, drop_cut, mark, pieces, rooted, sendable, slices, whole_text, without
from .quality import _mixed

#: Coordinates in a band, and bands: a pair at 0.8 shares none with a probability of 1.3e-7.
ROWS, BANDS = 5, 40
#: Members up to which a bucket proposes all pairs, and members in a block of a larger one.
SMALL, BLOCK = 8, 256
#: Salts of the two halves of a set's digest.
SALTS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A43)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts end to end, sorted in each, and where each text begins, and the end).

    A-Z is lower-cased; words end at ASCII white space. Fewer than n words are one shingle; none are none.
    """
    number: dict[bytes, int] = {}
    words, bounds = [], [0]
    for text in texts:
        words += [number.setdefault(w, len(number)) for w in text.encode("utf-8", "surrogatepass").lower().split()]
        bounds.append(len(words))
    hashed = np.fromiter((xxh3_64_intdigest(w) for w in number), np.uint64, len(number))[np.array(words, np.int64)] if words else np.zeros(0, np.uint64)
    count = max(0, len(hashed) - n + 1)
    window = _mixed(hashed[:count] + np.uint64(n))
    for j in range(1, n):
        window = _mixed(window * _ODD + hashed[j : j + count])
    sets = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= n:
            own = np.sort(window[a : b - n + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in hashed[a:b]:
                h = _mixed(h * _ODD + w)
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def sketches(shingles: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """A row of t filled coordinates for each set that is not empty; rows of empty sets stay at the largest value."""
    none = np.uint64((1 << 64) - 1)
    sizes = np.diff(bounds)
    out = np.full((len(sizes), t), none, np.uint64)
    flat = out.reshape(-1)
    active = np.flatnonzero(sizes > 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = shingles
    for i in range(2 * t):
        mixed = _mixed(own + np.uint64((i + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        bins = (mixed >> np.uint64(40)).astype(np.int64) % t if i < t else i - t
        value = (np.uint64(i) << np.uint64(54)) | (_mixed(mixed ^ _ODD) >> np.uint64(10))
        np.minimum.at(flat, owner * t + bins, value)
        filled = (out[active] != none).all(1)
        if filled.any():
            active = active[~filled]
            if not len(active):
                break
            going = np.zeros(len(sizes), bool)
            going[active] = True
            still = going[owner]
            owner, own = owner[still], own[still]
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _digests(shingles: np.ndarray, bounds: np.ndarray, salts: tuple[int, ...]) -> list[np.ndarray]:
    """A sum over each set for each salt, of hashes that no other set is likely to sum to."""
    out = []
    for salt in salts:
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(shingles ^ np.uint64(salt)) if salt else shingles & np.uint64(1))))
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out


def _sketched(docs: DataFrame, n: int, rows: int, bands: int, salts: tuple[int, ...] = SALTS) -> DataFrame:
    """(doc_id, mark, n, f1, f2, bands): set size, a 128-bit digest of the set, and band keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 21):
            texts = [t or "" for t in part.column(1).to_pylist()]
            shingles, bounds = shingle_sets(texts, n)
            sketch = sketches(shingles, bounds, rows * bands).reshape(len(texts), bands, rows)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(texts), bands)).copy()
            for j in range(rows):
                keys = _mixed(keys * _ODD + sketch[:, :, j])
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), _signed(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(bounds)), *map(_signed, _digests(shingles, bounds, salts)), listed], ["doc_id", "mark", "n", "f1", "f2", "bands"])

    return docs.withColumn("mark", mark(whole_text())).mapInArrow(make, "doc_id long, mark long, n long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int, salts: tuple[int, ...]) -> DataFrame:
    """(doc_id, n, f1, f2, set) of the documents whose doc_id is in ``wanted``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            shingles, bounds = shingle_sets(texts, n)
            listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _signed(shingles))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), *map(_signed, _digests(shingles, bounds, salts)), listed], ["doc_id", "n", "f1", "f2", "set"])

    return docs.join(sendable(wanted.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(make, "doc_id long, n long, f1 long, f2 long, set array<long>")


_SET = ["n", "f1", "f2"]


def _folded(made: DataFrame, docs: DataFrame, n: int, salts: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(made with ``part``, one row for each set: n, f1, f2, part, id, bands, rep).

    Digests that occur again are checked by the smallest and largest set under each; ``part``
    is 0 but where sets share a digest, which it then numbers.
    """
    again = cut(made.where("n > 0").groupBy(*_SET).agg(F.count("*").alias("c")).where("c > 1"))
    copies = made.join(again, _SET).select("doc_id")
    compared = _sets(docs, copies, n, salts).groupBy(*_SET).agg(F.min("set").alias("low"), F.max("set").alias("high"))
    differ = cut(compared.where("low <> high").select(*_SET))
    if differ.isEmpty():
        made = made.withColumn("part", F.lit(0))
    else:
        told = _sets(docs, made.join(differ, _SET).select("doc_id"), n, salts).join(differ, _SET)
        parts = told.select(*_SET, "set").distinct().withColumn("part", F.dense_rank().over(Window.partitionBy(*_SET).orderBy("set")))
        told = told.join(parts, [*_SET, "set"]).groupBy("doc_id", *_SET).agg(F.min("part").alias("part"))
        made = cut(made.join(told, ["doc_id", *_SET], "left").withColumn("part", F.coalesce("part", F.lit(0))))
    reps = made.where("n > 0").groupBy(*_SET, "part").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    return made, cut(reps.withColumn("rep", F.monotonically_increasing_id()))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and other columns) whose full sets are similar enough."""
    pairs = cut(pairs)
    own = sets.join(sendable(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()), "rep", "left_semi")
    left = own.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    right = own.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    alike = 100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)
    return cut(pairs.join(left, "a").join(right, "b").where(alike).select(pairs.columns))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, b, comp_a, comp_b): the pairs that no link connects yet."""
    of = lambda x: comps.select(F.col("id").alias(x), F.col("component").alias(f"comp_{x}"))
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("comp_a <> comp_b").select("a", "b", "comp_a", "comp_b")


def _merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """The components after links between them: (comp_a, comp_b) in ``found``."""
    links = cut(found.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct())
    if links.isEmpty():
        return comps
    met = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    roots = sendable(components(met, links).select(F.col("id").alias("component"), F.col("component").alias("root")).where("component <> root"))
    return cut(comps.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component")))


def _cross_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components of the rows, as many as connect what they connect."""
    group = group.drop_duplicates("rep").reset_index(drop=True)
    comp = group["comp"].to_numpy()
    sizes = np.array([len(s) for s in group["set"]])
    flat = np.concatenate(group["set"].to_numpy()) if len(group) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(group)), sizes)
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    main = pd.Series(comp).mode().iloc[0] if len(comp) else 0
    # Rows of the largest component are not compared with each other.
    rest, every = np.flatnonzero(comp != main), np.arange(len(group))
    place = np.full(len(group), -1)
    place[rest] = np.arange(len(rest))
    common = np.zeros((len(rest), len(group)), np.float32)
    for start in range(0, int(column.max()) + 1 if len(column) else 0, 8192):
        here = (column >= start) & (column < start + 8192)
        part = np.zeros((len(group), 8192), np.float32)
        part[owner[here], column[here] - start] = 1
        common += part[rest] @ part.T
    union = sizes[rest][:, None] + sizes[None, :] - common
    r, c = np.nonzero((100 * common >= percent * union) & (comp[rest][:, None] != comp[None, :]))
    root = {x: x for x in np.unique(comp)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for a, b in zip(rest[r], every[c]):
        p, q = find(comp[a]), find(comp[b])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(comp[a]), int(comp[b])))
    del common, union
    return pd.DataFrame(out, columns=["comp_a", "comp_b"], dtype="int64")


def _open(large: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, rep, n, comp): members of buckets that hold two components or more; of buckets with equal members, one.

    ``large``: rep, n, keys. Components are found once for a member, not once for each of its buckets.
    """
    each = large.join(comps.select(F.col("id").alias("rep"), F.col("component").alias("comp")), "rep").select("rep", "n", "comp", F.explode("keys").alias("key"))
    mixed = each.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)) % (1 << 40)).alias("y"))
    one = mixed.where("low <> high").groupBy("c", "x", "y").agg(F.min("key").alias("key"))
    return each.join(one.select("key"), "key", "left_semi")


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members that share enough of their shingles with other components for a link; others have none left to find.

    A link takes ``percent`` hundredths of a set at least.
    """
    own = sendable(members.select("rep", "n", "comp").distinct())
    spread = sets.join(own, "rep").select("rep", "n", "comp", F.explode("set").alias("shingle"))
    common = spread.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("shingle")
    # Both sides are shuffled, so that the skew join can split a shingle of many members.
    return spread.join(common, "shingle").groupBy("rep", "n").agg(F.count("*").alias("c")).where(F.col("c") * 100 >= F.col("n") * percent).select("rep")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """(key, i, j, rep, comp): members of buckets dealt to pairs of blocks.

    The component of a bucket's pivot is spread over blocks of its own; those are met with blocks of
    the others, which are met with each other. Rows are dealt by hash, so no task orders a bucket.
    """
    mains = members.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"))
    marked = cut(members.join(mains, "key").select("key", "rep", "comp", (F.col("comp") == F.col("main.comp")).alias("same")))
    counts = marked.groupBy("key").agg(F.sum(F.col("same").cast("int")).alias("n_same"), F.sum((~F.col("same")).cast("int")).alias("n_rest")).where("n_rest > 0")
    counts = cut(counts.select("key", F.ceil(F.col("n_same") / block).cast("int").alias("b_same"), F.ceil(F.col("n_rest") / block).cast("int").alias("b_rest")))
    dealt = marked.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("same"), F.col("b_same")).otherwise(F.col("b_rest"))).cast("int"))
    rest = F.sequence(F.lit(0), F.col("b_rest") - 1)
    # Blocks of the largest component have numbers from b_rest on.
    mates = F.when(F.col("same"), F.transform(rest, lambda x: F.struct(x.alias("i"), (F.col("own") + F.col("b_rest")).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("b_rest") + F.col("b_same") - 1), lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j")))
    )
    return dealt.select("key", "rep", "comp", F.explode(mates).alias("to")).select("key", "to.i", "to.j", "rep", "comp")


def _close(x: Column, y: Column, percent: int) -> Column:
    """Whether the sizes of two sets alone leave room for a link."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _classes(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, bands: int = BANDS, small: int = SMALL, block: int = BLOCK, salts: tuple[int, int] = SALTS) -> DataFrame:
    """What near_duplicates() returns, with the mark of each row's text."""
    if not 0 < rows * bands <= 512:
        raise ValueError("a sketch has 1 to 512 coordinates")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sketched = cut(_sketched(own, n, rows, bands, salts))
    made, reps = _folded(sketched, own, n, salts)
    keyed = reps.select("rep", "n", F.explode("bands").alias("key"))
    # One random order of all representatives, so that a group of copies has few pivots over all its buckets.
    buckets = cut(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "n")).alias("p")).where("size > 1"))
    members = cut(keyed.join(buckets.select("key", "size", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n")), "key"))
    star = members.where("rep <> pivot").where(_close(F.col("n"), F.col("pivot_n"), percent)).groupBy("rep", "pivot").agg(F.count("*").alias("c"))
    star = cut(star.select("rep", "pivot", "c", F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")))
    few = members.where(F.col("size") <= small)
    a, b = few.select("key", F.col("rep").alias("a"), F.col("n").alias("na")), few.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & _close(F.col("na"), F.col("nb"), percent)).select("a", "b")
    pairs = cut(pairs.union(star.select("a", "b")).distinct())
    large = cut(members.where(F.col("size") > small).groupBy("rep", "n").agg(F.collect_list("key").alias("keys")))  # a list of ``bands`` keys at most
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).union(large.select("rep")).distinct()
    wanted = cut(reps.join(wanted, "rep", "left_semi").select("rep", F.col("id").alias("doc_id"), *_SET))
    # Of rows that share an id and a set, one will do.
    sets = cut(_sets(own, wanted, n, salts).join(wanted, ["doc_id", *_SET]).groupBy("rep").agg(F.first("set").alias("set")))
    drop_cut(members, buckets)
    ids = reps.select(F.col("rep").alias("id"))
    # First the pivot of most of a member's buckets, then all other pairs between what is not connected.
    first = star.groupBy("rep").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("pivot")).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    # A pivot comes before its members in the random order, so that links to them make a forest.
    trees = rooted(_linked(first, sets, percent).select(F.col("a").alias("id"), F.col("b").alias("parent")))
    comps = cut(ids.join(trees, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    comps = _merged(comps, _linked(_apart(pairs, comps), sets, percent))
    drop_cut(pairs, star)
    left = cut(_open(large, comps))
    if not left.isEmpty():
        left = _open(large.join(cut(_linkable(left, sets, percent)), "rep", "left_semi"), comps)
        dealt = cut(_blocks(cut(left), block))
        more = dealt.join(sets, "rep").groupBy("key", "i", "j").applyInPandas(lambda g: _cross_links(g, percent), "comp_a long, comp_b long")
        comps = _merged(comps, more)
    smallest = reps.select(F.col("rep"), "id", *_SET, "part").join(comps.select(F.col("id").alias("rep"), "component"), "rep")
    named = smallest.groupBy("component").agg(F.min("id").alias("component_id"))
    # Cut, so that the join of a hot group of copies can be split.
    named = cut(smallest.join(named, "component").select(*_SET, "part", "component_id"))
    joined = made.select("doc_id", "mark", *_SET, "part").join(named, [*_SET, "part"], "left").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 80, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): classes of documents linked by similar shingle sets.

    Two documents are linked if 100 times the size of their sets' intersection is at
    least ``percent`` times that of the union; a class is what links connect, named by
    its smallest doc_id, which is the one that stays. Null and empty texts have no
    shingles and no links: each is a class of its own. Every row with an id gives one
    row, and rows that share an id are documents of their own (all that have their
    class's id are kept). Rows without an id are left out. Other columns are ignored,
    whatever their names. No rows: no rows. ``options``: ``id_col``, ``text_col``;
    ``rows`` and ``bands`` of the sketch, 512 coordinates at most; ``small``, ``block``.
    """
    return _classes(docs, n, percent, **options).drop("mark")


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one row of each class, and rows without an id.

    Null and empty texts are alike to nothing and stay. Rows that share an id and a text are one
    document; rows that share an id alone are not. No rows: no rows.
    """
    classes = cut(_classes(docs, n, percent))
    twice = classes.where("kept").groupBy("doc_id", "mark").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", "mark")
    return without(docs, classes.where("not kept").select("doc_id", "mark"), twice)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op10_near_dedup": op10_near_dedup}
#: Word sequences of fewer than four words cannot equal a shingle: words hold no blanks.
ORACLES = {
    "op10_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                           ELSE [concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]) for i in range(1, len(w) - 2)] END) AS s FROM words),
        folded AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
        each AS (SELECT id, len(s) AS n, unnest(s) AS shingle FROM folded),
        held AS (SELECT id, n, shingle FROM each WHERE shingle IN (SELECT shingle FROM each GROUP BY shingle HAVING count(*) > 1)),
        links AS (
            SELECT a.id AS a, b.id AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        reached(id, other) AS (
            SELECT id, id FROM folded UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a),
        classes AS (SELECT id, min(other) AS component FROM reached GROUP BY id),
        named AS (SELECT f.s, c.component FROM folded f JOIN classes c ON f.id = c.id)
        SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(n.component, d.doc_id) AS component_id, coalesce(n.component, d.doc_id) = d.doc_id AS kept
        FROM sets d LEFT JOIN named n ON list_sort(d.s) = n.s"""
}
