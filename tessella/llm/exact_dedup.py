"""Exact dedup by deterministic block naming (DataFrame functions only).

Every text is cut into blocks of a fixed number of characters, and blocks get
integer names: the distinct ones are sorted by (64-bit hash, content) and ranked.
Adjacent names of a text are then paired, the distinct pairs sorted and ranked in
the same way, and so on until a text has one name left. Texts with an equal
number of rounds and an equal last name are equal, and only those: a name stands
for one content.

The hash decides nothing. Blocks travel under it, and contents are read again
where a hash occurs more than once, copies folded before they meet: the smallest
and largest content under a hash are compared, and only where they differ do
contents themselves cross the network to be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, drop_cut, mark, running_sums, sendable, whole_text, without

#: Characters in a block.
BLOCK = 4096


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``name``: 1 for the first row in the order of ``by``, then 2, 3, ..."""
    ranked = running_sums(distinct.withColumn("_one", F.lit(1)), [], by, _before="_one")
    return ranked.withColumn("name", F.col("_before") + 1).drop("_one", "_before")


def _blocks(docs: DataFrame, text: Column, carried: list[Column], block: int, hashed) -> DataFrame:
    """(row, carried columns, size, pos, block, hash): the blocks of every row, whose number in its scan is its own."""
    size = F.greatest(F.lit(1), F.ceil(F.char_length("_t") / block).cast("int"))
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), *carried).alias("row"), text.alias("_t")).withColumn("size", size)
    # A text of one block is not sliced.
    parts = F.when(F.col("size") == 1, F.array("_t")).otherwise(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.substr("_t", i * block + 1, F.lit(block))))
    return rows.select("row", "size", F.posexplode(parts).alias("pos", "block")).withColumn("hash", hashed("block"))


def identities(docs: DataFrame, carried: list[Column], text: Column | None = None, block: int = BLOCK, hashed=F.xxhash64) -> DataFrame:
    """(row, round, name) for every row of ``docs``: equal (round, name) means equal text.

    ``row`` is a struct of a number of its own and the ``carried`` columns, so rows may
    repeat in all of them. A null text is empty; the empty text has one empty block.
    """
    text = whole_text() if text is None else text
    slim = cut(_blocks(docs, text, carried, block, hashed).select("row", "size", "pos", "hash"))
    # A hash that occurs once has one content; the others are compared.
    again = sendable(slim.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    contents = _blocks(docs, text, [], block, hashed).select("hash", "block").join(again, "hash", "left_semi")
    differ = cut(contents.groupBy("hash").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low <> high").select("hash"))
    if differ.isEmpty():
        # Each hash has one content, so the distinct hashes are the distinct blocks.
        level = slim.select("row", "size", "pos", F.lit(0).alias("kind"), F.col("hash").alias("old"))
    else:
        told = cut(_named(contents.join(differ, "hash", "left_semi").distinct(), ["hash", "block"]))
        plain = slim.join(differ, "hash", "left_anti").select("row", "size", "pos", F.lit(0).alias("kind"), F.col("hash").alias("old"))
        shared = _blocks(docs, text, carried, block, hashed).join(told, ["hash", "block"]).select("row", "size", "pos", F.lit(1).alias("kind"), F.col("name").alias("old"))
        level = cut(plain.union(shared))
    ranks = cut(_named(level.select("kind", "old").distinct(), ["kind", "old"]))
    level = cut(level.join(ranks, ["kind", "old"]).select("row", "size", "pos", "name"))
    # Texts of one block have their identity.
    done, rounds = level.where("size = 1").select("row", F.lit(0).alias("round"), "name"), 0
    level = cut(level.where("size > 1"))
    while not level.isEmpty():
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = level.groupBy("row", ((F.col("size") + 1) / 2).cast("int").alias("size"), half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),  # null for a name without a neighbour
        )
        pairs = cut(pairs)
        names = cut(_named(pairs.select("left", "right").distinct(), ["left", "right"]))
        same = (F.col("left") == F.col("l")) & F.col("right").eqNullSafe(F.col("r"))
        met = cut(pairs.join(names.select(F.col("left").alias("l"), F.col("right").alias("r"), "name"), same).select("row", "size", "pos", "name"))
        drop_cut(pairs)
        rounds += 1
        done = done.union(met.where("size = 1").select("row", F.lit(rounds).alias("round"), "name"))
        level = met.where("size > 1")
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", keep: str = "max", block: int = BLOCK, carry: tuple[str, ...] = (), text: Column | None = None) -> DataFrame:
    """(id_col, keep_id, group_size, kept, ``carry``): the group of equal texts of every row.

    Of a group the row with the largest (``keep="max"``) or smallest id stays. Null
    texts equal empty ones. Rows may share ids, with equal texts or others: each gives
    a row, and all of a group that have its keep_id are kept. Columns of ``docs`` that
    ``carry`` does not name are ignored. No rows: no rows. Rows whose id is null get no
    group and are left out.
    """
    named = cut(identities(docs.where(F.col(id_col).isNotNull()), [F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]], text, block=block))
    pick = {"max": F.max, "min": F.min}[keep]
    groups = cut(named.groupBy("round", "name").agg(pick("row.id").alias("keep_id"), F.count("*").alias("group_size")))
    # Both sides are shuffled for the join, so that the skew join can split a hot group.
    of = named.join(groups, ["round", "name"])
    return of.select(F.col("row.id").alias(id_col), "keep_id", "group_size", (F.col("row.id") == F.col("keep_id")).alias("kept"), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: one row for each text, and rows with a null id.

    Of rows that share text and id, one stays. Null texts equal empty ones. No rows: no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    found = cut(exact_dedup(own.withColumn("mark", mark(F.col("text"))), "id", carry=("mark",)))
    twice = found.where("kept").groupBy("id", "mark").agg(F.count("*").alias("c")).where("c > 1").select("id", "mark")
    return without(docs, found.where("not kept").select("id", "mark"), twice, id_col, text_col)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.sha2(whole_text(), 256).alias("text_sha256"))
    return exact_dedup(docs, carry=("text_sha256",))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
}
