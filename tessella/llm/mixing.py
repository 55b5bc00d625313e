"""Mixing sources to target weights.

Documents get hash-random keys and are range-sorted by them within their source.
Distributed prefix sums of the token counts then say how much of a source comes
before each document, and every source is cut at its exact budget: whole epochs
of all its documents first, then the documents before the cut, the one that the
cut falls into with the part before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, documents, mark, running_sums, sendable, unused, whole_text

#: Weights of the sources in order, over and over.
WEIGHTS = (5, 2, 1)
#: The mix's share of all tokens, and the most epochs of a source.
SHARE, EPOCHS = 1.5, 2


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): the token budget of each source.

    Sources, sorted by code point, null last, take the weights in turn and share
    ``share`` times all tokens. A target stops at ``epochs`` times its source's size;
    what is over goes to the others by weight, until no target is above. That ends
    where one level, times the weight, is the target of all that are not stopped:
    with the sources sorted by size over weight, prefix sums give each one's level.
    """
    own = cut(sizes.select("source", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.lit(1).alias("one"), F.col("source").isNull().alias("last")))
    ranked = running_sums(own, [], ["last", "source"], rank="one")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("most"))
    ranked = ranked.withColumn("turn", F.col("most") / F.col("weight"))
    stopped = cut(running_sums(ranked, [], ["turn", "source"], most_before="most", weight_before="weight"))
    total = stopped.agg((F.lit(share) * F.sum("source_size")).alias("total"), F.sum("weight").alias("weights"))
    level = (F.col("total") - F.col("most_before")) / (F.col("weights") - F.col("weight_before"))
    # One row: the level of the first source that doesn't stop; none if all stop.
    found = stopped.crossJoin(F.broadcast(total)).withColumn("level", level).where("level <= turn").agg(F.min_by("level", F.struct("turn", "source")).alias("level"))
    return stopped.crossJoin(F.broadcast(found)).select("source", "source_size", F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.col("most").cast("double")).alias("target"))


def _mixed(docs: DataFrame, size: Column | None = None, seed: str = "mix", share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """What mix() returns, with the mark of each row's text."""
    sized = cut(docs.select("doc_id", "source", mark(whole_text()).alias("mark"), (count_words(whole_text()) if size is None else size).alias("size")))
    budgets = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, epochs, weights)
    keyed = sized.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    placed = running_sums(keyed, ["source"], ["key", "doc_id", "size", "mark"], before="size").withColumnRenamed("source", "_source")
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("before")))
    return placed.join(budgets, F.col("_source").eqNullSafe(F.col("source"))).select("doc_id", "source", "mark", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, size: Column | None = None, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``taken``: the tokens that the mix has of the row, epochs counted; over a source
    they sum to its target, rounded. ``size`` is the number of words by default. Null
    and empty texts have none. Null sources are one source. Keys come from the doc_id
    and the seed, so that reruns agree; rows that share a doc_id follow one another, by
    size. Other columns are ignored. No rows: no rows. ``options``: ``seed``, ``share``,
    ``epochs``, ``weights``.
    """
    return _mixed(docs, size, **options).drop("mark")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in whole documents, columns of ``docs``: each as often as ``taken`` holds its size, to the nearest.

    A document without tokens comes once. Rows that share id, source and text are alike
    and come as often as all of them together. Rows with null ids come too. No rows: no rows.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    # The source travels as a hash, so that what may be sent has a fixed width.
    of = lambda source: F.xxhash64(source, source.isNull())
    counts = _mixed(docs, **options).groupBy("doc_id", of(F.col("source")).alias("source"), "mark").agg(F.sum(times).cast("int").alias("times"), F.count("*").cast("int").alias("rows"))
    own, copy = unused(docs, "mix"), unused(docs, "copy")
    side = sendable(counts.where("times > 0").select(F.struct("*").alias(own)))
    met = F.col("doc_id").eqNullSafe(F.col(f"{own}.doc_id")) & (of(F.col("source")) == F.col(f"{own}.source")) & (mark(whole_text()) == F.col(f"{own}.mark"))
    each = docs.join(side, met)
    alone = each.where(F.col(f"{own}.rows") == 1)
    alike = side.where(F.col(f"{own}.rows") > 1)
    if not alike.isEmpty():
        alone = alone.union(each.where(F.col(f"{own}.rows") > 1).dropDuplicates([own]))
    return alone.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{own}.times")))).select(docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {
    "op5_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        ranked AS (
            SELECT source, source_size, 2 * source_size AS most,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
            FROM sources),
        stopped AS (
            SELECT *, most / weight AS turn,
                   coalesce(sum(most) OVER before, 0) AS most_before, coalesce(sum(weight) OVER before, 0) AS weight_before
            FROM ranked WINDOW before AS (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        levels AS (
            SELECT turn, source, (1.5 * (SELECT sum(source_size) FROM sources) - most_before) / ((SELECT sum(weight) FROM ranked) - weight_before) AS level FROM stopped),
        found AS (SELECT level FROM levels WHERE level <= turn ORDER BY turn, source NULLS FIRST LIMIT 1),
        budgets AS (
            SELECT source, source_size, coalesce(least(CAST(most AS DOUBLE), CAST((SELECT level FROM found) AS DOUBLE) * weight), CAST(most AS DOUBLE)) AS target FROM stopped),
        cuts AS (
            SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM budgets),
        placed AS (
            SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
        SELECT doc_id, size, source_size, target,
               CAST((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
                    + greatest(0, least(size, budget - (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * source_size - before)) AS BIGINT) AS taken
        FROM placed p JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source"""
}
