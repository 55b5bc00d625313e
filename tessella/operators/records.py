"""Bookkeeping over records: metrics, sessions, splits, quotas, edit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def confusion(df: DataFrame, keys: list[str], pred: Column, target: Column) -> DataFrame:
    """tp, fp, fn, tn by keys."""
    one = lambda x: F.sum(x.cast("int")).cast("long")
    return df.groupBy(*keys).agg(one((pred == 1) & (target == 1)).alias("tp"), one((pred == 1) & (target == 0)).alias("fp"), one((pred == 0) & (target == 1)).alias("fn"), one((pred == 0) & (target == 0)).alias("tn"))


def metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, iou, accuracy and fpr; every denominator has a small number added."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    out = counts.withColumn("precision", precision).withColumn("recall", recall)
    out = out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS))
    return out.withColumn("iou", tp / (tp + fp + fn + EPS)).withColumn("accuracy", (tp + tn) / (tp + tn + fp + fn + EPS)).withColumn("fpr", fp / (fp + tn + EPS))


def macro(measured: DataFrame, names: list[str]) -> DataFrame:
    """Means over tiles of the tiles' own metrics."""
    return measured.agg(*[F.avg(n).alias(n) for n in names])


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], preserve: list[str]) -> DataFrame:
    """A merge by key: new values overwrite, but columns in ``preserve`` keep the old value where there is one."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    first = lambda c, a, b: F.coalesce(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c)
    return both.select(first(key, "o", "n"), *[first(c, "n", "o") for c in overwrite], *[first(c, "o", "n") for c in preserve])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row by ``order`` of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def state_at(log: DataFrame, keys: list[str], value: str, seq: str, version: int) -> DataFrame:
    """An edit log replayed to a version: the last write to each key no later than it."""
    return log.where(F.col(seq) <= version).groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def hash_order(key: Column, seed: str) -> Column:
    """A shuffle that every engine agrees on."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string")))


def hash_split(df: DataFrame, key: str, seed: str, share: float, least: int) -> DataFrame:
    """Adds ``split``: ``val`` for max(1, half-even round of n * share) rows in hash order if there are ``least`` or more, else ``train``.

    Rows are ranked through a threshold, not a global sort: the n-th smallest hash is
    found from counts of hash prefixes, and only the rows that share its prefix are sorted.
    """
    hashed = df.withColumn("_h", hash_order(F.col(key), seed))
    n = hashed.agg(F.count("*").alias("n")).first()["n"]
    want = max(1, round(n * share)) if n >= least else 0
    if not want:
        return hashed.withColumn("split", F.lit("train")).drop("_h")
    prefixes = sorted((r["p"], r["n"]) for r in hashed.groupBy(F.substring("_h", 1, 3).alias("p")).agg(F.count("*").alias("n")).collect())  # 4096 at most
    total = 0
    for prefix, count in prefixes:
        if total + count >= want:
            break
        total += count
    edge = hashed.where(F.substring("_h", 1, 3) == prefix).orderBy("_h").limit(want - total).agg(F.max("_h")).first()[0]
    return hashed.withColumn("split", F.when(F.col("_h") <= edge, "val").otherwise("train")).drop("_h")


def hash_share(key: Column, seed: str, share: float) -> Column:
    """Whether a key is among a ``share`` of all, by its hash; the same in every run."""
    return F.substring(hash_order(key, seed), 1, 8) < f"{round(share * (1 << 32)):08x}" if share < 1 else F.lit(True)


def quota(df: DataFrame, stratum: Column, key: str, seed: str, quotas: dict[str, int]) -> DataFrame:
    """As many rows of each stratum as its quota says, in hash order."""
    w = Window.partitionBy("stratum").orderBy(hash_order(F.col(key), seed))
    ranked = df.withColumn("stratum", stratum).withColumn("rn", F.row_number().over(w))
    most = F.lit(0)
    for name, n in quotas.items():
        most = F.when(F.col("stratum") == name, n).otherwise(most)
    return ranked.where(F.col("rn") <= most)


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(F.count("*").alias("n")).withColumn("weight", 1.0 / F.col("n"))
