"""Queries over records: metrics, review sessions, splits, quotas, edit logs, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import predictions, review_items, sql, table
from ..operators import records
from ..operators.numbering import numbered

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


COUNTS = """CAST(sum(CASE WHEN pred = 1 AND target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN pred = 1 AND target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN pred = 0 AND target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN pred = 0 AND target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn"""
RATES = """m AS (SELECT *, tp / (tp + fp + 1e-8::DOUBLE) AS precision, tp / (tp + fn + 1e-8::DOUBLE) AS recall, tp / (tp + fp + fn + 1e-8::DOUBLE) AS iou,
    (tp + tn) / (tp + tn + fp + fn + 1e-8::DOUBLE) AS accuracy, fp / (fp + tn + 1e-8::DOUBLE) AS fpr FROM n)"""
NAMES = ["precision", "recall", "f1", "iou", "accuracy", "fpr"]
ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-8::DOUBLE), 6) AS f1, round(iou, 6) AS iou, round(accuracy, 6) AS accuracy, round(fpr, 6) AS fpr"


@query(f"{sql('predictions')}, n AS (SELECT tile, {COUNTS} FROM predictions GROUP BY tile), {RATES} SELECT tile, tp, fp, fn, tn, {ROUNDED} FROM m")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = records.confusion(predictions(spark, sf_dir), ["tile"], F.col("pred"), F.col("target"))
    return records.metrics(counts).select("tile", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in NAMES])


@query(
    f"""{sql('predictions')}, n AS (SELECT tile, {COUNTS} FROM predictions GROUP BY tile), {RATES}, f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-8::DOUBLE) AS f1 FROM m)
    SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(iou), 6) AS iou, round(avg(accuracy), 6) AS accuracy, round(avg(fpr), 6) AS fpr FROM f"""
)
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = records.confusion(predictions(spark, sf_dir), ["tile"], F.col("pred"), F.col("target"))
    return records.macro(records.metrics(counts), NAMES).select(*[F.round(c, 6).alias(c) for c in NAMES])


@query(f"{sql('predictions')} SELECT target, count(*) AS n, round(avg(CASE WHEN pred = target THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM predictions GROUP BY GROUPING SETS ((target), ())")
def accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predictions(spark, sf_dir).withColumn("hit", (F.col("pred") == F.col("target")).cast("double"))
    return own.rollup("target").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("accuracy")).select("target", "n", "accuracy")


@query(f"{sql('predictions')} SELECT round((2 * sum(CAST(pred AS DOUBLE) * target) + 1e-6) / (sum(pred) + sum(target) + 1e-6), 6) AS dice FROM predictions")
def dice_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predictions(spark, sf_dir)
    dice = (2 * F.sum(F.col("pred") * F.col("target")) + 1e-6) / (F.sum("pred") + F.sum("target") + 1e-6)
    return own.agg(F.round(dice, 6).alias("dice"))


@query(f"{sql('items')} SELECT status, count(*) AS n, count(CASE WHEN corrected THEN 1 END) AS n_corrected FROM items GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_items(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count(F.when(F.col("corrected"), 1)).alias("n_corrected"))


@query(f"{sql('items')} SELECT tile_id, source, status FROM items WHERE (status = 'incorrect' AND corrected) OR status = 'correct'")
def finetune_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_items(spark, sf_dir).where("(status = 'incorrect' and corrected) or status = 'correct'").select("tile_id", "source", "status")


@query(
    """WITH h AS (SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS k FROM labels), r AS (SELECT doc_id, row_number() OVER (ORDER BY k) AS rn, count(*) OVER () AS n FROM h)
    SELECT doc_id, CASE WHEN n >= 5 AND rn <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM r"""
)
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.hash_split(table(spark, sf_dir, "labels"), "doc_id", "42", 0.2, 5).select("doc_id", "split")


@query(f"{sql('items')} SELECT status, count(*) AS n, round(1.0::DOUBLE / count(*), 8) AS weight FROM items GROUP BY status")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.class_weights(review_items(spark, sf_dir), "status").select("status", "n", F.round("weight", 8).alias("weight"))


@query(
    """WITH s AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'olive' WHEN lang = 'fr' THEN 'vine' ELSE 'rest' END AS stratum FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || CAST(doc_id AS VARCHAR))) AS rn FROM s)
    SELECT doc_id, stratum FROM r WHERE rn <= CASE stratum WHEN 'olive' THEN 60 WHEN 'vine' THEN 30 ELSE 10 END"""
)
def quota_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: fixed quotas by stratum."""
    stratum = F.when(F.col("lang") == "en", "olive").when(F.col("lang") == "fr", "vine").otherwise("rest")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return records.quota(docs, stratum, "doc_id", "7", {"olive": 60, "vine": 30, "rest": 10}).select("doc_id", "stratum")


@query(
    f"""{sql('items')}, o AS (SELECT * FROM items WHERE tile_id % 3 <> 0), n AS (SELECT tile_id, 'new' AS source, 'pending' AS status, FALSE AS corrected FROM items WHERE tile_id % 3 <> 1)
    SELECT coalesce(o.tile_id, n.tile_id) AS tile_id, coalesce(n.source, o.source) AS source, coalesce(o.status, n.status) AS status, coalesce(o.corrected, n.corrected) AS corrected FROM o FULL OUTER JOIN n ON o.tile_id = n.tile_id"""
)
def upsert_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh of a review session: sources are new, verdicts stay."""
    items = review_items(spark, sf_dir)
    new = items.where("tile_id % 3 <> 1").select("tile_id", F.lit("new").alias("source"), F.lit("pending").alias("status"), F.lit(False).alias("corrected"))
    return records.upsert(items.where("tile_id % 3 <> 0"), new, "tile_id", ["source"], ["status", "corrected"]).select("tile_id", "source", "status", "corrected")


@query(f"{sql('items')} SELECT tile_id, CASE WHEN tile_id % 5 = 0 THEN 'incorrect' ELSE status END AS status, corrected OR tile_id % 5 = 0 AS corrected FROM items")
def save_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved corrections mark their tiles corrected and incorrect."""
    items = review_items(spark, sf_dir)
    saved = items.where("tile_id % 5 = 0").select("tile_id", F.lit(True).alias("saved"))
    both = items.join(saved, "tile_id", "left")
    return both.select("tile_id", F.when(F.col("saved"), "incorrect").otherwise(F.col("status")).alias("status"), (F.col("corrected") | F.coalesce("saved", F.lit(False))).alias("corrected"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS rn FROM events) WHERE rn = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return records.latest(events, ["user_id"], [F.desc("ts"), F.col("event_type")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events WHERE event_id <= 5000 GROUP BY user_id, event_type")
def undo_to_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.state_at(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id", 5000)


@query("WITH u AS (SELECT 'n' AS tile_id, CAST(n_nationkey AS BIGINT) AS local_id, n_name AS name FROM nation UNION ALL SELECT 'r', r_regionkey, r_name FROM region) SELECT row_number() OVER (ORDER BY tile_id, local_id) AS id, tile_id, name FROM u")
def merge_union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of many tiles put together and numbered anew."""
    part = lambda name, t, k, n: table(spark, sf_dir, name).select(F.lit(t).alias("tile_id"), F.col(k).cast("long").alias("local_id"), F.col(n).alias("name"))
    both = part("nation", "n", "n_nationkey", "n_name").unionByName(part("region", "r", "r_regionkey", "r_name"), allowMissingColumns=True)
    return numbered(both, ["tile_id", "local_id"], "i").select((F.col("i") + 1).alias("id"), "tile_id", "name")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch still has to predict."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT event_id, event_type FROM events WHERE lower(event_type) NOT IN ('error', 'click') OR event_type IS NULL")
def skip_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes on a skip list go, whatever their case; a null class stays."""
    return table(spark, sf_dir, "events").where(~F.coalesce(F.lower("event_type").isin("error", "click"), F.lit(False))).select("event_id", "event_type")


STEMS = "stems AS (SELECT p_partkey, 'map_r' || lpad(CAST(p_size * 3 AS VARCHAR), 5, '0') || '_c' || lpad(CAST(p_partkey % 40 * 2 AS VARCHAR), 5, '0') AS stem FROM part), cells AS (SELECT DISTINCT CAST(regexp_extract(stem, '_r(\\d+)_c(\\d+)', 1) AS BIGINT) AS r, CAST(regexp_extract(stem, '_r(\\d+)_c(\\d+)', 2) AS BIGINT) AS c FROM stems), grid AS (SELECT r, c, dense_rank() OVER (ORDER BY r) - 1 AS ri, dense_rank() OVER (ORDER BY c) - 1 AS ci FROM cells)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    stem = F.format_string("map_r%05d_c%05d", F.col("p_size") * 3, F.col("p_partkey") % 40 * 2)
    cells = part.select(stem.alias("stem")).select(*[F.regexp_extract("stem", r"_r(\d+)_c(\d+)", k + 1).cast("long").alias(n) for k, n in enumerate("rc")]).distinct()
    rank = lambda n: numbered(cells.select(n).distinct(), [n], f"{n}i")
    return cells.join(rank("r"), "r").join(rank("c"), "c").select("r", "c", "ri", "ci")


@query(f"WITH {STEMS} SELECT r, c, ri, ci FROM grid")
def stem_grid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query(f"WITH {STEMS} SELECT a.ri, a.ci FROM grid a JOIN grid b ON b.ri BETWEEN a.ri - 1 AND a.ri + 1 AND b.ci BETWEEN a.ci - 1 AND a.ci + 1 GROUP BY a.ri, a.ci HAVING count(*) = 9")
def interior_cells_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with all eight neighbours."""
    grid = _grid(spark, sf_dir).select("ri", "ci")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = grid.withColumn("s", F.explode(steps)).select((F.col("ri") + F.col("s.i")).alias("ri"), (F.col("ci") + F.col("s.j")).alias("ci"))
    return around.groupBy("ri", "ci").agg(F.count("*").alias("n")).where("n = 9").join(grid, ["ri", "ci"], "left_semi").select("ri", "ci")


@query("SELECT l_returnflag AS kind, count(*) AS n, sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) * 2 >= count(*) AS lot, round(median(l_quantity), 6) AS median_w, round(sum(l_extendedprice), 1) AS area FROM lineitem GROUP BY l_returnflag")
def lots_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem")
    lot = F.sum((F.col("l_quantity") >= 25).cast("int")) * 2 >= F.count("*")
    return own.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), lot.alias("lot"), F.round(F.median("l_quantity"), 6).alias("median_w"), F.round(F.sum("l_extendedprice"), 1).alias("area"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column, read with a schema."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), "user_id").where("k >= 50")


@query("SELECT doc_id, lang FROM documents WHERE lower(trim(coalesce(source, ''))) IN ('src1', 'src2') OR regexp_matches(coalesce(lang, ''), 'e')")
def name_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact set of names, or a part of one."""
    exact = F.lower(F.trim(F.coalesce("source", F.lit("")))).isin("src1", "src2")
    return table(spark, sf_dir, "documents").where(exact | F.coalesce("lang", F.lit("")).rlike("e")).select("doc_id", "lang")


@query("SELECT 'both' AS side, n_nationkey AS id FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def compare_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"))
    return nation.join(supplier, "id", "left_semi").select(F.lit("both").alias("side"), "id").union(nation.join(supplier, "id", "left_anti").select(F.lit("nation").alias("side"), "id"))


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_id % 4 = 0 UNION ALL SELECT -event_id FROM events WHERE event_id % 3 = 0 AND event_id % 4 <> 0")
def mask_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two masks intersected, and one less the other (its keys negated)."""
    ids = table(spark, sf_dir, "events").select("event_id")
    a, b = ids.where("event_id % 3 = 0"), ids.where("event_id % 4 = 0")
    return a.intersect(b).union(a.exceptAll(b).select((-F.col("event_id")).alias("event_id")))
