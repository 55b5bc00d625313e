"""Chat formatting in budgeted windows (DataFrame functions only).

Prefix sums of a conversation's turn tokens choose turn-aligned spans. Every
window opens with the system turns that head the conversation (within half the budget), repeats as much
of the turns before its span as a history budget holds, and then has its span.
The loss mask covers the assistant texts of the span alone: targets that are
repeated as history are masked out, so each is learnt once.

A turn is written ``<turn role>\\ntext</turn>\\n``. In roles and texts the
characters of the template are escaped: ``\\`` as ``\\s``, ``<`` as ``\\l``, and
in roles ``>`` as ``\\g`` and a line break as ``\\n``. No text can hold a control
string then, and unescaping gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Tokens in a window, and of them for repeated history.
BUDGET, HISTORY = 1024, 256
#: Tokens of the template in each turn.
TURN_TOKENS = 4
#: Turns after which a window is cut in any case.
CHAPTER = 1024


def count_tokens(text: Column) -> Column:
    """Pieces that a word tokenizer would at least make: runs of letters, digits, and other marks."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The opposite of escape: an escaped backslash is put back last, when no other escape is left."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n")))


def _numbered(turns: DataFrame, budget: int, history: int, tokens) -> DataFrame:
    """The turns with their places and prefix sums: conv_id, role, text, at, head, heads, head_tokens, start, end, from, from_start."""
    clean = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    clean = clean.withColumn("tokens", (tokens(F.col("text")) + TURN_TOKENS).cast("long"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = clean.withColumn("at", F.row_number().over(ordered) - 1).withColumn("sum", F.sum("tokens").over(so_far)).withColumn("system", F.min(F.col("role") == "system").over(so_far))
    out = out.withColumn("head", F.col("system") & ((F.col("sum") <= budget // 2) | (F.col("at") == 0)))
    # Heads come first, so that these sums are whole at every later turn.
    out = out.withColumn("heads", F.sum(F.col("head").cast("int")).over(so_far)).withColumn("head_tokens", F.sum(F.when(F.col("head"), F.col("tokens")).otherwise(0)).over(so_far))
    # Prefix sums leave out the heads, which every window repeats.
    out = out.withColumn("end", F.col("sum") - F.col("head_tokens")).withColumn("start", F.when(F.col("head"), F.col("end")).otherwise(F.col("end") - F.col("tokens")))
    # The first turn whose distance to this one fits into the history.
    near = Window.partitionBy("conv_id").orderBy("start").rangeBetween(-history, Window.currentRow)
    for name, value in (("from", "at"), ("from_start", "start")):
        out = out.withColumn(name, F.min(F.when(~F.col("head"), F.col(value))).over(near))
    return out.drop("turn", "tokens", "sum", "system")


def _spans(numbered: DataFrame, budget: int, chapter: int) -> DataFrame:
    """(conv_id, window, first_turn, from, next, heads) by greedy cuts over the prefix sums.

    A window is cut before the first turn that would pass the budget, and at every
    ``chapter`` turns, so that no more than so many sums are ever gathered.
    """
    slim = numbered.groupBy("conv_id", F.floor(F.col("at") / chapter).alias("chapter")).agg(
        F.array_sort(F.collect_list(F.struct("at", "start", "end", "from", "from_start", "heads", "head_tokens"))).alias("turns"), (F.max("at") + 1).alias("n")
    )
    fits = lambda t, base: t["end"] - base + t["head_tokens"] <= budget
    # History that leaves no room for the turn itself is left out.
    back = lambda t: (t["at"] > t["heads"]) & fits(t, t["from_start"])
    cut_at = lambda t: F.struct(t["at"].alias("at"), F.when(back(t), t["from"]).otherwise(t["at"]).alias("from"), t["heads"].alias("heads"))
    base = lambda t: F.when(back(t), t["from_start"]).otherwise(t["start"])
    goes_on = lambda acc, t: ((t["at"] > 0) & (t["at"] <= t["heads"])) | ((F.size(acc["cuts"]) > 0) & fits(t, acc["base"]))
    cuts = F.aggregate(
        "turns",
        F.struct(F.array().cast("array<struct<at:int,from:int,heads:bigint>>").alias("cuts"), F.lit(0).cast("long").alias("base")),
        lambda acc, t: F.when(goes_on(acc, t), acc).otherwise(F.struct(F.array_append(acc["cuts"], cut_at(t)).alias("cuts"), base(t).alias("base"))),
        lambda acc: acc["cuts"],
    )
    each = slim.select("conv_id", "n", F.explode(cuts).alias("cut")).select("conv_id", F.col("cut.at").alias("first_turn"), "cut.from", F.when(F.col("cut.at") == 0, 0).otherwise(F.col("cut.heads")).cast("int").alias("heads"), "n")
    whole, ordered = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("first_turn")
    following = F.coalesce(F.lead("first_turn").over(ordered), F.max("n").over(whole))
    return each.withColumn("next", following).withColumn("window", F.row_number().over(ordered) - 1).drop("n")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=count_tokens, chapter: int = CHAPTER) -> DataFrame:
    """(conv_id, window, first_turn, n_context, text, loss): the windows of every conversation.

    ``turns``: conv_id, turn, role, text; other columns are ignored. ``first_turn`` is
    the place (from 0) of the span's first turn, ``n_context`` the number of repeated
    turns that stand before the span, ``loss`` the [start, end) of each target in
    code points of ``text``. Repeated are the system turns that head the conversation,
    as far as they take half the budget (the first one always), and then the history.
    A span holds one turn at least: the window of a turn that is larger than the budget
    exceeds it. Turns come in the order of (turn, role, text), nulls first, and repeated
    rows are turns like others; null roles and texts are empty; null conv_ids are one
    conversation. No rows: no rows. Turns stay rows: they meet their windows by place,
    and only the texts of one window are ever gathered.
    """
    numbered = cut(_numbered(turns, budget, history, tokens))
    spans = _spans(numbered, budget, chapter)
    up_to = lambda a, b: F.when(F.col(a) < F.col(b), F.sequence(F.col(a), F.col(b) - 1)).otherwise(F.array().cast("array<int>"))
    places = F.concat(up_to("zero", "heads"), up_to("from", "next"))
    members = spans.withColumn("zero", F.lit(0)).select(F.col("conv_id").alias("conv"), "window", "first_turn", F.explode(places).alias("place"))
    met = members.join(numbered.select("conv_id", "at", "role", "text"), F.col("conv").eqNullSafe(F.col("conv_id")) & (F.col("place") == F.col("at")))
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    written = F.concat(F.lit("<turn "), role, F.lit(">\n"), text, F.lit("</turn>\n"))
    part = F.struct("at", written.alias("w"), (F.length(role) + 8).alias("skip"), F.length(text).alias("size"), ((F.col("role") == "assistant") & (F.col("at") >= F.col("first_turn"))).alias("target"))
    each = met.groupBy("conv_id", "window", "first_turn").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum((F.col("at") < F.col("first_turn")).cast("int")).cast("int").alias("n_context"))
    # A running length gives the places of targets in the window.
    loss = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda acc, p: F.struct((acc["at"] + F.length(p["w"])).alias("at"), F.when(p["target"], F.array_append(acc["loss"], F.struct((acc["at"] + p["skip"]).alias("start"), (acc["at"] + p["skip"] + p["size"]).alias("end")))).otherwise(acc["loss"]).alias("loss")),
        lambda acc: acc["loss"],
    )
    return each.select("conv_id", "window", "first_turn", "n_context", F.array_join("parts.w", "").alias("text"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) from the text, context size and loss mask of windows alone.

    Gathers each conversation, as a digest of all its turns needs. Null conv_ids are one
    conversation; empty texts come back as empty, where nulls were too. No rows: no rows.
    """
    pattern = F.lit(r"<turn ([^>]*)>\n([^<]*)</turn>\n")
    roles, texts = F.regexp_extract_all("text", pattern, F.lit(1)), F.regexp_extract_all("text", pattern, F.lit(2))
    turns = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    learnt = F.transform("loss", lambda x: unescape(F.substring("text", x["start"] + 1, x["end"] - x["start"])))
    parsed = formatted.withColumn("all", turns).select("conv_id", "window", F.slice("all", F.col("n_context") + 1, F.size("all")).alias("turns"), F.array_join(learnt, "").alias("learnt"), F.length("text").cast("long").alias("chars"))
    in_order = F.array_sort(F.collect_list(F.struct("window", "turns", "learnt")))
    whole = parsed.groupBy("conv_id").agg(in_order.alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten("w.turns").alias("turns"), F.array_join("w.learnt", "").alias("loss_text"), "formatted_chars")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_back(windows(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


QUERIES = {"op2_chat_format": op2_chat_format}
#: The length of the formatted text follows from the windows, which SQL of this size does not choose; see the tests.
ORACLES: dict[str, str] = {}
