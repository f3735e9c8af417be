"""Chat formatting in budgeted windows, native DataFrame operations only.

A turn is written as ``### role`` newline text newline ``</turn>`` newline. Inside texts every
backslash, ``#`` and ``<`` gets a backslash before it, so an unescaped ``#`` or ``<`` exists in
markers only and the text comes back by removing those backslashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read

END = "\n</turn>\n"
#: Tokens a window may have, and how many of them repeated history may take.
BUDGET = 512
HISTORY = 128
#: One token for so many characters of formatted text.
CHARS_PER_TOKEN = 4

#: The contract's extra conversation.
PROBE_ID = -7
PROBE_TEXT = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<])", "$1")


def _role_out(role: Column) -> Column:
    """Plain roles as they are; any other in hex after ``x-``, which no plain role starts with."""
    plain = F.coalesce(role, F.lit(""))
    return F.when(plain.rlike(r"\A[a-z_]+\z"), plain).otherwise(F.concat(F.lit("x-"), F.hex(F.encode(plain, "UTF-8"))))


def _role_in(role: Column) -> Column:
    return F.when(role.startswith("x-"), F.decode(F.unhex(F.substring(role, 3, 1 << 30)), "UTF-8")).otherwise(role)


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), _role_out(role), F.lit("\n"), escape(F.coalesce(text, F.lit(""))), F.lit(END))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_turns, repeated, formatted, loss_spans): turn-aligned windows.

    conversations has conv_id, turn, role, text. Turns go in order of turn, role, text (nulls first;
    null role and text count as empty, extra columns are ignored). Prefix sums of turn tokens choose the spans: a window starts at
    the first turn not yet written and takes turns while their tokens fit into budget - system - history;
    a longer turn gets a window alone, whole. Every window opens with the conversation's first turn if
    its role is system, then repeats the latest earlier turns whose tokens fit into `history`; `repeated`
    counts both. loss_spans are (start, end) code points in formatted: the escaped text of assistant
    turns the window introduces; repeated turns are masked. Null conv_ids are one conversation. One
    conversation is one row, as its digest asks. An empty table gives an empty result.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(conversations["conv_id"], conversations["turn"], role.alias("role"), text.alias("text"))
    turns = turns.withColumn("out", turn_text(F.col("role"), F.col("text")))
    turns = turns.withColumn("tok", F.ceil(F.length("out") / F.lit(CHARS_PER_TOKEN)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("i", F.row_number().over(order))
    turns = turns.withColumn("before", F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tok"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "out", "tok", "before"))).alias("ts"))
    talks = talks.withColumn("sys", (F.element_at("ts", 1)["role"] == "system").cast("int"))
    talks = talks.withColumn("prefix", F.concat(F.transform("ts", lambda t: t["before"]), F.array(F.element_at("ts", -1)["before"] + F.element_at("ts", -1)["tok"])))
    talks = talks.withColumn("room", budget - history - F.when(F.col("sys") == 1, F.element_at("ts", 1)["tok"]).otherwise(0))
    # The turns (from 1) at which windows start, found in one walk over the prefix sums.
    first = F.array(F.col("sys") + 1)
    after = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: i > F.col("sys") + 1)
    walk = lambda acc, i: F.when(
        F.element_at(F.col("prefix"), i + 1) - F.element_at(F.col("prefix"), F.element_at(acc, -1)) > F.col("room"), F.concat(acc, F.array(i))
    ).otherwise(acc)
    talks = talks.withColumn("starts", F.aggregate(after, first, walk))
    spans = talks.select("*", F.posexplode("starts").alias("window", "start"))
    n = F.size("ts")
    stop = F.when(F.col("window") + 1 < F.size("starts"), F.get("starts", F.col("window") + 1) - 1).otherwise(n)
    spans = spans.withColumn("stop", stop)
    # Repeated history: the turns before start whose tokens up to start fit; never the system turn again.
    fits = lambda i: (i > F.col("sys")) & (F.element_at("prefix", F.col("start")) - F.element_at("prefix", i) <= history)
    back = F.size(F.filter(F.sequence(F.greatest(F.lit(1), F.col("start") - history), F.col("start")), lambda i: (i < F.col("start")) & fits(i)))
    spans = spans.withColumn("back", back)
    picked = F.concat(
        F.slice("ts", 1, F.col("sys")),
        F.slice("ts", F.col("start") - F.col("back"), F.col("back")),
        F.slice("ts", F.col("start"), F.greatest(F.col("stop") - F.col("start") + 1, F.lit(0))),
    )
    # A conversation's first window introduces the system turn; later ones repeat it.
    spans = spans.select(
        "conv_id",
        F.col("window").cast("long").alias("window"),
        F.when(F.col("window") == 0, F.col("back")).otherwise(F.col("back") + F.col("sys")).alias("repeated"),
        picked.alias("ps"),
    )
    ends = F.aggregate(F.transform("ps", lambda p: F.length(p["out"])), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    spans = spans.withColumn("at", ends)
    head = len("### ") + len("\n")
    asked = F.filter(F.sequence(F.lit(1), F.size("ps")), lambda i: (i > F.col("repeated")) & (F.element_at("ps", i)["role"] == "assistant"))
    loss = F.transform(
        F.when(F.size("ps") > 0, asked).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            (F.element_at("at", i) + head + len("assistant")).cast("long").alias("start"),
            (F.element_at("at", i + 1) - len(END)).cast("long").alias("end"),
        ),
    )
    return spans.select(
        "conv_id", "window", F.size("ps").cast("long").alias("n_turns"), F.col("repeated").cast("long").alias("repeated"),
        F.array_join(F.transform("ps", lambda p: p["out"]), "").alias("formatted"), loss.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """array of (role, text) read back from a formatted window."""
    parts = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _role_in(F.substring(p, F.lit(5), F.locate("\n", p) - 5)).alias("role"),
            unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
        ),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, read back from the windows."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    out = windows(rows.unionByName(probe))
    own = out.select(
        "conv_id", "window", F.length("formatted").cast("long").alias("chars"),
        F.slice(parse(F.col("formatted")), F.col("repeated").cast("int") + 1, F.greatest(F.size(parse(F.col("formatted"))), F.lit(1))).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))).alias("loss"),
    )
    talks = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "chars", "turns", "loss"))).alias("ws"))
    turns = F.flatten(F.transform("ws", lambda w: w["turns"]))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.flatten(F.transform("ws", lambda w: w["loss"])), "")
    return talks.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda acc, w: acc + w["chars"]).alias("formatted_chars"),
    )


SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         length(CASE WHEN regexp_full_match(role, '[a-z_]+') THEN role ELSE 'x-' || hex(role) END) + 14
           + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) AS chars FROM c),
p AS (
  SELECT *, ceil(chars / 4.0)::BIGINT AS tok,
         (first_value(role) OVER w = 'system')::BIGINT AS sys,
         CASE WHEN first_value(role) OVER w = 'system' THEN first_value(ceil(chars / 4.0)::BIGINT) OVER w ELSE 0 END AS systok,
         sum(ceil(chars / 4.0)::BIGINT) OVER w AS upto
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
walk AS (
  SELECT conv_id, i, upto - tok AS base, i AS start FROM p WHERE i = sys + 1
  UNION ALL
  SELECT p.conv_id, p.i, CASE WHEN p.upto - w.base > 384 - p.systok THEN p.upto - p.tok ELSE w.base END,
         CASE WHEN p.upto - w.base > 384 - p.systok THEN p.i ELSE w.start END
  FROM walk w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i + 1),
starts AS (SELECT DISTINCT conv_id, start, base FROM walk),
hist AS (
  SELECT s.conv_id, sum(h.chars) AS chars FROM starts s JOIN p h ON h.conv_id IS NOT DISTINCT FROM s.conv_id
    AND h.i < s.start AND h.i > h.sys AND s.base - (h.upto - h.tok) <= 128 GROUP BY s.conv_id),
n AS (SELECT conv_id, greatest(count(*), 1) AS windows FROM starts GROUP BY conv_id),
t AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(chars) AS chars, max(CASE WHEN i = 1 AND role = 'system' THEN chars ELSE 0 END) AS syschars
  FROM o GROUP BY conv_id)
SELECT t.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       (t.chars + (coalesce(windows, 1) - 1) * syschars + coalesce(hist.chars, 0))::BIGINT AS formatted_chars
FROM t LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN hist ON hist.conv_id IS NOT DISTINCT FROM t.conv_id
"""
