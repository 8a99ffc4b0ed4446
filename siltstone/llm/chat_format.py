"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role are merged under one header by array functions; everything is
concatenated to one string:

    ### Role: first text</turn>second text</turn>\n### Other: ...

Inside roles and texts a backslash becomes \\b, < becomes \\l, # becomes \\h,
and in roles a colon becomes \\c.  So the marks ``### ``, ``: `` and ``</turn>``
stand only where the template puts them, and every escape begins with the only
kind of backslash left, which makes reading back exact.

The loss mask is a list of spans (start, length) of the formatted string, in
code points: the texts of assistant turns, without their marks.

Nulls, ties and odd input: a null text or role is empty; a null turn sorts
first; turns that tie are ordered by role and then text, so repeated rows stay
and results do not depend on the order of input; a null conv_id is a
conversation of its own; an empty table gives an empty result.  Work on one
conversation is linear in its length.  A conversation is one row of the result,
so its length is bounded by the size of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MID, END, BREAK = "### ", ": ", "</turn>", "\n"
LOSS_ROLE = "assistant"
#: Lengths are summed in runs of this many, so that sums of prefixes stay linear.
RUN = 256

_TEXT = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE = (*_TEXT, (":", "\\c"))


def escaped(c: Column, table=_TEXT) -> Column:
    for plain, code in table:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, table=_TEXT) -> Column:
    for plain, code in reversed(table):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _prefix_sums(lengths: Column) -> Column:
    """array<long> -> sums of all elements before each one, run by run."""

    def running(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")))["out"]

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    n = F.size(lengths)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / RUN) - 1).cast("int")), lambda k: F.slice(lengths, k * RUN + 1, RUN))
    bases = running(F.transform(runs, total))
    return F.flatten(F.transform(F.arrays_zip(runs.alias("r"), bases.alias("b")), lambda x: F.transform(running(x["r"]), lambda s: s + x["b"])))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, length>>, n_blocks.

    Reads the columns conv_id, turn, role and text; others are ignored."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.withColumn(
        "turns",
        F.transform("turns", lambda t: F.struct(escaped(t["role"], _ROLE).alias("role"), escaped(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss"))),
    )
    # first turn of each run of one role
    chats = chats.withColumn("n", F.size("turns")).withColumn(
        "heads",
        F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])),
    )
    merged = F.transform(
        F.arrays_zip(F.col("heads").alias("a"), F.concat(F.slice("heads", 2, F.size("heads")), F.array("n")).alias("b")),
        lambda x: F.struct(
            F.get("turns", x["a"])["role"].alias("role"),
            F.get("turns", x["a"])["loss"].alias("loss"),
            F.transform(F.slice("turns", x["a"] + 1, x["b"] - x["a"]), lambda t: t["text"]).alias("texts"),
        ),
    )
    chats = chats.withColumn("blocks", merged)
    header = lambda b: F.concat(F.lit(HEAD), b["role"], F.lit(MID))
    block = lambda b: F.concat(header(b), F.array_join(F.transform(b["texts"], lambda t: F.concat(t, F.lit(END))), ""), F.lit(BREAK))
    chats = chats.withColumn("formatted", F.array_join(F.transform("blocks", block), ""))
    # every mark and text as (length, under the mask), whose sums of prefixes place the spans
    parts = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(F.struct(F.length(header(b)).cast("long").alias("len"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t: F.array(
                            F.struct(F.length(t).cast("long").alias("len"), b["loss"].alias("loss")),
                            F.struct(F.lit(len(END)).cast("long").alias("len"), F.lit(False).alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(len(BREAK)).cast("long").alias("len"), F.lit(False).alias("loss"))),
            ),
        )
    )
    chats = chats.withColumn("parts", parts).withColumn("starts", _prefix_sums(F.transform("parts", lambda p: p["len"])))
    spans = F.transform(
        F.filter(F.arrays_zip(F.col("parts").alias("p"), F.col("starts").alias("s")), lambda x: x["p"]["loss"]),
        lambda x: F.struct(x["s"].alias("start"), x["p"]["len"].alias("length")),
    )
    return chats.select("conv_id", "formatted", spans.alias("loss_spans"), F.size("blocks").alias("n_blocks"))


def read_turns(formatted: Column) -> Column:
    """Formatted string -> array<struct<role, text>> of the turns as they were."""
    pieces = F.split(formatted, HEAD)  # nothing stands before the first mark
    heads = F.transform(pieces, lambda p: F.struct(F.substring_index(p, MID, 1).alias("role"), p.alias("piece")))
    bodies = F.transform(
        heads,
        lambda h: F.struct(unescaped(h["role"], _ROLE).alias("role"), F.split(F.substr(h["piece"], F.length(h["role"]) + len(MID) + 1), END).alias("texts")),
    )
    # what follows the last end mark of a piece is the break, or nothing
    turns = lambda b: F.transform(F.slice(b["texts"], 1, F.size(b["texts"]) - 1), lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text")))
    return F.flatten(F.transform(bodies, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped.  The string is first cut at every
    RUN-th span, as finding a place in a string takes time in proportion to it."""
    n = F.size(spans)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / RUN) - 1).cast("int")), lambda k: F.slice(spans, k * RUN + 1, RUN))
    begin = lambda r: F.coalesce(F.get(r, F.lit(0))["start"], F.lit(0))
    end = lambda r: F.coalesce(F.get(r, F.size(r) - 1)["start"] + F.get(r, F.size(r) - 1)["length"], F.lit(0))
    cuts = F.transform(
        runs,
        lambda r: F.struct(begin(r).alias("base"), r.alias("spans"), F.substr(formatted, (begin(r) + 1).cast("int"), (end(r) - begin(r)).cast("int")).alias("text")),
    )
    part = lambda c: F.transform(c["spans"], lambda s: unescaped(F.substr(c["text"], (s["start"] - c["base"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(F.flatten(F.transform(cuts, part)), "")


EXTRA_CONV, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA_CONV, i, role, EXTRA_TEXT) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    chats = format_chats(table.unionByName(extra))
    chats = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t AS (
  SELECT *, row_number() OVER o AS i, coalesce(lag(role) OVER o <> role, true) AS head
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + 7)
   + sum(CASE WHEN head THEN length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + 7 ELSE 0 END))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
