"""Chat formatting from an event log.

Events. A row is (conversation, sequence, message, kind, role, text). A conversation's events are
put in order of their sequence and folded: ``message`` sets a message's role and text, ``delta``
adds to its text, ``edit`` replaces the text, ``regenerate`` empties it for the deltas that follow
and ``delete`` removes it: what comes after a ``delete`` is ignored until a ``message`` event makes the message
anew. Events of other kinds change nothing, and a message that no event but such has named is none.
Messages stand in the order of their first event. A later ``message`` event of the same message
replaces it. Role: the last one that isn't null.

Template. A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>\\n``. Control strings inside roles and
texts (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first
character, and a backslash is doubled; so no control string can be forged, and reading the output
back gives the very texts.

Loss mask. For each assistant turn the code points [start, end) of its escaped text.

Everything is DataFrame functions: one shuffle by conversation. A conversation is one row of the
result by its nature; whatever their number, none gathers with another.

A table of whole turns becomes such a log by ``turns_as_events``: as a service would have written it, with
drafts, streamed portions, edits and regenerations, all of which fold to the very turns.

Edge cases: null texts and roles are empty; equal sequence numbers are ordered by kind, message, role and
text; an event whose message is null is a message of its own; repeated rows of a table of turns are turns
of their own; turns of equal number stand in the order of role and text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, r"<(?=\||/?s>)", r"<\\"), r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


EVENT = "struct<seq:bigint,message:string,kind:string,role:string,text:string>"


def turns_as_events(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """A table of whole turns as the log of a chat service.

    Answers are streamed in two portions after a first attempt that is regenerated; what others say is sent
    with a slip and edited. One shuffle deals whole conversations out, and folding them needs no other.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.select("conv_id", "role", "text", place.alias("place"))
    none, half = F.lit(None).cast("string"), F.floor(F.length("text") / 2).cast("int")
    event = lambda step, kind, role, text: F.struct((8 * F.col("place") + step).alias("seq"), F.col("place").cast("string").alias("message"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    begin, end = F.substring("text", F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    answer = [event(0, "message", F.col("role"), F.lit("")), event(1, "delta", none, F.substring("text", 1, 8)), event(2, "regenerate", none, none), event(3, "delta", none, begin), event(4, "delta", none, end)]
    other = [event(0, "message", F.col("role"), F.concat(F.substring("text", 1, 8), F.lit("?"))), event(1, "edit", none, F.col("text"))]
    return rows.select("conv_id", F.inline(F.when(F.col("role") == learn, F.array(*answer)).otherwise(F.array(*other)).cast(f"array<{EVENT}>")))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) of the conversations that have messages."""
    e = events.select("conv_id", F.col("seq").cast("long").alias("seq"), "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    own = F.concat_ws("|", F.col("seq").cast("string"), "kind", F.coalesce("role", F.lit("")), "text")
    e = e.withColumn("name", F.coalesce(F.concat(F.lit("m"), F.col("message")), F.concat(F.lit("l"), own)))
    row = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("r"), "text", "role")
    named = e.groupBy("conv_id", "name").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    zero = F.struct(F.lit("").alias("role"), F.lit("").alias("text"), F.lit("new").alias("state"))

    def step(a: Column, x: Column) -> Column:
        kind, gone = x["kind"], a["state"] == "gone"
        known = kind.isin("message", "delta", "edit", "regenerate", "delete")
        counts = known & (~gone | (kind == "message"))
        text = F.when(kind == "delta", F.concat(a["text"], x["text"])).when(kind.isin("message", "edit"), x["text"]).otherwise(F.lit(""))
        return F.struct(
            F.when(counts, F.coalesce(x["role"], a["role"])).otherwise(a["role"]).alias("role"), F.when(counts, text).otherwise(a["text"]).alias("text"),
            F.when(counts, F.when(kind == "delete", "gone").otherwise("live")).otherwise(a["state"]).alias("state"),
        )

    # lone events that are equal are as many messages; others of one name fold to one
    lone = F.startswith("name", F.lit("l"))
    one = F.array(F.aggregate("rows", zero, step))
    each = F.transform("rows", lambda x: step(zero, x))
    named = named.select("conv_id", F.col("rows")[0]["seq"].alias("seq"), "name", F.when(lone, each).otherwise(one).alias("x"))
    turns = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name", "x"))), lambda m: F.filter(m["x"], lambda y: y["state"] == "live")))
    both = named.groupBy("conv_id").agg(turns.alias("turns")).where(F.size("turns") > 0)
    return both.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(folded: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, end>>): the text and the code points that are learnt."""
    shown = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("learn")))
    d = folded.select("conv_id", shown.alias("t"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        return F.struct((end + len(END)).alias("at"), F.when(t["learn"], F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["spans"]).alias("spans"))

    text = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return d.select("conv_id", text.alias("formatted"), F.aggregate("t", zero, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars) read from the formatted text and the mask alone."""
    parts = F.split(F.col("formatted"), r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(START) + 1), F.length(p))
        return F.struct(unescape(F.substring_index(body, SEP, 1)).alias("role"), unescape(F.substring_index(body, SEP, -1)).alias("text"))

    learnt = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", F.transform(parts, turn).alias("turns"), learnt.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))
