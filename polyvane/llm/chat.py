r"""Chat formatting with a grammar round trip, native.

A turn is rendered ``### role: text </turn>`` and a line break. The parser is deterministic: it splits at ``</turn>`` and
a line break, then reads ``### role: text `` from each piece, and undoes escapes. Each turn is first rendered as it is
and parsed back by itself; only where that doesn't give the same turn, or leaves a control string in it, is it escaped
(``\`` to ``\\``, ``#`` to ``\#``, ``:`` in roles to ``\:``, ``</turn>`` to ``<\/turn>``). No rendered turn then holds a
control string inside, so turns can be joined and parsed back as a whole, which ``round_trip`` confirms.

Defined cases: null text and null role count as empty; turns of a conversation go by (turn, role, text), null turn first;
repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "### ", " </turn>\n", "</turn>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    out = F.replace(out, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(text: Column) -> Column:
    """A backslash stands for the character after it; texts without one are passed over."""
    return F.when(F.instr(text, "\\") > 0, F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def with_masked_text(chats: DataFrame, conv_id: str = "conv_id", keep: tuple[str, ...] = (), name: str = "loss") -> DataFrame:
    """One row per conversation: the id, the columns to keep, and the text of the formatted string that its loss mask covers, read from the string itself and
    unescaped, nothing between the spans.

    The string is cut once at the ends of turns; running lengths tell where each piece stands, and a span, which lies within a turn, is read from the last piece that
    begins at or before it. Spans and pieces are rows, so that the work grows with the length of a conversation and not with its square.
    """
    pieces = F.transform(F.split("formatted", r" </turn>\n"), lambda x, k: F.struct(k.cast("long").alias("k"), x.alias("piece"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("length")))
    spans = F.transform("loss_spans", lambda x: F.struct(F.lit(None).cast("long").alias("k"), F.lit(None).cast("string").alias("piece"), x["start"].cast("long").alias("start"), x["length"].cast("long").alias("length")))
    rows = chats.select(conv_id, *keep, F.explode(F.concat(pieces, spans)).alias("_x")).select(conv_id, *keep, "_x.*")
    sizes = Window.partitionBy(conv_id).orderBy(F.col("k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_at", F.coalesce("start", F.sum(F.length("piece") + len(CLOSE)).over(sizes) - F.length("piece") - len(CLOSE)))
    places = Window.partitionBy(conv_id).orderBy("_at", F.col("k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda x: F.last(x, ignorenulls=True).over(places)
    met = rows.withColumn("_in", last("piece")).withColumn("_from", last(F.when(F.col("k").isNotNull(), F.col("_at"))))
    text = unescape(F.substring(F.concat("_in", F.lit(CLOSE)), (F.col("start") - F.col("_from") + 1).cast("int"), F.col("length").cast("int")))
    whole = met.groupBy(conv_id, *keep).agg(F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", text.alias("text"))))).alias("_texts"))
    return whole.select(conv_id, *keep, F.concat_ws("", F.transform("_texts", lambda x: x["text"])).alias(name))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(": "), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Array of (role, text, raw_text) of a formatted string; raw_text is still escaped."""
    pieces = F.slice(F.split(formatted, r" </turn>\n"), 1, F.greatest(F.lit(0), F.size(F.split(formatted, r" </turn>\n")) - 1))

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, r"(?s)\A### ((?:[^\\:]|\\.)*+): ", 1)
        raw = F.substring(piece, F.length(F.lit(OPEN)) + F.length(role) + 3, F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(raw).alias("text"), raw.alias("raw_text"))

    return F.transform(pieces, turn)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learn: str = "assistant") -> DataFrame:
    """One row per conversation: the id, formatted string, loss_spans (array of start and length in code points, of the texts
    of role ``learn``), turns (parsed back from the formatted string), round_trip.
    """
    rows = turns.select(F.col(conv_id).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    alone = parse(render(F.col("_role"), F.col("_text")))
    plain = (F.size(alone) == 1) & (alone[0]["role"] == F.col("_role")) & (alone[0]["text"] == F.col("_text"))
    held = F.concat(F.col("_role"), F.lit("\n"), F.col("_text"))
    # most turns hold no control character at all; only the others are rendered and parsed by themselves
    suspect = held.rlike(r"[\\]|###|</turn>") | F.col("_role").contains(":")
    clear = ~suspect | (plain & ~F.contains(held, F.lit("###")) & ~F.contains(held, F.lit(END)))
    rows = rows.withColumn("_clear", clear)
    rows = rows.withColumn("_r", F.when(F.col("_clear"), F.col("_role")).otherwise(escape(F.col("_role"), True)))
    rows = rows.withColumn("_t", F.when(F.col("_clear"), F.col("_text")).otherwise(escape(F.col("_text"))))
    rows = rows.withColumn("_out", render(F.col("_r"), F.col("_t")))
    before = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.row_number().over(before)).withColumn("_end", F.sum(F.length("_out")).over(before))
    start = F.col("_end") - F.length(F.lit(CLOSE)) - F.length("_t")
    span = F.when(F.col("_role") == learn, F.struct(start.alias("start"), F.length("_t").cast("long").alias("length")))
    whole = rows.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("_n", "_out", "_role", "_text", span.alias("span")))).alias("_all"))
    whole = whole.select("_conv", F.concat_ws("", F.transform("_all", lambda x: x["_out"])).alias("formatted"),
                         F.filter(F.transform("_all", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
                         F.transform("_all", lambda x: F.struct(x["_role"].alias("role"), x["_text"].alias("text"))).alias("_source"))
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    same = F.transform("turns", lambda x: F.struct(x["role"], x["text"])) == F.col("_source")
    return whole.select(F.col("_conv").alias(conv_id), "formatted", "loss_spans", "turns", same.alias("round_trip"))
