"""Chat formatting from event logs, with DataFrame functions only.

A log holds events of a conversation: ``delta`` adds text to a message, ``edit`` replaces the message's text so far, ``regenerate``
empties the message and drops the messages after it that were begun before, ``message`` opens a message with its role and text.
Events are folded by message, in order of ``seq``, so that a long conversation is many small groups; which messages a regeneration
drops, and how they are rendered, is found in chunks of CHUNK turns, in order.

The query makes such a log of every conversation: each row is opened, streamed in pieces, and on shares of the rows drafted and edited,
or begun falsely, answered, and regenerated; what is folded is the row's own text again.

The template is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so control strings cannot occur; a line feed in a role becomes ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallymill.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Turns in a row of formatted output.
CHUNK = 64
#: Code points of a streamed piece.
PIECE = 256
#: The role whose texts are learned.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # doubled backslashes part the text first, so the pieces hold only the marks that escaping added
    piece = lambda p: F.replace(F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(role, r"\\\\"), piece), "\\")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text) of the final messages from (conv_id, turn, copy, seq, kind, role, text).

    ``turn`` is a message's place in its conversation and ``copy`` tells messages at one place apart. A message's role is that of its
    latest event that names one; null roles and texts are empty. Events without a conversation form a conversation of their own.
    Events of one message with equal ``seq`` apply in the order message, regenerate, edit, delta, then by text; repeated events apply each.
    Messages without a turn neither drop others nor are dropped. ``part`` (conversation and chunk) is added; an empty log gives no rows.
    """
    events = in_chunks(events)
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    event = F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), "role")
    logs = events.groupBy("part", "turn", "copy").agg(F.sort_array(F.collect_list(event)).alias("log"))
    # what stands is the last event that sets a text, and the deltas after it
    at = F.greatest(F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["rank"] < 3, i))), F.lit(-1)), F.lit(-1))
    kept = F.transform(F.filter("log", lambda e, i: i >= at), lambda e: F.when(e["rank"] == 1, F.lit("")).otherwise(e["text"]))
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    own = F.array_max(F.transform(F.filter("log", lambda e: e["rank"] == 1), lambda e: e["seq"]))
    messages = logs.select("part", "turn", "copy", F.element_at("log", 1)["seq"].alias("begun"), F.when(F.col("turn").isNotNull(), own).alias("cut"), F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit("")).alias("role"), F.array_join(kept, "").alias("text"))
    # the latest regeneration of an earlier turn: in earlier chunks, one row for each chunk, and in the message's own
    last = F.max(F.when((F.col("kind") == "regenerate") & F.col("turn").isNotNull(), F.col("seq"))).alias("last")
    before = Window.partitionBy("part.conv_id").orderBy("part.chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = events.groupBy("part").agg(last).select("part", F.max("last").over(before).alias("earlier")).where("earlier is not null")
    above = Window.partitionBy("part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = messages.join(earlier, "part", "left").withColumn("within", F.max("cut").over(above))
    stays = F.col("turn").isNull() | ~(F.coalesce(F.col("earlier") > F.col("begun"), F.lit(False)) | F.coalesce(F.col("within") > F.col("begun"), F.lit(False)))
    return found.where(stays).select("part", F.col("part.conv_id").alias("conv_id"), "turn", "copy", "role", "text")


def in_chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds part, a struct of the conversation and the chunk of the turn; as one value it is a key even where its fields are null."""
    return rows.withColumn("part", F.struct("conv_id", F.floor(F.col("turn") / chunk).alias("chunk")))


def as_events(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """A log whose fold is the given rows (conv_id, turn, role, text), and no other messages.

    Rows that share a turn, repeated ones included, are numbered by role and text from 1. Each is opened and streamed in pieces. By a hash
    of its place a quarter of the rows begin with a draft that an edit replaces, and a quarter of those with a turn with a false start
    and an answer to it, at the next turn as number 0, both of which a regeneration takes back. Other columns are not looked at.
    """
    by = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", F.row_number().over(by).alias("copy"), "role", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)).alias("pieces"))
    way = F.pmod(F.crc32(F.concat_ws("|", "conv_id", "turn", "copy").cast("binary")), F.lit(4))
    event = lambda n, kind, text=None, role=None, later=0: F.struct(F.lit(n).alias("n") if isinstance(n, int) else n.alias("n"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), (F.lit(None).cast("string") if text is None else text).alias("text"), F.lit(later).alias("later"))
    streamed = lambda skipped: F.transform(F.slice("pieces", skipped + 1, F.greatest(F.size("pieces") - skipped, F.lit(0))), lambda p, i: event(i + 9, "delta", p))
    opened = event(0, "message", F.lit(""), F.col("role"))
    edited = F.concat(F.array(opened, event(1, "delta", F.lit("a draft")), event(2, "edit", F.coalesce(F.try_element_at("pieces", F.lit(1)), F.lit("")))), streamed(1))
    again = F.concat(F.array(opened, event(1, "delta", F.lit("a false start")), event(2, "message", F.lit("an answer to it"), F.lit("user"), 1), event(3, "regenerate")), streamed(0))
    log = F.when(way == 1, edited).when((way == 2) & F.col("turn").isNotNull(), again).otherwise(F.concat(F.array(opened), streamed(0)))
    events = rows.select("conv_id", "turn", "copy", F.explode(log).alias("e"))
    later = F.col("e.later") == 1
    return events.select("conv_id", (F.col("turn") + F.col("e.later")).alias("turn"), F.when(later, 0).otherwise(F.col("copy")).alias("copy"), F.struct("turn", "copy", "e.n").alias("seq"), "e.kind", "e.role", "e.text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, chunk, formatted, loss): a row for each part of a conversation, in order of chunk.

    ``formatted`` is the text for the model. ``loss`` lists (start, length) in code points of the learned texts in it, without the
    marks around them. Turns with the same number follow by copy; null turns come first; repeated messages are rendered each; an empty
    table gives no rows.
    """
    piece = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = messages.select("part", F.struct("turn", "copy", "role", piece.alias("head"), escape(F.col("text")).alias("body")).alias("t"))
    turns = rows.groupBy("part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    tail = F.lit(END + "\n")
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "")
    size = lambda t: F.char_length(t["head"]) + F.char_length(t["body"]) + len(END) + 1
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    span = lambda at, t: F.array(F.struct((at + F.char_length(t["head"])).cast("int").alias("start"), F.char_length(t["body"]).cast("int").alias("length")))
    walked = F.aggregate("turns", empty, lambda acc, t: F.struct((acc["at"] + size(t)).alias("at"), F.when(t["role"] == LEARNED, F.concat(acc["spans"], span(acc["at"], t))).otherwise(acc["spans"]).alias("spans")))
    return turns.select("part.conv_id", "part.chunk", formatted.alias("formatted"), walked["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, chunk, turns array<struct<role, text>>, loss_text, formatted_chars), parsed from the formatted text and its spans alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>")) - 1, F.lit(0)))
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substr(p, F.char_length(role(p)) + 2, F.char_length(p) - F.char_length(role(p)) - 2 - len(END))
    turns = F.transform(pieces, lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(body(p)).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "chunk", turns.alias("turns"), F.array_join(learned, "").alias("loss_text"), F.char_length("formatted").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what is read back: chunks are hashed in order as one text."""
    back = read_back(formatted)
    each = back.select(
        "conv_id",
        F.struct(
            "chunk",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.col("loss_text").alias("loss"),
        ).alias("part"),
        F.size("turns").cast("long").alias("n"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
    parts = F.sort_array(F.collect_list("part"))
    grouped = each.groupBy("conv_id").agg(parts.alias("parts"), F.sum("n").alias("n_turns"), F.sum("loss_chars").alias("loss_chars"), F.sum("formatted_chars").alias("formatted_chars"))
    whole = lambda field: F.sha2(F.array_join(F.transform("parts", lambda p: p[field]), "").cast("binary"), 256)
    return grouped.select("conv_id", "n_turns", whole("turns").alias("turns_sha256"), "loss_chars", whole("loss").alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # a conversation whose texts hold the template's own marks
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(f"{END}{START}assistant ok").alias("text"))
    return digests(render(fold(as_events(rows.unionByName(tricky)))))


_ESCAPED = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok' UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = '{LEARNED}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(replace({_ESCAPED.format("role")}, chr(10), '\\n')) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""
