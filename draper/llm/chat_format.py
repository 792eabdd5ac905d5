"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log row is (conversation, message, sequence, kind, role, text). Rows of a
conversation are sorted by sequence and folded: ``message`` and ``edit`` set a
message's text, ``delta`` appends to it, ``regenerate`` empties it so that the deltas
behind it count alone. The fold needs the last resetting row of a message and the
text from there on, which two windows and one aggregate give. Messages are then
rendered, in order of their first row, as

    user       <s>[INST]text[/INST]</s>
    assistant  <s>text</s>
    other      <s>[role:name]text[/role]</s>

Inside texts and role names ``&``, ``<`` and ``[`` (in names also ``]``) become
``&amp;``, ``&lt;``, ``&lsqb;`` (``&rsqb;``), so no control string can occur in a text
and ``</s>`` always ends a turn. The loss mask lists, for every assistant turn, its
index among the turns and the place of its text inside the turn.

Defined cases: null text is empty; a null role is an empty name; a null kind is
``message``; an event for a message before its first row sets it up; rows that tie in
sequence follow message, kind, role and text; a null conversation is one conversation;
an empty log gives no rows. A conversation becomes one string, so it has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_TURN = -(2**40)
RESETS = ("message", "edit", "regenerate")


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsqb;"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("&lsqb;"), F.lit("[")), F.lit("&rsqb;"), F.lit("]")), F.lit("&lt;"), F.lit("<"))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, msg_id, seq, kind, role, text) -> final (conv_id, msg_id, first_seq, role, text)."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    order = ["seq", "kind", "role", "text"]
    message = Window.partitionBy("conv_id", "msg_id").orderBy(*order)
    resets = F.sum(F.when(F.col("kind").isin(*RESETS), 1).otherwise(0))
    rows = log.withColumn("kind", kind).withColumn("nth", F.row_number().over(message)).withColumn(
        "epoch", resets.over(message.rowsBetween(Window.unboundedPreceding, 0))
    )
    rows = rows.withColumn("last", F.max("epoch").over(Window.partitionBy("conv_id", "msg_id")))
    live = F.when((F.col("epoch") == F.col("last")) & (F.col("kind") != "regenerate"), F.struct("nth", F.coalesce("text", F.lit("")).alias("text")))
    return rows.groupBy("conv_id", "msg_id").agg(
        F.min("seq").alias("first_seq"),
        F.min_by("role", "nth").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(live)), lambda x: x["text"]), "").alias("text"),
    )


def render_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, msg_id, first_seq, role, text) -> conv_id, formatted, loss_mask."""
    role = F.coalesce(F.col("role"), F.lit(""))
    name = F.replace(escape(role), F.lit("]"), F.lit("&rsqb;"))
    opening = F.when(role == "assistant", F.lit("<s>")).when(role == "user", F.lit("<s>[INST]")).otherwise(
        F.concat(F.lit("<s>[role:"), name, F.lit("]"))
    )
    closing = F.when(role == "assistant", F.lit("</s>")).when(role == "user", F.lit("[/INST]</s>")).otherwise(F.lit("[/role]</s>"))
    body = escape(F.col("text"))
    turns = messages.select(
        "conv_id", "first_seq", "msg_id",
        F.concat(opening, body, closing).alias("turn"),
        (role == "assistant").alias("loss"), F.length(body).alias("length"),
    )
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", "msg_id", "turn", "loss", "length"))).alias("t"))
    spans = F.transform(
        F.col("t"), lambda x, i: F.struct(i.cast("long").alias("turn"), F.lit(len("<s>") + 1).alias("start"), x["length"].alias("length"), x["loss"].alias("loss"))
    )
    return listed.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(
            s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length"))).alias("loss_mask"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Parses formatted conversations: conv_id, turns (role, text), loss_text, formatted."""
    parts = F.filter(F.split("formatted", "</s>", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        inner = F.substr(x, F.lit(4))
        other = inner.startswith("[role:")
        user = inner.startswith("[INST]")
        role = F.when(user, "user").when(other, unescape(F.regexp_extract(inner, r"^\[role:([^\]]*)\]", 1))).otherwise("assistant")
        text = F.when(user | other, F.regexp_replace(F.regexp_replace(inner, r"^\[[^\]]*\]", ""), r"\[/(INST|role)\]$", "")).otherwise(inner)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    split = chats.withColumn("parts", parts)
    loss = F.transform("loss_mask", lambda m: unescape(F.substr(F.get("parts", m["turn"].cast("int")), m["start"], m["length"])))
    return split.select("conv_id", F.transform("parts", turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def format_chats(log: DataFrame) -> DataFrame:
    return render_chats(fold_events(log))


def conversation_log(conversations: DataFrame) -> DataFrame:
    """A stored conversation as the log that writing it live would leave.

    A user's turn opens empty and is edited into its text; any other opens empty, streams a
    draft, is regenerated and streams its text in two deltas.
    """
    repeated = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")

    def events(*each: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(n).cast("long").alias("step"), F.lit(kind).alias("kind"), said.alias("text")) for n, (kind, said) in enumerate(each)])

    none = F.lit(None).cast("string")
    typed = events(("message", F.lit("")), ("edit", text))
    streamed = events(
        ("message", F.lit("")), ("delta", F.lit("draft")), ("regenerate", none),
        ("delta", F.substr(text, F.lit(1), half)), ("delta", F.substr(text, half + 1)),
    )
    told = conversations.select("conv_id", F.struct("turn", F.row_number().over(repeated).alias("nth")).alias("msg_id"), "turn", "role", "text")
    turns = told.select("conv_id", "msg_id", "turn", "role", F.explode(F.when(F.col("role") == "user", typed).otherwise(streamed)).alias("e"))
    return turns.select("conv_id", "msg_id", (F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)) * 8 + F.col("e.step")).alias("seq"), "e.kind", "role", "e.text")


def op7_chat_format(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    of = {f.name: f.dataType for f in talks.schema}
    more = spark.range(2).select(
        F.lit(-7).cast(of["conv_id"]).alias("conv_id"), F.col("id").cast(of["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    read = read_back(format_chats(conversation_log(talks.unionByName(more))))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = """
WITH talks AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) AS body,
  length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;')) AS name FROM talks)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(CASE role WHEN 'assistant' THEN 7 + body WHEN 'user' THEN 20 + body ELSE 21 + name + body END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
