"""Operator 4: chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped, any other part
becomes a numbered placeholder, and its reference and expanded token count are recorded. Turns are marked by control strings; a backslash
after the first character keeps the same strings inside texts apart, and a backslash in a text is doubled, so the output reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Openings of control strings, of this template and of common tokenizers, that may not stand in a text.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The content of a plain text: one text part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def _body(parts: Column, files_before: Column, is_file) -> Column:
    """The parts in order: runs of text are joined before they are escaped, so that neighbours can't form a control string; a placeholder's number
    counts the attachments of the conversation up to it."""
    state = F.struct(F.lit("").alias("done"), F.lit("").alias("run"), files_before.cast("long").alias("no"))
    placeholder = lambda p, no: F.concat(F.lit("<|"), F.replace(escape(p["type"]), F.lit("|>"), F.lit("|\\>")), F.lit(":"), no.cast("string"), F.lit("|>"))

    def add(t: Column, p: Column) -> Column:
        put = F.struct(F.concat(t["done"], escape(t["run"]), placeholder(p, t["no"] + 1)).alias("done"), F.lit("").alias("run"), (t["no"] + 1).alias("no"))
        return F.when(is_file(p), put).otherwise(F.struct(t["done"].alias("done"), F.concat(t["run"], F.coalesce(p["text"], F.lit(""))).alias("run"), t["no"].alias("no")))

    return F.aggregate(parts, state, add, lambda t: F.concat(t["done"], escape(t["run"])))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv_col, formatted, loss_spans (start and end in code points of each assistant body), attachments (no,
    type, ref, tokens, in order), expanded_tokens (sum of the attachments' tokens).

    Turns stand in order of turn, then role, then content; repeated rows are turns of their own. Null roles, part texts and part types
    (taken as text) count as empty; null or empty parts give an empty body; null tokens count as 0. A null conversation is one
    conversation. An empty table gives an empty result. One shuffle, by conversation; a conversation is one row of output.
    """
    conv = F.col(conv_col).alias("conv")
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    rows = turns.select(conv, F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("parts", F.transform("parts", lambda p: p.withField("type", F.coalesce(p["type"], F.lit("text")))))
    is_file = lambda p: p["type"] != "text"
    rows = rows.withColumn("files", F.filter("parts", is_file))
    order = W.partitionBy("conv").orderBy("turn", "role", "parts")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("files_before", F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)))
    rows = rows.withColumn("body", _body(F.col("parts"), F.col("files_before"), is_file))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = rows.withColumn("piece", F.concat(head, "body", F.lit(END))).withColumn("head_chars", F.char_length(head)).withColumn("body_chars", F.char_length("body"))
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.col("head_chars")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.col("body_chars")).alias("end")))
    files = F.transform("files", lambda p, i: F.struct((F.col("files_before") + i + 1).cast("long").alias("no"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).cast("long").alias("tokens")))
    rows = rows.select("conv", "seq", "piece", span.alias("span"), files.alias("files"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seq", "piece", "span", "files"))).alias("t"))
    out = whole.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda t: t["files"])).alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def _fields(formatted: Column) -> Column:
    """array<struct<role, raw>> of a formatted conversation, as they stand there."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    field = lambda p, k: F.regexp_extract(p, r"(?s)^(.*?)<\|body\|>(.*)<\|end\|>$", k)
    return F.transform(pieces, lambda p: F.struct(field(p, 1).alias("role"), field(p, 2).alias("raw")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, body>> of a formatted conversation, unescaped; placeholders stay in the body as they are (read_parts tells them apart
    from texts that look alike)."""
    return F.transform(_fields(formatted), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["raw"]).alias("body")))


def read_parts(formatted: Column) -> Column:
    """array<struct<role, parts>> of a formatted conversation; parts are array<struct<type, text, no>> in order: texts (neighbouring ones joined, empty
    ones left out), and attachments by their number."""
    cut = lambda raw: F.regexp_extract_all(raw, F.lit(r"(?s)<\|.*?:\d+\|>|(?:(?!<\|).)++"), F.lit(0))
    of = lambda x, k: F.regexp_extract(x, r"(?s)^<\|(.*):(\d+)\|>$", k)
    text = lambda x: F.struct(F.lit("text").alias("type"), unescape(x).alias("text"), F.lit(None).cast("long").alias("no"))
    file = lambda x: F.struct(unescape(of(x, 1)).alias("type"), F.lit(None).cast("string").alias("text"), of(x, 2).cast("long").alias("no"))
    part = lambda x: F.when(F.startswith(x, F.lit("<|")), file(x)).otherwise(text(x))
    return F.transform(_fields(formatted), lambda t: F.struct(unescape(t["role"]).alias("role"), F.transform(cut(t["raw"]), part).alias("parts")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    both = F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(tricky).alias("text")) for n, role in enumerate(("user", "assistant")))))
    planted = spark.range(1).select(both.alias("r")).select("r.*")
    done = format_chats(talk.unionByName(planted).withColumn("parts", text_part(F.col("text"))))
    # What follows reads the formatted text back.
    read = done.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    out = f"replace({x}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum({len(TURN) + len(BODY) + len(END)} + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""
