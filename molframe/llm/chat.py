"""Chat formatting by a grammar round trip, in SQL functions only.

A turn is written between the markers of its role. The written text is read again by a deterministic parser; where
the turns read differ from the source, the conversation's conflicting content is escaped, and the result must read back
identically (else the query fails). A control string gets one `~` after its first character, one that already has some gets
one more, so escaping is reversible and no control string is left inside a text.

Defined results: a null text or role is empty; turns are ordered by turn, then role, then text, repeated rows stay;
a null conv_id is one conversation; an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.session import table

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE:", ">>", "<</ROLE>>")
_TAILS = r"(/?s>|/?INST\]|</?SYS>>|<ROLE:|</ROLE>>)"
_TURN = r"<<SYS>>[\s\S]*?<</SYS>>|\[INST\][\s\S]*?\[/INST\]|<s>[\s\S]*?</s>|<<ROLE:[0-9A-F]*>>[\s\S]*?<</ROLE>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + _TAILS, "$1~$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + _TAILS, "$1$2$3")


def rendered(turns: Column, change) -> Column:
    """The turns as strings, each between its role's markers."""

    def one(turn: Column) -> Column:
        text = change(turn["text"])
        out = F.concat(F.lit(OTHER[0]), F.hex(F.encode(turn["role"], "UTF-8")), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
        for role, (start, end) in MARKS.items():
            out = F.when(turn["role"] == role, F.concat(F.lit(start), text, F.lit(end))).otherwise(out)
        return out

    return F.transform(turns, one)


def parsed(written: Column) -> Column:
    """Array of (role, text, raw, start): start is where the text begins, relative to its turn."""

    def one(turn: Column) -> Column:
        head = F.instr(turn, OTHER[1]) + len(OTHER[1])
        body = lambda start, end: F.substring(turn, start, F.length(turn) - start - F.lit(len(end)) + 1)
        make = lambda role, start, end: F.struct(role.alias("role"), unescaped(body(start, end)).alias("text"), turn.alias("raw"), (start - 1).alias("start"), (F.length(turn) - start - F.lit(len(end)) + 1).alias("chars"))
        role = F.decode(F.unhex(F.substring(turn, F.lit(len(OTHER[0]) + 1), head - len(OTHER[0]) - len(OTHER[1]) - 1)), "UTF-8")
        out = make(role, head, OTHER[2])
        for name, (start, end) in MARKS.items():
            out = F.when(F.startswith(turn, F.lit(start)), make(F.lit(name), F.lit(len(start) + 1), end)).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(written, F.lit(_TURN), F.lit(0)), one)


def _same(turns: Column, read: Column, written: Column) -> Column:
    plain = F.transform(read, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return (plain == turns) & (F.concat_ws("", F.transform(read, lambda t: t["raw"])) == written)


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, turns array<role, text> read back, loss_spans array<start, chars> of the assistant's texts in formatted, loss_text unescaped, was_escaped)."""
    nothing = F.lit("")
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), nothing).alias("role"), F.coalesce(F.col(text_col), nothing).alias("text"))
    convs = df.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    convs = convs.select("id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    convs = convs.withColumn("raw", F.concat_ws("", rendered(F.col("turns"), lambda t: t)))
    convs = convs.withColumn("was_escaped", ~_same(F.col("turns"), parsed(F.col("raw")), F.col("raw")))
    convs = convs.withColumn("formatted", F.when(F.col("was_escaped"), F.concat_ws("", rendered(F.col("turns"), escaped))).otherwise(F.col("raw")))
    convs = convs.withColumn("read", parsed(F.col("formatted")))
    convs = convs.withColumn("read", F.when(_same(F.col("turns"), F.col("read"), F.col("formatted")), F.col("read")).otherwise(F.raise_error(F.lit("a formatted conversation does not read back"))))
    ends = F.aggregate("read", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t["raw"]))))
    spans = F.zip_with("read", "ends", lambda t, at: F.when(t["role"] == "assistant", F.struct((at + t["start"]).alias("start"), t["chars"].alias("chars"))))
    return convs.withColumn("ends", ends).select(
        F.col("id").alias(id_col),
        "formatted",
        F.transform("read", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"),
        "was_escaped",
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["chars"]))))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql(f"SELECT -7L AS conv_id, CAST(turn AS long) AS turn, role, '{odd}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"))
    out = format_chats(rows).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
esc AS (
  SELECT *, regexp_replace(text, '([<\[])(~*)(/?s>|/?INST\]|</?SYS>>|<ROLE:|</ROLE>>)', '\1~\2\3', 'g') AS safe,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
              ELSE 18 + 2 * octet_length(encode(role)) END AS marks
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(safe) + marks) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""
