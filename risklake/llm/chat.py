r"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that reply under the loss
mask. Turns after the last assistant turn form one more row without a target, so nothing of a conversation is lost and
the conversation's last row reads back to all of it.

Template: `[INST]text[/INST]` for user, `<s>text</s>` for assistant, `[ROLE]role[ROLE]text[/ROLE]` for any other role.
A control string inside a text gets a backslash after its first character, one more than it has (`[INST]` -> `[\INST]`,
`[\INST]` -> `[\\INST]`); taking one away restores the text. No control string holds `[` or `<` after its first
character, so a text and a marker never join into one.

Cases. Null text and null role read as empty. Turns are ordered by turn (null first), then role, then text; rows that
repeat whole are turns of their own. Null conv_id is a conversation of its own. A conversation without an assistant
turn has one row without a target. An empty table gives no rows; other columns are not read. By definition the
examples' total length grows with the square of a conversation's turns; rows are made one by one and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.common import table

CONTROL = r"([\[<])(\\*)(/?(?:INST|ROLE)\]|/?s>)"
ESCAPED = r"([\[<])\\(\\*)(/?(?:INST|ROLE)\]|/?s>)"
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\]"
CONTROLS_TEXT = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def format_turn(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), escape(text), F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), escape(text), F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[ROLE]"), escape(text), F.lit("[/ROLE]")))
    )


def prefix_examples(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, example_no, formatted, loss_start and loss_length (code points from 0;
    null without a target), is_last (the conversation's last row)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    made = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    made = made.select("conv_id", F.struct("turn", "role", "text").alias("key"), format_turn(F.col("role"), F.col("text")).alias("piece"))
    told = made.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("key", "piece"))).alias("told"))
    told = told.select(
        "conv_id",
        F.transform("told", lambda x: x["piece"]).alias("pieces"),
        F.transform("told", lambda x: x["key"]["role"] == "assistant").alias("replies"),
    )
    place = F.sequence(F.lit(1), F.size("pieces"))
    ends = F.filter(place, lambda i: F.get("replies", i - 1) | (i == F.size("pieces")))
    rows = told.select("conv_id", "pieces", "replies", F.posexplode(ends).alias("example_no", "end"))
    target = F.get("replies", F.col("end") - 1)
    rows = rows.select(
        "conv_id",
        "example_no",
        F.array_join(F.slice("pieces", F.lit(1), F.col("end")), "").alias("formatted"),
        F.when(target, F.length(F.get("pieces", F.col("end") - 1)) - 7).alias("loss_length"),
        (F.col("end") == F.size("pieces")).alias("is_last"),
    )
    start = F.when(F.col("loss_length").isNotNull(), F.length("formatted") - 4 - F.col("loss_length"))
    return rows.withColumn("loss_start", start)


def read_turns(formatted: Column) -> Column:
    """The formatted text's turns, as structs of role and text."""

    def turn(piece: Column) -> Column:
        inner = lambda first, last: unescape(F.substring(piece, first + 1, F.length(piece) - first - last))
        rest = F.substring(piece, F.lit(7), F.length(piece) - 13)
        cut = F.locate("[ROLE]", rest)
        other = F.struct(unescape(F.substring(rest, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(rest, cut + 6, F.length(rest))).alias("text"))
        known = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
        return (
            F.when(piece.startswith("[INST]"), known("user", inner(F.lit(6), F.lit(7))))
            .when(piece.startswith("<s>"), known("assistant", inner(F.lit(3), F.lit(4))))
            .otherwise(other)
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    return F.when(length.isNotNull(), unescape(F.substring(formatted, start + 1, length))).otherwise(F.lit(""))


def digests(examples: DataFrame) -> DataFrame:
    """Read the examples back: one row per conversation. Only each example's own reply is shuffled, not its context."""
    turns = F.when(F.col("is_last"), read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    light = examples.withColumn("turns", turns).select(
        "conv_id",
        "example_no",
        F.length("formatted").cast("long").alias("chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        F.col("loss_length").isNotNull().cast("int").alias("target"),
        F.size("turns").cast("long").alias("n"),
        F.sha2(said, 256).alias("sha"),
        "is_last",
    )
    losses = F.sort_array(F.collect_list(F.struct("example_no", "loss")))
    whole = light.groupBy("conv_id").agg(
        F.max(F.when(F.col("is_last"), F.col("n"))).alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(losses, lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.sum("target").alias("n_examples"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROLS_TEXT).alias("text"),
    )
    return digests(prefix_examples(turns.unionByName(planted)))


OP1_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), pieces AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST|ROLE)\]|/?s>)', '\1\\\2\3', 'g'))
      + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
        ELSE 19 + length(regexp_replace(role, '([\[<])(\\*)(/?(?:INST|ROLE)\]|/?s>)', '\1\\\2\3', 'g')) END AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_
), upto AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS formatted FROM pieces
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(formatted) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_examples
FROM upto GROUP BY conv_id
"""
