"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns up to it as context, and only its reply trainable.
A conversation whose last turn is not an assistant's gives one more example with nothing trainable, so that
no turn is lost. A turn is written as

    <|im_start|>ROLE newline TEXT<|im_end|> newline

Control strings inside roles and texts are escaped reversibly: a backslash becomes `\\s`, `<|` becomes `<\\p`, and in
roles a line feed becomes `\\n`; every backslash in the output so begins an escape of two characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chats(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> examples.

    One row an example: conv_id, example long (0, 1, ... in a conversation), n_turns long, formatted string,
    loss_start long and loss_length long (code points of `formatted` that train; length 0 and start null where nothing
    does), complete boolean (it holds the whole conversation).

    Rows of a conversation are ordered by turn (nulls first), then role and text; repeated rows are all kept. A null
    role or text counts as empty. Rows with a null conv_id are one conversation. Other columns are ignored. An empty
    table gives no rows. A conversation is one string in the output, so it has to fit in a row; examples
    of a conversation are cut from that string one at a time and never gathered.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    flat = turns.select("conv_id", F.col("turn").alias("t"), role.alias("r"), text.alias("x"))
    flat = flat.withColumn("loss_length", F.char_length(escape(F.col("x"))).cast("long")).withColumn(
        "piece", F.concat(F.lit(START), escape_role(F.col("r")), F.lit("\n"), escape(F.col("x")), F.lit(END))
    )
    w = Window.partitionBy("conv_id").orderBy("t", "r", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = flat.withColumn("upto", F.sum(F.char_length("piece")).over(w)).withColumn("k", F.count(F.lit(1)).over(w))
    whole = placed.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("all_turns"),
        F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when((F.col("r") == "assistant"), F.struct("k", "upto", "loss_length")))).alias("targets"),
    )
    last = F.when(
        F.coalesce(F.try_element_at("targets", F.lit(-1))["k"], F.lit(0)) < F.col("all_turns"),
        F.array(F.struct(F.col("all_turns").alias("k"), F.lit(None).cast("long").alias("upto"), F.lit(0).cast("long").alias("loss_length"))),
    ).otherwise(F.expr("cast(array() as array<struct<k:bigint,upto:bigint,loss_length:bigint>>)"))
    joined = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    # `conversation` is made once a conversation, below the explode; each example is a prefix of it.
    cut = whole.select("conv_id", "all_turns", joined.alias("conversation"), F.concat("targets", last).alias("targets"))
    return cut.select("conv_id", "all_turns", "conversation", F.posexplode("targets").alias("example", "t")).select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("t.k").alias("n_turns"),
        F.when(F.col("t.k") == F.col("all_turns"), F.col("conversation")).otherwise(F.substring(F.col("conversation"), F.lit(1), F.col("t.upto").cast("int"))).alias("formatted"),
        (F.col("t.upto") - F.col("t.loss_length") - len(END)).alias("loss_start"),
        F.col("t.loss_length").alias("loss_length"),
        (F.col("t.k") == F.col("all_turns")).alias("complete"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    parts = F.split(formatted, "<\\|im_end\\|>\n", -1)
    bodies = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substr(b, F.locate("\n", b) + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped; null where nothing trains."""
    return unescape(F.substring(formatted, start.cast("int") + 1, length.cast("int")))


def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, then read back from the examples."""
    own = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    examples = format_chats(turns.unionByName(extra))
    said = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id",
        "example",
        F.when(F.col("complete"), F.size(read_turns(F.col("formatted")))).cast("long").alias("n"),
        F.when(F.col("complete"), F.sha2(said, 256)).alias("turns"),
        F.when(F.col("loss_start").isNotNull(), read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    # The examples are still dealt by conv_id, so this needs no further exchange.
    losses = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda t: t["loss"]), "")
    return read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("turns").alias("turns_sha256"), losses.alias("all_loss"), F.sum("chars").alias("formatted_chars")
    ).select("conv_id", "n_turns", "turns_sha256", F.char_length("all_loss").cast("long").alias("loss_chars"), F.sha2("all_loss", 256).alias("loss_sha256"), "formatted_chars")


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), p AS (
  SELECT *, sum(12 + length(replace(replace(replace(r, '\', '\s'), '<|', '<\p'), chr(10), '\n')) + 1
    + length(replace(replace(x, '\', '\s'), '<|', '<\p')) + 11)
    OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x ROWS UNBOUNDED PRECEDING) AS upto,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, r DESC, x DESC) AS back
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE r = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
