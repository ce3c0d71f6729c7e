"""Chat formatting with a grammar round trip, in DataFrame operations alone.

The grammar of a conversation's output:

    output = turn*        turn = "### " role ": " text "</turn>" newline

Control strings are ``### ``, ``: `` (in a role only), ``</turn>`` and the
backslash.  A turn is first written as it is, and parsed; if the parser doesn't
return the same role and text, its control strings are escaped (``\\b`` the
backslash, ``\\e`` the end, ``\\h`` the marks, ``\\c`` the colon).  Then the whole
output is parsed and its turns compared to the source's; where they differ all turns
are escaped and the output is parsed and compared again.  Escaped content holds no
control string, so that round agrees, or else the query fails.  The parser splits at
"</turn>" newline, cuts the role at the first ": ", and undoes the escapes; it needs
nothing but the output.

The loss mask is the text of the assistant's turns: spans of code points in the
output, the turn's own end excluded.

Nulls: a null text or role is empty; a null conv_id is a conversation of its
own.  Turns are ordered by turn (null first), then role and text; repeated rows
are turns of their own.  Extra columns are ignored.

A conversation's output is one string, so its turns meet in one task; that is
the result's own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BEGIN, COLON, END, NEWLINE = "### ", ": ", "</turn>", "\n"
ASSISTANT = "assistant"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, role: bool = False) -> Column:
    for old, new in (("\\", "\\b"), (END, "\\e"), ("###", "\\h"), *(((":", "\\c"),) if role else ())):
        c = _swap(c, old, new)
    return c


def unescape(c: Column) -> Column:
    for old, new in ((":", "\\c"), ("###", "\\h"), (END, "\\e"), ("\\", "\\b")):
        c = _swap(c, new, old)
    return c


def parse_turn(body: Column) -> tuple[Column, Column]:
    """Role and text of what stands before a turn's end."""
    at = F.instr(body, COLON)
    role = F.substring(body, F.lit(len(BEGIN) + 1), F.greatest(at - len(BEGIN) - 1, F.lit(0)))
    return unescape(role), unescape(F.substring(body, at + len(COLON), F.length(body)))


def format_conversations(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length; from 0)."""
    rows = conversations.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    plain = F.concat(F.lit(BEGIN), "role", F.lit(COLON), "text")
    rows = rows.withColumn("plain", plain)
    role, text = parse_turn(F.col("plain"))
    # the parser must cut here and nowhere else, and read the same role and text
    same = ~F.contains(F.concat("plain", F.lit(END)), F.lit(END + NEWLINE)) & (F.instr("plain", END) == 0) & ~F.contains("text", F.lit("###")) & ~F.contains("role", F.lit("###")) & (role == F.col("role")) & (text == F.col("text"))
    rows = rows.withColumn("safe", same)
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("no", F.row_number().over(order))
    for way, safe in (("some", F.col("safe")), ("all", F.lit(False))):
        head = F.concat(F.lit(BEGIN), F.when(safe, F.col("role")).otherwise(escape(F.col("role"), True)), F.lit(COLON))
        rows = rows.withColumn("head", head).withColumn("body", F.when(safe, F.col("text")).otherwise(escape(F.col("text"))))
        size = F.length("head") + F.length("body") + len(END) + len(NEWLINE)
        start = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - len(END) - len(NEWLINE) - F.length("body")
        span = F.when(F.col("role") == ASSISTANT, F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
        rows = rows.withColumn(way, F.struct(F.concat("head", "body", F.lit(END + NEWLINE)).alias("out"), span.alias("span")))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("no", F.struct("role", "text").alias("source"), "some", "all"))).alias("t"))
    some, all_ = F.array_join(F.col("t.some.out"), ""), F.array_join(F.col("t.all.out"), "")
    turns = turns.withColumn("agrees", parse(some) == F.col("t.source"))
    written = F.when(F.col("agrees"), some).when(parse(all_) == F.col("t.source"), all_).otherwise(F.raise_error(F.lit("an output that doesn't parse to its source")).cast("string"))
    return turns.select(
        F.col("conv").alias(id_col),
        written.alias("formatted"),
        F.filter(F.when(F.col("agrees"), F.col("t.some.span")).otherwise(F.col("t.all.span")), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of an output."""

    def turn(body: Column) -> Column:
        role, text = parse_turn(body)
        return F.struct(role.alias("role"), text.alias("text"))

    bodies = F.split(formatted, END + NEWLINE)
    return F.transform(F.slice(bodies, 1, F.size(bodies) - 1), turn)


def digest(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from the outputs."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    x = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss)
    return x.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the query adds.
ADDED, ADDED_TEXT = -7, r"\### Assistant: </turn> ok"


def with_added(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(ADDED).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT), F.lit(ADDED_TEXT))
    return rows.unionAll(more)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, contains(role, ': ') OR list_bool_or([contains(role, x) OR contains(text, x) FOR x IN ['###', '</turn>', '\b', '\e', '\h', '\c']]) AS odd FROM c
), f AS (
  SELECT *, CASE WHEN odd THEN replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') ELSE text END AS body,
    CASE WHEN odd THEN replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c') ELSE role END AS head FROM e
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(4 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
