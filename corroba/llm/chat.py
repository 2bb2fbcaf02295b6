r"""Chat formatting with a grammar round trip, in DataFrame functions only.

The template, one string a conversation:

    conversation = turn*
    turn         = "### " role ": " body "</turn>" LF

The parser is deterministic: it cuts at every ``### ``, takes the role up to the
first ``: `` that no backslash precedes, the body up to the first ``</turn>``,
and removes one backslash before any character of role and body.

A turn is rendered as it is and parsed. If the parser does not give back the
same role and text, its conflicting content is escaped (``\`` to ``\\``,
``</turn>`` to ``<\/turn>``, ``### `` to ``#\## ``, in roles also ``:`` to
``\:``) and it is rendered again; escaped text always parses back. The whole
conversation is then parsed once more and compared with its source; a
difference is an error, so no formatted row is ever wrong.

Turns are ordered by turn number (nulls first), ties by role, then text.
Repeated rows are turns like others. Null role and null text are empty. Rows
with a null conv_id form one conversation. An empty table gives no rows. Extra
columns are ignored. A conversation is one value, so it has to fit into one
row (2 GB); its turns are ordered by a sort that can spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
OPEN, CLOSE, END = "### ", "</turn>", "</turn>\n"
#: The role whose texts are trained on.
LOSS_ROLE = "assistant"
_ROLE = r"(?s)^((?:[^:\\]|\\.)*+): "


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(CLOSE), F.lit("<\\/turn>"))
    out = F.replace(out, F.lit(OPEN), F.lit("#\\## "))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def pieces(formatted: Column) -> Column:
    """What stands between one ``### `` and the next."""
    return F.filter(F.split(formatted, OPEN), lambda x, i: i > 0)


def parse_piece(piece: Column) -> Column:
    """struct(role, text) of one turn; null where the piece breaks the grammar."""
    role = F.regexp_extract(piece, _ROLE, 1)
    rest = F.substr(piece, F.char_length(role) + 3)
    body = F.substring_index(rest, CLOSE, 1)
    return F.when(F.startswith(piece, F.concat(role, F.lit(": "))) & (rest == F.concat(body, F.lit(END))), F.struct(unescape(role).alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    return F.transform(pieces(formatted), parse_piece)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(": "), text, F.lit(END))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans, escaped_turns), one row a conversation.

    loss_spans: array of (turn, turn_start, start, length) of every text of
    ``loss_role`` as it stands escaped in ``formatted``: turn counts from 0,
    positions are code points from 0.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    plain = parse(render(F.col("role"), F.col("text")))
    rows = rows.withColumn("same", F.coalesce(plain == source, F.lit(False)))
    rows = rows.withColumn("r", F.when(F.col("same"), F.col("role")).otherwise(escape(F.col("role"), True))).withColumn("b", F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))))
    rows = rows.withColumn("chunk", render(F.col("r"), F.col("b")))

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("turn_start", F.sum(F.char_length("chunk").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("chunk"))
    span = F.struct(F.col("at").alias("turn"), "turn_start", (F.col("turn_start") + len(OPEN) + F.char_length("r") + 2).alias("start"), F.char_length("b").cast("long").alias("length"))
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "chunk", "role", "text"))).alias("t"),
        F.array_sort(F.collect_list(F.when(F.col("role") == loss_role, span))).alias("loss_spans"),
        F.sum(F.when(F.col("same"), 0).otherwise(1)).alias("escaped_turns"),
    )
    whole = whole.withColumn("formatted", F.array_join(F.transform("t", lambda x: x["chunk"]), ""))
    same = parse(F.col("formatted")) == F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    formatted = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("round trip failed for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string"))
    return whole.select("conv_id", formatted.alias("formatted"), "loss_spans", "escaped_turns")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and the text under the loss mask."""
    cut = formatted.withColumn("p", pieces(F.col("formatted"))).withColumn("turns", F.transform("p", parse_piece))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.get(F.col("p"), s["turn"]), (s["start"] - s["turn_start"] - len(OPEN) + 1).cast("int"), s["length"].cast("int"))))
    cut = cut.withColumn("loss", F.array_join(masked, ""))
    return cut.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.col("escaped_turns").cast("long").alias("escaped_turns"),
    )


#: The conversation that the query adds to the table.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"

ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, contains(text, '\') OR contains(text, '</turn>') OR contains(text, '### ') AS clash FROM t
), e AS (
  SELECT *, CASE WHEN clash THEN replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') ELSE text END AS body FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(body) + 14)::BIGINT AS formatted_chars,
  sum(clash::INT)::BIGINT AS escaped_turns
FROM e GROUP BY conv_id
"""
