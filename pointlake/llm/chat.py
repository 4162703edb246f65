"""Multi-party perspective rotation: a dialogue once for every participant, in whose place the assistant speaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM, UNNAMED = "system", "unknown"


#: Characters that a name in a head may not hold as they are.
_NAME = {"%": "%25", "|": "%7C", "<": "%3C", ">": "%3E", "\n": "%0A", "\r": "%0D"}


def safe_name(name: Column) -> Column:
    """A name with the characters that would end or forge a head as percent codes."""
    for c, code in _NAME.items():
        name = F.replace(name, F.lit(c), F.lit(code))
    return name


def safe_content(content: Column) -> Column:
    """A content without markers: "<" and pipes after it get one more pipe, so that "<|" followed by no pipe is a marker's alone. Undone by taking one away."""
    return F.regexp_replace(content, r"<(\|+)", "<$1|")


def head(role: Column, name: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(":"), safe_name(name)), F.lit("")), F.lit("|>\n"))


def rendered(role: Column, name: Column, content: Column) -> Column:
    """One message as text: role and name on a line, then the content, none of which can forge a turn."""
    return F.concat(head(role, name), safe_content(content), F.lit("<|end|>\n"))


def perspectives(turns: DataFrame, spans: bool = False) -> DataFrame:
    """For every participant of each conversation, all its turns with that participant as assistant.

    ``turns``: conv_id, turn, role (who speaks), text. Returns conv_id, perspective, turn, speaker,
    role, name, message, mask: the participant's own turns have role assistant and mask 1 (they are
    learned), the others' have role user, their speaker as name and mask 0, and system turns stay
    system turns with mask 0. Sorted by turn, the messages of one (conv_id, perspective) are the
    rendered dialogue.

    ``spans`` adds span_start and span_end: where in ``message``, in code points, the content that is
    learned lies; null where mask is 0.

    A null role is a participant named "unknown"; a null text is empty; a null conv_id is a
    conversation of its own. Repeated and tied turns are kept as they are. A conversation of system
    turns alone has no participant and gives no rows. Other columns are not read.

    A turn is a row throughout and no dialogue is gathered, so its length has no bound: participants
    are distinct (conversation, role) pairs, pre-aggregated before the shuffle, and meet the turns
    in an equi-join that adaptive execution splits where a conversation is hot.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    told = turns.select(key.alias("key"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(UNNAMED)).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    present = told.where(F.col("speaker") != SYSTEM).select("key", F.col("speaker").alias("perspective")).distinct()
    each = told.join(present, "key")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    role = F.when(own, F.lit("assistant")).when(system, F.lit(SYSTEM)).otherwise(F.lit("user"))
    name = F.when(~own & ~system, F.col("speaker"))
    each = each.select("conv_id", "perspective", "turn", "speaker", role.alias("role"), name.alias("name"), "content", own.cast("int").alias("mask"))
    begin = F.when(F.col("mask") == 1, F.length(head(F.col("role"), F.col("name"))))
    end = begin + F.length(safe_content(F.col("content")))
    more = [begin.alias("span_start"), end.alias("span_end")] if spans else []
    return each.select("conv_id", "perspective", "turn", "speaker", "role", "name", rendered(F.col("role"), F.col("name"), F.col("content")).alias("message"), "mask", *more)


PERSPECTIVES_SQL = """
WITH told AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations
), present AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM told WHERE speaker <> 'system'
)
SELECT t.conv_id, p.perspective, t.turn, t.speaker,
       CASE WHEN t.speaker = p.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user' END AS role,
       CASE WHEN t.speaker <> p.perspective AND t.speaker <> 'system' THEN t.speaker END AS name,
       '<|' || CASE WHEN t.speaker = p.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user:' || t.speaker END
         || '|>' || chr(10) || t.content || '<|end|>' || chr(10) AS message,
       CAST(t.speaker = p.perspective AS INTEGER) AS mask
FROM told t JOIN present p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
"""
