r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and
only its text is trainable. A turn is written as

    <|turn|>ROLE<|text|>TEXT<|end|>

and a context ends with nothing else, so an example is a plain concatenation. Inside a
role or text a backslash is written ``\\`` and ``<`` is written ``\<``; an unescaped ``<``
therefore always starts a mark, whatever the conversation says.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.text import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TARGET_ROLE = "assistant"

_ESCAPED = re.compile(r"\\([\\<])")
_BODY = r"([^<\\]*+(?:\\[\\<][^<\\]*+)*+)"
_TURN = re.compile(re.escape(TURN) + _BODY + re.escape(TEXT) + _BODY + re.escape(END))


def escaped(text: Column) -> Column:
    """``text`` without anything that reads as a mark; null is empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn of an example; anything but whole turns is an error."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return turns


def expand_targets(conversations: DataFrame, target_role: str = TARGET_ROLE) -> DataFrame:
    """One example per assistant turn, and one for turns that follow the last of them.

    Takes ``conv_id, turn, role, text``; other columns are left out. Returns ``conv_id``,
    ``example`` (from 0), ``n_turns``, ``formatted``, and the trainable characters of it,
    ``loss_start`` and ``loss_stop`` (code points, the stop excluded). The example of
    trailing turns trains nothing: its two bounds are equal.

    Turns are ordered by ``turn``, equal ones by role and text, null first. Null texts and
    roles are empty, a null ``conv_id`` is a conversation too, and repeated rows are
    repeated turns. An empty table gives no rows.

    An example holds its whole context, so a conversation has to fit a row, and its text
    is repeated once per reply: that is the format. One shuffle gathers each conversation.
    """
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    gathered = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    is_target = F.col("turns.role")
    # An example ends at a target turn; the conversation's last turn ends one in any case.
    ends = gathered.select(
        "conv_id",
        "turns",
        F.filter(
            F.sequence(F.lit(1), F.size("turns")),
            lambda n: (F.element_at(is_target, n) == target_role) | (n == F.size("turns")),
        ).alias("ends"),
    )
    one = ends.select("conv_id", "turns", F.posexplode("ends").alias("example", "n_turns"))

    def written(turn: Column) -> Column:
        return F.concat(F.lit(TURN), escaped(turn["role"]), F.lit(TEXT), escaped(turn["text"]), F.lit(END))

    formatted = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n_turns")), written), "")
    last = F.element_at("turns", F.col("n_turns"))
    examples = one.select("conv_id", "example", "n_turns", formatted.alias("formatted"), last.alias("last"))
    stop = F.char_length("formatted") - len(END)
    length = F.when(F.col("last.role") == target_role, F.char_length(escaped(F.col("last.text")))).otherwise(0)
    return examples.select(
        "conv_id", "example", "n_turns", "formatted", (stop - length).alias("loss_start"), stop.alias("loss_stop")
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples say, read from their text: one row per conversation.

    The turns come from the longest example, the trained text from each example's own
    loss range, so a wrong mark, escape or mask shows.
    """
    schema = (
        "conv_id long, example int, n_turns long, turns_sha256 string, loss string, chars long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, number, text, start, stop, is_last = (c.to_pylist() for c in batch.columns)
            turns = [parse_turns(t) if last else None for t, last in zip(text, is_last, strict=True)]
            digest = [
                None if t is None
                else hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in t).encode()).hexdigest()
                for t in turns
            ]
            loss = [unescaped(t[a:b]) for t, a, b in zip(text, start, stop, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(conv, type=pa.int64()),
                    pa.array(number, type=pa.int32()),
                    pa.array([None if t is None else len(t) for t in turns], type=pa.int64()),
                    pa.array(digest, type=pa.string()),
                    pa.array(loss, type=pa.string()),
                    pa.array([len(t) for t in text], type=pa.int64()),
                ],
                names=["conv_id", "example", "n_turns", "turns_sha256", "loss", "chars"],
            )

    # Examples of a conversation are still in one partition, so this window does not shuffle.
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("example"))) == 1
    read = examples.select("conv_id", "example", "formatted", "loss_start", "loss_stop", last.alias("last"))
    parsed = read.mapInArrow(run, schema)
    losses = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return parsed.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        losses.alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )


# A conversation whose texts look like marks and escapes.
PROBE_ID = -7
PROBE_TEXT = r"\### Assistant: </turn> ok"


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TARGET_ROLE).alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return read_back(expand_targets(given.unionByName(probe))).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), sized AS (
  SELECT *, 23 + length(replace(replace(role, '\', '\\'), '<', '\<'))
            + length(replace(replace(text, '\', '\\'), '<', '\<')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM turns
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS until FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR n = n_turns THEN until ELSE 0 END) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""

QUERIES = {"op4_chat": chat_query}
ORACLES = {"op4_chat": CHAT_SQL}
