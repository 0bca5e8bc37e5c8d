r"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, message_id, seq, kind, role, text): ``start`` opens a message with its role, ``delta``
appends streamed text, ``edit`` replaces all text so far, ``regenerate`` clears it for new deltas, ``delete``
withdraws the message. The log is partitioned by conversation and message, so that a conversation with a third of
all rows is spread over tasks; each message is folded in the order of seq. Messages are then rendered one by one:

    <|im_start|>role\ntext<|im_end|>\n

A conversation's formatted text is its segments in order. Control strings inside a text get one backslash after
their first character (those that have backslashes there already get one more), so texts come back unchanged. In
roles, percent signs and line breaks are percent-encoded. The loss mask of an assistant's segment covers its escaped
text and nothing else.

Defined cases: null text is empty, a null role is the empty role; null conv_ids are one conversation; a delta before
its start belongs to the message all the same (its role is empty if no start comes); messages with equal first seq
are ordered by role, then text; repeated rows are messages of their own; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What follows < or [ in a control string.
REST = r"/?s>|/?INST\]|/?<SYS>>|</SYS>>|\|[a-z_]+\|>"
GUARD = r"([<\[])(\\*)(" + REST + ")"
UNGUARD = re.compile(r"([<\[])\\(\\*(?:" + REST + "))")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, GUARD, r"$1\\$2$3")


def unescape(text: str) -> str:
    return UNGUARD.sub(r"\1\2", text)


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message_id, first_seq, role, text of the messages that a log leaves."""
    x = events.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first_seq"), F.max_by(F.col("role"), F.when(F.col("kind") == "start", F.col("seq"))).alias("role"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("_reset"), F.max(F.when(F.col("kind") == "delete", F.col("seq"))).alias("_gone"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin("delta", "edit"), F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))).alias("_parts"),
    )
    live = F.filter("_parts", lambda p: F.col("_reset").isNull() | (p["seq"] >= F.col("_reset")))
    return x.where("_gone IS NULL").select("conv_id", "message_id", "first_seq", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Adds segment, and the span of code points in it that bears loss (null for other roles than assistant)."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    loss = F.col("role") == "assistant"
    return messages.withColumns({
        "segment": F.concat(head, body, F.lit(CLOSE + "\n")),
        "loss_start": F.when(loss, F.length(head)), "loss_end": F.when(loss, F.length(head) + F.length(body)),
    })


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    if not (segment.startswith(OPEN) and segment.endswith(CLOSE + "\n")):
        raise ValueError("not a rendered message")
    role, _, body = segment[len(OPEN) : -len(CLOSE) - 1].partition("\n")
    return unescape_role(role), unescape(body)


def conversation_log(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log: a start and the text in two deltas."""
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    event = lambda k, kind, t: F.struct(F.struct("turn", F.lit(k).alias("k")).alias("seq"), F.lit(kind).alias("kind"), F.col("role"), t.alias("text"))
    made = F.array(event(0, "start", F.lit(None).cast("string")), event(1, "delta", F.substring(text, F.lit(1), half)), event(2, "delta", F.substring(text, half + 1, F.length(text))))
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("message_id", F.monotonically_increasing_id())
    return numbered.select("conv_id", "message_id", F.explode(made).alias("e")).select("conv_id", "message_id", "e.*")


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    """Segments sorted by conversation and place, streamed through digests: no conversation is held."""
    now, state, done = object(), None, []

    def flush():
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]))
            done.clear()

    def close():
        if state:
            done.append({"conv_id": now, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]})

    for batch in batches:
        for conv, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
            if state is None or conv != now:
                close()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if a is not None:
                under = unescape(segment[a:b])
                state[2] += len(under)
                state[3].update(under.encode())
            state[4] += len(segment)
        if len(done) > 10_000:
            yield from flush()
    close()
    yield from flush()


def summaries(rendered: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its segments."""
    x = rendered.select("conv_id", "first_seq", "role", "text", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "first_seq", "role", "text")
    return x.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(_digest, SUMMARY)


def probe(spark) -> DataFrame:
    """A conversation whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def format_chat(rows: DataFrame) -> DataFrame:
    """Rendered segments of rows (conv_id, turn, role, text)."""
    return render(fold(conversation_log(rows)))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, '<|im_start|>' || replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') || chr(10)
             || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?<SYS>>|</SYS>>|\|[a-z_]+\|>)', '\1\\\2\3', 'g') || '<|im_end|>' || chr(10) AS segment FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(segment))::BIGINT AS formatted_chars FROM r GROUP BY conv_id
"""
