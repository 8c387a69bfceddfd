"""Chat formatting from event logs.

Conversations are logged as events: whole messages, streamed deltas, edits, regenerations. Logs are partitioned by
conversation, a very long one in blocks of its messages, and each message's events are folded in the order of their
sequence. Final messages are sorted by conversation and rendered turn by turn, so no task holds more of a conversation
than a part of its output.

Template, by turn: ``### `` role ``: `` text ``</turn>`` and a newline. In role and text a backslash stands before each
backslash, ``###`` and ``</turn>`` (in a role also before ``:``), so control strings in them read back as text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import new_path, ship, sized, written

ASSISTANT = "assistant"
#: Characters of a part of a conversation's output, at least one turn.
PART_CHARS = 1 << 18
#: Events of a conversation above which its messages are dealt to several tasks for folding.
HOT_EVENTS = 100_000

_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:")
_BACK = re.compile(r"\\(\\|###|</turn>|:)")
_STOP = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>")
_COLON = re.compile(r"\\(?:\\|###|</turn>|:)|: ")


def escaped(text: str, role: bool = False) -> str:
    return (_ROLE if role else _TEXT).sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _BACK.sub(r"\1", text)


def rendered(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """A turn, and where its text stands in it."""
    head = f"### {escaped(role, True)}: "
    body = escaped(text)
    return f"{head}{body}</turn>\n", (len(head), len(head) + len(body))


def parsed(formatted: str):
    """``role, text, start, end`` of each turn; ``start:end`` is the escaped text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith("### ", at):
            raise ValueError("a turn must begin here")
        colon = next(m for m in _COLON.finditer(formatted, at + 4) if m[0] == ": ")
        stop = next(m for m in _STOP.finditer(formatted, colon.end()) if m[0] == "</turn>")
        yield unescaped(formatted[at + 4 : colon.start()]), unescaped(formatted[colon.end() : stop.start()]), colon.end(), stop.start()
        at = stop.end() + 1


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of whole messages (``conv_id, turn, role, text``) as events. Rows that repeat are messages each."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.monotonically_increasing_id().alias("message"), F.col("turn").cast("long").alias("turn"),
        F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of whole messages as the log that their making may have left, whatever the texts.

    An assistant's message is streamed, given up and regenerated in three deltas; any other is sent as a draft and edited
    after the conversation's last turn. Null roles and texts are empty. Rows that repeat are messages each.
    """
    n, turn = F.length("text"), F.coalesce("turn", F.lit(0))
    a, b = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")
    cut = lambda start, end: F.substring("text", start + 1, end - start)
    event = lambda k, kind, text, late=0: F.struct((turn * 8 + k + late).alias("seq"), F.lit(kind).alias("kind"), (F.col("role") if k == 0 else F.lit(None).cast("string")).alias("role"), text.alias("text"))
    zero, none = F.lit(0), F.lit(None).cast("string")
    streamed = F.array(event(0, "delta", cut(zero, b)), event(1, "regenerate", none), event(2, "delta", cut(zero, a)), event(3, "delta", cut(a, b)), event(4, "delta", cut(b, n)))
    edited = F.array(event(0, "message", F.concat(cut(zero, a), F.lit(" .."))), event(1, "edit", F.col("text"), 1 << 40))
    rows = events_of(conversations).drop("seq", "kind").withColumn("e", F.explode(F.when(F.col("role") == ASSISTANT, streamed).otherwise(edited)))
    return rows.select("conv_id", "message", "turn", "e.seq", "e.kind", "e.role", "e.text")


def folded(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of events ``conv_id, message, turn, seq, kind, role, text``.

    ``message`` names a message within its conversation, ``turn`` its place (the least of its events'). By ``seq``, then kind and
    text: ``message`` and ``edit`` set the text, ``delta`` adds to it, ``regenerate`` empties it, ``delete`` removes
    the message until a later event. The last role that is not null counts; null texts are empty; other kinds are an error.
    """
    ship(events.sparkSession)
    # What the folding of a message needs of an event goes through one sort; a message's deltas stream by.
    rows = events.select("conv_id", "message", "turn", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    hot = written(events.groupBy("conv_id").agg(F.count("*").alias("n")).where((F.col("n") > HOT_EVENTS) & F.col("conv_id").isNotNull()).select("conv_id", F.ceil(F.col("n") / HOT_EVENTS).alias("blocks")), "hot")
    if hot.isEmpty():
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    else:
        rows = rows.join(sized(hot), "conv_id", "left").withColumn("block", F.pmod(F.xxhash64("message"), F.coalesce("blocks", F.lit(1))))
    rows = rows.select("conv_id", "block", "message", "turn", "seq", "kind", "role", "text")
    order = ["conv_id", "message", "seq", "kind", "text"]

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["conv_id"], r["message"]) != key:
                    if state and not state[3]:
                        out.append((key[0], state[0], state[1], "".join(state[2])))
                    key, state = (r["conv_id"], r["message"]), [r["turn"], "", [], False]
                if r["turn"] is not None and (state[0] is None or r["turn"] < state[0]):
                    state[0] = r["turn"]
                state[1] = r["role"] if r["role"] is not None else state[1]
                kind = r["kind"]
                if kind == "delta":
                    state[2].append(r["text"])
                elif kind in ("message", "edit", "regenerate"):
                    state[2] = [r["text"]] if kind != "regenerate" else []
                elif kind != "delete":
                    raise ValueError(f"unknown kind of event: {kind}")
                state[3] = kind == "delete"
            yield _batch(out, MESSAGE)
        if state and not state[3]:
            yield _batch([(key[0], state[0], state[1], "".join(state[2]))], MESSAGE)

    return rows.repartition("conv_id", "block").sortWithinPartitions(*order).mapInArrow(run, "conv_id long, turn long, role string, text string")


MESSAGE = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])
READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def formatted(messages: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss_spans``: a conversation's text in parts of whole turns, and in each part the
    places (start, end, start, end, ..) of assistant text.

    Messages of a conversation are in order of turn (null first), then role and text. Joining a conversation's parts
    gives its text. One shuffle by conversation; rows stream, so a huge conversation needs no more memory than a part.
    """
    ship(messages.sparkSession)

    def run(batches):
        key, part, texts, spans, size = None, 0, [], [], 0
        first = True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if first or r["conv_id"] != key or size >= PART_CHARS:
                    if texts:
                        out.append((key, part, "".join(texts), spans))
                    part = part + 1 if not first and r["conv_id"] == key else 0
                    key, texts, spans, size, first = r["conv_id"], [], [], 0, False
                turn, (a, b) = rendered(r["role"] or "", r["text"] or "")
                if r["role"] == ASSISTANT:
                    spans += [size + a, size + b]
                texts.append(turn)
                size += len(turn)
            yield _batch(out, PART)
        if texts:
            yield _batch([(key, part, "".join(texts), spans)], PART)

    return messages.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, part long, formatted string, loss_spans array<long>")


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation of :func:`formatted`: ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    ship(parts.sparkSession)

    def run(batches):
        key, state, first = None, None, True

        def ended():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if first or r["conv_id"] != key:
                    if not first:
                        out.append(ended())
                    key, first = r["conv_id"], False
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text, spans = r["formatted"], r["loss_spans"]
                for role, said, _, _ in parsed(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    said = unescaped(text[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield _batch(out, READ)
        if not first:
            yield _batch([ended()], READ)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def write_formatted(events: DataFrame, path: str | None = None) -> DataFrame:
    """Fold, render, write as Parquet; returns the table as read from ``path`` (in the shared folder by default).

    Null roles and texts are empty, a null ``conv_id`` is a conversation of its own; an empty table gives none.
    """
    spark = events.sparkSession
    path = path or new_path(spark, "chat")
    parts = formatted(folded(events))
    parts.write.parquet(path)
    return spark.read.schema(parts.schema).parquet(path)


#: The rows of ``op8_chat_format`` in DuckDB.
SQL = r"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
    escaped AS (
        SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS etext,
            replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS erole
        FROM said)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length('### ' || erole || ': ' || etext || '</turn>') + 1)::BIGINT AS formatted_chars
    FROM escaped GROUP BY conv_id"""
