"""Chat formatting from event logs.

A conversation's log is a set of events in order of sequence. The events of a message_id act on the
message that stands under it, if there is one. An event of kind

* ``message`` opens a message, or gives the standing one a new role and text in its old place,
* ``delta`` appends its text,
* ``edit`` replaces the text and discards every message that was opened after it,
* ``regenerate`` empties the text, which later deltas fill again, and discards later messages too.

An event whose message does not stand, because it was never opened or has been discarded, opens one
at its own place; an edit or a regeneration then discards nothing. A message is so known by its
conversation and the place where it was opened. A streaming pass over the sorted log finds that place
for the events of ids that occur more than once; it holds the open messages of one conversation
(places, no texts). All else is done by windows: what stands of a message is the text of its last
resetting event followed by the deltas after it, unless a later cut fell on a message before it. The
folded messages are rendered one segment each: a turn is
``<|im_start|>role\\n`` + text + ``<|im_end|>\\n``. Inside roles and texts the character ``<`` before
``|`` or before a run of backslashes that ends in ``|`` gets one backslash more after it
(``<|`` is written ``<\\|``), which cannot be mistaken for a control string and is undone by taking
one backslash away. The loss mask covers the text of assistant turns, not their marks.

No conversation is gathered in one row or group: segments stay rows, and what has to be read in
order (digests) streams over rows sorted by conversation.

Edge cases: null texts and roles count as empty. Events that share a sequence number are ordered by
role, text, message_id and kind. Repeated rows of a conversation table are turns of their own;
repeated events act twice. A null conv_id is a conversation of its own, a null message_id an id like
others. Events of unknown kinds count as messages. An empty log gives an empty result. Other columns
are never looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

START, END = "<|im_start|>", "<|im_end|>"
#: Kinds of events that discard later messages.
CUTS = ("edit", "regenerate")
#: Role whose texts are trained on.
LOSS_ROLE = "assistant"


def _opened(events: DataFrame) -> DataFrame:
    """The events (conv_id, place, kind, message_id, ...) with opened, the place where their message was opened."""
    schema = StructType([*events.schema.fields, StructField("opened", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, standing = object(), {}
        for b in batches:
            opened = []
            facts = (b.column(c).to_pylist() for c in ("conv_id", "place", "kind", "message_id"))
            for conv, place, kind, key in zip(*facts, strict=True):
                if conv != at:
                    at, standing = conv, {}  # in order of opening
                since = standing.setdefault(key, place)
                if kind in CUTS:
                    while next(reversed(standing.values())) > since:
                        standing.popitem()
                opened.append(since)
            names = [*b.schema.names, "opened"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(opened, pa.int64())], names=names)

    return events.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)


def fold(events: DataFrame) -> DataFrame:
    """conv_id, position, role and text of the messages that stand at the end of the log.

    events: conv_id, seq, kind, message_id, role, text.
    """
    kind = F.when(F.col("kind").isin("delta", *CUTS), F.col("kind")).otherwise("message")
    rows = events.select(
        "conv_id", "seq", kind.alias("kind"), "message_id",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text", "message_id", "kind")
    rows = rows.withColumns(
        {
            "place": F.row_number().over(order).cast("long"),
            "alone": F.count(F.lit(1)).over(Window.partitionBy("conv_id", "message_id")) == 1,
        }
    ).drop("seq")
    # An event that is its message's only one opens it and cuts nothing.
    single = rows.filter("alone").select(
        "conv_id", F.col("place").alias("opened"), "role",
        F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"), F.lit(None).cast("long").alias("cut_at"),
    )
    acting = _opened(rows.filter("not alone").drop("alone"))
    message = Window.partitionBy("conv_id", "opened").orderBy("place")
    acting = acting.withColumn("version", F.sum((F.col("kind") != "delta").cast("int")).over(message))
    pieces = F.array_sort(F.collect_list(F.when(F.col("kind") != "regenerate", F.struct("place", "text"))))
    versions = acting.groupBy("conv_id", "opened", "version").agg(
        F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"),
        F.min_by("role", "place").alias("first_role"),
        F.max_by("role", F.when(F.col("kind") == "message", F.col("place"))).alias("told_role"),
        F.max(F.when(F.col("kind").isin(*CUTS), F.col("place"))).alias("cut_at"),
    )
    # The last version has the text; the last message event has the role, or else the first event.
    told = F.max_by("told_role", F.when(F.col("told_role").isNotNull(), F.col("version")))
    folded = versions.groupBy("conv_id", "opened").agg(
        F.coalesce(told, F.min_by("first_role", "version")).alias("role"),
        F.max_by("text", "version").alias("text"),
        F.max("cut_at").alias("cut_at"),
    )
    # A message falls if one that was opened before it is cut after it was opened.
    before = Window.partitionBy("conv_id").orderBy("opened").rowsBetween(Window.unboundedPreceding, -1)
    return (
        folded.unionByName(single)
        .withColumn("cut", F.max("cut_at").over(before))
        .filter("cut is null or cut < opened")
        .select("conv_id", F.col("opened").alias("position"), "role", "text")
    )


def escaped(text: Column) -> Column:
    """The text without control strings; unescape() undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """A role on one line: backslashes are doubled and line feeds written as such."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    """What escaped_role() was given."""
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def unescape(text: str) -> str:
    """What escaped() was given."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(messages: DataFrame) -> DataFrame:
    """One segment for each message: conv_id, position, segment, and where its loss mask begins and ends."""
    role, text = escaped_role(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    trained = F.col("role") == LOSS_ROLE
    return messages.select(
        "conv_id", "position", F.concat(head, text, F.lit(f"{END}\n")).alias("segment"),
        F.when(trained, F.length(head)).otherwise(0).alias("loss_from"),
        F.when(trained, F.length(head) + F.length(text)).otherwise(0).alias("loss_to"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted segments in order.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars and
    loss_sha256 (text under the loss mask, unescaped), formatted_chars.
    """
    turn = re.compile(re.escape(START) + r"(.*?)\n(.*)" + re.escape(END) + r"\n", re.S)

    class State:
        def __init__(self, conv):
            self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, segment, start, stop):
            role, text = turn.fullmatch(segment).groups()
            self.all.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(segment[start:stop])
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
            self.turns += 1
            self.loss_chars += len(masked)
            self.chars += len(segment)

        def row(self):
            return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def frame(rows):
        ids = pd.array([r[0] for r in rows], "Int64")
        return pd.DataFrame([r[1:] for r in rows], columns=names[1:]).assign(conv_id=ids)[names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for b in batches:
            out = []
            for conv, segment, start, stop in zip(b["conv_id"], b["segment"], b["loss_from"], b["loss_to"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or state.conv != conv:
                    if state is not None:
                        out.append(state.row())
                    state = State(conv)
                state.add(segment, start, stop)
            if out:
                yield frame(out)
        if state is not None:
            yield frame([state.row()])

    dealt = segments.withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "position", "segment")
    return ordered.mapInPandas(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log: every row is a message of its own."""
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"
    ).withColumn("copy", F.row_number().over(order)).select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"),
        F.concat_ws("/", F.coalesce(F.col("turn").cast("string"), F.lit("-")), "copy").alias("message_id"), "role", "text",
    )
