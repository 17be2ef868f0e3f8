"""Chat formatting from an event log.

A log has one event per row: conv_id, seq, message, kind, role, delta. The kinds are

- ``open``: a message begins, with its role;
- ``delta``: a piece of streamed text is added to the message;
- ``edit``: the message's text is replaced by the delta;
- ``regenerate``: the text so far is dropped, the pieces that follow are streamed anew.

The fold is distributed by conversation and message: the last edit or regeneration of a message is a
running maximum, the pieces from there on, sorted by sequence, are its text. Rendering marks turns
and escapes control strings, message by message. Only the digests of a conversation are sequential;
they stream over sorted rows and keep nothing but a hash state.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, ship

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"

#: Code points in a streamed piece of a message.
PIECE = 512

#: ``<``, backslashes, ``|``: one backslash more hides it, one less brings it back.
HIDE, SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return HIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return SHOW.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log of finished conversations, as a server would have streamed it.

    Every row of conv_id, turn, role, text becomes a message: an ``open``, a first piece that is
    dropped again, and the text in pieces. Odd messages drop it by a ``regenerate``, even ones by an
    ``edit`` to the text's first piece. Messages are ordered by turn, then by role and text, nulls
    first, so repeated rows stay messages of their own. The events of a message stand in the log with
    the last one first, as a log that is read from several places is in no order.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    text = F.coalesce(F.col("text"), F.lit(""))
    # Window functions order rows within a conversation; they stream through sorted rows
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest((F.length(text) - 1) / PIECE, F.lit(0)).cast("int")),
        lambda i: F.struct(F.lit("delta").alias("kind"), F.substr(text, i * PIECE + 1, F.lit(PIECE)).alias("delta")),
    )
    event = lambda kind, delta: F.array(F.struct(F.lit(kind).alias("kind"), delta.alias("delta")))
    none = F.lit(None).cast("string")
    first = F.left(text, F.lit(PIECE))
    opening = F.concat(event("open", none), event("delta", first))
    edited = F.concat(opening, event("edit", first), F.slice(pieces, 2, F.size(pieces)))
    events = F.when(F.col("message") % 2 == 0, edited).otherwise(F.concat(opening, event("regenerate", none), pieces))
    numbers = F.transform(events, lambda e, i: F.struct(i.alias("seq"), e["kind"].alias("kind"), e["delta"].alias("delta")))
    return numbered.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.explode(F.reverse(numbers)).alias("e")).select(
        "conv_id", "message", "e.seq", "role", "e.kind", "e.delta"
    )


def fold(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the final state of every message.

    The role is that of the message's first event. seq orders the events of a message; null pieces
    count as empty. A message without pieces has an empty text.
    """
    restart = F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))
    log = log.withColumn("restart", F.max(restart).over(Window.partitionBy("conv_id", "message")))
    part = F.when(F.col("kind").isin("delta", "edit") & (F.col("restart").isNull() | (F.col("seq") >= F.col("restart"))), F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta")))
    folded = log.groupBy("conv_id", "message").agg(F.min(F.struct("seq", "role")).alias("first"), F.array_sort(F.collect_list(part)).alias("parts"))
    return folded.select("conv_id", "message", F.coalesce("first.role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["delta"]), "").alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, message, piece, loss_start, loss_end: each message's part of the formatted conversation.

    The parts of a conversation, in order of message, are the formatted conversation. loss_start and
    loss_end are the code points in the part whose text is trained on (null: none): the escaped text
    of the trained roles, without the turn marks.
    """

    def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for role, text in zip(batch["role"], batch["text"], strict=True):
                head, body = f"{START}{escape_role(role)}\n", escape(text)
                loss = (len(head), len(head) + len(body)) if role in trained else (None, None)
                rows.append((f"{head}{body}{END}\n", *loss))
            piece, begins, ends = zip(*rows, strict=True) if rows else ((), (), ())
            yield batch[["conv_id", "message"]].assign(piece=list(piece), loss_start=pd.array(begins, "Int64"), loss_end=pd.array(ends, "Int64"))

    ship(messages.sparkSession)
    kind = messages.schema["conv_id"].dataType.simpleString()
    messages = messages.select(F.col("conv_id").cast("string"), "message", "role", "text")
    out = messages.mapInPandas(rendered, "conv_id string, message long, piece string, loss_start long, loss_end long")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def read_back(piece: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    if not (piece.startswith(START) and piece.endswith(f"{END}\n")):
        raise ValueError("not a rendered message")
    role, _, body = piece[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body)


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the parts.

    A conversation's rows come sorted to one task, which keeps the states of two hashes and three
    counts, whatever its length.
    """

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None

        def done(s) -> pd.DataFrame:
            return pd.DataFrame([(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])], columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            out = []
            for conv_id, piece, begin, end in zip(batch["conv_id"], batch["piece"], batch["loss_start"], batch["loss_end"], strict=True):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        out.append(done(state))
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if not pd.isna(begin):
                    trained = unescape(piece[int(begin) : int(end)])
                    state[3] += len(trained)
                    state[4].update(trained.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
            if out:
                yield pd.concat(out)
        if state is not None:
            yield done(state)

    ship(parts.sparkSession)
    kind = parts.schema["conv_id"].dataType.simpleString()
    # null conversations are one, marked by a letter that no other id's text begins with
    keyed = parts.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv_id"), "message", "piece", "loss_start", "loss_end")
    keyed = keyed.repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "message")
    out = keyed.mapInPandas(digested, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.when(F.col("conv_id") != "-", F.substring("conv_id", 2, 1 << 30)).cast(kind))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Log, fold, render and read back: one row per conversation.

    Null texts and roles count as empty, null turns come first, rows of equal turn are ordered by role
    and text, repeated rows are turns of their own, null conv_ids form one conversation. Long texts are
    streamed, folded and digested whole. An empty table gives an empty result; other columns are
    ignored.
    """
    return digests(render(fold(log_of(conversations))))
