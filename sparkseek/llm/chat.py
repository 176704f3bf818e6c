"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<s>" "[ROLE]" " " role " " "[/ROLE]" "[INST]" " " text " " "[/INST]" "</s>"

Each turn is rendered, parsed again by a deterministic parser and compared with its source; while they
differ, the control strings in its role and text are escaped by one more backslash. The parser takes a
control string after at least one backslash as text, without its last backslash. A rendered turn stands
alone, so a conversation is the concatenation of its turns and is never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
CONTROL = "|".join(map(re.escape, CONTROLS))
#: Backslashes and the control string that they stand before.
ESCAPABLE = re.compile(rf"(\\*)({CONTROL})")
#: The role whose texts a model learns to write.
LEARNED = "assistant"

TURN_SCHEMA = "conv_id long, turn long, formatted string, loss_start long, loss_end long"
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    return ESCAPABLE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return ESCAPABLE.sub(lambda m: m[1][1:] + m[2], text)


def tokens(text: str) -> list[tuple[str, str]]:
    """("control", string) and ("text", characters), in turn."""
    found, at = [], 0
    for m in ESCAPABLE.finditer(text):
        if m[1]:
            continue
        found += [("text", text[at : m.start()])] if m.start() > at else []
        found.append(("control", m[2]))
        at = m.end()
    return found + ([("text", text[at:])] if at < len(text) else [])


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, unescaped; start and end of the escaped text. None: not in the grammar."""
    turns, at, row = [], 0, tokens(text)
    shape = ("<s>", "[ROLE]", None, "[/ROLE]", "[INST]", None, "[/INST]", "</s>")
    for first in range(0, len(row), len(shape)):
        parts, fields = row[first : first + len(shape)], []
        if len(parts) < len(shape):
            return None
        for want, (kind, value) in zip(shape, parts, strict=True):
            if want is None:
                if kind != "text" or len(value) < 2 or value[0] != " " or value[-1] != " ":
                    return None
                fields.append((unescape(value[1:-1]), at + 1, at + len(value) - 1))
            elif (kind, value) != ("control", want):
                return None
            at += len(value)
        turns.append((fields[0][0], *fields[1]))
    return turns


def render(role: str, text: str) -> str:
    """A turn that parses to exactly this role and text."""
    inner_role, inner = role, text
    while True:
        formatted = f"<s>[ROLE] {inner_role} [/ROLE][INST] {inner} [/INST]</s>"
        turns = parse(formatted)
        if turns is not None and [t[:2] for t in turns] == [(role, text)]:
            return formatted
        inner_role, inner = escape(inner_role), escape(inner)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, formatted, loss_start, loss_end (code points within `formatted`).

    Takes conv_id, turn, role, text; other columns are ignored. A null role or text is empty. The loss
    covers the texts of the assistant; for other roles both ends are null. Rows of the same conversation and
    turn are separate turns. Null ids and turns are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                formatted = render(role or "", text or "")
                ((_, _, start, end),) = parse(formatted)
                rows.append((formatted, start, end) if role == LEARNED else (formatted, None, None))
            text, start, end = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [pa.array(text, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), *columns],
                names=["conv_id", "turn", "formatted", "loss_start", "loss_end"],
            )

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(run, TURN_SCHEMA)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, from its formatted turns alone: the turns' digest, and that of the text under the loss mask.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars and
    loss_sha256 (all text under the mask, unescaped), formatted_chars. Turns are in order of turn, then of
    their formatted text. Each task reads its sorted rows one by one, so a conversation may be of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in DIGEST_SCHEMA.split(", ")]

        def result(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        done: list[tuple] = []
        current, state = object(), None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")], strict=True):
                conv, formatted, start, end = row
                if conv != current:
                    if state:
                        done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(formatted[start:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
            if len(done) >= 10_000:
                yield result(done)
                done = []
        if state:
            done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        if done:
            yield result(done)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, DIGEST_SCHEMA)
