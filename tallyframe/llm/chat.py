"""Conversations as training texts, put together column by column.

Rows arrive sorted by conversation and turn. For a batch of them numpy works
out the length of every segment (markers, role, content), the running offsets
and one target index per byte, and copies markers and contents into a single
buffer that Arrow then reads as the column of formatted texts. No string is
built per turn.

A turn reads ``[INST]role[/INST]content</s>`` and a conversation begins with
``<s>``. Inside roles and contents a backslash is doubled, and one is put
after the first character of every control string, so that no control string
is left there and the original comes back by dropping one backslash of each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

#: A conversation of more bytes than this comes out in several pieces, cut between turns.
PIECE_BYTES = 2 << 20

#: Rows are taken up in portions of this size; the index arrays need some 40 bytes per byte of text.
PORTION_BYTES = 1 << 20

BACKSLASH = 0x5C


@dataclass(frozen=True)
class Template:
    """Control strings, each two or more bytes and starting with a byte that none holds further in; roles under the loss."""

    begin: str = "<s>"
    open: str = "[INST]"
    close: str = "[/INST]"
    end: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return self.begin, self.open, self.close, self.end

    def __post_init__(self):
        heads = {c[:1] for c in self.controls()}
        if any(len(c) < 2 or "\\" in c or heads & set(c[1:]) for c in self.controls()):
            raise ValueError("control strings need two characters or more, no backslash, and first characters of their own")


DEFAULT_TEMPLATE = Template()


def formatted_conversations(conversations: DataFrame, template: Template = DEFAULT_TEMPLATE) -> DataFrame:
    """``conv_id, piece, n_turns, formatted, loss_starts, loss_ends`` from rows of ``conv_id, turn, role, text``.

    ``loss_starts`` and ``loss_ends`` are byte offsets into the UTF-8 of
    ``formatted``: the escaped contents of the turns under the loss. Null texts
    and roles are empty. Rows are ordered by turn, a null turn first, equal
    turns by role and then text; repeated rows are repeated turns. Rows
    without a conv_id are one conversation without one. Other columns are left
    out; an empty table gives an empty one.

    A conversation is one row (piece 0) unless it has more than
    ``PIECE_BYTES``. A longer one is cut between turns into numbered pieces, so
    a task holds a bounded part of it however long it is; a single turn is
    never cut. Pieces of one conversation stand next to each other in order.
    """
    ship(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    arranged = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, piece int, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(template)
        for batch in batches:
            for part in _portions(batch):
                yield from writer.add(part)
        yield from writer.close()

    return arranged.mapInArrow(run, schema)


class _Writer:
    """Holds back the rows of the last conversation until it ends or is long enough for a piece."""

    def __init__(self, template: Template):
        self.template = template
        self.held: list[pa.RecordBatch] = []
        self.last = None  # the conversation that the previous piece left open, and that piece's number
        self.piece = -1

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        if self.held and _differs(self.held[-1], batch):
            yield self._emit(self.held, ended=True)
            self.held = []
        starts = np.flatnonzero(_changes(batch.column(0)))
        final = int(starts[-1]) if len(starts) else 0
        if final:
            yield self._emit([*self.held, batch.slice(0, final)], ended=True)
            self.held = []
        self.held.append(batch.slice(final))
        if sum(b.column(2).nbytes for b in self.held) > PIECE_BYTES:
            yield self._emit(self.held, ended=False)
            self.held = []

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._emit(self.held, ended=True)

    def _emit(self, parts: Sequence[pa.RecordBatch], ended: bool) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        first_id = rows.column(0)[0].as_py()
        goes_on = self.piece >= 0 and self.last == first_id
        first = self.piece + 1 if goes_on else 0
        # Only rows of a single conversation are given out before it has ended.
        self.piece, self.last = (-1 if ended else first), first_id
        return assembled(rows, self.template, first)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``PORTION_BYTES`` of text each, or one row."""
    _, offsets = _column(batch.column(2))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + PORTION_BYTES, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def _differs(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return a.column(0)[a.num_rows - 1].as_py() != b.column(0)[0].as_py()


def _changes(ids: pa.Array) -> np.ndarray:
    """Whether each row, but for the first, has another id than the one before; null equals null."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[False], codes[1:] != codes[:-1]])


def _column(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column and where each row's begin, from 0, with the end behind."""
    strings = strings.cast(pa.string())
    _, places, data = strings.buffers()
    offsets = np.frombuffer(places, dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _insertions(data: np.ndarray, offsets: np.ndarray, controls: Sequence[bytes]) -> np.ndarray:
    """Per byte, 1 if a backslash goes before it."""
    put = (data == BACKSLASH).astype(np.int64)
    for control in controls:
        places = np.flatnonzero(data[: max(0, len(data) - len(control) + 1)] == control[0])
        for k in range(1, len(control)):
            places = places[data[places + k] == control[k]]
        row_end = offsets[np.searchsorted(offsets, places, side="right")]
        put[places[places + len(control) <= row_end] + 1] = 1
    return put


@dataclass
class _Escaped:
    data: np.ndarray
    offsets: np.ndarray
    put: np.ndarray
    moved: np.ndarray  # inserted backslashes up to and with each byte
    lengths: np.ndarray  # of the escaped rows

    def copy_to(self, out: np.ndarray, starts: np.ndarray) -> None:
        """Scatter every byte, and the backslashes, to the rows' places in ``out``."""
        if not len(self.data):
            return
        counts = np.diff(self.offsets)
        before = np.concatenate([[0], self.moved])[self.offsets[:-1]]
        target = np.arange(len(self.data)) + self.moved + np.repeat(starts - self.offsets[:-1] - before, counts)
        out[target] = self.data
        out[target[self.put > 0] - 1] = BACKSLASH


def _escaped(strings: pa.Array, controls: Sequence[bytes]) -> _Escaped:
    data, offsets = _column(strings)
    put = _insertions(data, offsets, controls)
    moved = np.cumsum(put)
    total = np.concatenate([[0], moved])
    return _Escaped(data, offsets, put, moved, np.diff(offsets) + np.diff(total[offsets]))


def _stamp(out: np.ndarray, starts: np.ndarray, marker: bytes) -> None:
    out[starts[:, None] + np.arange(len(marker))] = np.frombuffer(marker, dtype=np.uint8)


def assembled(rows: pa.RecordBatch, template: Template, first_piece: int = 0) -> pa.RecordBatch:
    """One row per conversation of ``rows`` (conv_id, role, text, sorted); the first one begins with piece ``first_piece``."""
    begin, opening, closing, end = controls = [c.encode() for c in template.controls()]
    n = rows.num_rows
    new = _changes(rows.column(0))
    new[0] = True
    firsts = np.flatnonzero(new)
    pieces = np.zeros(len(firsts), dtype=np.int32)
    pieces[0] = first_piece
    begins = new.copy()
    begins[0] = first_piece == 0

    role, text = _escaped(rows.column(1), controls), _escaped(rows.column(2), controls)
    # Segments of a row in their order: begin, open, role, close, text, end.
    lengths = np.empty((n, 6), dtype=np.int64)
    lengths[:, 0] = begins * len(begin)
    lengths[:, 1], lengths[:, 3], lengths[:, 5] = len(opening), len(closing), len(end)
    lengths[:, 2], lengths[:, 4] = role.lengths, text.lengths
    ends = np.cumsum(lengths.ravel()).reshape(n, 6)
    starts = ends - lengths

    out = np.empty(int(ends[-1, 5]), dtype=np.uint8)
    _stamp(out, starts[begins, 0], begin)
    _stamp(out, starts[:, 1], opening)
    _stamp(out, starts[:, 3], closing)
    _stamp(out, starts[:, 5], end)
    role.copy_to(out, starts[:, 2])
    text.copy_to(out, starts[:, 4])

    edges = np.concatenate([starts[firsts, 0], ends[-1:, 5]])
    owner = np.cumsum(new) - 1
    loss = pc.is_in(rows.column(1), value_set=pa.array(template.loss_roles, rows.column(1).type)).to_numpy(zero_copy_only=False)
    span_edges = np.concatenate([[0], np.cumsum(np.bincount(owner[loss], minlength=len(firsts)))]).astype(np.int32)
    spans = [pa.ListArray.from_arrays(span_edges, pa.array(at[loss, 4] - edges[owner[loss]])) for at in (starts, ends)]
    formatted = _strings(out, edges)
    turns = np.diff(np.concatenate([firsts, [n]]))
    return pa.RecordBatch.from_arrays(
        [rows.column(0).take(pa.array(firsts)), pa.array(pieces), pa.array(turns), formatted, *spans],
        names=["conv_id", "piece", "n_turns", "formatted", "loss_starts", "loss_ends"],
    )


def _strings(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The buffer itself as a column of strings; nothing is copied."""
    if edges[-1] >= 1 << 31:
        raise ValueError("a batch of conversations has 2 GB or more; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    """What stood there before escaping."""
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def turns_of(formatted: str, template: Template = DEFAULT_TEMPLATE) -> list[tuple[str, str]]:
    """The (role, text) turns of one formatted piece."""
    turns = []
    for turn in formatted.removeprefix(template.begin).split(template.end)[:-1]:
        role, _, text = turn.removeprefix(template.open).partition(template.close)
        turns.append((unescaped(role), unescaped(text)))
    return turns


def read_back(formatted: DataFrame, template: Template = DEFAULT_TEMPLATE, arranged: bool = False) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of formatted conversations.

    Everything is taken from the formatted texts and their loss spans: turns by
    splitting at the control strings, the loss text by the spans. Digests run
    on over the pieces of a conversation, one piece in memory at a time.
    ``arranged=True`` is for the very result of ``formatted_conversations``, whose
    pieces are in place already; else pieces are brought together by conv_id.
    """
    ship(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    pieces = formatted.select("conv_id", "piece", "formatted", "loss_starts", "loss_ends")
    if not arranged:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kind = None, None
        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            ids, numbers, texts, starts, ends = batch.columns
            for i in range(batch.num_rows):
                if state is None or numbers[i].as_py() == 0:
                    if state is not None:
                        done.append(state.row())
                    state = _Digests(ids[i].as_py())
                state.add(texts[i].as_py(), zip(starts[i].as_py(), ends[i].as_py(), strict=True), template)
            yield _digest_batch(done, kind)
        if state is not None:
            yield _digest_batch([state.row()], kind)

    return pieces.mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


class _Digests:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans, template: Template) -> None:
        for role, text in turns_of(formatted, template):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        self.chars += len(formatted)
        raw = formatted.encode()
        for start, end in spans:
            text = unescaped(raw[start:end].decode())
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


#: The conversation of the contract: control strings inside the texts of both turns.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_report(conversations: DataFrame, template: Template = DEFAULT_TEMPLATE) -> DataFrame:
    """The digests of all conversations and of ``PROBE``, read back from their formatted texts."""
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    return read_back(formatted_conversations(rows, template), template, arranged=True)
