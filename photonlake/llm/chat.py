"""Chat formatting by columnar byte assembly.

A turn is written as ``### <role>: <text></turn>`` and a line feed. Inside roles and texts ``\\``, ``#``, ``<``
and ``:`` (roles only) are written as ``\\\\``, ``\\h``, ``\\l`` and ``\\c``, so no control string can occur
there and the text comes back exactly. For a batch of turns, numpy computes segment lengths, their running
offsets and the scatter indices of all contents, and every header and content is copied once into one
preallocated Arrow buffer; conversations are slices of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_utf8, slices

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
#: Escapes, the backslash first; the last one is for roles only.
ESCAPES = [("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]
_BACK = {ord("\\"): "\\", ord("h"): "#", ord("l"): "<", ord("c"): ":"}


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    for plain, written in ESCAPES if role else ESCAPES[:-1]:
        column = pc.replace_substring(column, pattern=plain, replacement=written)
    return column


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    head, *rest = text.split("\\")
    out, i = [head], 0
    while i < len(rest):
        part = rest[i]
        if part:
            out.append(_BACK[ord(part[0])] + part[1:])
            i += 1
        else:  # an escaped backslash: the piece after it is plain text
            out.append("\\" + (rest[i + 1] if i + 1 < len(rest) else ""))
            i += 2
    return "".join(out)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; where each turn begins (n+1 bytes), and the bytes of each text in it (from, to)."""
    n = len(roles)
    role_bytes, role_at = flat_utf8(escape(roles.fill_null(""), role=True))
    text_bytes, text_at = flat_utf8(escape(texts.fill_null("")))
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    # Segments of a turn: opening, role, middle, text, close.
    lens = np.stack([np.full(n, len(OPEN)), role_len, np.full(n, len(MIDDLE)), text_len, np.full(n, len(CLOSE))], axis=1)
    begin = np.concatenate([[0], np.cumsum(lens.ravel())])
    at = begin[:-1].reshape(n, 5)
    total = int(begin[-1])
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8) if total else np.zeros(0, np.uint8)
    out.flags.writeable = True
    for k, word in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[at[:, k, None] + np.arange(len(word))] = np.frombuffer(word, np.uint8)
    for k, data, starts, size in ((1, role_bytes, role_at, role_len), (3, text_bytes, text_at, text_len)):
        out[np.repeat(at[:, k] - starts[:-1], size) + np.arange(len(data))] = data
    return buffer, np.append(at[:, 0], total), at[:, 3], at[:, 4]


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Format conversations with the assistant's texts as the loss mask.

    Returns rows (conversation id, ``part_no``, ``last``, ``n_turns``, ``formatted``, ``loss_spans``): the parts of a
    conversation in order, from 0 to the one marked last, make its whole text, a part holds whole turns, and
    ``loss_spans`` are the byte ranges (begin, end) of assistant texts in its part. Parts bound what a task holds in memory however long one
    conversation is. Rows are ordered by turn, then role and text, so ties have one defined order and repeated
    rows stay repeated; null turns come first; null roles and texts are empty; rows whose conversation id is
    null form one conversation. An empty table gives an empty result. Columns other than the four are not read.

    Turns are dealt out by conversation and sorted there: a digest over a conversation's turns is sequential.
    """
    src = df.select(df[conv_col].alias("c"), df[turn_col].alias("t"), df[role_col].cast("string").alias("r"), df[text_col].cast("string").alias("x"))
    src = src.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    c_type = src.schema["c"].dataType.simpleString()
    schema = f"`{conv_col}` {c_type}, part_no bigint, last boolean, n_turns bigint, formatted binary, loss_spans array<struct<begin:bigint,end:bigint>>"

    def run(batches):
        last, part, held = object(), 0, None
        for batch in batches:
            for piece in slices(batch, "x"):
                conv = piece.column(0).to_pylist()
                if held is not None:  # whether its last part ends a conversation is known only now
                    yield flagged(held, conv[0] != last)
                buffer, turns, text_from, text_to = assemble(piece.column(2), piece.column(3))
                spoken = pc.fill_null(pc.equal(piece.column(2), "assistant"), False).to_numpy(zero_copy_only=False)
                cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = part + 1 if conv[a] == last else 0
                    last = conv[a]
                    own = np.flatnonzero(spoken[a:b]) + a
                    spans = [{"begin": int(text_from[i] - turns[a]), "end": int(text_to[i] - turns[a])} for i in own]
                    rows.append((conv[a], part, b - a, spans))
                starts = turns[cuts].astype(np.int32)
                formatted = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(starts), buffer])
                span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                held = [pa.array([r[0] for r in rows], piece.column(0).type), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()), formatted, pa.array([r[3] for r in rows], span)]
        if held is not None:
            yield flagged(held, True)

    def flagged(cols, ended: bool):
        mark = pa.array([True] * (len(cols[0]) - 1) + [ended])
        return pa.RecordBatch.from_arrays([*cols[:2], mark, *cols[2:]], names=[conv_col, "part_no", "last", "n_turns", "formatted", "loss_spans"])

    return src.mapInArrow(run, schema)


def parse_turns(formatted: bytes) -> list[tuple[str, str]]:
    """The (role, text) of each turn in formatted text."""
    out = []
    for turn in formatted.decode().split(CLOSE.decode())[:-1]:
        role, text = turn[len(OPEN) :].split(MIDDLE.decode(), 1)
        out.append((unescape(role), unescape(text)))
    return out


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations, from their formatted text alone.

    Takes :func:`format_conversations`'s rows, in any order. Returns per conversation: id, ``n_turns``, ``turns_sha256``
    (of role, line feed, text, line feed per turn), ``loss_chars`` and ``loss_sha256`` (of the unescaped text under the
    loss mask) and ``formatted_chars``. A conversation of one part is read where it lies; the parts of others meet in
    order (a shuffle), and their digests run on from part to part, so a conversation is never held whole. A missing
    or repeated part, or turns other than the part says, fail the job. An empty table gives an empty result.
    """
    c_type = formatted.schema[conv_col].dataType.simpleString()
    schema = f"`{conv_col}` {c_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, kind = None, None

        def closed() -> list:
            if not now["last"]:
                raise ValueError(f"conversation {now['conv']} lacks its last part")
            return [now["conv"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["total"]]

        def built(rows):
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            done = []
            for piece in slices(batch, "formatted"):
                for conv, part, last, turns, body, spans in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if now is not None and (part == 0 or now["conv"] != conv):
                        done.append(closed())
                        now = None
                    if part != (0 if now is None else now["next"]) or (now is not None and now["last"]):
                        raise ValueError(f"conversation {conv} lacks a part before part {part}, or has it twice")
                    if now is None:
                        now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "total": 0}
                    now["next"], now["last"] = part + 1, last
                    found = parse_turns(body)
                    if len(found) != turns:
                        raise ValueError(f"part {part} of conversation {conv} has {len(found)} turns, not {turns}")
                    now["turns"] += turns
                    for role, text in found:
                        now["all"].update(f"{role}\n{text}\n".encode())
                    for s in spans:
                        plain = unescape(body[s["begin"] : s["end"]].decode())
                        now["chars"] += len(plain)
                        now["loss"].update(plain.encode())
                    now["total"] += len(body.decode())
            if done:
                yield built(done)
        if now is not None:
            yield built([closed()])

    src = formatted.select(F.col(conv_col), "part_no", "last", "n_turns", "formatted", "loss_spans")
    whole = F.col("last") & (F.col("part_no") == 0)
    longer = src.where(~whole).repartition(conv_col).sortWithinPartitions(conv_col, "part_no")
    return src.where(whole).mapInArrow(run, schema).union(longer.mapInArrow(run, schema))
