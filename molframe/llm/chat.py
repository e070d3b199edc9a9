"""Operator 8: whole conversations rendered and encoded once; loss masks from offsets by binary search."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of this template, and how control strings of common templates begin.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROLS = (TURN, SAYS, END)
OPENERS = r"(\||/?s>|/?INST\]|/?SYS>)"
# A backslash is put after the first character of anything that could be read as a control string, one more where some
# stand there already; taking one away restores the text.
_ESCAPE = re.compile(r"([<\[])(\\*)" + OPENERS)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + OPENERS)
_PART = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(SAYS) + r"(.*?)" + re.escape(END), re.DOTALL)

ASSISTANT = "assistant"
RENDERED = "text string, token_ids array<int>, loss_tokens array<boolean>, offsets array<int>, turn_spans array<int>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation as one text, and the span of each turn's own words in it."""
    parts, spans, length = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role or '')}{SAYS}", escape(text or "")
        spans.append((length + len(head), length + len(head) + len(body)))
        parts += [head, body, END]
        length += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _PART.finditer(rendered)]


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the sorted spans: the span that starts last before a token is found by binary search."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    held = spans[np.maximum(at, 0)]
    return (at >= 0) & (offsets[:, 1] <= held[:, 1]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(rendered: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All characters under the mask; tokens that share a character's bytes count it once."""
    out, done = [], 0
    for a, b in offsets[mask].tolist():
        if b > done:
            out.append(rendered[max(a, done) : b])
            done = b
    return "".join(out)


def _tokenizer(definition: str):
    from tokenizers import AddedToken, Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_str(definition)
    # Control strings become single tokens, so no token crosses from a header into a text.
    tokenizer.add_tokens([AddedToken(c, normalized=False) for c in CONTROLS])
    tokenizer.encode_special_tokens = True
    return tokenizer


def format_conversations(
    turns: DataFrame,
    tokenizer_file: str,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    loss_role: str = ASSISTANT,
) -> DataFrame:
    """One row per conversation: the rendered text, its token ids, which tokens bear loss, offsets and turn spans.

    Turns are ordered by turn, then role, then text, so that ties and repeated rows have one order; a null turn comes
    first, null roles and texts are empty. Rows without conversation id form one conversation. A conversation is one row,
    since it is rendered and encoded as a whole; conversations are spread by their id. The tokenizer's definition (some MB)
    is read on the driver and broadcast. Spans are pairs of code point places,
    flattened.
    """
    turn = F.struct(F.col(turn_column).alias("t"), F.coalesce(F.col(role_column), F.lit("")).alias("r"), F.coalesce(F.col(text_column), F.lit("")).alias("x"))
    with open(tokenizer_file, encoding="utf-8") as file:
        held = turns.sparkSession.sparkContext.broadcast(file.read())
    grouped = turns.groupBy(F.col(id_column).alias(id_column)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    source = grouped.select(id_column, F.col("turns.r").alias("roles"), F.col("turns.x").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(held.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                made = [render(list(zip(r, x, strict=True))) for r, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                coded = tokenizer.encode_batch([m[0] for m in made], add_special_tokens=False)
                rows = []
                for roles, (text, spans), code in zip(part.column(1).to_pylist(), made, coded, strict=True):
                    offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
                    spoken = np.array([s for r, s in zip(roles, spans, strict=True) if r == loss_role], np.int64).reshape(-1, 2)
                    rows.append((text, code.ids, token_mask(offsets, spoken).tolist(), offsets.ravel().tolist(), np.array(spans, np.int64).ravel().tolist()))
                kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_column, "text", "token_ids", "loss_tokens", "offsets", "turn_spans"])

    kind = grouped.schema[id_column].dataType.simpleString()
    return source.mapInArrow(run, f"{id_column} {kind}, {RENDERED}")


def read_back(formatted: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """What a formatted conversation says, from its output alone: turns by parsing, loss text by mask and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for low in range(0, batch.num_rows, 64):
                for record in batch.slice(low, 64).to_pylist():
                    text, offsets = record["text"], np.array(record["offsets"], np.int64).reshape(-1, 2)
                    said = parse(text)
                    digest = hashlib.sha256()
                    for role, words in said:
                        digest.update(f"{role}\n{words}\n".encode("utf-8", "surrogatepass"))
                    loss = unescape_masked(text, offsets, np.array(record["loss_tokens"], bool))
                    rows.append((record["id"], len(said), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    names = [id_column, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema[id_column].dataType.simpleString()
    source = formatted.select(F.col(id_column).alias("id"), "text", "offsets", "loss_tokens")
    return source.mapInArrow(run, f"{id_column} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def unescape_masked(text: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask without its escapes; each stretch between unmasked tokens is restored by itself."""
    runs = np.split(np.arange(len(mask)), np.flatnonzero(np.diff(mask.astype(np.int8))) + 1) if len(mask) else []
    out = []
    for run in runs:
        if len(run) and mask[run[0]]:
            out.append(unescape(masked_text(text, offsets[run], np.ones(len(run), bool))))
    return "".join(out)
