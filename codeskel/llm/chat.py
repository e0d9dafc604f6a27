"""Chat formatting with offset-aligned loss masks.

A turn is written as ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can occur
there and unescaping restores every character.  The three control strings are
single tokens of their own, at which the tokenizer always cuts.

Turns are range-partitioned and sorted by conversation and turn, so a very long
conversation spans several tasks.  A task renders the turns of a conversation that
it holds as one text (in *parts* of at least :data:`PART_CHARS` characters, cut
between turns), encodes it once with offsets, and finds each turn's tokens by
binary search of its span in the tokens' starts.  As the tokenizer cuts at control
tokens, parts encode to the same ids as the whole.

Output rows: ``conv_id, seq, n_turns, text, ids, starts, ends, loss`` -- token ids,
their character spans in ``text`` and whether they count for the loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
PART_CHARS = 1 << 20

PART_SCHEMA = (
    "conv_id long, seq long, n_turns long, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
)
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
)
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("seq", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())),
     ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))]
)

_turns = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)
_escaped = re.compile(r"\\(.)", re.S)


def escape(s: str | None) -> str:
    return (s or "").replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return _escaped.sub(r"\1", s)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the character span of each loss text, ascending."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}")
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turns.finditer(text)]


def mask_of(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens that lie inside a span; both lists ascend, so each span is found by binary search."""
    loss = np.zeros(len(starts), bool)
    if spans:
        lo, hi = np.array(spans).T
        first = np.searchsorted(starts, lo, side="left")
        last = np.searchsorted(ends, hi, side="right")
        for a, b in zip(first.tolist(), last.tolist()):
            loss[a:b] = True
    return loss


def masked_text(text: str, starts: list[int], ends: list[int], loss: list[bool]) -> Iterator[str]:
    """The unescaped text under each run of loss tokens."""
    on = np.flatnonzero(np.diff(np.concatenate(([0], np.array(loss, np.int8), [0]))))
    for a, b in zip(on[::2].tolist(), on[1::2].tolist()):
        yield unescape(text[starts[a] : ends[b - 1]])


_tokenizers: dict = {}


def chat_tokenizer(path: str):
    """The byte-level tokenizer with the control tokens added and untrimmed offsets."""
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer, processors

        tok = Tokenizer.from_file(path)
        tok.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (TURN, TEXT, END)])
        tok.post_processor = processors.ByteLevel(trim_offsets=False)
        _tokenizers[path] = tok
    return _tokenizers[path]


def _formatter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chat_tokenizer(path)
        base, part = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[str | None, str | None]] = []
        conv, size = None, 0

        def close() -> pa.RecordBatch:
            text, spans = render(held)
            enc = tok.encode(text, add_special_tokens=False)
            at = np.array(enc.offsets, np.int32).reshape(-1, 2)
            loss = mask_of(spans, at[:, 0], at[:, 1])
            cols = ([conv], [base + part], [len(held)], [text], [enc.ids], [at[:, 0]], [at[:, 1]], [loss])
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

        for b in batches:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held and (c != conv or size >= PART_CHARS):
                    yield close()
                    held, size, part = [], 0, part + 1
                conv = c
                held.append((role, text))
                size += len(text or "") + len(role or "")
        if held:
            yield close()

    return run


def format_chats(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Format ``conversations (conv_id, turn, role, text)`` and write the parts; returns them, read back.

    Null roles and texts count as empty; rows that share a turn are ordered by
    role, then text; a null turn comes first; null conversation ids are one
    conversation; an empty table gives no rows.
    """
    ship(conversations.sparkSession)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
        .repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
        .select("conv_id", "role", "text")
    )
    return cut(rows.mapInArrow(_formatter(tokenizer_path), PART_SCHEMA), "chats")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order to one row per conversation; holds one part at a time."""
    conv, state = None, None

    def close() -> pa.RecordBatch:
        turns, loss, n, chars, formatted, tokens = state
        cols = ([conv], [n], [turns.hexdigest()], [chars], [loss.hexdigest()], [formatted], [tokens])
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            if state is not None and r["conv_id"] != conv:
                yield close()
                state = None
            conv = r["conv_id"]
            state = state or [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
            for role, text in parse(r["text"]):
                state[0].update(f"{role}\n{text}\n".encode())
                state[2] += 1
            for text in masked_text(r["text"], r["starts"], r["ends"], r["loss"]):
                state[1].update(text.encode())
                state[3] += len(text)
            state[4] += len(r["text"])
            state[5] += len(r["ids"])
    if state is not None:
        yield close()


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, from the written parts: counts and checksums of turns and of the text under the mask."""
    ship(parts.sparkSession)
    ordered = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")
    return ordered.mapInArrow(_digests, DIGEST_SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The contract's additional conversation.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all conversations and the probe, formatted, written, read back and digested."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string"
    )
    return digests(format_chats(rows.union(probe), default_tokenizer())).drop("n_tokens")


_ESC = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + {len(TURN) + len(TEXT) + len(END)})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
