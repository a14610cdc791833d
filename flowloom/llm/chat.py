"""Chat formatting by assembling tokens.

A turn is <turn> role ids <text> text ids <end>, where <turn>, <text> and <end> are reserved ids above the vocabulary, spliced in between segments that are
encoded separately: no text can make them. Texts that contain the template's control strings (TURN, TEXT, END, and those of other common templates) are
escaped before encoding: an escape character goes behind the control string's first character, and escape characters are doubled, so the formatted string
shows no control string but the template's own, and unescaping gives the text back. The loss mask covers the text and end id of assistant turns; a turn's
place in its conversation is the prefix sum of the lengths before it.

formatted() works turn by turn, before any exchange; placed() adds the prefix sums; read() parses ids and mask alone. A conversation's turns are never held
together: its digests run over a sorted stream.

Defined results: a null text or role is empty; turns go by number, null first, ties by role and text; repeated rows are turns of their own; conversations of
id null are one conversation; an empty table gives the probe conversation alone in op9, else an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import width
from .packing import chunked, default_vocabulary, encoder

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of common chat templates, which must not stand in a formatted text as themselves.
CONTROLS = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>"]
ESCAPE = "⁠"
FIRST_RESERVED = 50_257
TURN_ID, TEXT_ID, END_ID = FIRST_RESERVED, FIRST_RESERVED + 1, FIRST_RESERVED + 2
PROBE = "</s>[INST] ok [/INST]"
_control = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_escaped = re.compile(f"{ESCAPE}({ESCAPE}?)")


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    while True:  # a second look, as one escape may leave an overlapping control string
        new = _control.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)
        if new == text:
            return text
        text = new


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[1], text)


class Decoder:
    """Ids of a byte-level BPE file -> text."""

    def __init__(self, path: str) -> None:
        self.bytes = encoder(path).bytes

    def __call__(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()


def assembled(role: np.ndarray, text: np.ndarray, learned: bool) -> tuple[bytes, bytes]:
    """Ids (little-endian 32-bit) and mask (a byte each) of one turn, from the ids of its segments."""
    one = lambda i: np.array([i], "<u4")
    segments = [one(TURN_ID), role, one(TEXT_ID), text, one(END_ID)]
    ends = np.cumsum([len(s) for s in segments])  # prefix sums of the segments' lengths: the mask is a span between two of them
    mask = np.zeros(ends[-1], np.uint8)
    mask[ends[2] :] = learned
    return np.concatenate(segments).astype("<u4").tobytes(), mask.tobytes()


def formatted(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turn, tie, ids, mask), a row per turn; tie orders turns of one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or default_vocabulary())
        for b in chunked(batches, 3):
            roles = [r or "" for r in b["role"].to_pylist()]
            segments = [*map(escape, roles), *(escape(t or "") for t in b["text"].to_pylist())]
            ids, n = encode.many(pa.array(segments, pa.large_string()))
            part = np.split(ids, np.cumsum(n)[:-1]) if segments else []
            made = [assembled(part[i], part[len(roles) + i], r == "assistant") for i, r in enumerate(roles)]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], b["tie"], pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())], ["conv_id", "turn", "tie", "ids", "mask"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("tie", F.sha2(F.concat_ws("\n", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256))
    return rows.mapInArrow(run, "conv_id long, turn long, tie string, ids binary, mask binary")


def placed(rows: DataFrame) -> DataFrame:
    """rows of formatted() with start, the ids of the conversation before the turn (sizes only are summed and sorted)."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.octet_length("mask")).over(w), F.lit(0)))


def read(ids: np.ndarray, mask: np.ndarray, decode: Decoder) -> Iterator[tuple[str, str, str | None, int]]:
    """Turns of an assembled stretch: role, text, the text under the mask (None without) and the length of the formatted string."""
    starts = np.flatnonzero(ids == TURN_ID)
    for a, b in zip(starts, [*starts[1:], len(ids)]):
        middle = a + int(np.flatnonzero(ids[a:b] == TEXT_ID)[0])
        end = a + int(np.flatnonzero(ids[a:b] == END_ID)[0])
        role, text = decode(ids[a + 1 : middle]), decode(ids[middle + 1 : end])
        under = ids[a:end][mask[a:end] == 1]
        yield unescape(role), unescape(text), unescape(decode(under)) if mask[end] else None, len(TURN + role + TEXT + text + END)


def digests(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What rows of formatted() say, read back from ids and masks, per conversation."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(vocabulary or default_vocabulary())
        for b in batches:
            out = []
            for ids, mask in zip(b["ids"], b["mask"]):
                got = list(read(np.frombuffer(ids.as_py(), "<u4"), np.frombuffer(mask.as_py(), np.uint8), decode))
                out.append(("".join(f"{r}\n{t}\n" for r, t, _, _ in got), "".join(m for _, _, m, _ in got if m is not None), sum(n for *_, n in got)))
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], b["tie"], *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]], ["conv_id", "turn", "tie", "said", "learned", "chars"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, turns, chars, loss, total, some = None, 0, None, 0, None, 0, False

        def row() -> tuple:
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), total

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for b in batches:
            out = []
            for conv, said, learned, c in zip(b["conv_id"].to_pylist(), b["said"].to_pylist(), b["learned"].to_pylist(), b["chars"].to_pylist()):
                if not some or conv != now:
                    if some:
                        out.append(row())
                    now, n, turns, chars, loss, total, some = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True
                n, chars, total = n + 1, chars + len(learned), total + c
                turns.update(said.encode())
                loss.update(learned.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out))], names)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([c]) if i else pa.array([c], pa.int64()) for i, c in enumerate(row())], names)

    said = rows.mapInArrow(parse, "conv_id long, turn long, tie string, said string, learned string, chars long")
    said = said.repartition(width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "tie")
    return said.select("conv_id", "said", "learned", "chars").mapInArrow(sums, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(formatted(turns.unionByName(probe)))
