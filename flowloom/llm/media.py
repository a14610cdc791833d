"""Media columns as progressive JPEG: payloads stored as coefficients, read back from the stored bytes, and full-resolution RGB tensors with their features.

stored() writes each payload into a file (a binary column); read() decodes files and gives the payload and the tensor; the codec is in jpeg.py.

Defined results: a null or empty payload is a whole frame of filling; repeated rows give equal files; texts of any length are whole (a file holds up to
65,535 x 65,535 pixels); an empty table gives an empty table; other columns are kept by stored().
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg

FRAME, FILL, TOGETHER = 576, b"\xff", 1 << 19


def framed(text: bytes) -> bytes:
    """The payload of a text: filled up to a positive multiple of FRAME."""
    return text + FILL * (-len(text) % FRAME if text else FRAME)


def some(values: Iterator[bytes], size: int = TOGETHER) -> Iterator[list[bytes]]:
    held, n = [], 0
    for v in values:
        held.append(v)
        n += len(v)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def stored(rows: DataFrame, column: str, media: str = "media") -> DataFrame:
    """rows with a binary column in place of `column`: the file that holds it. A column of the name that media gives is replaced."""
    others = [c for c in rows.columns if c not in (column, media)]
    schema = rows.select(*[F.col(f"`{c}`") for c in others], F.lit(b"").alias(media)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in some(t.as_py() or b"" for t in b.column(b.num_columns - 1)):
                x = b.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array([jpeg.write(framed(t)) for t in texts], pa.binary())], schema.names)

    return rows.select(*[F.col(f"`{c}`") for c in others], F.col(column).cast("binary").alias("__t")).mapInArrow(run, schema)


def tensors(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """The payload and the RGB tensor of each file."""
    read = [jpeg.Decoder(f) for f in files]
    return list(zip(map(jpeg.payload_of, read), jpeg.rgb_of(read)))


def feature(tensor: np.ndarray) -> str:
    """Size, sums of red, green and blue, and a checksum of the tensor."""
    sums = tensor.reshape(-1, 3).sum(0, dtype=np.int64)
    return f"{tensor.shape[1]}x{tensor.shape[0]} {sums[0]} {sums[1]} {sums[2]} {zlib.crc32(np.ascontiguousarray(tensor)):08x}"


def tensor_column(rows: DataFrame, media: str = "media") -> DataFrame:
    """rows with height, width and rgb (bytes, row by row) in place of the file."""
    others = [c for c in rows.columns if c != media]
    schema = rows.select(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("height"), F.lit(0).alias("width"), F.lit(b"").alias("rgb")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for files in some((t.as_py() for t in b.column(b.num_columns - 1)), TOGETHER // 4):
                x = b.slice(at, len(files))
                at += len(files)
                got = [t for _, t in tensors(files)]
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array([t.shape[0] for t in got], pa.int32()), pa.array([t.shape[1] for t in got], pa.int32()), pa.array([t.tobytes() for t in got], pa.binary())], schema.names)

    return rows.select(*[F.col(f"`{c}`") for c in others], F.col(media)).mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> what the stored files hold, read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for files in some(t.as_py() for t in b["media"]):
                x = b.slice(at, len(files))
                at += len(files)
                got = tensors(files)
                yield pa.RecordBatch.from_arrays(
                    [x["doc_id"], x["n_bytes"], pa.array([len(p) for p, _ in got]), pa.array([hashlib.sha256(p).hexdigest() for p, _ in got]), pa.array([zlib.crc32(p[-32:]) for p, _ in got], pa.int64()), pa.array([len(f) for f in files]), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array([feature(t) for _, t in got])],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return rows.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"), "text"))
