"""Packing documents into as few sequences as possible by linear grouping.

Every document is encoded and ends with one end id. A longer one is cut into pieces of full length, its first piece taking what is left over. The plan is
made from the histogram of piece lengths alone (at most `capacity` numbers, whatever the input): lengths above `small` are rounded up within groups of
equal cardinality; a linear program over configurations of the few rounded sizes (columns priced by a knapsack) says how many sequences hold which sizes;
actual pieces of a group then take the places of its rounded size, longest first; what rounding leaves over, and the small pieces, go where they fit best.
The plan is a list of runs (length, ranks from, to -> sequence, offset); pieces look their rank among equal lengths up in it.

Defined results: null and empty texts are one piece holding the end id; ties among equal lengths go by a hash of the row; repeated rows are separate
documents; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, ranked, written

CAPACITY, END, GROUPS, SMALL, GAIN = 1024, 2, 96, 32, 1e-4
CHUNK = 1 << 21
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space before a blank, or a blank at an end: there a blank does not start a word for sure. Or so much of it that a regular expression's stack ends.
WIDE = rf"{SPACES} |^ | $|{SPACES}{{256}}"


class Encoder:
    """Ids of whole texts from a byte-level BPE file.

    The pattern of such a tokenizer never matches across the start of white space that follows something else, so a text is a row of words cut before
    blanks. The distinct words of many texts are found first, in vector code, and encoded together; where one word's ids end shows from the lengths of the
    ids' bytes. Texts where blanks do not cut so (long white space, too), and those with strings of the file's added tokens, go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes these bytes as themselves, others as characters from 256 on
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b) if b in plain else chr(256 + other.index(b)): b for b in range(256)}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items()}
        with open(path) as f:
            merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in json.load(f)["model"]["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            raise ValueError("only vocabularies whose ids follow the order of the merges are supported")
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.size[i] = len(t)
        self.odd = "|".join([WIDE, *(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
        self.tokenizer = tokenizer
        self.bytes = {i: t for t, i in ranks.items()}  # what each id stands for

    def __call__(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, each with a blank before it; how many each has)."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ids = self.core.encode_to_numpy(" " + " ".join(words.to_pylist()), disallowed_special=()).astype("<u4")
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(pc.binary_length(words).to_numpy() + 1)) + 1
        return ids, np.diff(ends, prepend=0)

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has). Null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        start = lists.offsets.to_numpy()
        words = lists.values.slice(start[0], start[-1] - start[0])
        start = start - start[0]
        heads, words = words.take(pa.array(start[:-1])).dictionary_encode(), words.dictionary_encode()
        alone = [np.array(self(t), "<u4") for t in [*heads.dictionary.to_pylist(), *texts.filter(pa.array(odd)).to_pylist()]]
        ids, size = self.words(words.dictionary)
        known, size = np.concatenate([ids, *alone]), np.concatenate([size, np.array([len(x) for x in alone], np.int64)])
        which = np.concatenate([words.indices.to_numpy(), len(words.dictionary) + len(heads.dictionary) + np.arange(odd.sum())]).astype(np.int64)
        which[start[:-1]] = len(words.dictionary) + heads.indices.to_numpy()
        # back into the texts' order: a text is its words in a row, an odd one is one of them
        per = np.ones(len(texts), np.int64)
        per[~odd] = np.diff(start)
        first = np.cumsum(per) - per
        turn = np.empty_like(which)
        turn[np.arange(start[-1]) + np.repeat(first[~odd] - start[:-1], np.diff(start))] = which[: start[-1]]
        turn[first[odd]] = which[start[-1] :]
        n = size[turn]
        ends = np.concatenate([[0], np.cumsum(n)])
        return known[np.repeat((np.cumsum(size) - size)[turn] - ends[:-1], n) + np.arange(ends[-1])], ends[first + per] - ends[first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One Encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunked(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at least one row and about CHUNK bytes in a column."""
    for b in batches:
        lo, to = 0, np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False))
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(to, to[lo] + CHUNK, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, tie (a hash of the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or default_vocabulary())
        for x in chunked(batches, 2):
            yield cut_pieces(x, *encode.many(x[2]), capacity, end)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("tie"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, tie long")


def cut_pieces(b: pa.RecordBatch, ids: np.ndarray, count: np.ndarray, capacity: int, end: int) -> pa.RecordBatch:
    """The pieces (SCHEMA) of the texts of b (doc_id, tie), whose ids stand one after the other, count of each."""
    n = count + 1
    whole = np.full(n.sum(), end, "<u4")
    stop = np.zeros(len(whole), bool)
    stop[np.cumsum(n) - 1] = True
    whole[~stop] = ids
    first = (n - 1) % capacity + 1
    times = 1 + (n - first) // capacity
    doc = np.repeat(np.arange(len(n)), times)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
    start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
    length = np.where(piece > 0, capacity, first[doc])
    at, view = 4 * ((np.cumsum(n) - n)[doc] + start), memoryview(whole).cast("B")
    crc = [zlib.crc32(view[a:z]) for a, z in zip(at.tolist(), (at + 4 * length).tolist())]
    took = pa.array(doc)
    return pa.RecordBatch.from_arrays([b[0].take(took), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), b[1].take(took)], schema=SCHEMA)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("tie", pa.int64())])


def knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes within the capacity, and how many of each."""
    best, steps = np.zeros(capacity + 1), []
    for s, v in zip(sizes, values):
        for _ in range(capacity // s if v > 1e-12 else 0):
            other = best.copy()
            other[s:] = np.maximum(best[s:], best[:-s] + v)
            took = other > best + 1e-12
            if not took.any():
                break
            steps.append((s, took))
            best = other
    c, used = capacity, dict.fromkeys(sizes, 0)
    for s, took in reversed(steps):
        if took[c]:
            used[s] += 1
            c -= s
    return float(best[capacity]), [used[s] for s in sizes]


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 3000) -> list[tuple[list[int], int]]:
    """Whole numbers of sequences per configuration, rounded down from the linear program's optimum (column generation, revised simplex)."""
    k = len(sizes)
    need = np.array(counts, float)
    base = np.diag([float(capacity // s) for s in sizes])
    inverse = np.linalg.inv(base)
    x = inverse @ need
    for n in range(rounds):
        price = inverse.sum(0)
        value, column = knapsack(sizes, price, capacity)
        if value <= 1 + GAIN:
            break
        d = inverse @ np.array(column, float)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        base[:, r] = column
        x -= ratio[r] * d
        x[r] = ratio[r]
        if n % 64 == 63:
            inverse = np.linalg.inv(base)
            x = inverse @ need
        else:
            row = inverse[r] / d[r]
            inverse -= np.outer(d, row)
            inverse[r] = row
    return [([int(v) for v in base[:, i]], int(x[i] + 1e-6)) for i in range(k) if x[i] >= 1 - 1e-6]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, rank from, rank to, first sequence, offset) and the number of sequences, from how many pieces have each length."""
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(histogram, 0)
    top = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, sequence, offset))
        used[length] += n

    if histogram.get(capacity):
        put(capacity, histogram[capacity], 0, 0)
        top = histogram[capacity]
    large = [s for s in sorted(histogram, reverse=True) if small < s < capacity]
    total = sum(histogram[s] for s in large)
    # groups of equal cardinality, longest first; a length held by more than a group's share stays one group, so equal lengths are never split
    rounded: dict[int, list[int]] = {}
    top_of, held = 0, total
    for s in large:
        if held >= max(1, total / groups):
            top_of, held = s, 0
        rounded.setdefault(top_of, []).append(s)
        held += histogram[s]
    sizes = list(rounded)
    left = {s: histogram[s] for s in histogram if s != capacity}
    free: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)

    def fill(config: list[tuple[int, int]], n: int, start: int) -> None:
        """n sequences from start, each with these (rounded size, how many); actual pieces take the places, and runs part where lengths change."""
        spans = [(start, n, 0)]
        for size, times in config:
            for _ in range(times):
                new = []
                for at, m, offset in spans:
                    while m:
                        s = next((s for s in rounded[size] if left[s]), None)
                        if s is None:
                            new.append((at, m, offset))
                            break
                        take = min(m, left[s])
                        put(s, take, at, offset)
                        left[s] -= take
                        new.append((at, take, offset + s))
                        at, m = at + take, m - take
                spans = new
        for at, m, offset in spans:
            free.setdefault(capacity - offset, []).append((at, m))

    if sizes:
        for column, n in configurations(sizes, [sum(left[s] for s in rounded[g]) for g in sizes], capacity):
            fill([(g, t) for g, t in zip(sizes, column) if t], n, top)
            top += n
    for s in sorted((s for s in left if left[s]), reverse=True):  # best fit, longest first: what is left over, then small pieces
        while left[s]:
            room = min((r for r in free if r >= s and free[r]), default=None)
            if room is None:
                each = capacity // s
                n = -(-left[s] // each)
                free.setdefault(capacity, []).append((top, n))
                top += n
                continue
            at, m = free[room].pop()
            each = room // s
            n = min(m, max(1, left[s] // each)) if left[s] >= each else 1
            times = each if left[s] >= each else left[s]
            for t in range(times):
                put(s, n, at, capacity - room + t * s)
            left[s] -= n * times
            if n < m:
                free[room].append((at + n, m - n))
            free.setdefault(room - times * s, []).append((at, n))
    return runs, top


def packed(rows: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """rows of pieces() with sequence_id and offset."""
    spark = rows.sparkSession
    rows = written(rows)
    runs, _ = plan({r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity, groups, small)  # at most `capacity` rows
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, a, b, sequence, offset in runs:
        by_length.setdefault(length, []).append((a, b, sequence, offset))
    table = {n: [np.array(c, np.int64) for c in zip(*sorted(v))] for n, v in by_length.items()}
    shared = spark.sparkContext.broadcast(table)  # grows with lengths x configurations, not with the rows
    numbered = ranked(rows, ["length"], [F.col("tie"), F.col("doc_id"), F.col("piece")], F.xxhash64("tie", "piece"), buckets_for(rows.count()), "rank")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                m = length == n
                start, _, first, at = shared.value[int(n)]
                i = np.searchsorted(start, rank[m], "right") - 1
                sequence[m], offset[m] = first[i] + rank[m] - start[i], at[i]
            yield pa.RecordBatch.from_arrays([b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
