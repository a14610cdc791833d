"""Line dedup by winnowing, exact for runs of MIN_WORDS words.

Each document is the sequence of its words' hashes (case and white space apart). A window is MIN_WORDS successive words; every window that an earlier place
(by id, then place in the text) has too is deleted, so all of every equal run of MIN_WORDS words or more goes from the later place, wherever in a line it
starts or ends. The first place of every window stays, unless a window of its own that overlaps it has an earlier place.

Not every window is sent. Of a window's GRAM-word pieces the one of least hash is its fingerprint g, so equal windows have equal fingerprints at equal
offsets, and successive windows mostly share one. A row is such a group of windows: g, and c, a hash of all their words. Rows equal in g and c are equal
in all windows, and all but the first go. Where g comes with several c, the first row of each c is opened into its windows, which are compared one by one.
A frequent g does not fill one task: of rows equal within a chunk of texts only the first goes on, and a g seen with several c there is dealt by g and c.

Defined results: null texts stay null and empty ones empty; white space after a deleted run goes with it, but a line that keeps its beginning keeps its
line break; rows of equal id and text are one document (all of them keep what it keeps); ties of id go by a hash of the text, a null id counting as the
first; an empty table gives an empty table; other columns stay. line_count and lines_removed count lines cut after sentence ends too, the latter those
whose words all go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, parted, width, written

GRAM, MIN_WORDS, CHUNK = 8, 25, 1 << 17
BASE, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
OTHER = np.uint64(0xBF58476D1CE4E5B9)
INVERSE, OTHER_INVERSE = (np.uint64(pow(int(b), -1, 1 << 64)) for b in (BASE, OTHER))
SPACE, STOP = np.isin(np.arange(256), list(b" \t\n\r\f\v")), np.isin(np.arange(256), list(b".!?"))
PLAIN, LATER, OPEN, MARK = np.arange(4, dtype=np.int8)
ROW = "g long, c long, doc_id long, key long, at long"  # at: word, number of windows, kind


def cut(text: bytes) -> list[bytes]:
    """The lines, blank ones joined to the one before; together they are the text."""
    b = np.frombuffer(text, np.uint8)
    at = [0, *(np.flatnonzero((b == 10) | ((b == 32) & np.concatenate([[False], STOP[b[:-1]]])[: len(b)])) + 1).tolist(), len(text)]
    out: list[bytes] = []
    for part in (text[i:j] for i, j in zip(at, at[1:])):
        if out and (not part.strip() or not out[-1].strip()):
            out[-1] += part
        else:
            out.append(part)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Hashes of the words of texts, one text after the other, and of any range of them."""

    def __init__(self, words: list[list[bytes]]) -> None:
        self.size = np.array([len(w) for w in words], np.int64)
        n = int(self.size.sum())
        x = np.fromiter((xxhash.xxh64_intdigest(w) for t in words for w in t), np.uint64, n)
        powers = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b)]))
        self.power, self.total = powers(BASE), np.concatenate([[np.uint64(0)], np.cumsum(x * powers(INVERSE)[:n])])
        self.start, self.word, self.powers = np.cumsum(self.size) - self.size, x, powers

    def of(self, a: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes of words [a, a + n)."""
        return mixed((self.total[a + n] - self.total[a]) * self.power[a])


    def other(self, a: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes of the same words by another base, so that both have 128 bits."""
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.word ^ ODD) * self.powers(OTHER_INVERSE)[: len(self.word)])])
        return mixed((total[a + n] - total[a]) * self.powers(OTHER)[a])


def least(h: np.ndarray, window: int) -> np.ndarray:
    """The place of the least hash of each window, the last of equal ones."""
    view = np.lib.stride_tricks.sliding_window_view(h[::-1], window)
    return len(h) - 1 - (np.arange(len(view)) + view.argmin(1))[::-1]


def winnowed(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their places: the least hash of each window; of a shorter sequence its least."""
    at = np.unique(least(h, max(1, min(window, len(h))))) if len(h) else np.zeros(0, np.int64)
    return h[at], at


def groups(s: Hashed, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, g, c, pos, n): the n windows from word pos of a text that share a fingerprint."""
    gram = min(GRAM, min_words)
    text = np.repeat(np.arange(len(s.size)), np.maximum(s.size - min_words + 1, 0))
    windows = np.flatnonzero(np.arange(s.size.sum()) + min_words <= np.repeat(s.start + s.size, s.size))
    if not len(windows):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int32, np.int32))
    g = s.of(np.arange(s.size.sum() - gram + 1), gram)
    at = least(g, min_words - gram + 1)[windows]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(first, len(at)))
    a, at, text = windows[first], at[first], text[first]
    c = mixed(s.of(a, n - 1 + min_words) + (at - a).astype(np.uint64) * BASE + n.astype(np.uint64))
    return text, g[at], c, (a - s.start[text]).astype(np.int32), n.astype(np.int32)


def packed(pos: np.ndarray, n: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return pos.astype(np.int64) << 16 | n.astype(np.int64) << 2 | kind


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 16, at >> 2 & 0x3FFF


def sent(b: pa.RecordBatch, text: np.ndarray, g: np.ndarray, c: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """ROW. Of rows equal in g and c all but the first are LATER; of a g with several c the first ones are OPEN, and a MARK tells the others of that g."""
    doc, key, kind = b[0].take(pa.array(text)), b[1].take(pa.array(text)), np.full(len(g), PLAIN)
    order = np.lexsort((c, g))
    new_g = np.concatenate([[True], g[order][1:] != g[order][:-1]])
    many = np.bincount(group := np.cumsum(new_g) - 1) > 1
    order, group = order[many[group]], group[many[group]]
    mark = np.zeros(0, np.int64)
    if len(order):
        null, ids, keys = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(), key.to_numpy()
        order = order[np.lexsort((pos[order], keys[order], ids[order], ~null[order], c[order], group))]
        new_g = np.concatenate([[True], group[1:] != group[:-1]])
        new = new_g | np.concatenate([[True], c[order][1:] != c[order][:-1]])
        start = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        other = (pos[order] != pos[start]) | (keys[order] != keys[start]) | (ids[order] != ids[start]) | (null[order] != null[start])
        kind[order[other]] = LATER
        several = np.bincount(place := np.cumsum(new_g) - 1, weights=new) > 1
        kind[order[~other & several[place]]] = OPEN
        mark = order[new_g & several[place]]
    dealt = np.where(kind == OPEN, mixed(g ^ mixed(c)), np.where(kind == LATER, mixed(g + mixed(c + np.arange(len(g)).astype(np.uint64))), g))
    rows = np.concatenate([np.arange(len(g)), mark])
    at = pa.array(rows)
    c = np.concatenate([c, mixed(c[mark] ^ ODD)])
    where = packed(pos[rows], n[rows], np.concatenate([kind, np.full(len(mark), MARK)]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([dealt, g[mark]]).view(np.int64)), pa.array(c.view(np.int64)), doc.take(at), key.take(at), pa.array(where)], ["g", "c", "doc_id", "key", "at"])


def chunks(texts: pa.Array, min_words: int) -> Iterator[tuple[np.ndarray, Hashed]]:
    """Texts of min_words words or more, at least one and about CHUNK words at a time, with their places in the batch."""
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        words = (t.as_py() or b"").lower().split()
        if len(words) >= min_words:
            at.append(i)
            held.append(words)
            size += len(words)
            if size > CHUNK:
                yield np.array(at), Hashed(held)
                at, held, size = [], [], 0
    if at:
        yield np.array(at), Hashed(held)


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, text) -> ROW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, s in chunks(b[2], min_words):
                text, *row = groups(s, min_words)
                yield sent(b, at[text], *row)

    return docs.select("doc_id", "key", F.col("text").cast("binary")).mapInArrow(run, ROW)


def opened(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, text, at array of packed places) -> ROW of single windows, g and c their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, s in chunks(b[2], min_words):
                own = [np.unique(np.concatenate([np.arange(p, p + n) for p, n in zip(*(x.tolist() for x in unpacked(b[3][i].values.to_numpy())))])) for i in at.tolist()]
                text, pos = np.repeat(np.arange(len(own)), [len(p) for p in own]), np.concatenate(own)
                a = s.start[text] + pos
                yield sent(b, at[text], s.of(a, min_words), s.other(a, min_words), pos.astype(np.int32), np.ones(len(pos), np.int32))

    return docs.select("doc_id", "key", F.col("text").cast("binary"), "at").mapInArrow(run, ROW)


def met(rows: DataFrame) -> DataFrame:
    """ROW -> (doc_id, key, at, first): rows whose g and c an earlier place has; and, as first, the first row of each c of a g that has several.

    LATER rows pass, OPEN ones count as of a g that has several, MARK ones only make their g one that has several. Rows of equal g stream through one task,
    sorted by one number, most of g and some of c; a task holds one batch and the first rows of the classes that may go on, however many rows there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shown, many = None, np.zeros(0, bool), np.zeros(0, bool)  # rows, which have been sent as first, which have a g of several
        for b in batches:
            if not b.num_rows:
                continue
            last = int(b[0][-1].as_py()) >> 24, int(b[1][-1].as_py()) & (1 << 64) - 1
            t = (pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])).combine_chunks()
            old, more = np.arange(len(t)) < len(shown), np.zeros(b.num_rows, bool)
            shown, many = np.concatenate([shown, more]), np.concatenate([many, more])
            g, c, key, at = (t[i].chunk(0).to_numpy() for i in (0, 1, 3, 4))
            c, pos, null, doc = c.view(np.uint64), at >> 16, t[2].chunk(0).is_null().to_numpy(zero_copy_only=False), t[2].chunk(0).fill_null(0).to_numpy()
            order = np.lexsort((pos, key, doc, ~null, c, g))
            g, c, key, pos, null, doc, kind, old, shown, many = (x[order] for x in (g, c, key, pos, null, doc, at & 3, old, shown, many))
            new_g = np.concatenate([[True], g[1:] != g[:-1]])
            new = np.concatenate([[True], new_g[1:] | (c[1:] != c[:-1])])
            start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            other = (pos != pos[start]) | (key != key[start]) | (doc != doc[start]) | (null != null[start]) | ((kind == LATER) & ~old)
            group = np.cumsum(new_g) - 1
            several = (np.bincount(group[new]) > 1) | (np.bincount(group, weights=(kind == OPEN) | many) > 0)
            first = new & several[group]
            out = np.flatnonzero(((first & ~shown) | other) & (kind != MARK))
            if len(out):
                yield pa.RecordBatch.from_arrays([*(t[i].chunk(0).take(pa.array(order[out])) for i in (2, 3, 4)), pa.array(first[out])], ["doc_id", "key", "at", "first"])
            ends = np.flatnonzero(new)  # one for each class; those of the last g, or of a g with the same first bits, that may go on
            last_of_g = np.concatenate([group[ends][1:] != group[ends][:-1], [True]])
            stay = ends[(g[ends] >> 24 == last[0]) & (last_of_g | (c[ends] >> np.uint64(40) == np.uint64(last[1] >> 40)))]
            held, shown, many = t.take(pa.array(order[stay])), (first | shown)[stay], several[group[stay]]

    by = (F.col("g").bitwiseAND(F.lit(-1 << 24))).bitwiseOR(F.shiftrightunsigned("c", 40))
    return rows.repartition(width(rows.sparkSession), "g").sortWithinPartitions(by).mapInArrow(run, "doc_id long, key long, at long, first boolean")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, text) -> (doc_id, key, spans array of packed places): the windows to delete, for documents that have any."""
    assert min_words < 1 << 14, "the windows that share a fingerprint are counted in 14 bits"
    of_document = lambda rows, name: rows.groupBy("doc_id", "key").agg(F.collect_list("at").alias(name))  # noqa: E731  at most the words of one document
    with Scratch(docs.sparkSession) as made:
        found = written(met(fingerprints(docs, min_words)))
        at = of_document(found.where("first"), "at").select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "at")
        at = written(at)
        near, _ = parted(docs, at.select("i", "k"), [F.col("doc_id"), F.col("key")])
        single = met(opened(near.join(at, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "text", "at"), min_words))
        return made.outlive(of_document(found.where(~F.col("first")).unionByName(single.where(~F.col("first"))), "spans"))


def line_counts(texts: pa.Array) -> np.ndarray:
    """How many lines cut() makes of each text: those that are not blank, or one."""
    texts = texts.fill_null(b"")
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    b = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    if not len(b):
        return np.ones(len(texts), np.int64)
    begins = np.zeros(len(b) + 1, bool)
    begins[1:] = b == 10
    begins[2:] |= (b[1:] == 32) & STOP[b[:-1]]
    begins[start] = True
    begins = np.flatnonzero(begins[:-1])
    full = np.add.reduceat(~SPACE[b], begins, dtype=np.int64) > 0
    return np.maximum(1, np.bincount(np.searchsorted(start, begins, "right") - 1, weights=full, minlength=len(texts)).astype(np.int64))


def kept(text: bytes, spans: np.ndarray, min_words: int) -> tuple[bytes, int, int]:
    """What stays of the text, and how many lines and words go."""
    lines = cut(text)
    turn = np.diff(np.concatenate([[True], SPACE[np.frombuffer(text, np.uint8)], [True]]).astype(np.int8))
    start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    edge = np.zeros(len(start) + 1, np.int64)
    a, n = unpacked(spans)
    np.add.at(edge, a, 1)
    np.add.at(edge, a + n - 1 + min_words, -1)
    gone = np.cumsum(edge[:-1]) > 0
    line = np.searchsorted(np.cumsum([len(x) for x in lines]), start, "right")
    whole = np.bincount(line, minlength=len(lines)), np.bincount(line[gone], minlength=len(lines))
    turn = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
        to = int(start[b]) if b < len(start) else len(text)
        if a and b"\n" in text[end[b - 1] : to] and b"\n" not in text[end[a - 1] : start[a]]:
            to = int(end[b - 1])
        out.append(text[at : start[a]])
        at = to
    return b"".join([*out, text[at:]]), int(((whole[0] > 0) & (whole[0] == whole[1])).sum()), int(gone.sum())


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = True) -> DataFrame:
    """docs (doc_id, text and any other columns) with text as it stays; with report also line_count, lines_removed, words_removed (columns of these names are replaced)."""
    counts = ["line_count", "lines_removed", "words_removed"] if report else []
    others = [c for c in docs.columns if c != "text" and c not in counts]
    wide = docs.select(*[F.col(f"`{c}`") for c in others], "text", F.xxhash64("text").alias("__key"))
    spans = repeated(wide.select("doc_id", F.col("__key").alias("key"), "text"), min_words).select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), F.col("spans").alias("__spans"))
    near, rest = parted(wide, spans.select("__id", "__k"), [F.col("doc_id"), F.col("__key")])
    near = near.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left")
    rows = near.unionByName(rest.withColumn("__spans", F.lit(None).cast(spans.schema["__spans"].dataType)), allowMissingColumns=True)
    rows = rows.select(*[F.col(f"`{c}`") for c in others], "text", "__spans")
    schema = rows.select(*[F.col(f"`{c}`") for c in others], "text", *[F.lit(0).alias(c) for c in counts]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(len(others)).cast(pa.large_binary()), b.column(len(others) + 1)
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            new = [kept(texts[i].as_py(), spans[i].values.to_numpy(), min_words) for i in hit.tolist()]
            gone = np.zeros((len(texts), 2), np.int32)
            gone[hit] = np.array([x[1:] for x in new], np.int32).reshape(-1, 2)
            mask = pa.array(np.isin(np.arange(len(texts)), hit))
            left = pc.replace_with_mask(texts, mask, pa.array([x[0] for x in new], pa.large_binary())) if len(hit) else texts
            out = [line_counts(texts).astype(np.int32), gone[:, 0], gone[:, 1]] if report else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], left.cast(pa.large_string()).cast(pa.string()), *map(pa.array, out)], schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"`{c}`") for c in [*(c for c in docs.columns if c not in counts), *counts]])


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "line_count", "lines_removed", "words_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("kept_crc32"))
