"""Near-duplicates: by SimHash fingerprints, and by the Jaccard similarity of shingles.

linked(): components of fingerprints of whole texts within `tau` bits, exact for every pair of fingerprints: links by the generalised pigeonhole principle
(hamming.py), groups by components.

near_duplicates(): components of all pairs whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more. Fingerprints of these sets within
`tau` bits are linked first, as above, and texts of each linked group are compared along a tree. Fingerprints of similar sets can lie further apart, so a
prefix filter then finds every pair that this has not connected: two such sets of n and m shingles, in any one order (frequent ones of a sample last, then by hash), share one of their first n - ceil(SIMILARITY n) + 1 and m - ceil(SIMILARITY m) + 1; their sizes, and
the places of the first one they share, bound what they can share at most. Of these, candidates next to each other in a shingle's list are verified first; then all
other candidates that these have not connected yet. So no pair is lost, and a group of many near copies does not verify all its pairs.

Defined results: null and empty texts have fingerprint zero and are linked like any other; equal texts are always linked; ties keep the smallest id, a null
id counting as the largest; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, parted, width, written
from .hamming import links
from .lines import Hashed

TAU, WORDS, SIMILARITY, BLOCK, CHUNK, EPS, SAMPLE, FREQUENT, WORDS_HELD, PARTS = 4, 5, 0.8, 2048, 1 << 18, 1e-9, 5_000, 1 << 18, 1 << 17, 256


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles in order, repeats included; the whole sequence where it has fewer words."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(w))
    n = np.fromiter(map(len, w), np.int64, len(w)) + 1
    starts = np.concatenate([[0], np.cumsum(n)])
    k = max(1, len(w) - words + 1)
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[:k].tolist(), (starts[min(words, len(w)) :][:k] - 1).tolist())], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """docs with fp (long) in place of the text."""
    columns = [c for c in docs.columns if c != text_col]
    kept = [F.col(f"`{c}`") for c in columns]
    schema = docs.select(*kept, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = (shingle_hashes(t.as_py() or b"", words) for t in b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([fingerprint(h) for h in hs], pa.int64())], [*b.schema.names[:-1], "fp"])

    return docs.select(*kept, F.col(text_col).cast("binary").alias("__t")).mapInArrow(run, schema)


def linked(docs: DataFrame, words: int = 4, tau: int = TAU) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id) for every row."""
    rows = written(fingerprints(docs.select("doc_id", "text"), words))
    with Scratch(docs.sparkSession) as made:
        first = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
        group = components(links(first, "fp", tau)).withColumnRenamed("node", "fp")
        group = group.join(first, "fp")
        smallest = group.groupBy("component").agg(F.min("first").alias("smallest"))
        group = group.join(smallest, "component").select("fp", "smallest")
        # a table of its own, so that the join below can part a fingerprint that many rows have
        ids = made.outlive(first.join(group, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text in turn the distinct hashes of its shingles, rising; the whole sequence where it has fewer words."""
    held: list[list[bytes]] = []
    size = 0

    def out() -> Iterator[np.ndarray]:
        s = Hashed(held)
        for a, n in zip(s.start.tolist(), s.size.tolist()):
            yield np.unique(s.of(np.arange(a, a + max(1, n - words + 1)), min(words, n))) if n else np.zeros(0, np.uint64)

    for t in texts.cast(pa.large_binary()):
        held.append((t.as_py() or b"").lower().split())
        size += len(held[-1])
        if size > WORDS_HELD:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def set_fingerprints(keyed: DataFrame, words: int) -> DataFrame:
    """(key, text) -> (key, fp), once for each key: the fingerprint of the distinct shingles of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, once = np.unique(b[0].to_numpy(), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([fingerprint(h) for h in shingle_sets(b[1].take(pa.array(once)), words)], pa.int64())], ["key", "fp"])

    return keyed.select("key", "text").mapInArrow(run, "key long, fp long").groupBy("key").agg(F.min("fp").alias("fp"))


def fingerprint_pairs(keyed: DataFrame, words: int, tau: int) -> DataFrame:
    """(key, text) -> pairs (a, b) of keys, a < b, that connect all whose fingerprints are linked within `tau` bits: a row for each text of a group but one.

    A group is dealt into PARTS parts by a hash; a text meets the smallest key of its part, and that the smallest of the group, so no key meets all of a large group.
    """
    with Scratch(keyed.sparkSession) as made:
        prints = written(set_fingerprints(keyed, words))
        near = components(links(written(prints.select("fp").distinct()), "fp", tau)).withColumnRenamed("node", "fp")
        dealt = written(prints.join(near, "fp", "left").select("key", F.coalesce("component", "fp").alias("group"), F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part")))
        parts = dealt.groupBy("group", "part").agg(F.min("key").alias("first"))
        groups = parts.groupBy("group").agg(F.min("first").alias("a"))
        inside = dealt.join(parts, ["group", "part"]).where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
        return made.outlive(inside.unionByName(parts.join(groups, "group").where("first <> a").select("a", F.col("first").alias("b"))))


def frequent(keyed: DataFrame, n: int, words: int) -> np.ndarray:
    """Shingles that three texts or more of a sample have (SAMPLE texts, or a sixteenth), rising in frequency, FREQUENT at most. They only choose an order."""
    share = max(1 / 16, SAMPLE / max(n, 1))
    some = keyed.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20))).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, once = np.unique(b[0].to_numpy(), return_index=True)
            for h in shingle_sets(b[1].take(pa.array(once)), words):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["token"])

    most = some.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 2").orderBy(F.desc("c"), "token").limit(FREQUENT).toPandas()
    return most["token"].to_numpy(np.int64)[::-1].view(np.uint64)


def prefixes(keyed: DataFrame, words: int, similarity: float, last: np.ndarray) -> DataFrame:
    """(key, text) -> (token, n, at, key): the shingles of each text's prefix and their places, n how many distinct ones the text has. No shingle: token 0.

    The order is that of the hashes, after which those of `last` come in theirs."""
    rank = np.argsort(last, kind="stable")
    shared_last = keyed.sparkSession.sparkContext.broadcast((last[rank], rank + 1))

    def ordered(h: np.ndarray) -> np.ndarray:
        token, place = shared_last.value
        if not len(token):
            return h
        i = np.minimum(np.searchsorted(token, h), len(token) - 1)
        return h[np.argsort(np.where(token[i] == h, place[i], 0), kind="stable")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, once = np.unique(b[0].to_numpy(), return_index=True)
            held, size = [], []
            for h in map(ordered, shingle_sets(b[1].take(pa.array(once)), words)):
                size.append(len(h))
                held.append(h[: len(h) - int(np.ceil(similarity * len(h) - EPS)) + 1] if len(h) else np.zeros(1, np.uint64))
            if held:
                each = np.array([len(h) for h in held])
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.repeat(np.array(size, np.int32), each)), pa.array(at.astype(np.int32)), pa.array(np.repeat(key, each))], ["token", "n", "at", "key"])

    return keyed.select("key", "text").mapInArrow(run, "token long, n int, at int, key long")


def possible(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles whose first common ones are at these places can be similar."""
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - EPS) & (np.minimum(n - at, m - to) >= similarity / (1 + similarity) * (n + m) - EPS)


def shared(rows: DataFrame, similarity: float) -> DataFrame:
    """prefixes() -> its distinct rows whose token two texts or more have, with `before`: a text next to it in the token's list where they can be similar.

    Rows come sorted by one number, most of the token and some of the key, so repeated rows are neighbours; each batch is put in order of (token, n, key). A
    task holds one batch, and of the tokens that may go on the last row and those that may be repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = None, np.zeros(0, bool)  # rows, and which have been sent
        for b in batches:
            if not b.num_rows:
                continue
            last = int(b[0][-1].as_py()) >> 24, int(b[3][-1].as_py()) & (1 << 24) - 1
            columns = [b[i].to_numpy() for i in range(4)]
            old = np.zeros(b.num_rows, bool)
            if held is not None:
                columns, old = [np.concatenate([x, y]) for x, y in zip(held, columns)], np.concatenate([np.ones(len(held[0]), bool), old])
            gone = np.concatenate([sent, np.zeros(b.num_rows, bool)])
            token, n, at, key = columns
            order = np.lexsort((~old, key, n, token))
            token, n, at, key, gone, old = (x[order] for x in (token, n, at, key, gone, old))
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
            token, n, at, key, gone, old = (x[new] for x in (token, n, at, key, gone, old))
            same = np.concatenate([[False], token[1:] == token[:-1]])
            out = (same | np.concatenate([same[1:], [False]])) & ~gone
            before = same.copy()
            before[1:] &= possible(n[1:], at[1:], n[:-1], at[:-1], similarity) & ~(old[1:] & old[:-1])
            link = gone & before  # rows that have been sent without this neighbour go again, for the pair alone
            put = out | link
            if put.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[put]), pa.array(n[put]), pa.array(at[put]), pa.array(key[put]), pa.array(np.roll(key, 1)[put], mask=~before[put]), pa.array(out[put])], ["token", "n", "at", "key", "before", "whole"])
            ends = np.concatenate([token[1:] != token[:-1], [True]])
            stay = (token >> 24 == last[0]) & (ends | (key & ((1 << 24) - 1) == last[1]))
            held, sent = [x[stay] for x in (token, n, at, key)], (gone | out)[stay]

    by = F.col("token").bitwiseAND(F.lit(-1 << 24)).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 24) - 1)))
    return rows.repartition(width(rows.sparkSession), "token").sortWithinPartitions(by).mapInArrow(run, "token long, n int, at int, key long, before long, whole boolean")


def candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """(token, n, at, key, component) -> pairs (a, b) of texts in different components that can be similar. The list of a token of more than BLOCK texts
    is parted into blocks, and blocks meet in pairs."""
    heavy = rows.groupBy(F.col("token").alias("t")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select("t", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")))
    dealt = rows.join(heavy, F.col("token") == F.col("t"), "left").withColumn("x", F.explode(meets))
    side = F.when(F.col("x.i") == F.col("x.j"), 0).when(own == F.col("x.i"), 1).otherwise(2).cast("byte")
    dealt = dealt.select(F.when(F.col("blocks").isNull(), F.col("token")).otherwise(F.xxhash64("token", "x.i", "x.j")).alias("task"), side.alias("side"), "n", "at", "key", "component")

    def pairs(task: np.ndarray, side: np.ndarray, n: np.ndarray, at: np.ndarray, key: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        last = np.searchsorted(task, task, "right")
        count = last - np.arange(len(task)) - 1
        ends, lo = np.cumsum(count), 0
        while lo < len(task):
            to = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
            x = np.repeat(np.arange(lo, to), count[lo:to])
            y = x + 1 + np.arange(len(x)) - np.repeat(ends[lo:to] - count[lo:to] - (ends[lo - 1] if lo else 0), count[lo:to])
            good = (group[x] != group[y]) & ((side[x] == 0) | (side[x] != side[y])) & possible(n[x], at[x], n[y], at[y], similarity)
            if good.any():
                p = np.unique(np.sort(np.stack([key[x[good]], key[y[good]]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])
            lo = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [c.to_numpy() for c in b.columns] if left is None else [np.concatenate([x, c.to_numpy()]) for x, c in zip(left, b.columns)]
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last task may go on
            yield from pairs(*(r[:cut] for r in rows))
            left = [r[cut:] for r in rows]
        if left is not None:
            yield from pairs(*left)

    return dealt.repartition(width(rows.sparkSession), "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long").distinct()


def sketch(h: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each of about as many bits, a power of two. Sets that differ in d shingles differ in d bits at most."""
    bits = 1 << max(6, int(len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """How many bits two sketches differ in, the larger folded to the size of the smaller."""
    x, y = (np.frombuffer(z, np.uint64) for z in (a, b))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(key, text) -> (key, n, bits), once for each batch and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, once = np.unique(b[0].to_numpy(), return_index=True)
            sets = [(len(h), sketch(h)) for h in shingle_sets(b[1].take(pa.array(once)), words)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([n for n, _ in sets], pa.int32()), pa.array([x for _, x in sets], pa.binary())], ["key", "n", "bits"])

    return texts.select("key", "text").mapInArrow(run, "key long, n int, bits binary")


def verified(pairs: DataFrame, keyed: DataFrame, words: int, similarity: float) -> DataFrame:
    """pairs (a, b) of keys -> those whose texts (keyed: key, text) are similar.

    Sketches meet first: sets of n and m shingles that differ in d share (n + m - d) / 2, so more than (1 - s) / (1 + s) (n + m) bits apart is too far. Only
    the texts of pairs that pass move, to be compared exactly.
    """
    ends = lambda pairs: pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    with Scratch(keyed.sparkSession) as made:
        need = written(ends(pairs))
        lean = written(sketches(parted(keyed.select("key", "text"), need, [F.col("key")])[0], words).join(need, F.col("key") == F.col("k")).groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                far = np.array([apart(x.as_py(), y.as_py()) for x, y in zip(b["x"], b["y"])], np.int64)
                good = far <= (1 - similarity) / (1 + similarity) * (b["n"].to_numpy().astype(np.int64) + b["m"].to_numpy()) + EPS
                yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        side = lambda k, n, x: lean.select(F.col("key").alias(k), F.col("n").alias(n), F.col("bits").alias(x))
        left = written(pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(near, "a long, b long"))
        made.drop(need, lean)
        need = written(ends(left))
        whole = written(parted(keyed.select("key", "text"), need, [F.col("key")])[0].join(need, F.col("key") == F.col("k")).select("key", "text").dropDuplicates(["key"]))
        both = left.join(whole.select(F.col("key").alias("a"), F.col("text").alias("s")), "a").join(whole.select(F.col("key").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for s, t in zip(shingle_sets(batch["s"], words), shingle_sets(batch["t"], words)):
                    n = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(n >= similarity * (len(s) + len(t) - n))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return made.outlive(both.mapInArrow(exact, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, tau: int = TAU) -> DataFrame:
    """(doc_id, text) -> (key, keep_id): for each distinct text (key: a hash) the id of the document that stays for its group."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    with Scratch(docs.sparkSession) as made:
        texts = written(keyed.groupBy("key").agg(F.min("doc_id").alias("first")))
        linked_first = fingerprint_pairs(keyed, words, tau)
        edges = verified(linked_first, keyed, words, similarity)
        near = components(edges)
        rows = written(shared(prefixes(keyed, words, similarity, frequent(keyed, texts.count(), words)), similarity))
        next_to = rows.where("before IS NOT NULL").select(F.least("key", "before").alias("a"), F.greatest("key", "before").alias("b")).distinct()
        for side in "ab":
            next_to = next_to.join(near.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
        next_to = next_to.where("NOT of_a <=> of_b OR of_a IS NULL").select("a", "b")
        next_to = written(next_to.join(linked_first, ["a", "b"], "left_anti"))
        edges = edges.unionByName(verified(next_to, keyed, words, similarity))
        near = components(edges).withColumnRenamed("node", "key")
        grouped = rows.where("whole").join(near, "key", "left").select("token", "n", "at", "key", F.coalesce("component", "key").alias("component"))
        rest = written(candidates(grouped, similarity).join(next_to.unionByName(linked_first), ["a", "b"], "left_anti"))
        made.drop(rows, next_to, linked_first)
        same = components(edges.unionByName(verified(rest, keyed, words, similarity))).withColumnRenamed("node", "key")
        same = written(same.join(texts, "key"))
        smallest = same.groupBy("component").agg(F.min("first").alias("smallest"))
        same = same.join(smallest, "component").select("key", "smallest")
        return made.outlive(texts.join(same, "key", "left").select("key", F.coalesce("smallest", "first").alias("keep_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) that stay: one document for each group of near duplicates, the one of the smallest id.

    Of repeated rows with the same id and text one stays. Only rows that may have to go move.
    """
    wide = docs.withColumn("__k", F.xxhash64("text"))
    with Scratch(docs.sparkSession) as made:
        keep = near_duplicates(docs.select("doc_id", "text"))
        rows = wide.groupBy(F.col("__k").alias("key"), F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(keep, "key").withColumn("stays", F.col("id").eqNullSafe(F.col("keep_id")))
        few = made.outlive(rows.where("n > 1 OR NOT stays").select(F.col("key").alias("__key"), F.col("id").alias("__id"), F.col("stays").alias("__stays")))
    near, rest = parted(wide, few.select("__key", "__id"), [F.col("__k"), F.col("doc_id")])
    near = near.join(few, (F.col("__k") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    once = near.where("__stays").dropDuplicates(["__k", "doc_id"])
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return rest.select(*kept).unionByName(near.where("__stays IS NULL").select(*kept)).unionByName(once.select(*kept))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
