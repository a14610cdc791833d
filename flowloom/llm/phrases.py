"""Phrase collocation mining by hierarchical pair naming.

Texts are parted into chunks, whose words become numbers of a small dictionary of the chunk. A word's name is the place (chunk, number) that has it first, so names
need no hash and no counter. Two neighbours with names are a pair; a chunk sends each of its pairs once, with a count, and the pairs that are frequent over all
chunks get names in the same way: a pair of words is a phrase of two, a pair of overlapping phrases of k - 1 words is one of k. A phrase's two parents are thus
what is left of it without its last and without its first word, and all its cuts and all that lies within it are found by following them.

A chunk holds about 16 MB of text; what moves are its distinct words and pairs of frequent neighbours, never single occurrences, and a frequent word is one row of
every chunk.

Null texts are empty; a null lang counts as `und`; ids and other columns play no part; repeated rows are counted each; a text of any length goes into one chunk
whole; equal scores are ordered by count and phrase; an empty table gives no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, width, written

CHUNK, SLICE = 16 << 20, 2 << 20
#: A place is chunk * PLACES + number.
PLACES = 1 << 27
BREAK = b"\xff"  # no byte of UTF-8
#: ASCII capitals become small, tabs spaces and what ends a piece the break.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)


def tokens(text: bytes) -> list[bytes]:
    """A break, then words and breaks in order."""
    return [BREAK, *text.translate(FOLD).replace(BREAK, b" \xff ").split()]


def numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Texts as numbers, and the words that the numbers from 1 stand for; 0 is a break."""
    parts, held, size = [], [], 0
    for t in [*texts, None]:
        if held and (t is None or size + len(t) > SLICE):
            parts.append(pa.array(tokens(BREAK.join(held)), pa.binary()).dictionary_encode())
            held, size = [], 0
        if t is not None:
            held.append(t)
            size += len(t)
    both = pa.chunked_array(parts).unify_dictionaries()
    return np.concatenate([p.indices.to_numpy() for p in both.chunks]), both.chunk(0).dictionary.slice(1)


def coded(docs: DataFrame) -> DataFrame:
    """Chunks of one lang each: (chunk, lang, seq: 32-bit numbers, words, counts)."""
    names = ["chunk", "lang", "seq", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        first, made, size = TaskContext.get().partitionId() << 12, 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, texts in held.items():
                seq, words = numbered(texts)
                counts = np.bincount(seq, minlength=len(words) + 1)[1:].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words.cast(pa.string()), pa.array(counts))]
                yield pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([lang]), pa.array([seq.astype(np.int32).tobytes()], pa.binary()), *lists], names)
                made += 1

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                t = text.as_buffer().to_pybytes()
                held.setdefault(lang, []).append(t)
                size += len(t) + 1
                if size >= CHUNK:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    rows = docs.where("text <> ''").selectExpr("coalesce(lang, 'und') AS lang", "cast(text AS binary) AS text")
    return rows.mapInArrow(run, "chunk long, lang string, seq binary, words array<string>, counts array<int>")


def pairs_of(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbours that both have a name (two numbers in one), their counts, and the sequence in numbers of pairs from 1."""
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    pairs, where, counts = np.unique(seq[at].astype(np.int64) << 32 | seq[at + 1], return_inverse=True, return_counts=True)
    if len(pairs) >= PLACES:
        raise ValueError(f"a chunk has {len(pairs)} pairs, but places number {PLACES}")
    new = np.zeros(len(seq), np.int32)
    new[at] = where + 1
    return pairs, counts, new


def neighbours(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk, seq, names) -> their distinct pairs of names (place, left, right, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, chunk in enumerate(b["chunk"].to_pylist()):
                pairs, counts, _ = pairs_of(np.frombuffer(b["seq"][i].as_buffer(), np.int32))
                names = b["names"][i].values.to_numpy()
                for s in range(0, len(pairs), 1 << 16):
                    p = pairs[s : s + (1 << 16)]
                    columns = chunk * PLACES + np.arange(s + 1, s + 1 + len(p)), names[(p >> 32) - 1], names[(p & 0xFFFFFFFF) - 1], counts[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["place", "left", "right", "c"])

    return chunks.select("chunk", "seq", "names").mapInArrow(run, "place long, left long, right long, c long")


def renamed(chunks: DataFrame, named: DataFrame, words: bool) -> DataFrame:
    """Chunks in numbers of the named (place, id): of words, or of the pairs that their sequence has. What has no name becomes 0."""

    def one(old: pa.Table, new: pa.Table) -> pa.Table:
        if not (len(old) and len(new)):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.list_(pa.int64()))], ["chunk", "seq", "names"])
        seq = np.frombuffer(old["seq"][0].as_buffer(), np.int32)
        seq = seq if words else pairs_of(seq)[2]
        at, ids = new["at"].to_numpy(), new["id"].to_numpy()
        to = np.zeros(max(int(seq.max(initial=0)), int(at.max())) + 1, np.int32)
        to[at] = np.arange(1, len(at) + 1)
        return pa.table([old["chunk"].slice(0, 1), pa.array([to[seq].tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["chunk", "seq", "names"])

    named = named.selectExpr(f"place div {PLACES} AS chunk", f"place % {PLACES} AS at", "id")
    sides = chunks.select("chunk", "seq").groupBy("chunk"), named.groupBy("chunk")
    return sides[0].cogroup(sides[1]).applyInArrow(one, "chunk long, seq binary, names array<long>")


def frequent(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """Rows (place, key, c) of the keys that occur `least` times in all as (place, id): the key's name is its first place. Rows at that place have the key and its number f.

    One exchange; a key has a row per chunk.
    """
    w = Window.partitionBy(*key)
    out = rows.select("*", F.sum("c").over(w).alias("f"), F.min("place").over(w).alias("id")).where(F.col("f") >= least)
    return out.select("place", "id", *[F.when(F.col("id") == F.col("place"), F.col(c)).alias(c) for c in (*key, "f")])


def joined(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """Names of pairs (id, left, right, f) with what their parents give: lang, phrase, its last word and the counts of its first words and of its last ones, by length."""
    side = lambda s: below.select(*[F.col(c).alias(f"{s}_{c}") for c in below.columns])
    both = pairs.join(side("l"), F.col("left") == F.col("l_id")).join(side("r"), F.col("right") == F.col("r_id"))
    return both.select(
        "id", "left", "right", "f", F.col("l_lang").alias("lang"), F.concat_ws(" ", "l_phrase", "r_last").alias("phrase"), F.col("r_last").alias("last"),
        F.concat("l_heads", F.array("l_f")).alias("heads"), F.concat("r_tails", F.array("r_f")).alias("tails"),
    )


def scored(names: DataFrame, longer: DataFrame | None, words: int, inside: int) -> DataFrame:
    """Phrases of so many words with their lowest-scoring cut, but for those that a longer one explains: a longer phrase has a parent's name, and none that it lies in is more frequent than the next longer ones."""
    if longer is not None:
        most = longer.select(F.explode(F.array("left", "right")).alias("part"), F.col("f").alias("most")).groupBy("part").agg(F.max("most").alias("most"))
        names = names.join(most, F.col("id") == F.col("part"), "left").where(f"most IS NULL OR 100 * most < {inside} * f")
    whole = lambda x: f"cast({x} AS decimal(15, 0))"  # noqa: E731  counts below 10^15 keep the products within 38 digits
    cut = f"named_struct('score', (cast(1000000 AS decimal(7, 0)) * {whole('f')} * {whole('f')}) div ({whole('heads[k - 1]')} * {whole(f'tails[{words} - k - 1]')}), 'k', k, 'l', heads[k - 1], 'r', tails[{words} - k - 1])"
    return names.selectExpr("lang", "phrase", "f AS a", f"array_min(transform(sequence(1, {words - 1}), k -> {cut})) AS x").selectExpr("lang", "phrase", "a", "x.l AS l", "x.r AS r", "x.score AS score")


def cut_at(bins: DataFrame, bin_: str, top: int) -> DataFrame:
    """Counts n by lang and bin, the first of them with `above` rows over it -> the bin of each lang that its row `top` falls into, or its lowest, and the rows above that bin."""
    before = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc(bin_)).rowsBetween(Window.unboundedPreceding, -1))
    rows = bins.select("lang", bin_, (F.col("above") + F.coalesce(before, F.lit(0))).alias("above")).where(F.col("above") < top)
    return rows.groupBy("lang").agg(F.min(bin_).alias(bin_), F.max("above").alias("above"))


def best(rows: DataFrame, top: int, buckets: int) -> DataFrame:
    """The first `top` rows of each lang by score, count and phrase, with their rank.

    Scores do not pass a million: counts by the thousand and then by single scores within one thousand (at most 1,001 bins for a lang) give the score of the last
    row, and counts of its ties by their number of occurrences give that. Ties in both are cut by buckets, so that a task sorts about `top` rows and no more than
    buckets * top, however many phrases a lang has.
    """
    count = F.count(F.lit(1)).alias("n")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    each = lambda t: t.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))  # noqa: E731  a row per lang, met in every bucket
    coarse = cut_at(rows.groupBy("lang", F.expr("score div 1000").alias("bin")).agg(count).withColumn("above", F.lit(0)), "bin", top)
    fine = rows.join(each(coarse), ["lang", "b"]).where("score div 1000 = bin").groupBy("lang", "above", "score").agg(count)
    least = cut_at(fine, "score", top).withColumnRenamed("score", "least")
    ties = rows.join(each(least), ["lang", "b"]).where("score = least").groupBy("lang", "least", "above", F.col("a").alias("often")).agg(count)
    least = least.drop("above").join(cut_at(ties, "often", top).drop("above"), "lang")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    out = rows.join(each(least), ["lang", "b"]).where("score > least OR score = least AND a >= often")
    out = out.withColumn("in_bucket", F.row_number().over(Window.partitionBy("lang", "b").orderBy(*order))).where(F.col("in_bucket") <= top)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("least", "often", "b", "in_bucket")


def collocations(docs: DataFrame, words: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """Each lang's phrases of 2 to `words` words that occur at least `least` times, the first `top` by score: lang, rank, phrase, a, l, r, n, score.

    inside: a phrase goes if a longer one has so many hundredths of its occurrences.
    """
    spark = docs.sparkSession
    with Scratch(spark) as made:
        chunks = start = written(coded(docs))
        totals = start.selectExpr("lang", "aggregate(counts, 0L, (s, x) -> s + x) AS n").groupBy("lang").agg(F.sum("n").alias("n"))
        local = start.selectExpr("chunk", "lang", "posexplode(arrays_zip(words, counts)) AS (i, x)").selectExpr(f"chunk * {PLACES} + i + 1 AS place", "lang", "x.words AS word", "cast(x.counts AS bigint) AS c")
        named = written(frequent(local, ["lang", "word"], least))
        none = F.array().cast("array<bigint>")
        levels = [named.where("f IS NOT NULL").select("id", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails"))]
        for k in range(2, words + 1):
            new = written(renamed(chunks, named, k == 2))
            if chunks is not start:
                made.drop(chunks)
            chunks, pairs = new, neighbours(new)
            if k < words:
                named = written(frequent(pairs, ["left", "right"], least))
                names = named.where("f IS NOT NULL")
            else:
                names = pairs.groupBy("left", "right").agg(F.sum("c").alias("f")).where(F.col("f") >= least).withColumn("id", F.lit(None).cast("long"))
            levels.append(written(joined(names, levels[-1].select("id", "lang", "phrase", "last", "f", "heads", "tails"))))
        found = [scored(names, levels[k] if k < words else None, k, inside) for k, names in enumerate(levels[1:], 2)]
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        out = best(written(rows), top, width(spark)).join(totals, "lang")
        return made.outlive(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_PIECES = r"[.,;:!?\x0A-\x0D]"
#: Words by lang and piece, phrases of one to three words with their counts, and of each phrase its cuts.
SQL = rf"""
WITH low AS (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
cut AS (SELECT lang, unnest(regexp_split_to_array(text, '{_PIECES}')) AS piece FROM low),
pieces AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS t(k)),
f AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
parts AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, k, a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 :], ' ') AS tail FROM parts, (VALUES (1), (2)) AS t(c) WHERE c < k),
valued AS (SELECT cuts.lang, cuts.phrase, cuts.k, cuts.a, c, x.a AS l, y.a AS r, CAST((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
 FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
held AS (SELECT lang, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase, a AS longer FROM parts WHERE k = 3),
most AS (SELECT lang, phrase, max(longer) AS longer FROM held GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN most ON k = 2 AND most.lang = lowest.lang AND most.phrase = lowest.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
