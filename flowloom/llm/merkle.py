"""Merkle manifest of a dataset, and proofs of its rows by coordinate lookup.

A row's leaf is a digest of its fields. The leaves of a group (a lang) are numbered by a range sort, and every `fan` consecutive ones are a run, whose digest is a node
of the next level, up to the group's subroot; the subroots of all groups are the leaves of one more tree. Nodes are written as a table by (tree, level, idx), each
with its children's digests.

A proof needs the siblings of a leaf and of all nodes above it. Their coordinates follow from the leaf's index and the group's size alone: the leaves of a run share
all of them but for the place that each leaves out, so a run asks once for each level, joins the table of nodes, and puts the answers in order. A node high in a tree
is asked for by all the runs below it: it is there once for every fan^3 runs, so that no coordinate is hot. The siblings are then joined into one text, and the leaf
is folded with them up to the root.

Null fields are `-`, a null lang is a group of its own (the first), null ids come first in their group and are never tampered with; rows of equal ids are leaves each,
by their digests; equal rows are leaves each; an empty table has no leaves; columns beyond the five of documents play no part. Texts are hashed where they are read
and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, written

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(fields: dict[str, Column]) -> Column:
    """32 bytes over the fields in order, each with its length in UTF-8 bytes."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(one, fields.values())), 256))


def leaves(docs: DataFrame, group: str = "lang") -> DataFrame:
    """(tree, doc_id, digest, tampered, place): tampered is the digest with the text's capitals gone, for rows that are tampered with; place tells rows apart."""
    fields = {c: F.col(c) for c in FIELDS}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"), "doc_id", digest(fields).alias("digest"),
        F.when(changed, digest(fields | {"text": F.translate("text", UPPER, LOWER)})).alias("tampered"), F.monotonically_increasing_id().alias("place"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, their place in their tree from 0 by order, and n, the tree's size: a range sort over all trees, then counts per tree and part of it."""
    part = F.shiftright("at", 33)
    rows = written(rows.orderBy("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    parts = rows.groupBy("tree", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("tree").alias("t"), "part", (before - F.col("first")).alias("shift"), F.sum("c").over(tree).alias("n"))
    return rows.join(parts, (F.col("tree") == F.col("t")) & (part == F.col("part"))).withColumn("idx", F.col("at") + F.col("shift")).drop("t", "part", "shift", "at")


def runs_of(rows: DataFrame, fan: int, more: list[str]) -> DataFrame:
    """Rows (tree, n, idx, digest, more) in runs: (tree, n, run, kids: the digests one after the other, members)."""
    run = F.floor(F.col("idx") / fan).alias("run")
    out = rows.groupBy("tree", "n", run).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", *more))).alias("members"))
    return out.withColumn("kids", F.expr("aggregate(members, cast('' AS binary), (s, x) -> concat(s, x.digest))"))


def grown(rows: DataFrame, order: list[str], fan: int, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves (tree, digest, more) -> their runs, and the nodes above them: (tree, n: leaves of the tree, level, idx, m: nodes of the level, kids, digest)."""
    runs = written(runs_of(numbered(rows, order), fan, more))
    most = runs.agg(F.max("n")).collect()[0][0] or 0
    kids = F.unhex(F.sha2(F.lower(F.hex("kids")), 256))
    above = lambda m: F.ceil(F.col(m) / fan)
    level = written(runs.where("n > 1").select("tree", "n", F.lit(1).alias("level"), F.col("run").alias("idx"), above("n").alias("m"), "kids", kids.alias("digest")))
    nodes, size, k = level, -(-most // fan), 1
    while size > 1:
        k, size = k + 1, -(-size // fan)
        rows = level.where("m > 1").groupBy("tree", "n", "m", F.floor(F.col("idx") / fan).alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("x"))
        rows = rows.withColumn("kids", F.expr("aggregate(x, cast('' AS binary), (s, x) -> concat(s, x.digest))"))
        level = written(rows.select("tree", "n", F.lit(k).alias("level"), F.col("run").alias("idx"), above("m").alias("m"), "kids", kids.alias("digest")))
        nodes = nodes.unionByName(level)
    return runs, nodes


def roots(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, n, digest) of each tree; a lone leaf is its tree's root."""
    lone = runs.where("n = 1").select("tree", "n", F.col("members")[0]["digest"].alias("digest"))
    return nodes.where("m = 1").select("tree", "n", "digest").unionByName(lone)


STEP = "struct<a string, b string>"


def around(kids: str, place: str) -> str:
    """The siblings before a place and after it, in hex."""
    return f"named_struct('a', lower(hex(substring({kids}, 1, cast(32 * ({place}) AS int)))), 'b', lower(hex(substring({kids}, cast(32 * ({place}) + 33 AS int)))))"


def proofs(runs: DataFrame, nodes: DataFrame, fan: int, tails: DataFrame | None = None) -> DataFrame:
    """A row per leaf with its steps, from its own run upwards: the siblings of each level before and after it. tails (tree, n, tail) is what each tree's leaves get besides, with its steps after their own."""
    share = fan**3
    powers = [fan**k for k in range(64) if fan**k < 1 << 62]
    power = lambda k: f"element_at(array({', '.join(f'{p}L' for p in powers)}), cast({k} AS int))"  # noqa: E731  fan to the k - 1
    of = tails.schema["tail"].dataType.simpleString() if tails is not None else f"struct<steps array<{STEP}>>"

    # levels from 2 up, and level 0, the tail; a run of level k's node k - 2 levels below it is the place it comes from
    levels = f"filter(array({', '.join(f'{k}' for k in range(2, len(powers) + 1))}), k -> {power('k')} < n)"
    asked = runs.selectExpr("tree", "run", "n", f"inline(concat({'array(named_struct(\"level\", 0, \"place\", 0L)), ' if tails is not None else ''}transform({levels}, k -> named_struct('level', k, 'place', (run div {power('k - 1')}) % {fan}))))")
    asked = asked.selectExpr("tree", "run", "level", "place", f"CASE WHEN level = 0 THEN 0L ELSE run div {power('level')} END AS idx", f"run div {share} AS copy")
    below = f"sequence((idx * {power('level')}) div {share}, (least((idx + 1) * {power('level')}, cast(ceil(n / {fan}) AS bigint)) - 1) div {share})"
    known = nodes.where("level > 1").selectExpr("tree", "level", "idx", "kids", f"cast(NULL AS {of}) AS tail", f"explode({below}) AS copy")
    if tails is not None:
        known = known.unionByName(tails.selectExpr("tree", "0 AS level", "0L AS idx", "cast(NULL AS binary) AS kids", "tail", f"explode(sequence(0L, (cast(ceil(n / {fan}) AS bigint) - 1) div {share})) AS copy"))
    answers = asked.join(known, ["tree", "level", "idx", "copy"]).selectExpr("tree", "run", f"CASE WHEN level > 0 THEN named_struct('level', level, 'step', {around('kids', 'place')}) END AS up", "tail")

    both = runs.select("tree", "run", "n", "kids", "members").unionByName(answers, allowMissingColumns=True)
    once = lambda c: F.first(c, ignorenulls=True).alias(c)
    whole = both.groupBy("tree", "run").agg(once("n"), once("kids"), once("members"), once("tail"), F.sort_array(F.collect_list("up")).alias("up"))
    rows = whole.selectExpr("tree", "n", "kids", "tail", f"concat(transform(up, x -> x.step), coalesce(tail.steps, cast(array() AS array<{STEP}>))) AS up", "posexplode(members) AS (place, leaf)")
    own = f"CASE WHEN n > 1 THEN array({around('kids', 'place')}) ELSE cast(array() AS array<{STEP}>) END"
    return rows.selectExpr("tree", "n", "leaf.*", "tail", f"concat({own}, up) AS steps")


def folded(leaf: str) -> str:
    """The root that a leaf (in hex) and its steps give."""
    return f"aggregate(steps, {leaf}, (h, x) -> sha2(concat(x.a, h, x.b), 256))"


def proven(docs: DataFrame, fan: int = 8) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents."""
    with Scratch(docs.sparkSession) as made:
        runs, nodes = grown(written(leaves(docs)), ["doc_id", "digest", "place"], fan, ["doc_id", "tampered"])
        subs = written(roots(runs, nodes))
        top_runs, top_nodes = grown(subs.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), "digest"), ["name"], fan, ["name", "size"])
        root = roots(top_runs, top_nodes).select("tree", F.lower(F.hex("digest")).alias("root"))
        tails = proofs(top_runs, top_nodes, fan).join(root, "tree")
        tails = written(tails.select(F.col("name").alias("tree"), F.col("size").alias("n"), F.struct(F.lower(F.hex("digest")).alias("subroot"), "root", "steps").alias("tail")))
        rows = proofs(runs, nodes, fan, tails).selectExpr(
            "doc_id", "lower(hex(digest)) AS leaf", "tail.subroot AS subroot", "tail.root AS root", "sha2(array_join(transform(steps, x -> concat(x.a, x.b)), ''), 256) AS proof_sha256", f"{folded('lower(hex(coalesce(tampered, digest)))')} AS folded_root",
        )
        return made.outlive(rows.withColumn("verified", F.col("folded_root") == F.col("root")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proven(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_field = lambda c, text="text": f"coalesce(strlen(CAST({c.replace('text', text)} AS VARCHAR)) || ':' || CAST({c.replace('text', text)} AS VARCHAR), '-')"
_leaf = lambda text="text": "sha256(" + " || ".join(_field(c, text) for c in FIELDS) + ")"


def _levels(name: str, base: str) -> str:
    """Nodes of all levels over base (tree, idx, digest)."""
    return f"""{name} AS (SELECT tree, 0 AS level, idx, digest, count(*) OVER (PARTITION BY tree) AS m FROM {base}
 UNION ALL SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (m + 7) // 8 FROM {name} WHERE m > 1 GROUP BY tree, level, idx // 8, m)"""


SQL = f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
l0 AS (SELECT coalesce('=' || lang, '') AS tree, doc_id, {_leaf()} AS digest, {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS low,
 xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 0 AS changed FROM documents, tab),
lf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM l0),
{_levels("nd", "lf")},
sub AS (SELECT tree AS name, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, '' AS tree FROM nd WHERE m = 1),
{_levels("tp", "sub")},
root AS (SELECT digest AS root FROM tp WHERE m = 1),
up AS (SELECT lf.tree, lf.idx AS leaf, nd.level, lf.idx // CAST(8 ** nd.level AS BIGINT) AS mine, nd.idx, nd.digest FROM lf JOIN nd ON nd.tree = lf.tree AND nd.m > 1 AND nd.idx // 8 = lf.idx // CAST(8 ** (nd.level + 1) AS BIGINT)
 UNION ALL SELECT lf.tree, lf.idx, 100 + tp.level, sub.idx // CAST(8 ** tp.level AS BIGINT), tp.idx, tp.digest FROM lf JOIN sub ON name = lf.tree JOIN tp ON tp.m > 1 AND tp.idx // 8 = sub.idx // CAST(8 ** (tp.level + 1) AS BIGINT)),
st AS (SELECT tree, leaf, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx < mine), '') AS a, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx > mine), '') AS b, row_number() OVER (PARTITION BY tree, leaf ORDER BY level) AS s FROM up GROUP BY tree, leaf, level),
fo AS (SELECT tree, idx AS leaf, CAST(0 AS BIGINT) AS s, CASE WHEN coalesce(changed, false) THEN low ELSE digest END AS h FROM lf UNION ALL SELECT fo.tree, fo.leaf, st.s, sha256(st.a || h || st.b) FROM fo JOIN st ON st.tree = fo.tree AND st.leaf = fo.leaf AND st.s = fo.s + 1),
pr AS (SELECT tree, leaf, sha256(string_agg(a || b, '' ORDER BY s)) AS proof, max(s) AS s FROM st GROUP BY tree, leaf)
SELECT doc_id, lf.digest AS leaf, sub.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM lf JOIN sub ON sub.name = lf.tree CROSS JOIN root LEFT JOIN pr ON pr.tree = lf.tree AND pr.leaf = lf.idx JOIN fo ON fo.tree = lf.tree AND fo.leaf = lf.idx AND fo.s = coalesce(pr.s, 0)"""
