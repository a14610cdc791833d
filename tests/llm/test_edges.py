"""The pipeline's stages and the registered queries against brute force, and what no operator may stumble over: clashing names, empty tables, long and repeated texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOC, brute_lines, closed, prose, words

import corpus_pipeline
from flowloom.llm import chat, common, ctw, embeddings, lines, media, mixing, packing, quality, registry, sharding, simhash


def brute_quality(spark, rows, labels):
    """Scores of all rows by ridge regression in plain numpy on the same features, learned from labels (doc_id -> 0 or 1)."""
    key = {r["i"]: (r["key"], r["late"], r["tie"]) for r in spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, doc_id long, text string").select("i", F.xxhash64(F.lit(quality.SEED), "doc_id").alias("key"), (F.pmod(F.xxhash64(F.xxhash64(F.lit(quality.SEED), "doc_id")), F.lit(5)) == 0).alias("late"), F.xxhash64("text").alias("tie")).collect()}
    x = np.array([quality.statistics((r[1] or "").encode()) for r in rows], np.float32).astype(float)
    taught = {}
    for i, r in enumerate(rows):
        if r[0] in labels and (r[0] not in taught or key[i][2] < key[taught[r[0]]][2]):
            taught[r[0]] = i
    learn, late = ([i for i in taught.values() if key[i][1] == when] for when in (False, True))
    m = quality.Model(x.shape[1])
    m.mean, s = x[learn].mean(0), x[learn].std(0)
    m.scale = np.where(s > 1e-9, s, 1.0)
    z, y = m.z(x[learn]), np.array([float(labels[rows[i][0]]) for i in learn])
    m.beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    m.at, m.value = quality.isotonic(m.raw(x[late]), np.array([float(labels[rows[i][0]]) for i in late]))
    return m.score(x)


def brute_near(rows):
    """The smallest id of each row's group of near duplicates, by all pairs."""
    sets = [set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set() for w in (words(r[1]) for r in rows)]
    near = lambda s, t: s == t or len(s & t) >= 0.8 * len(s | t)
    root = closed(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])])
    least = {}
    for r, k in zip(rows, root):
        least[k] = min(least.get(k, 10**9), 10**9 if r[0] is None else r[0])
    return [least[k] for k in root]


def brute_mix(spark, rows, weights, repeats=3):
    """How often each row is taken, by sorting every pass by its virtual finish time."""
    hashed = {r["i"]: (r["b"], r["h"], r["x"]) for r in spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, doc_id long, text string").withColumn("h", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")).select("i", "h", mixing.spread(F.col("h"), common.buckets_for(len(rows))).alias("b"), F.xxhash64("h").alias("x")).collect()}
    size = [len(words(r[1])) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    total, weight = sum(size), {s: weights[i % len(weights)] for i, s in enumerate(names)}
    own = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in names}
    target, free, left = {}, list(names), float(total)
    while free:  # stop those that pass their limit, share the rest again
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > repeats * own[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = float(repeats * own[s])
            left -= target[s]
            free.remove(s)
    passes = []
    for s in names:
        order = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (hashed[i][0], hashed[i][1], rows[i][0] is None, rows[i][0] or 0, size[i]))
        for c in range(repeats):
            at = c * own[s]
            for i in order:
                if size[i] and at < target[s]:
                    passes.append(((at + size[i]) / target[s], i))
                at += size[i]
    taken, used = [0] * len(rows), 0
    for _, i in sorted(passes):
        if used + size[i] > total:
            break
        used += size[i]
        taken[i] += 1
    return taken


@pytest.fixture(scope="module")
def corpus():
    """Documents of three sources with junk, copies, near copies, shared passages within and across lines, blanks and nulls; and labels."""
    rnd = random.Random(12)
    out = []
    for i in range(150):
        text = prose(rnd, rnd.choice([3, 25, 60, 120]))
        out.append((i, text if i % 4 else "!!".join(text.upper().split()), "en", f"s{i % 3}", len(text)))
    long = [w for w in prose(rnd, 90).split(" ")]
    for i in range(150, 170):
        t = list(long)
        t[rnd.randrange(90)] = "changed"
        out.append((i, " ".join(t), "en", "s1", 0))
    passage = prose(rnd, 40)
    out += [(170 + i, f"{prose(rnd, 20)} {passage} {prose(rnd, 15)}\n{prose(rnd, 8)}", "en", "s2", 0) for i in range(6)]
    out += [(180, None, None, None, None), (181, "", "en", None, 0), (182, " \n\t ", "en", "s0", 3), (183, out[5][1], "en", "s0", 0), (184, out[5][1], "en", "s2", 0)]
    return out, {i: int(i % 4 > 0) for i in range(120)}


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus[0], DOC).withColumn("extra", F.lit(1)).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(k, v, 0) for k, v in corpus[1].items()], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((80, 64)).astype(np.float32)
    x[40:60] = x[:20] + rnd.standard_normal((20, 64)).astype(np.float32) * 0.1
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    spark.createDataFrame([(0, 0, "user", "hi"), (0, 1, "assistant", "<|endoftext|> yes"), (-7, 0, "user", "taken")], "conv_id long, turn long, role string, text string").write.parquet(str(path / "conversations.parquet"))
    hosts = ("a.example.com", "www.example.com", "x.net", "y.org")
    spark.createDataFrame([(i, f"http://{hosts[i % 4]}/{('en', 'es', 'fr')[i % 3]}/{i}", "<p>") for i in range(60)], "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    return str(path)


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] is None, r[1]))


def test_pipeline_equals_brute_force(spark, corpus, folder):
    """Each stage on the brute result of the stage before it."""
    rows, labels = corpus
    frame = lambda rows: spark.createDataFrame(rows, DOC).repartition(3)
    got = lambda i, rows: by_id([tuple(r) for r in corpus_pipeline.STAGES[i][1](spark, frame(rows), folder).collect()])
    score = brute_quality(spark, rows, labels)
    good = [r for r, s in zip(rows, score) if s >= quality.CUT]
    assert 0 < len(good) < len(rows) and got(0, rows) == by_id(good)
    good = by_id(good)
    left = got(1, good)
    assert [words(r[1]) for r in left] == brute_lines([r[1] for r in good])
    assert all(r[4] == (len(r[1]) if r[1] != g[1] else g[4]) for r, g in zip(left, good) if r[1] is not None) and any(r[1] != g[1] for r, g in zip(left, good))
    keep = brute_near(left)
    alone = [r for r, k in zip(left, keep) if r[0] == k]
    assert len(alone) < len(left) and got(2, left) == alone
    taken = brute_mix(spark, alone, corpus_pipeline.WEIGHTS)
    mixed = by_id([r for r, n in zip(alone, taken) for _ in range(n)])
    assert got(3, alone) == mixed
    packed = got(4, mixed)
    e = packing.encoder(packing.default_vocabulary())
    assert sum(r[3] for r in packed) == sum(len(e(r[1] or "")) + 1 for r in mixed)
    assert sorted(corpus_pipeline.run(spark, folder).agg(F.sum("length"), F.count("*")).collect()[0]) == sorted((sum(r[3] for r in packed), len(packed)))


def test_pipeline_on_an_empty_table(spark, folder):
    d = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, folder)
        assert d.count() == 0
        d = spark.createDataFrame([], DOC)


def test_queries_of_the_registry(spark, corpus, folder):
    """The opN queries themselves: columns, folds, digests, the probe conversation."""
    rows, labels = corpus
    q = registry.queries()
    ran = {n: [r.asDict() for r in q[n](spark, folder).collect()] for n in q}
    crc = lambda x: zlib.crc32(str(x).encode()) % 5
    assert all(len(ran[n]) == len(rows) for n in q if n not in ("op7_embeddings", "op9_chat", "op10_packing", "op12_phrases", "op13_urls"))
    one = {r["doc_id"]: r for r in ran["op1_mixing"]}
    assert {i: one[i]["copies"] for i in one} == {r[0]: n for r, n in zip(rows, brute_mix(spark, rows, [1, 2, 3]))}
    assert all(one[r[0]]["taken"] == one[r[0]]["copies"] * len(words(r[1])) for r in rows)
    two = {r["doc_id"]: r for r in ran["op2_lines"]}
    left = dict(zip((r[0] for r in by_id(rows)), brute_lines([r[1] for r in by_id(rows)])))
    assert all(two[r[0]]["words_removed"] == len(words(r[1])) - len(left[r[0]]) for r in rows)
    assert all(len(r["fingerprint"]) == 16 and r["component_id"] <= r["doc_id"] for r in ran["op3_simhash"])
    four = {r["doc_id"]: r for r in ran["op4_sharding"]}
    for r in rows:
        raw = (r[1] or "").encode()
        assert (four[r[0]]["size"], four[r[0]]["text_crc32"], four[r[0]]["law"], four[r[0]]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    five = {r["doc_id"]: r for r in ran["op5_quality"]}
    want = brute_quality(spark, rows, {k: v for k, v in labels.items() if crc(k)})
    for r, s in zip(rows, want):
        assert five[r[0]]["score"] == pytest.approx(s, abs=1e-6) and five[r[0]]["held_out"] == (crc(r[0]) == 0) and five[r[0]]["predicted"] == int(five[r[0]]["score"] >= 0.3)
    assert all(r["held_out"] == (crc(r["doc_id"]) == 1) for r in ran["op6_scoring"])
    assert sum(r["n_links"] for r in ran["op7_embeddings"]) >= 38 and len(ran["op7_embeddings"]) == 80
    assert all(r["payload_bytes"] % 576 == 0 and r["n_bytes"] == len((dict((x[0], x[1]) for x in rows)[r["doc_id"]] or "").encode()) for r in ran["op8_media"])
    nine = {r["conv_id"]: r for r in ran["op9_chat"]}
    assert (nine[-7]["n_turns"], nine[-7]["loss_chars"]) == (3, len(chat.PROBE)) and nine[0]["loss_chars"] == len("<|endoftext|> yes")
    assert sum(r["length"] for r in ran["op10_packing"]) == sum(len(packing.encoder(packing.default_vocabulary())(r[1] or "")) + 1 for r in rows)
    assert len({r["root"] for r in ran["op11_merkle"]}) == 1 and all(r["verified"] == (r["folded_root"] == r["root"]) for r in ran["op11_merkle"])
    assert all(r["a"] >= 10 and r["a"] <= min(r["l"], r["r"]) and r["score"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in ran["op12_phrases"])
    thirteen = {r["page_id"]: (r["rule"], r["verdict"]) for r in ran["op13_urls"]}
    assert len(thirteen) == 60 and thirteen[0] == ("example.com/en/", "block") and thirteen[9] == ("www.example.com/en/", "allow") and thirteen[10] == ("net/es/", "block")


CLASHES = ["target", "source_size", "target_budget", "place", "shard", "slot", "shard_key", "line_count", "lines_removed", "words_removed", "media", "x", "score", "fp", "key", "n", "v", "tie", "bucket", "rank", "spans", "at"]


def test_clashing_names(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, 30), f"s{i % 2}", *range(len(CLASHES))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in CLASHES))
    own = lambda df, replaced: {c: [r[0] for r in df.select(c).distinct().collect()] == [i] for i, c in enumerate(CLASHES) if c in df.columns and c not in replaced}
    for df, replaced in (
        (mixing.mixed(d, [1, 2]), ()), (sharding.sharded(d, 2), ("shard", "slot")), (lines.deduplicated(d), ("line_count", "lines_removed", "words_removed")), (simhash.deduplicated(d), ()),
        (media.stored(d, "text"), ("media",)), (quality.scored(d, quality.Model(len(quality.STATISTICS))), ("score",)), (ctw.lm_scores(d, F.lit(True), 2), ("score",)),
    ):
        assert set(d.columns) - {"text"} <= set(df.columns) and len(set(df.columns)) == len(df.columns)
        kept = own(df, replaced)
        assert len(kept) == len(CLASHES) - len(replaced) and all(kept.values())
    assert packing.packed(packing.pieces(d)).count() == 40 and simhash.linked(d).count() == 40 and mixing.mix(d, [1]).count() == 40


def test_long_and_repeated_texts(spark):
    """A megabyte in one text, one word of that length, and a third of all rows equal in id and text."""
    rnd = random.Random(8)
    big = prose(rnd, 200_000)
    rows = [(0, big), (1, "w" * 10**6), (2, " " * 10**6), (3, f"{big} end"), *[(5, prose(random.Random(1), 40))] * 30, *[(i, prose(rnd, 30)) for i in range(10, 60)]]
    d = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(4)
    assert simhash.linked(d).count() == len(rows) and simhash.deduplicated(d).count() == 4 - 1 + 1 + 50
    out = {r["doc_id"]: r["words_removed"] for r in lines.deduplicated(d).collect()}
    assert out[3] > 190_000 and out[5] == 0
    copies = [r["mix_copies"] for r in mixing.mix(d, [1]).where("doc_id = 5").collect()]
    assert len(copies) == 30 and mixing.mixed(d, [1]).where("doc_id = 5").count() == sum(copies)
    assert sharding.sharded(d, 2).count() == len(rows)
    p = packing.packed(packing.pieces(d))
    assert p.where("doc_id = 5").select("sequence_id", "offset").distinct().count() == 30
    assert len({tuple(r[1:]) for r in media.digests(media.stored(d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").where("doc_id IN (1, 5)"), "text")).collect()}) == 2
    t = spark.createDataFrame([(1, 0, "assistant", big), (1, 1, "user", "u" * 10**6)], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(t)).collect()[0]["loss_chars"] == len(big)
    assert ctw.lm_scores(d.where("doc_id IN (1, 5)"), F.lit(True), 2).count() == 31
    vectors = spark.createDataFrame([(1, [1.0] * 64)] * 5 + [(2, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.linked(vectors).collect()) == [(1, 5, 1, True)] * 5 + [(2, 5, 1, False)]


@pytest.mark.parametrize("share", [0.4, 0.6, 1.5])
def test_even_bytes_go_before_whole_groups(spark, share):
    """A group of equal texts under half a shard stays whole, a larger one is dealt out; sizes are near equal in both cases."""
    rnd, shards = random.Random(3), 4
    rest = [prose(rnd, 20) for _ in range(2_000)]
    whole = sum(len(t) + 1 for t in rest)
    n = int(share * whole / (shards - share) / 101)
    d = spark.createDataFrame(list(enumerate([*rest, *["g" * 100] * n])), "doc_id long, text string").repartition(3)
    out = sharding.sharded(d, shards).groupBy("shard").agg(F.sum("shard_size").alias("n"), F.count_if(F.col("text").startswith("gg")).alias("g")).collect()
    sizes = [r["n"] for r in out]
    assert len(out) == shards and max(sizes) - min(sizes) < 0.03 * sum(sizes) / shards
    assert sum(r["g"] > 0 for r in out) == (1 if share < 0.5 else shards)


def test_tables_go_with_their_span(spark):
    d = spark.range(10)
    with common.Scratch(spark) as outer:
        a = common.written(d)
        with common.Scratch(spark) as inner:
            b, c = common.written(d), inner.outlive(d)
            assert b.count() == 10
        assert c.count() == 10 and len(outer.made) == 2
        paths = [p for _, p in [*outer.made]]
        outer.keep(c)
    exists = lambda p: (q := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(q)
    assert [exists(p) for p in paths] == [False, True] and a is not None


def test_near_duplicates_go_through_fingerprints(spark, monkeypatch):
    """Where the prefix filter finds nothing, SimHash still links long texts of few changed words."""
    rnd, texts = random.Random(8), []
    for _ in range(6):
        w = [f"u{rnd.randrange(10**6)}" for _ in range(4_000)]
        texts += [" ".join(w[:i] + [x] + w[i + 1 :]) for i, x in ((0, w[0]), (1_000, "x"), (3_000, "y"))]
    nothing = spark.createDataFrame([], "token long, n int, at int, key long, before long, whole boolean")
    monkeypatch.setattr(simhash, "shared", lambda rows, similarity: nothing)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(d).collect()) == list(range(0, 18, 3))
