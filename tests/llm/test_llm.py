"""The operators against brute force, round trips and held-out accuracy, with nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.llm import chat, common, ctw, embeddings, hamming, jpeg, lines, media, mixing, packing, quality, sharding, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + ("." if i % 9 == 8 else "") for i in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for i in range(120):
        out.append((i, prose(rnd, rnd.choice([1, 3, 20, 80, 200])), "en", f"s{i % 4}", 0))
    long = prose(rnd, 120).split(" ")
    for i in range(120, 150):  # near copies of one text
        t = list(long)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = "x" + rnd.choice(WORDS)
        out.append((i, " ".join(t), "en", "s0", 0))
    out += [(150 + i, out[3][1], "en", "s1", 0) for i in range(10)]
    out += [(160, None, None, None, None), (161, "", "en", None, 0), (162, " \n\t ", "en", "s2", 0), (None, "no id here", "en", "s3", 0), (163, "!!! ??? ñ é 日本 \U0001f600", "en", "s3", 0), (164, prose(rnd, 4000), "en", "s3", 0)]
    return [*out, out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    return (t or "").encode().lower().split()


def closed(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, [1, 2, 3]).collect()
    assert len(got) == len(rows)
    assert sorted(r["mix_size"] for r in got) == sorted(len(words(r[1])) for r in rows)
    total, by = sum(r["mix_size"] for r in got), {}
    for r in got:
        assert 0 <= r["mix_copies"] <= 3
        by.setdefault(r["mix_source"], []).append(r)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-6
        assert abs(sum(r["mix_size"] * r["mix_copies"] for r in v) - v[0]["target"]) <= max(r["mix_size"] for r in v)
    again = mixing.mix(docs.repartition(5), [1, 2, 3]).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["mix_copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    wide = mixing.mixed(docs.withColumn("mix", F.lit(1)), [1, 2, 3])
    assert wide.columns == [*docs.columns, "mix"] and wide.count() == sum(r["mix_copies"] for r in got)
    assert mixing.mix(empty, [1, 2, 3]).count() == 0


def test_lines(spark, docs, rows, empty):
    passage = " ".join(f"p{i}" + ("." if i % 10 == 9 else "") for i in range(60))
    texts = [f"aa bb cc. {passage} dd ee ff.", f"zz yy. tail {passage} qq.", "clean words only here. nothing else.", f"{passage} {passage}", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.deduplicated(d).collect()}
    assert got[0]["text"] == texts[0] and got[2]["text"] == texts[2] and got[4]["text"] is None and got[5]["text"] == ""
    assert got[1]["words_removed"] >= 45 and "zz yy." in got[1]["text"] and got[3]["words_removed"] >= 100
    out = lines.deduplicated(docs.withColumn("key", F.lit(1)))
    assert out.columns == [*docs.columns, "key", "line_count", "lines_removed", "words_removed"] and out.count() == len(rows)
    assert lines.deduplicated(empty).count() == 0
    for t in ("a. b! c\n\n\nd", "\n\n", "", "x.  y"):
        assert b"".join(lines.cut(t.encode())) == t.encode()
    h = np.array([5, 1, 4, 1, 5, 9, 2, 6], np.uint64)
    assert set(np.diff(lines.winnowed(h, 3)[1])) <= {1, 2, 3}


def test_simhash_components(docs, rows, empty):
    got = simhash.linked(docs).collect()
    fp = []
    for r in rows:
        w = words(r[1])
        h = [int.from_bytes(bytes.fromhex(__import__("xxhash").xxh64(b" ".join(w[i : i + 4]), seed=42).hexdigest()), "big") for i in range(max(1, len(w) - 3))] if w else []
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    assert sorted(r["fp"] & (2**64 - 1) for r in got) == sorted(fp)
    root = closed(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 4])
    least = {}
    for r, k in zip(rows, root):
        if r[0] is not None:
            least[k] = min(least.get(k, 10**9), r[0])
    want = sorted((-1 if r[0] is None else r[0], least.get(k, -1)) for r, k in zip(rows, root))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == want
    assert simhash.linked(empty).count() == 0


@pytest.mark.parametrize("tau", [3, 4, 8])
def test_links_are_complete(spark, tau):
    rnd = np.random.default_rng(tau)
    base = rnd.integers(0, 2**63, 60, dtype=np.uint64)
    codes = [int(b) for b in base]
    for b in base[:20]:
        for _ in range(12):
            x = int(b)
            for bit in rnd.choice(64, rnd.integers(0, tau + 3), replace=False):
                x ^= 1 << int(bit)
            codes.append(x)
    codes = sorted(set(codes))
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in codes], "fp long")
    found = {tuple(sorted((r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)))) for r in hamming.links(df, "fp", tau, dense=False).collect()}
    assert found == {(x, y) for i, x in enumerate(codes) for y in codes[i + 1 :] if bin(x ^ y).count("1") <= tau}
    near = {r["node"]: r["component"] for r in common.components(hamming.links(df, "fp", tau)).collect()}
    root = closed(len(codes), [(codes.index(a), codes.index(b)) for a, b in found])
    signed = [x - 2**64 if x >> 63 else x for x in codes]
    for i, x in enumerate(signed):
        assert near.get(x, x) == min(signed[j] for j in range(len(codes)) if root[j] == root[i])


def test_forest_keeps_connection():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 50, 400).astype(np.uint64), rnd.integers(50, 90, 400).astype(np.uint64)
    x, y = hamming.forest(a, b)
    assert len(x) <= 90
    pairs = lambda p, q: closed(90, list(zip(p.tolist(), q.tolist())))
    assert pairs(a.astype(int), b.astype(int)) == pairs(x.astype(int), y.astype(int))


def test_near_duplicates(docs, rows, empty):
    kept = simhash.deduplicated(docs.withColumn("key", F.lit(1)))
    assert kept.columns == [*docs.columns, "key"]
    sets = [set(simhash.shingle_hashes((r[1] or "").encode(), 5).tolist()) for r in rows]
    near = lambda s, t: s == t or len(s & t) >= 0.8 * len(s | t)
    same = lambda i, j: rows[i][1] == rows[j][1] or (rows[i][1] is not None and rows[j][1] is not None and near(sets[i], sets[j]))
    root = closed(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if same(i, j) or (not sets[i] and not sets[j])])
    assert kept.count() == len(set(root))
    assert simhash.deduplicated(empty).count() == 0


def test_sharding(docs, rows, empty):
    out = sharded = sharding.sharded(docs, 4).collect()
    assert len(out) == len(rows)
    sizes = [0] * 4
    for r in sharded:
        sizes[r["shard"]] += r["shard_size"]
    for k in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    assert sum(sizes) == sum(len((r[1] or "").encode()) + 1 for r in rows)
    assert sharding.sharded(empty, 4).count() == 0


def test_sharding_is_even_and_keeps_groups(spark):
    rnd = random.Random(2)
    data = [(i, "copy " * 20 if i % 12 == 0 else prose(rnd, rnd.randint(1, 40))) for i in range(4000)]
    out = sharding.sharded(spark.createDataFrame(data, "doc_id long, text string"), 8).groupBy("shard").agg(F.sum("shard_size").alias("n"), F.count_distinct("shard_group")).collect()
    sizes = [r["n"] for r in out]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8
    third = spark.createDataFrame([(i, "hot" if i % 3 == 0 else prose(rnd, 3)) for i in range(3000)], "doc_id long, text string")
    n = [r["n"] for r in sharding.sharded(third, 8).groupBy("shard").agg(F.sum("shard_size").alias("n")).collect()]
    assert len(n) == 8 and max(n) < 1.2 * sum(n) / 8


def test_quality(spark, empty):
    rnd = random.Random(1)
    data = [(i, prose(rnd, 60) if i % 3 else "!!".join(prose(rnd, 60).upper().split())) for i in range(900)]
    d, l = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(900)], "doc_id long, quality int")
    got = quality.quality_scores(d, l, quality.id_fold(F.col("doc_id")) != 0).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == 900 and sum((r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, ""), (1, "")], "doc_id long, text string")
    assert [r["score"] for r in quality.quality_scores(odd, l.limit(0)).collect()] == [0.5] * 4
    assert quality.quality_scores(empty, l).count() == 0
    s, v = quality.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert list(v) == [0.0, 0.5, 1.0]


def brute_ctw(train, depth):
    """Bit by bit over explicit trees: each decision node's contexts with counts, mixed from the leaves up."""
    counts = {}
    seq = lambda t: [0xFE] * depth + list(t) + [0xFF]
    for t in train:
        b = seq(t)
        for p in range(depth, len(b)):
            for j in range(8):
                node, bit = (1 << j) | (b[p] >> (8 - j)), (b[p] >> (7 - j)) & 1
                for d in range(depth + 1):
                    counts.setdefault((node, tuple(reversed(b[p - d : p]))), [0, 0])[bit] += 1
    kt = lambda n: float(ctw.log_kt(np.array([float(n[0])]), np.array([float(n[1])]))[0])
    mix = {}
    for (node, c), n in sorted(counts.items(), key=lambda x: -len(x[0][1])):
        below = sum(mix[k] for k in [(node, (*c, x)) for x in range(256)] if k in mix) if len(c) < depth else None
        mix[node, c] = kt(n) if below is None else np.logaddexp(kt(n), below) - np.log(2)

    def chance(node, context, d=0):
        key = (node, context[:d])
        if key not in counts:
            return 0.5
        n, own = counts[key], (counts[key][1] + 0.5) / (sum(counts[key]) + 1)
        if d == depth:
            return own
        w = np.exp(kt(n) - np.log(2) - mix[key])
        return w * own + (1 - w) * chance(node, context, d + 1)

    def score(t):
        b, out = seq(t), 0.0
        for p in range(depth, len(b)):
            for j in range(8):
                q = chance((1 << j) | (b[p] >> (8 - j)), tuple(reversed(b[p - depth : p])))
                out += log10(q if (b[p] >> (7 - j)) & 1 else 1 - q)
        return out

    return score


@pytest.mark.parametrize("model_rows", [10**6, 40])
def test_ctw_equals_brute_force(spark, model_rows):
    train, other = [b"abracadabra abra", b"banana band", b""], [b"abra band", "né".encode(), b"", b"zzz"]
    rows = spark.createDataFrame([(i, i < 3, bytearray(t)) for i, t in enumerate(train + other)], "doc_id long, train boolean, text binary")
    got = {r["doc_id"]: r["score"] for r in ctw.lm_scores(rows.withColumn("extra", F.lit(1)), F.col("train"), 3, "text", model_rows).collect()}
    score = brute_ctw(train, 3)
    for i, t in enumerate(train + other):
        assert got[i] == pytest.approx(score(t), abs=1e-6)


def test_scoring_base(spark, docs, rows, empty):
    d = ctw.blocks(docs.select("doc_id", "text"), 16).select("block", "doc_id", (F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 1).alias("train"), F.col("text").cast("binary").alias("text"))
    got = ctw.scored_with_base(d, depth=2).collect()
    c, ends = {}, 0
    for r in rows:
        if (r[0] or 0) % 5 != 1:
            ends += 1
            for w in words(r[1]):
                c[w] = c.get(w, 0) + 1
    n = sum(c.values()) + ends
    base = log10(n + 0.5 * (len(c) + 2))
    want = sorted((-1 if r[0] is None else r[0], len(words(r[1])) + 1, sum(w in c for w in words(r[1])) + 1, round(sum(log10(c.get(w, 0) + 0.5) for w in words(r[1])) + log10(ends + 0.5) - (len(words(r[1])) + 1) * base, 6)) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}


def test_embeddings(spark):
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((300, 64))
    for i in range(60):
        x[100 + i] = x[i // 3] + rnd.standard_normal(64) * 0.15
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    data += [(300 + i, data[5][1]) for i in range(4)] + [(310, None), (311, [0.0] * 64), (312, [float("nan")] * 64), (313, [1.0]), (314, [None] * 64), (315, [])]
    got = {r["vec_id"]: r for r in embeddings.linked(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    good = [(i, np.array(v, float)) for i, v in data if i < 310]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(got) == len(data)
    assert sum(got[i]["n_links"] for i, _ in good) >= 0.98 * near.sum()
    assert all(got[i]["n_links"] <= near[k].sum() for k, (i, _) in enumerate(good))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(310, 316))
    assert got[300]["component_id"] == got[5]["component_id"] and got[300]["n_links"] >= 4
    assert embeddings.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_clusters(spark):
    """Clusters of many different near vectors, in dense tasks of several blocks: links and groups as by all pairs."""
    rnd = np.random.default_rng(6)
    x = np.concatenate([c + rnd.standard_normal((n, 64)) * s for c, n, s in ((rnd.standard_normal(64) * 2, 300, 0.35), (rnd.standard_normal(64) * 2, 150, 0.2), (0, 200, 1.0))])
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1_000 + i, x[3].tolist()) for i in range(3)]
    x = np.concatenate([x, x[[3, 3, 3]]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    for block in (2048, 64):
        embeddings.BLOCK = block
        got = {r["vec_id"]: r for r in embeddings.linked(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)).collect()}
        embeddings.BLOCK = 2048
        found = [got[i]["n_links"] for i, _ in data]
        assert near.sum() > 5_000 and 0.98 * near.sum() <= sum(found) <= near.sum() and all(f <= n for f, n in zip(found, near.sum(1)))
        root = closed(len(data), [(int(i), int(j)) for i, j in zip(*np.nonzero(near))])
        assert [got[i]["component_id"] for i, _ in data[:450]] == [min(data[k][0] for k in range(len(data)) if root[k] == root[i]) for i in range(450)]


def test_jpeg_round_trip_and_transform():
    rnd = random.Random(3)
    for n in (576, 576 * 5, 576 * 70):
        p = rnd.randbytes(n)
        d = jpeg.Decoder(jpeg.write(p))
        assert jpeg.payload_of(d) == p
        assert d.rgb().shape == (d.height, d.width, 3)
    x = np.random.default_rng(0).integers(-200, 200, (300, 8, 8)).astype(np.int32)
    k = np.arange(8)
    c = np.where(k[None, :] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16)
    exact = np.clip(np.round(np.einsum("xu,nuv,yv->nxy", c, x, c) + 128), 0, 255)
    assert np.abs(exact - jpeg.inverse(x)).max() <= 1


def test_jpeg_general_scans():
    """One grey block through the loops: runs of zeros, an end of band, and refinement of old and new coefficients."""
    bits = lambda s: int(s + "1" * (-len(s) % 8), 2).to_bytes(-(-len(s) // 8), "big").replace(b"\xff", b"\xff\x00")
    table = lambda cls, symbols: jpeg._segment(0xC4, bytes([cls, 0, 0, len(symbols)] + [0] * 13) + bytes(symbols))  # noqa: E731  three-bit codes in order
    scan = lambda ss, se, a, data: jpeg._segment(0xDA, bytes([1, 1, 0, ss, se, a])) + bits(data)
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + b"\x01" * 64) + jpeg._segment(0xC2, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00") + table(0x00, [0, 3]) + table(0x10, [0x00, 0x12, 0x01, 0xF0])
    dc = scan(0, 0, 0x01, "001" + "101")  # category 3, 5 -> 10 after the point transform
    ac = scan(1, 63, 0x01, "001" + "11" + "000")  # one zero, then 3 -> 6 at place 2, end of band
    dc2 = scan(0, 0, 0x10, "1")
    ac2 = scan(1, 63, 0x10, "010" + "1" + "000" + "1")  # a new 1 at place 1, then end of band, and 6 becomes 7
    d = jpeg.Decoder(head + dc + ac + dc2 + ac2 + b"\xff\xd9")
    got = d.parts[0].coef[0, 0]
    assert got[0] == 11 and got[1] == 1 and got[2] == 7 and not got[3:].any()
    assert d.rgb().shape == (8, 8, 3)


def test_media(spark, docs, rows, empty):
    d = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    got = media.digests(media.stored(d, "text")).collect()
    want = sorted(hashlib.sha256(media.framed((r[1] or "").encode())).hexdigest() for r in rows)
    assert sorted(r["payload_sha256"] for r in got) == want and all(r["payload_bytes"] % 576 == 0 and r["payload_bytes"] > 0 for r in got)
    one = media.tensor_column(media.stored(docs.where("doc_id = 3").select("doc_id", "text"), "text")).collect()[0]
    assert len(one["rgb"]) == one["height"] * one["width"] * 3
    assert media.stored(empty.select("doc_id", "text"), "text").count() == 0


def test_chat(spark):
    rnd = random.Random(8)
    parts = [*chat.CONTROLS, chat.ESCAPE, "a", " ", "é", "\n", "[", "<", "日"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(200)]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)
    turns = [(i // 5 if i < 190 else None, i % 5, rnd.choice(["user", "assistant", "system", None]), t if i % 17 else None) for i, t in enumerate(texts)]
    turns += [(0, 1, "assistant", "tie"), (0, 1, "assistant", "tie")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(df)).collect()}
    by = {}
    for c, n, role, t in turns:
        by.setdefault(c, []).append((n, hashlib.sha256(f"{role or ''}\n{t or ''}".encode()).hexdigest(), role or "", t or ""))
    assert len(got) == len(by)
    for c, v in by.items():
        v.sort()
        learned = "".join(t for *_, r, t in v if r == "assistant")
        assert got[c]["n_turns"] == len(v) and got[c]["loss_chars"] == len(learned) and got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in v).encode()).hexdigest()
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
    starts = chat.placed(chat.formatted(df.where("conv_id = 3"))).orderBy("start").collect()
    assert [r["start"] for r in starts] == [0, *np.cumsum([len(r["mask"]) for r in starts])[:-1]]


def test_encoder_equals_the_tokenizer():
    """Also for added tokens' strings, odd white space, and long runs of one character."""
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    t, e, rnd = Tokenizer.from_file(path), packing.Encoder(path), random.Random(1)
    letters = [*" \n\t\r\x0b\x1c\x85\xa0 a'b sdtmrevll9²½Ⅷ_é日.,!?<|endoftext|>́\U0001f600", "<|endoftext|>", " <|endoftext|> "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    texts += ["", "a", " ", "a b", "one <|endoftext|> two", " " * 9000 + "x", "x" + "\n" * 9000, "ab" * 5000, "日" * 5000, *["again the same words"] * 5]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[3004] == [505, 220, 50256, 734]
    ids, n = e.many(pa.array([*texts, None]))
    ends = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n)] == [*want, []]
    assert [len(x) for x in e.many(pa.array([], pa.string()))] == [0, 0]


def test_packing(docs, rows, empty):
    got = packing.packed(packing.pieces(docs, capacity=256), capacity=256).collect()
    e = packing.Encoder(packing.default_vocabulary())
    want = []
    for r in rows:
        ids = e(r[1] or "") + [2]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(-1 if r[0] is None else r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    full = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert full.get(r["sequence_id"], 0) == r["offset"]
        full[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(full.values()) <= 256 and len(full) <= 1.1 * sum(r["length"] for r in got) / 256 + 2
    assert packing.packed(packing.pieces(empty)).count() == 0


def test_plan_is_near_the_bound():
    rnd = random.Random(1)
    h = {}
    for _ in range(20_000):
        n = rnd.randint(1, 1024)
        h[n] = h.get(n, 0) + 1
    runs, n = packing.plan(h)
    placed = {}
    for length, a, b, first, offset in runs:
        placed[length] = placed.get(length, 0) + b - a
        assert offset + length <= 1024
    assert placed == h and n <= 1.02 * sum(k * v for k, v in h.items()) / 1024
    assert packing.plan({}) == ([], 0)


def test_components_on_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(e).collect()}
    assert got == {**{i: 0 for i in range(71)}, 200: 200, 201: 200}


def test_pipeline_on_small_table(spark, tmp_path, docs):
    import corpus_pipeline as c

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in c.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    assert c.run(spark, str(tmp_path)).count() > 0
    d = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("extra", F.lit(1))
    for _, stage in c.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == c.COLUMNS


def brute_lines(texts, min_words=25):
    """Texts in order of id -> the words that stay: window by window, all but the first place of each."""
    seen, out = {}, []
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - min_words + 1):
            if seen.setdefault(tuple(w[a : a + min_words]), (i, a)) != (i, a):
                gone[a : a + min_words] = [True] * min_words
        out.append([x for x, g in zip(w, gone) if not g])
    return out


def line_stage(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in lines.deduplicated(d).collect()}


def test_lines_equal_brute_force(spark):
    """Runs of 20 to 80 words copied between foreign lines, one-line documents, and texts that repeat themselves."""
    rnd = random.Random(11)
    fresh = lambda n: " ".join(f"u{rnd.randrange(10**6)}" + rnd.choice(["", "", "", "", ".", ".\n"]) for _ in range(n))
    texts = [fresh(rnd.randint(30, 300)) for _ in range(60)]
    for _ in range(150):
        w = rnd.choice(texts).split(" ")
        a = rnd.randrange(len(w))
        passage = " ".join(w[a : a + rnd.randint(20, 80)])
        texts.append(f"{fresh(rnd.randint(0, 40))} {passage} {fresh(rnd.randint(0, 40))}")
    one = " ".join(f"v{i}" for i in range(60))
    texts += [one, one.upper(), "la " * 100, f"{one}\n{one}", None, ""]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in ("3", batch):  # classes that go on over many batches, too
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        got = line_stage(spark, texts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert [words(got[i]["text"]) for i in range(len(texts))] == brute_lines(texts)
    assert got[211]["text"] == "" and got[211]["words_removed"] == 60 and got[211]["lines_removed"] == 1


def test_line_counts():
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab .\n.!? ") for _ in range(rnd.randint(0, 30))).encode() for _ in range(2000)]
    assert lines.line_counts(pa.array([*texts, None])).tolist() == [len(lines.cut(t)) for t in [*texts, b""]]


def test_lines_inside_lines(spark):
    """A passage pasted into the middle of a line goes whole, its partial lines too; the rest of the line and its line break stay."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"aa bb {passage} cc dd.\nnext line here.", f"zz yy {passage}\nqq {passage} rr.\n{passage}\nend."]
    got = line_stage(spark, texts)
    assert got[0]["text"] == texts[0] and got[1]["text"] == "zz yy \nqq rr.\nend."
    assert got[1]["words_removed"] == 90 and got[1]["lines_removed"] == 1


def test_lines_meet_beyond_the_first_holder(spark):
    """A frequent short line that stands first alone, or in hundreds of texts, hides no longer run that goes through it."""
    rnd = random.Random(3)
    fresh = lambda n: " ".join(f"u{rnd.randrange(10**6)}" for _ in range(n))
    common = " ".join(f"c{i}" for i in range(20))
    texts = [f"{fresh(30)} {common} {fresh(30)}" for _ in range(400)]
    shared = f"{fresh(8)} {common} {fresh(8)}"
    texts += [f"{fresh(20)} {shared} {fresh(20)}" for _ in range(40)]
    got = line_stage(spark, texts)
    assert [words(got[i]["text"]) for i in range(len(texts))] == brute_lines(texts)
    assert sum(r["words_removed"] for r in got.values()) == 39 * 36


def test_sketches_never_pass_the_difference():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        n, m, both = rnd.integers(0, 400, 3)
        c, a, b = (rnd.integers(0, 2**63, k, dtype=np.uint64) for k in (both, n, m))
        x, y = np.unique(np.concatenate([c, a])), np.unique(np.concatenate([c, b]))
        assert simhash.apart(simhash.sketch(x), simhash.sketch(y)) <= len(np.setxor1d(x, y))
    assert simhash.apart(simhash.sketch(x), simhash.sketch(x)) == 0


def test_near_duplicates_of_block_edits(spark):
    """Copies with a block appended, cut off or replaced, similarity around 0.8, in one and in many batches: the kept ids are those of brute force."""
    rnd = random.Random(21)
    fresh = lambda n: [f"u{rnd.randrange(10**5)}" for _ in range(n)]
    texts = []
    for _ in range(120):
        w = fresh(rnd.choice([5, 14, 30, 60, 150, 400]))
        k = max(1, int(len(w) * rnd.uniform(0.05, 0.25)))
        texts += [w, w + fresh(k), w[:-k], w[: len(w) // 2] + fresh(k // 2 + 1) + w[len(w) // 2 + k // 2 + 1 :]]
    hub = fresh(40)
    texts += [hub[:i] + ["x"] + hub[i + 1 :] for i in range(40)]
    texts = [" ".join(w) for w in texts]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(len(sets[i] & sets[j]) < 0.86 * len(sets[i] | sets[j]) for i, j in pairs) > 40
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in (batch, "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        kept = sorted(r["doc_id"] for r in simhash.deduplicated(d).collect())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert kept == sorted(set(closed(len(texts), pairs)))


def test_quality_calibrates_on_unseen_rows_at_every_size(spark, monkeypatch):
    seen, isotonic = [], quality.isotonic
    monkeypatch.setattr(quality, "isotonic", lambda s, y: seen.append(len(y)) or isotonic(s, y))
    rnd = random.Random(6)
    rows = quality.measured(spark.createDataFrame([(i, float(i % 2), prose(rnd, 20)) for i in range(100)], "key long, y double, text string")).select("key", "x", "y")
    late = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    quality.fit(rows)
    assert seen == [rows.where(late).count()] and 0 < seen[0] < 50
    for some in (rows.where(late), rows.where(~late).limit(6)):
        assert ((s := quality.fit(some).score(np.zeros((3, len(quality.STATISTICS))))) >= 0).all() and (s <= 1).all()
