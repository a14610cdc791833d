"""Merkle proofs, phrases and url filters against brute force and their SQL, with nulls, empty tables, ties, repeated rows and clashing columns; vectors of several lengths."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from math import ceil

import pytest
from oracle import compare
from pyspark.sql import functions as F

from flowloom.llm import embeddings, merkle, phrases, registry, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grow(digests, fan):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def steps(levels, i, fan):
    """What lies before and after the node on its way up."""
    for level in levels[:-1]:
        run = i // fan * fan
        yield level[run:i], level[i + 1 : run + fan]
        i //= fan


def leaf(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(field, (row[0], row[3], row[2], row[4], text)))


def expected(rows, fan):
    lower = lambda t: t and re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(r, r[1])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: grow([x[1] for x in groups[g]], fan) for g in names}
    top = grow([trees[g][-1][0] for g in names], fan)
    for j, g in enumerate(names):
        for i, (r, d) in enumerate(groups[g]):
            way = [*steps(trees[g], i, fan), *steps(top, j, fan)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, lower(r[1])) if tampered else d
            for a, b in way:
                h = H(*a, h, *b)
            yield r[0], d, trees[g][-1][0], top[-1][0], H(*[x for a, b in way for x in (*a, *b)]), h, h == top[-1][0]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_proofs(spark, fan):
    rnd = random.Random(fan)
    rows = [(i, f"Text {rnd.random()} É {i}", rnd.choice(["en", "en", "en", "de", "é", "", None, *[f"l{k}" for k in range(9)]]), rnd.choice(["s", None]), i) for i in range(700)]
    rows += [(900, None, "lone", None, None), (None, "A", "en", None, 1), (None, "A", "en", None, 1), (7, "again", "en", "s", 2), rows[3], (901, "", "en", "", 0), (902, "L" * 1_000_000, "de", "s", 5)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"tree": F.lit("x"), "digest": F.lit(1), "idx": F.lit(2)})
    got = merkle.proven(docs.repartition(7), fan).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows, fan), key=key)


def test_proofs_of_few(spark):
    assert merkle.proven(spark.createDataFrame([], DOC)).count() == 0
    one = [(3, "Abc", None, None, None)]
    got = merkle.proven(spark.createDataFrame(one, DOC)).select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == list(expected(one, 8))
    assert got[0]["proof_sha256"] == H() and got[0]["leaf"] == got[0]["root"]


def test_hot_coordinates_are_shared_out(spark):
    """A tree of fan 2 and 300 leaves has nodes with more than 8 runs below them: each copy answers at most 8 of them."""
    leaves = spark.range(300).select(F.lit("").alias("tree"), F.col("id").alias("name"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    runs, nodes = merkle.grown(leaves, ["name"], 2, ["name"])
    assert nodes.groupBy("level").count().orderBy("level").collect()[0]["count"] == 150 and nodes.where("m = 1").count() == 1
    out = merkle.proofs(runs, nodes, 2)
    assert out.count() == 300 and {r["n"] for r in out.select(F.size("steps").alias("n")).collect()} == {9}


def counted(rows, words, least, inside, top):
    """Phrases by plain counting."""
    n, f = Counter(), {}
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        within = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        out = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and within(p, q) for q, b in candidates.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            out.append((" ".join(p), a, l, r, n[lang], score))
        out.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        yield from ((lang, i, *x) for i, x in enumerate(out[:top], 1))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    vocabulary = ["new", "york", "city", "of", "the", "é", "x-1", "日本", "\x1c", "Big", "apple", "a b"]
    rows = []
    for i in range(150):
        words = [rnd.choice(vocabulary) + rnd.choice([""] * 6 + [".", ",", "\n", "\t", "  ", "?!"]) for _ in range(rnd.choice([0, 1, 2, 30, 60]))]
        rows.append((i, rnd.choice([" ", "\t", "  "]).join(words), rnd.choice(["en", "en", "de", None, "und"]), "s", 0))
    return [*rows, (None, "new york city " * 40, "en", None, 0), (500, None, "en", None, None), (501, "", "fr", None, None), (502, "one. two", "it", None, None), rows[5], rows[5]]


@pytest.mark.parametrize(("words", "top", "chunk"), [(3, 2000, None), (3, 5, 300), (2, 2000, 500), (4, 2000, 300)])
def test_phrases(spark, texts, words, top, chunk, monkeypatch):
    if chunk:
        monkeypatch.setattr(phrases, "CHUNK", chunk)  # many small chunks; the functions that are sent hold the value
    docs = spark.createDataFrame(texts, DOC).withColumns({"chunk": F.lit("x"), "seq": F.lit(1), "words": F.lit(2)}).repartition(3)
    got = phrases.collocations(docs, words, 4, 50, top)
    assert sorted(map(tuple, got.collect())) == sorted(counted(texts, words, 4, 50, top))


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOC)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "...", "en", None, None), (3, "only once here", "en", None, None)], DOC)).count() == 0


def test_counts_past_64_bits(spark):
    names = spark.createDataFrame([(1, 2, 3, 9 * 10**13, "en", "a b", "b", [9 * 10**13], [9 * 10**13 + 7])], "id long, left long, right long, f long, lang string, phrase string, last string, heads array<long>, tails array<long>")
    got = phrases.scored(names, None, 2, 50).collect()[0]
    assert got["score"] == 1_000_000 * (9 * 10**13) ** 2 // (9 * 10**13 * (9 * 10**13 + 7))


def test_long_texts_and_slices():
    text = ("Alpha beta. " * 400_000).encode()
    seq, words = phrases.numbered([text, b"", b"gamma\tDELTA"])
    assert words.to_pylist() == [b"alpha", b"beta", b"gamma", b"delta"] and (seq > 0).sum() == 800_002


PAGE = "page_id long, url string, html string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def verdicts(rows, support, confidence):
    """Every combination of tokens counted, every surviving rule tried on every url."""
    low = lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s)
    made, labelled = [], []
    for page_id, url, *_ in rows:
        host, path = parts(url)
        fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        t = {"h:" + x for x in host.split(".") if x} | {"p:#" if x.isascii() and x.isdigit() else "p:" + x for x in re.split("[^a-z0-9]+", low(path)) if x}
        made.append((page_id, host, path, rule, t))
        if rule:
            labelled.append((t, rule[0]))
    whole, each = Counter(), Counter()
    for t, v in labelled:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                whole[c] += 1
                each[c, v] += 1
    rules = {(c, v): n / whole[c] for (c, v), n in each.items() if n >= ceil(support * len(labelled)) and n / whole[c] >= confidence}
    kept = {(c, v): s for (c, v), s in rules.items() if not any(rules.get((c[:i] + c[i + 1 :], v), -1) >= s for i in range(len(c)))}
    for page_id, host, path, rule, t in made:
        best = max(((s, each[c, v] / len(labelled), v, " ".join(c)) for (c, v), s in kept.items() if t.issuperset(c)), default=None) if not rule else None
        yield page_id, host, path, rule and rule[1] + rule[2], rule[0] if rule else best[2] if best else "allow", best and best[3], best and best[0]


def test_urls(spark):
    rnd = random.Random(2)
    make = lambda: f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'www.', 'm.', 'BLOG.'])}{rnd.choice(['example', 'spam', 'Shop'])}.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en', 'es', 'fr'])}/{rnd.randrange(99)}{rnd.choice(['', '.html', '?q=1/2', '#top'])}"
    odd = [None, "", "no scheme", "://", "http://", "http://com", "http://COM/", "https://x.example.com?/en/", "http://example.com/en/a", "http://www.example.com/en/a", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://xcom/", "ftp://é.net/es/ñ/1", "http://a..net//fr/", "http://b.org/" + "a/" * 200_000]
    rows = [(i, u, "<p>") for i, u in enumerate([*(make() for _ in range(300)), *odd])]
    rows += [(None, rows[0][1], None), rows[1], rows[1]]
    pages = spark.createDataFrame(rows, PAGE).withColumns({"host": F.lit(1), "tokens": F.lit(2), "verdict": F.lit("x")}).repartition(4)
    got = urls.judged(pages, support=0.02, confidence=0.7).select("page_id", "host", "path", "rule", "verdict", "why", "confidence")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(verdicts(rows, 0.02, 0.7), key=key)


def test_urls_without_labels(spark):
    assert urls.judged(spark.createDataFrame([], PAGE)).count() == 0
    got = urls.judged(spark.createDataFrame([(1, "http://a.org/x", None), (2, None, None)], PAGE)).collect()
    assert [(r["page_id"], r["verdict"], r["rule"]) for r in sorted(got)] == [(1, "allow", None), (2, "allow", None)]


def test_vectors_of_several_lengths(spark):
    """Each length links within itself, however few vectors have it; vectors of different lengths have no cosine."""
    rows = [(i, [1.0 if j == i else 0.1 for j in range(64)]) for i in range(10)] + [(20, [1.0, 2.0, 3.0]), (21, [1.0, 2.0, 3.0]), (22, [2.0, 4.0, 6.1]), (23, [3.0, -1.0, 0.0]), (30, [5.0]), (31, [7.0]), (32, [-7.0]), (40, []), (41, None), (42, [0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) and all(got[i] == (0, i, True) for i in (*range(10), 23, 32, 40, 41, 42))
    assert got[20] == (2, 20, True) and got[21] == got[22] == (2, 20, False) and got[30] == (1, 30, True) and got[31] == (1, 30, False)
