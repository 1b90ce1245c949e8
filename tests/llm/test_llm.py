import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import _text, decontam, html_text, line_dedup, mixing, queries, simhash, token_count, token_output, toxicity, url_filter, vector_search

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, extra string, n_tokens int, k1 string, slot string"
rnd = random.Random(5)
WORDS = ["w" + "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edit(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty, repeated and very long rows, clashing column names."""
    long = prose(60_000, 1)
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, prose(80, 2)), (5, prose(80, 2)), (None, prose(80, 2)), (6, long), (7, "\x00 \ud83d" .encode("utf-8", "replace").decode()), (8, prose(90, 3))]
    return spark.createDataFrame([(i, t, "s" if (i or 0) % 2 else None, "x", 1, "k", "l") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", queries.SQL)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.SQL[name]).df()
    c = sorted(a.columns)
    a, b = (x[c].astype(str).sort_values(c).reset_index(drop=True) for x in (a, b))
    assert len(a) and a.equals(b)


def test_toxicity_held_out(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 3 > 0"))
    held = labels.where("doc_id % 3 = 0")
    got = toxicity.score(docs.join(held.select("doc_id"), "doc_id"), model).join(held.select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    right = [r for r in got if r.y == 1 and r.toxic]
    assert len(right) >= 0.8 * sum(r.y for r in got) and sum(r.toxic and not r.y for r in got) <= 0.01 * len(got)
    s = toxicity.score(odd, model)
    assert s.count() == odd.count() and s.where("doc_id in (1, 2)").where("toxic or toxicity <> 0").count() == 0
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(odd, model).columns == odd.columns
    empty = toxicity.train(docs, labels.where("false"))
    assert toxicity.score(odd, empty).where("toxic").count() == 0


def test_toxicity_fits_twenty_thousand_rows(spark):
    """The whole sample is used, and the fit makes no array as long as its features."""
    import inspect
    import tracemalloc

    most = inspect.signature(toxicity.train).parameters["most"].default
    labels = spark.range(25_000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.lit("t").alias("text"))
    assert toxicity.sample_labelled(docs, labels, most, 7).count() == 20_000
    g = np.random.default_rng(2)
    y = (np.arange(20_000) % 7 == 0).astype(float)
    ratio = g.normal(size=5000)
    feats = [g.integers(0, 5000, 200).astype(np.int32) for _ in y]
    for f, v in zip(feats, y):
        f[:20] = np.flatnonzero(ratio > 1.5 if v else ratio < -1.5)[:20]
    own = [f.copy() for f in feats]
    tracemalloc.start()
    w, bias = toxicity._fit(feats, y, ratio, 1e-3, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 4 * 200 * len(y)
    z = np.array([bias + w[f].sum() for f in own])
    assert ((z > 0) == (y > 0)).mean() > 0.99


def test_long_text_keeps_its_ngrams():
    useful = np.ones(1 << toxicity.BITS, bool)
    text = prose(40_000, 9)
    whole = set(toxicity._hits(_text.codepoints("\x00" + text + "\x00"), useful)[1].tolist())
    assert whole == set(toxicity.present([text], useful)[1].tolist())


def test_long_words_gain_no_ngrams():
    """However a text is cut, its n-grams are those of the whole; nothing is lost, nothing comes in at a cut."""
    useful = np.ones(1 << toxicity.BITS, bool)
    r = random.Random(4)
    for text in ("ab" * 200_000, "".join(r.choice("abcdefg  .") for _ in range(300_000)), " " * 140_000 + "x", "x" + "." * 140_000, "\x00" * 140_000 + "word"):
        whole = set(toxicity._hits(_text.codepoints("\x00" + text.replace("\x00", " ") + "\x00"), useful)[1].tolist())
        assert whole == set(toxicity.present([text], useful)[1].tolist())


def test_toxicity_by_brute_force(spark):
    """Counts, ratios, fit and logits against plain dictionaries and a slow descent."""
    r = random.Random(12)
    bad = ["idiot", "scum", "vermin"]
    rows = []
    for k in range(240):
        words = [r.choice(WORDS[:60]) for _ in range(12)]
        if k % 4 == 0:
            words[r.randrange(12)] = r.choice(bad)
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.select("doc_id", F.col("y").alias("toxic"))
    model = toxicity.train(docs, labels, alpha=0.5, least_z=2.0, steps=400)

    def grams(text):  # a blank before and after; any run of other signs is one blank
        t = " " + re.sub(r"[^a-z0-9]+", " ", text.lower()).strip() + " "
        return {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}

    def bucket(g):
        v = [int(_text._letters()[ord(c)] >> np.uint64(20)) & 0xFFFFFFFF if c != " " else 0 for c in g]
        h = 0
        for x in v:
            h = (h * 0x9E3779B1 + x) & 0xFFFFFFFF
        h ^= h >> 15
        return ((h * (0x2C1B3C6D + 2 * len(g))) & 0xFFFFFFFF) >> (32 - toxicity.BITS)

    held = [{bucket(g) for g in grams(t)} for _, t, _ in rows]
    y = np.array([v for *_, v in rows], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    counts = {}
    for h, v in zip(held, y):
        for b in h:
            counts.setdefault(b, [0, 0])[int(v)] += 1
    ratio = {b: np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1)) for b, (c0, c1) in counts.items()}
    ratio = {b: v for b, v in ratio.items() if abs(v) >= 2.0 * np.sqrt(1 / (counts[b][1] + 0.5) + 1 / (counts[b][0] + 0.5))}
    assert set(np.flatnonzero(model.weight)) <= set(ratio)
    used = sorted(ratio)
    x = np.array([[ratio[b] * (b in h) for b in used] for h in held])
    w, bias = np.zeros(len(used)), float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(60_000):
        g = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w -= 0.05 * (x.T @ g + 1e-3 * w) / len(y)
        bias -= 0.05 * g.sum() / len(y)
    slow = x @ w + bias

    def loss(z, w):
        return np.log1p(np.exp(-np.where(y > 0, z, -z))).sum() + 0.5e-3 * (w**2).sum()

    own = np.array([model.weight[b] / ratio[b] for b in used])
    fast = toxicity.logits([t for _, t, _ in rows], model)
    assert np.allclose(fast, model.bias + x @ own, atol=1e-3)
    assert loss(fast, own) <= loss(slow, w) * 1.05 + 0.05 and ((fast > 0) == (slow > 0)).mean() > 0.99


def test_token_counts(spark, odd, none):
    machine, e = token_count.Transducer(), token_count.encoding(token_count.VOCABULARY)
    r = random.Random(3)
    for _ in range(1500):
        t = "".join(r.choice("ab c\n\t'sré .,1٣ \x1c\x00  ßtheing\U0001f600") for _ in range(r.randrange(50)))
        assert machine.count(t, r.choice((3, 7, 500))) == len(e.encode_ordinary(t)), t
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for df in (docs, odd):
        want = sorted(((r.doc_id is None, r.doc_id, r.text is None, None if r.text is None else len(e.encode_ordinary(r.text))) for r in df.collect()), key=str)
        got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens is None, r.n_tokens) for r in token_count.token_counts(df).collect()), key=str)
        assert got == want
    assert token_count.token_counts(none).count() == 0


def test_alignment_by_brute_force():
    def slow(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    g = np.random.default_rng(1)
    for _ in range(60):
        a = g.integers(1, 6, g.integers(1, 15)).astype(np.uint64)
        b = [g.integers(1, 6, n).astype(np.uint64) for n in g.integers(1, 20, 4)]
        assert decontam.align(a, b).tolist() == [slow(a, x) for x in b]


def test_decontamination(spark, odd, none):
    items = [(k, prose(40, 100 + k)) for k in range(6)] + [(None, prose(40, 1)), (7, None), (8, ""), (9, "too short"), (0, prose(40, 100))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(10 + k, prose(200, 200 + k) + " " + edit(prose(40, 100 + k), 0.1 * (k % 3), k) + ". " + prose(100, 300 + k)) for k in range(6)]
    rows += [(50 + k, prose(300, 400 + k)) for k in range(30)] + [(99, prose(30_000, 7) + " " + prose(40, 103))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, bench).collect()}
    assert set(got) == {(10 + k, k) for k in range(6)} | {(99, 3)} and got[10, 0] == 1.0
    kept = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == {50 + k for k in range(30)}
    assert decontam.leaks(odd, bench).count() == 0 and decontam.decontaminate(odd, bench).count() == odd.count()
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs, bench.where("false")).count() == 0


def test_decontamination_by_brute_force(spark):
    """Every document against every item; a passage that a third of all texts hold stands in an item, and one item is long."""
    r = random.Random(31)
    shared = prose(6, 77)
    items = [(k, prose(r.choice((8, 20, 45)), 700 + k)) for k in range(25)] + [(25, prose(10, 801) + " " + shared + " " + prose(14, 802)), (26, prose(900, 803))]
    rows = []
    for k in range(240):
        t = prose(r.randrange(20, 160), 1100 + k)
        if k % 3 == 0:
            t += " " + shared + ", " + prose(20, 1500 + k)
        if k % 4 == 0:
            i, x = items[r.randrange(27)]
            t = t + " " + edit(x, r.choice((0, 0.1, 0.2)), k) + " " + prose(15, 1900 + k)
        rows.append((k, t))
    got = {(x.doc_id, x.item_id): x.score for x in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, x in items:
        a = _text.words([x])[0]
        b = [_text.words([t])[0] for _, t in rows]
        enough = min(0.5, max(decontam.LEAST_WORDS / len(a), decontam.LONG_SCORE))
        for (k, _), v in zip(rows, decontam.align(a, b) / len(a)):
            assert ((k, i) in got) == (v >= enough) and abs(got.get((k, i), v) - v) < 1e-6, (k, i, v)
    assert len(got) > 50


def test_passages_follow_the_item(spark):
    items = spark.createDataFrame([(0, prose(8, 1)), (1, prose(4000, 2))], "item_id long, text string")
    docs = spark.createDataFrame([(0, prose(3000, 3) + " " + prose(8, 1) + " " + prose(3000, 4))], "doc_id long, text string")
    table = decontam.items(items)
    rows = decontam.passages(docs, decontam.seeds(table)).where("kind = 0").collect()
    assert [len(x.words) // 8 for x in rows] and max(len(x.words) // 8 for x in rows) <= 2 * 16 + 8


def test_decontamination_of_edited_copies(spark):
    items = [(k, prose((18, 30, 38, 55)[k % 4], 5000 + k)) for k in range(100)]
    shares, rows = (0.1, 0.15, 0.2, 0.25, 0.3), [(-1 - k, prose(200, 9000 + k)) for k in range(300)]
    for i, share in enumerate(shares):
        for k, t in items:
            n = 1000 * i + k
            rows.append((n, f"{prose(40, 20_000 + n)} {edit(t, share, n)} {prose(40, 30_000 + n)}"))
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id >= 0 and r.doc_id % 1000 == r.item_id for r in got)
    found = [sum(r.doc_id // 1000 == i for r in got) for i in range(len(shares))]
    assert all(n >= least for n, least in zip(found, (98, 96, 93, 85, 75))), found


def test_simhash(spark, odd, none):
    base = [prose(n, 900 + n) for n in range(60, 160)]
    rows = [(k, t) for k, t in enumerate(base)] + [(1000 + k, edit(t, 0.04, k)) for k, t in enumerate(base[:40])] + [(2000 + k, base[50]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.keep_id for r in simhash.groups(docs, bucket=16).collect()}
    s, _ = simhash.signatures_of([t for _, t in rows])
    d = np.bitwise_count(s[:, None, 0] ^ s[None, :, 0]).astype(int) + np.bitwise_count(s[:, None, 1] ^ s[None, :, 1])
    near = [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(d <= simhash.DISTANCE)) if i < j]
    assert sum(groups.get(a, -1) == groups.get(b, -2) for a, b in near) >= 0.9 * len(near)
    assert not any(k in groups for k in range(60, 100)) or all(groups[k] == k for k in groups if 60 <= k < 100)
    assert {groups[2000 + k] for k in range(30)} == {50}
    kept = simhash.dedup(docs).select("doc_id").collect()
    assert len(kept) == len(rows) - len(groups) + len(set(groups.values()))
    out = simhash.dedup(odd)
    assert out.columns == odd.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(["None", "1", "2", "3", "4", "5", "6", "7", "8"])
    assert simhash.groups(none).count() == 0 and simhash.dedup(none).count() == 0


def test_bucket_ends_by_brute_force():
    g = np.random.default_rng(2)
    p = np.unique(g.integers(0, 40, (300, 2)).astype(np.uint64) << np.uint64(58), axis=0)
    end = simhash.bucket_ends(p, 2, 5)
    sizes = np.diff([0, *np.unique(end)])
    assert end[-1] == len(p) and sizes.max() <= 5


def test_simhash_recall_at_long_prefixes(spark):
    """Pairs at the very limit are found by as many bits as a table of a million and more takes, with skewed bits too."""
    g = np.random.default_rng(8)
    for bias in (0.5, 0.62):
        bits = (g.random((1 << 14, simhash.BITS)) < bias).astype(np.uint8)
        for k in range(1000):
            bits[2 * k + 1] = bits[2 * k]
            bits[2 * k + 1, g.permutation(simhash.BITS)[: simhash.DISTANCE]] ^= 1
        s = np.packbits(bits, axis=1).view(np.int64)
        sigs = spark.createDataFrame(s.tolist(), "s0 long, s1 long")
        ids = [r.h for r in sigs.select(F.xxhash64("s0", "s1").alias("h")).collect()]
        root = {r.node: r.root for r in simhash.components(simhash.edges(sigs, bucket=8)).collect()}
        found = sum(root.get(ids[2 * k], ids[2 * k]) == root.get(ids[2 * k + 1], ids[2 * k + 1]) for k in range(1000))
        assert found >= 900, (bias, found)


def test_simhash_number_of_tables():
    trials = np.random.default_rng(6).random((20_000, simhash.BITS)).argsort(axis=1)[:, :14]
    assert abs((trials >= simhash.DISTANCE).all(axis=1).mean() - simhash.agreement(simhash.DISTANCE)[14]) < 0.005
    for least in range(25):
        t = simhash.tables_for(least)
        assert t >= simhash.TABLES and 1 - (1 - simhash.agreement(simhash.DISTANCE)[least]) ** t >= simhash.RECALL
    assert simhash.tables_for(14) > 73


def test_html(spark):
    page = "<html><head><title>Ti</title><script>var a='<p>x</p>';</script></head><body><nav><a href='/'>home</a><a>two</a></nav><p>" + prose(60, 1) + "</p><p>" + prose(70, 2) + " &amp; co<footer>c 2020 all rights</footer></body>"
    rows = [(1, page), (2, None), (3, ""), (None, "<p"), (4, "<p>" + "x " * 300_000), (1, page), (5, "<script>" + prose(50, 3)), (6, "no tags at all"), (7, "<p><a href='x'>" + prose(40, 4) + "</a></p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit("t"), "n_blocks": F.lit("x"), "n_kept": F.lit(1)})
    found = html_text.extract(df).collect()
    got = {r.page_id: r for r in found}
    assert len(found) == len(rows) and sum(r.page_id == 1 for r in found) == 2
    assert got[1].text.split("\n") == [prose(60, 1), prose(70, 2) + " & co"] and got[2].n_blocks == 0 and got[3].text == "" and got[4].n_kept == 1
    assert got[None].n_kept == 0 and got[5].n_blocks == 0 and got[6].n_kept == 0 and got[7].n_kept == 0
    assert html_text.extract(df.where("false")).count() == 0


def test_html_on_pages_held_out():
    """Each labelled page is judged by a tree that was grown on the others."""
    right, words, every = [], 0, 0
    for k, page in enumerate(html_text.PAGES):
        tree = html_text.train(html_text.PAGES[:k] + html_text.PAGES[k + 1 :])
        x, y = html_text.labelled([page])
        ok = html_text.classify(tree, x) == y
        right += ok.tolist()
        words, every = words + x[ok, 2].sum(), every + x[:, 2].sum()
    assert np.mean(right) >= 0.85 and words / every >= 0.93


def test_html_by_brute_force(spark):
    """Blocks, features and the tree's verdict on whole pages against a parser of the standard library and plain walks."""
    from html.parser import HTMLParser

    class Slow(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.words, self.linked, self.link, self.skip = [], [], 0, False, 0

        def cut(self):
            if self.words:
                self.out.append((" ".join(self.words), len(self.words), self.linked / len(self.words)))
            self.words, self.linked = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "noscript", "template", "svg", "iframe")
            self.link = True if tag == "a" else self.link
            if tag in html_text._BLOCK:
                self.cut()

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "noscript", "template", "svg", "iframe") and self.skip > 0
            self.link = False if tag == "a" else self.link
            if tag in html_text._BLOCK:
                self.cut()

        def handle_data(self, data):
            if not self.skip:
                own = data.split()
                self.words += own
                self.linked += len(own) * self.link

    def walk(tree, x, k=0):
        f, v, left, right = tree[k]
        return v >= 0.5 if f < 0 else walk(tree, x, left if x[f] <= v else right)

    tree = html_text.train()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    same = 0
    for r in html_text.extract(spark.read.parquet(f"{DIR}/pages.parquet")).collect():
        p = Slow()
        p.feed(pages[r.page_id])
        p.close()
        p.cut()
        own = [("", 0, 0.0), *p.out, ("", 0, 0.0)]
        kept = [b[0] for a, b, c in zip(own, own[1:], own[2:]) if walk(tree, [*a[1:], *b[1:], *c[1:]])]
        same += (r.n_blocks, r.text) == (len(p.out), "\n".join(kept))
    assert same >= 0.98 * len(pages), (same, len(pages))  # the two differ on tags that don't close


def test_token_output(spark, odd, none):
    g = np.random.default_rng(4)
    arrays = [g.integers(0, hi, n).astype(np.uint32) for hi, n in ((1, 5), (50_000, 1000), (10, 128), (2**32 - 1, 300), (2, 0), (300, 129))]
    arrays += [np.where(g.random(500) < 0.05, 4_000_000_000, g.integers(0, 30, 500)).astype(np.uint32)]
    packed = token_output.pack_many(arrays)
    for a, b in zip(arrays, packed):
        assert (token_output.unpack(b) == a).all() and len(token_output.unpack(b)) == len(a)
    assert (token_output.unpack_block(packed[1], 3) == arrays[1][384:512]).all() and len(packed[6]) < 700
    e = token_count.encoding(token_count.VOCABULARY)
    rows = {(r.doc_id, r.text) for r in odd.collect()}
    for r in token_output.encode(odd).collect():
        if r.payload is not None:
            ids = token_output.unpack(r.payload).tolist()
            assert r.n_tokens == len(ids) and (r.doc_id, e.decode(ids)) in rows
    assert token_output.encode(none).count() == 0


def test_vector_search(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("nan"), 1.0]), (9, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.rank, r.neighbour_id) for r in vector_search.neighbours(df.withColumn("v", F.lit(1)), 2).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1), (4, 1, 1), (4, 2, 2)]
    assert vector_search.neighbours(df.where("false")).count() == 0
    assert vector_search.neighbours(df.where("vec_id = 1")).count() == 0


def test_vector_search_by_brute_force(spark):
    """Clusters, copies by the hundred, ties, several passes and several rounds of exact reads."""
    g = np.random.default_rng(3)
    m = np.vstack([g.normal(size=(600, 8)), 0.01 * g.normal(size=(500, 8)) + 2, np.repeat(g.normal(size=(2, 8)), 300, axis=0), np.round(g.normal(size=(300, 8)))]).astype(np.float32)
    ids = g.permutation(10 * len(m))[: len(m)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m)], "vec_id long, embedding array<float>").repartition(7)
    got = {}
    for r in vector_search.neighbours(df, 5, F.col("vec_id") % 9 == 0, pass_bytes=50 * 32).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id, r.distance))
    assert set(got) == {int(i) for i in ids if i % 9 == 0}
    for q, found in got.items():
        d = np.sqrt(((m.astype(np.float64) - m[ids == q][0].astype(np.float64)) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:5]
        assert [x for _, x, _ in sorted(found)] == [int(ids[k]) for k in order]
        assert np.allclose([v for *_, v in sorted(found)], d[order], atol=1e-6)


def test_vector_bounds_hold():
    g = np.random.default_rng(5)
    m = np.vstack([g.normal(size=(2000, 6)) * [1, 10, 0, 1e-3, 1, 5], [[0, 0, 0, 0, 0, 0]]]).astype(np.float32)
    lo, hi = m.min(0).astype(np.float64), m.max(0).astype(np.float64)
    cells = vector_search.Cells(lo, (hi - lo) / vector_search.CELLS)
    codes = np.clip((m - lo) / np.where(cells.width > 0, cells.width, 1), 0, 255).astype(np.uint8)
    q = g.normal(size=m.shape) * 3
    near, far = cells.bounds(q, codes)
    d = np.sqrt(((q - m) ** 2).sum(1))
    assert (near <= d).all() and (d <= far).all()


def test_line_dedup(spark):
    schema = "page_id long, url string, html string"
    rows = [(k, f"http://A.test:80/{k}", f"<p>menu</p><p>own {k}</p><p>own {k}</p>") for k in range(20)] + [(50, None, "<p>menu"), (51, "x", None), (None, "http://b.test/", ""), (None, None, None)]
    rows += [(60, "http://c.test/1", "<p>a</p><script>var x = '<p>b</p>'"), (61, "http://c.test/2", "<p>" + "word " * 300_000 + "</p><!-- open <p>c</p>"), (62, "http://d.test/", "<p>same")] + [(63, "http://e.test/", "<p>again</p>")] * 3
    df = spark.createDataFrame(rows, schema).withColumns({"lines": F.lit(1), "host": F.lit("h"), "bad": F.lit("b"), "part": F.lit(0)})
    for hot in (line_dedup.HOT, 4):
        found = line_dedup.drop_boilerplate(df, hot=hot).collect()
        got = {r.page_id: r for r in found}
        assert len(found) == len(rows)
        assert got[3].text == "own 3\nown 3" and got[3].host == "a.test" and got[3].n_dropped == 1 and got[50].text == "menu" and got[51].text == "" and got[None].n_lines == 0
        assert got[60].text == "a" and got[61].n_lines == 1 and len(got[61].text) == 1_499_999 and got[62].text == "same" and got[63].text == ""
    assert line_dedup.drop_boilerplate(df.where("false")).count() == 0
    tie = spark.createDataFrame([(k, f"http://t.test/{k}", f"<p>{'half' if k % 2 else 'x'}</p><p>{'three' if k < 3 else 'y'}</p>") for k in range(12)], schema)
    got = {r.page_id: r.text for r in line_dedup.drop_boilerplate(tie, ratio=0.5).collect()}
    assert got[1] == "half\nthree" and got[4] == "x"  # at the ratio a line stays; y is on 9 of 12 pages
    assert {r.page_id: r.text for r in line_dedup.drop_boilerplate(tie, ratio=0.2).collect()} == dict.fromkeys(range(12), "")


def _schedule(spans):
    """The schedule slot by slot: spans is a list of (source, blocks, lo, hi)."""
    played, out, t = {s: 0 for s, *_ in spans}, [], 0
    m = min(48, max(int(np.ceil(np.log2((b + 1) * 2.0**48 / (hi - lo)))) for _, b, lo, hi in spans))
    while any(played[s] < b for s, b, *_ in spans):
        point = int(f"{t:0{m}b}"[::-1], 2) << (48 - m)
        s, b = next((s, b) for s, b, lo, hi in spans if lo <= point < hi)
        out.append((t, s, played[s] % b))
        played[s], t = played[s] + 1, t + 1
    return out


def test_mixing_by_brute_force(spark):
    """Schedule, blocks and their joined tokens against plain Python; Chinese texts without blanks fill blocks alike."""
    r = random.Random(8)
    docs = [(k, prose(40 + k % 60, k), "a" if k % 10 else "b") for k in range(150)]
    docs += [(1000 + k, "".join(chr(r.randrange(0x4E00, 0x5000)) for _ in range(600)), "zh") for k in range(10)] + [(5, prose(45, 5), "a"), (None, "null id", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    got = sorted(mixing.blocks(df, block=100).collect(), key=lambda x: x.slot)
    rows = mixing.coded(df).collect()
    total = {}
    for x in rows:
        total[x.source] = total.get(x.source, 0) + x.n
    n = {s: -(-v // 100) for s, v in total.items()}
    w = {s: v**mixing.POWER for s, v in total.items()}
    share = {s: max(w[s] / sum(w.values()), n[s] / (mixing.LONGEST * sum(n.values()))) for s in w}
    spans, at = [], 0.0
    for s in sorted(share):
        lo, at = round(at / sum(share.values()) * 2**48), at + share[s]
        spans.append((s, n[s], lo, round(at / sum(share.values()) * 2**48)))
    assert [(x.slot, x.source, x.block) for x in got] == _schedule(spans)
    e = token_count.encoding(token_count.VOCABULARY)
    keys = {x.uid: h for x, h in zip(rows, [r.h for r in spark.createDataFrame([(x.k1, x.k2) for x in rows], "k1 long, k2 int").select(mixing.order_key(3).alias("h")).collect()])}
    texts = {i: t for i, t, _ in docs}
    for s in total:
        own = sorted((x for x in rows if x.source == s), key=lambda x: (keys[x.uid], x.doc_id is not None, x.doc_id or 0, x.k1, x.k2, x.uid))
        ids = np.concatenate([e.encode_ordinary(texts[x.doc_id]) for x in own])
        ends = np.cumsum([x.n for x in own])
        for x in (x for x in got if x.source == s):
            a, b = 100 * x.block, min(100 * x.block + 100, len(ids))
            assert np.frombuffer(x.tokens, mixing.word()).tolist() == ids[a:b].tolist() and x.n_tokens == b - a
            assert x.doc_ids == [own[k].doc_id for k in range(len(own)) if ends[k] > a and ends[k] - own[k].n < b]
    assert all(x.n_tokens == 100 or x.block == n[x.source] - 1 for x in got)


def test_mixing(spark, odd, none, monkeypatch):
    docs = spark.createDataFrame([(k, prose(50 + k % 40, k), "a" if k % 10 else "b") for k in range(400)], "doc_id long, text string, source string")
    got = mixing.blocks(docs, {"a": 0.5, "b": 0.5}, block=100).collect()
    slots = {r.slot: r.source for r in got}
    assert sorted(slots) == list(range(len(got))) and {i for r in got for i in r.doc_ids} == set(range(400))
    for n in (20, 50, 100, 300, len(got)):  # low discrepancy at every prefix
        assert abs(sum(slots.get(t) == "a" for t in range(n)) - n / 2) <= 3
    for weights in ({"a": 1, "b": 1e-12}, {"a": 1e-300, "b": 1e300}, {"a": 1, "b": 1e-12, "c": 3}):  # a share too small to play gets the least that does
        got = mixing.blocks(docs, weights, block=100).collect()
        assert {i for r in got for i in r.doc_ids} == set(range(400)) and len(got) <= 18 * len({(r.source, r.block) for r in got})
    got = mixing.blocks(docs, {"a": 1, "b": 0}, block=100).collect()
    assert {r.source for r in got} == {"a"} and len(got) == len({r.block for r in got})
    out = mixing.mix(docs, {"a": 0.5, "b": 0.5}, block=100).collect()
    assert {r.doc_id for r in out} == set(range(400)) and len(out) > 600
    assert mixing.blocks(odd).count() > 0
    out = mixing.mix(odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}
    assert mixing.blocks(none).count() == 0 and mixing.mix(none).count() == 0
    monkeypatch.setattr(mixing, "PART", 500)  # many parts, and one that equal rows make too large
    again = docs.unionByName(spark.createDataFrame([(7, prose(70, 7), "a")] * 200, docs.schema))
    got = mixing.blocks(again, block=100).collect()
    first = {(r.source, r.block): r for r in got}
    assert sum(r.n_tokens for r in first.values()) == sum(r.n for r in mixing.coded(again, ids=False).collect())
    assert len({r.slot for r in got}) == len(got) and sum(i == 7 for r in first.values() for i in r.doc_ids) >= 201


def test_url_filter_on_unseen_sites():
    """Five folds of whole sites: a model never sees a page of the sites that it judges."""
    table = url_filter.LABELLED
    sites = np.random.default_rng(1).permutation(sorted({s for *_, s in table}))
    p, y = np.zeros(len(table)), np.array([v for _, v, _ in table])
    for fold in range(5):
        held = set(sites[fold::5].tolist())
        model = url_filter.train([row for row in table if row[2] not in held])
        at = [k for k, row in enumerate(table) if row[2] in held]
        p[at] = url_filter.probability([table[k][0] for k in at], model)
    blocked = p >= url_filter.THRESHOLD
    assert blocked[y == 1].mean() >= 0.75 and blocked[y == 0].mean() <= 0.12


def test_url_filter(spark):
    df = spark.createDataFrame([(1, "https://www.best-casino.test/en/1"), (2, "https://www.city-library.test/a"), (3, None), (4, " "), (None, "http://[bad"), (5, "http://x.test/" + "casino" * 20_000), (2, "https://www.city-library.test/a"), (6, "://"), (7, "no scheme, \U0001f600 and blanks")], "page_id long, url string")
    rows = url_filter.score(df.withColumns({"p_bad": F.lit("x"), "blocked": F.lit(1), "row": F.lit(2)})).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == df.count() and sum(r.page_id == 2 for r in rows) == 2
    assert got[1].blocked and not got[2].blocked and got[3].blocked and got[3].p_bad is None and got[4].blocked and got[5].blocked
    assert url_filter.score(df.where("false")).count() == 0


def test_url_filter_by_brute_force(spark):
    """The n-grams, hashes and logits of every page against plain Python."""
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    w, bias = model = url_filter.train()

    def mix(x):
        x &= (1 << 64) - 1
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
        return x ^ x >> 31

    def slow(url):
        u = url.strip().lower().split("#")[0].split("?")[0].split("://", 1)[-1]
        host, _, path = u.partition("/")
        held = set()
        for part in (host.split("@")[-1].split(":")[0].removeprefix("www."), path):
            t = "_" + re.sub(r"\d", "0", re.sub(r"[^\w]+|_+", "_", part)) + "_"
            for n in url_filter.ORDERS:
                for i in range(len(t) - n + 1):
                    h = 0
                    for c in t[i : i + n]:
                        h = (h * 0x9E3779B97F4A7C15 + mix(ord(c))) & (1 << 64) - 1
                    held.add(mix(h + n) >> 64 - url_filter.BITS)
        return 1 / (1 + np.exp(-(sum(w[b] for b in held) / np.sqrt(max(1, len(held))) + bias)))

    for r in url_filter.score(pages, model).collect():
        assert abs(r.p_bad - slow(r.url)) < 1e-9 and r.blocked == (r.p_bad >= url_filter.THRESHOLD)


def test_pipeline_by_brute_force(spark):
    """Each stage against a plain computation over the rows that the stage before kept."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    z = toxicity.logits(list(rows.values()), model)
    rows = {k: t for (k, t), v in zip(rows.items(), z) if 1 / (1 + np.exp(-v)) < model.threshold}
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, DIR).collect()} == set(rows)
    ids, (s, _) = list(rows), simhash.signatures_of(list(rows.values()))
    root = dict(zip(ids, ids))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    d = np.bitwise_count(s[:, None, 0] ^ s[None, :, 0]).astype(int) + np.bitwise_count(s[:, None, 1] ^ s[None, :, 1])
    for i, j in zip(*np.nonzero(d <= simhash.DISTANCE)):
        a, b = sorted((find(ids[i]), find(ids[j])))
        root[b] = a
    rows = {k: t for k, t in rows.items() if find(k) == k}
    now = docs.where(F.col("doc_id").isin([*ids]))
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, now, DIR).collect()} == set(rows)
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    whole = {k for k, t in rows.items() if any(x in " ".join(words(t)) for x in items)}
    now = docs.where(F.col("doc_id").isin([*rows]))
    left = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, now, DIR).collect()}
    assert whole and not whole & left and len(set(rows) - left - whole) <= 1
    e = token_count.encoding(token_count.VOCABULARY)
    got = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in got} == left
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(e.decode(token_output.unpack(r.payload).tolist()) == texts[r.doc_id] for r in got)


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Null ids and texts, empty, repeated and very long rows, and no rows at all, through every stage."""
    columns = "doc_id long, text string, lang string, source string, n_chars int"
    rows = [(r.doc_id, r.text, None, r.source, 1) for r in odd.collect()]
    for name, own in (("odd", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(own, columns).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(5, 0, 0), (8, 1, 1), (None, 1, None)] if own else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(0, prose(20, 901)), (None, None), (1, "")] if own else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = corpus_pipeline.run(spark, d).collect()
        # row 5 stands for its copies; rows without text, tokens or words stay as they are; row 8 is labelled toxic, but is one text
        assert ({r.doc_id for r in got} - {8} == {None, 1, 2, 3, 4, 5, 6, 7}) if own else not got
