"""The training-data operators against brute force, round trips and held-out rows, and on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veriframe.llm import chat, decontam, html, licenses, packing, quality, rabitq, simhash, tokens, toxicity
from veriframe.llm.queries import QUERIES, vocabulary
from veriframe.llm.shared import connected_components, forest

DIR = "/root/testdata/sf0.001"
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "Ünï <|endoftext|> 'tis  two   spaces \n\n x"), (5, "word " * 3000), (6, "日本 İstanbul ﬁ é"), (7, " \t\n ")]


def table(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "fp": F.lit(1), "part": F.lit(None).cast("int"), "seg": F.lit(2)})


def texts(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)], "a long, b long")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (9, 1)]
    assert connected_components(edges.limit(0)).count() == 0
    member, root = forest(5, np.array([0, 3]), np.array([3, 4]))
    assert sorted(zip(member, root)) == [(3, 0), (4, 0)]


def test_html_broken_and_other_templates(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><div class='main-body'><h1>A &amp; B</h1><p>one <b>two</b><p>three<br>four<aside>side</aside></div><div id='comments'>no</div><script>var x='<p>';</script><footer>f</footer></body>"
    assert html.main_text(page, None)[0] == "A & B one two three four"
    assert html.main_text("<article>a<form>f</form> b<div class='comments'>c</div></article>x", None)[0] == "a b"
    for odd in (None, "", "<", "<p", "<p class='x", "a<b", "&#xZZ;", "</p></p>", "<script>never ends"):
        assert isinstance(html.main_text(odd, None)[0], str)
    rows = [(i, "http://h.example/x", f"<body><div><span>Shop</span> <i>of</i></div><div class=z><p>text {i} is long enough to be the slot with most text</p></div><div>Terms apply</div></body>") for i in range(5)]
    rows += [(None, None, None), (9, "odd url", "<p>x</p>"), (9, "odd url", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("t"))
    out = html.extract(df).collect()
    assert len(out) == 8
    got = {r.page_id: r for r in out}
    assert got[2].text == "text 2 is long enough to be the slot with most text" and got[2].template_tokens > 5 and got[2].n_chars == len(got[2].text)
    assert got[None].text == "" and got[9].text == "x"
    assert html.extract(df.limit(0)).count() == 0


def test_html_keeps_sibling_containers():
    page = "<body><div class=page><section id=s1><p>the first and by far the heaviest section of all</p></section><section id=s2><p>second</p></section><div class=ad>buy</div></div></body>"
    assert html.main_text(page, None)[0] == "the first and by far the heaviest section of all second"


def test_html_template_decides_without_telling_names(spark):
    """The given pages without article, nav, footer and class names: the template finds what the names would have told."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: r for r in html.extract(pages).collect()}
    names = {"<nav>": "<div class=k1>", '<div class="ad">': "<div class=k2>", "<article>": "<div class=k3>", "<footer>": "<div class=k4>", "</nav>": "</div>", "</article>": "</div>", "</footer>": "</div>"}
    bare = lambda page: re.sub("|".join(map(re.escape, names)), lambda m: names[m[0]], page)
    made = spark.createDataFrame([(r.page_id, r.url, bare(r.html)) for r in pages.collect()], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(made).collect()}
    with_template = [i for i, r in got.items() if r.template_tokens]
    assert len(with_template) > 150 and all(got[i].text == want[i].text for i in with_template)
    alone = {r.page_id: html.main_text(r.html, None)[0] for r in made.collect()}
    assert sum(alone[i] != got[i].text for i in with_template) > 20  # with the template off the texts are others


def test_html_template_text_in_articles_goes_but_copies_stay(spark):
    share = "<p>Share this story</p>"
    rows = [(i, "http://a.example/x", f"<body><div class=q>Menu</div><article><h1>Title {i}</h1><p>Body number {i} of some length</p>{share}</article></body>") for i in range(8)]
    rows += [(20 + i, "http://b.example/x", f"<body><div class=q>Menu {i}</div><article><p>One story that all pages copy</p></article></body>") for i in range(5)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} Body number {i} of some length" for i in range(8))
    assert all(got[20 + i] == "One story that all pages copy" for i in range(5))
    assert html.main_text(rows[0][2], None)[0].endswith("Share this story")


def test_html_classes_by_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for i in range(40):
        items = "".join(f"<li>{rng.choice('abc')}</li>" for _ in range(rng.randint(1, 3)))
        rows.append((i, f"http://h{i % 3}.example/", f"<body><ul>{items}</ul><div class=x><p>text {i}</p>{'<hr>' * (i % 2)}</div><p>end</p></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    for r in html.templates(df).collect():
        mine = [html.signature(*html.parse(doc)[:2]) for i, u, doc in rows if r.host in u]
        longest = [max((x.text for x in html.parse(doc)[1]), key=len) for i, u, doc in rows if r.host in u]
        vectors = {}
        for key in {k for m in mine for k in m}:
            vectors[key] = tuple(m.count(key) for m in mine)
        runs = {html.run_key(x) for _, u, doc in rows if r.host in u for x in html.parse(doc)[1]}
        often = {k: v for k, v in vectors.items() if sum(map(bool, v)) >= max(html.SUPPORT * len(mine), html.LEAST_PAGES * html.SUPPORT)}
        often = {k: v for k, v in often.items() if k not in runs or len({t for t, n in zip(longest, v) if n}) >= html.LEAST_PAGES}
        found = {t.token: t.cls for t in r.template if t.kind != html.CONTAINER}
        assert found.keys() == often.keys()
        assert len({(found[k], often[k]) for k in found}) == len(set(found.values())) == len(set(often.values()))


def test_segments_are_maximal():
    model, rng = toxicity.Toxicity(np.zeros(0, np.int64), np.zeros(0, np.float32)), random.Random(1)

    def brute(s):
        """All maximal scoring segments: the best one (shortest of equals), then the same on both sides."""
        best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[2], -best[2] - best[1]
        return brute(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute(s[b:])]

    for _ in range(200):
        s = [rng.choice([-1.7, -0.31, 0.53, 2.11]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in model.segments(np.array(s))] == brute(s)


def test_toxicity_learns_and_takes_odd_rows(spark):
    rng = random.Random(2)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        rows.append((i, " ".join(rng.choices(plain, k=60) + ["zzvile", "zzrot"] * toxic)))
        labels.append((i, int(toxic)))
    docs, lab = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, lab).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    model = toxicity.fit(docs, lab)
    odd = table(spark).select("doc_id", toxicity.scorer(model, spark)("text").alias("r")).collect()
    assert len(odd) == len(ODD) and all(0 <= r.r.score < 0.5 for r in odd)
    assert toxicity.score_toxicity(docs.limit(0), lab).count() == 0 and toxicity.score_toxicity(table(spark), lab.limit(0)).count() == len(ODD)


def test_separable_labels_give_a_finite_curve():
    x = np.c_[np.ones(400), np.r_[np.zeros(200), np.full(200, 17.0)], np.r_[np.zeros(200), np.full(200, 5.0)]]
    w = toxicity._logistic(x, np.r_[np.zeros(200), np.ones(200)])
    assert x[0] @ w < -2 and x[-1] @ w > 2


def test_chat_round_trip(spark):
    turns = [(1, 2, "user", "bye </turn>\n<turn>assistant\n&lt; \\"), (1, 0, "user", "q&amp;"), (1, 1, "assistant", "a<b"), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, None, None, None), (None, 1, "as\nsistant", "x"), (4, 0, "assistant", "one"), (4, 1, "assistant", "two")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("upto", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.expand_targets(df)).collect()}
    for conv, r in got.items():
        own = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text in turns if c == conv])
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.expand_targets(df.limit(0))).count() == 0
    e = chat.expand_targets(df).filter("conv_id = 1 and upto = 2").first()
    assert e.formatted[e.loss_start : e.loss_start + e.loss_length] == "a&lt;b" and "bye" not in e.formatted


def test_ordinal_thresholds_and_grades():
    rng = random.Random(3)
    texts, grades = [], []
    for i in range(600):
        g = i % 3
        texts.append(" ".join(rng.choices([f"w{k}" for k in range(50)], k=30) + ["bad"] * (4 * (g == 0)) + ["fine"] * (4 * (g == 2))))
        grades.append(g)
    m = quality.fit_rows([quality.features(t, {}) for t in texts[:450]], grades[:450])
    assert (np.diff(m.thresholds) > 0).all()
    tails = [m.tails(t, {}) for t in texts[450:]]
    assert all((np.diff(t) <= 0).all() for t in tails)
    assert np.mean([int((t > 0.5).sum()) == g for t, g in zip(tails, grades[450:])]) > 0.9


def test_ordinal_gradient_by_differences():
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 40, 6), rng.random(6)) for _ in range(30)]
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    start, of, y = np.arange(30) * 6, np.repeat(np.arange(30), 6), rng.integers(0, 4, 30)
    p = np.r_[rng.normal(0, 0.3, 1 << quality.BITS), -0.5, 0.1, -0.2]
    at = lambda q: quality.loss(q, idx, val, start, of, y, 3, 1e-2)
    grad = at(p)[1]
    for k in [*range(40), len(p) - 3, len(p) - 2, len(p) - 1]:
        step = np.zeros(len(p))
        step[k] = 1e-5
        assert abs((at(p + step)[0] - at(p - step)[0]) / 2e-5 - grad[k]) < 1e-5
    # the likelihood by hand
    theta = np.r_[p[-3], p[-3] + np.cumsum(np.exp(p[-2:]))]
    tail = lambda eta, j: 1.0 if j == 0 else 0.0 if j == 4 else 1 / (1 + np.exp(theta[j - 1] - eta))
    want = -np.mean([np.log(tail(e, g) - tail(e, g + 1)) for e, g in (((p[i] * v).sum(), g) for (i, v), g in zip(rows, y))])
    assert abs(at(p)[0] - want - 5e-3 * (p[: 1 << quality.BITS] ** 2).sum()) < 1e-9


def test_null_quality_is_no_rating(spark):
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id, r.grade) for r in quality.graded(lab).collect() if r.grade is not None) == [(1, 1), (2, 0)]


def test_quality_on_odd_rows(spark):
    lab = spark.createDataFrame([(3, 1), (5, 0), (7, 2), (None, 1), (6, None)], "doc_id long, grade int")
    got = quality.score_quality(table(spark), lab).collect()
    assert len(got) == len(ODD) and all(0 <= r.p_tail <= 1 for r in got)
    assert quality.score_quality(table(spark).limit(0), lab).count() == 0


def test_token_counts_as_the_library(spark):
    tok = tokens.tokenizer(vocabulary(WORD))
    for df in (table(spark), texts(spark)):
        got = tokens.count_tokens(df, vocabulary(WORD)).collect()
        want = sorted((r.doc_id or 0, len(tok.encode(r.text or "", add_special_tokens=False).ids), len((r.text or "").encode())) for r in df.collect())
        assert sorted((r.doc_id or 0, r.n_tokens, r.n_bytes) for r in got) == want
    whole = tokens.whole_tokens(vocabulary(WORD))
    assert len(whole) > 10_000 and all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(whole)[::500])


def test_chunked_ids_as_the_library():
    rng, tok = random.Random(4), tokens.tokenizer(vocabulary(BYTE))
    parts = ["a", "Word", " ", "  ", "\n", "\t", "'s", "é", "12", "!!", ".", "don't", "\r\n", "<|endoftext|>", "½", "¿", "日"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    got = tokens.Ids(vocabulary(BYTE)).encode(made)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in made]


def test_leaks_by_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(6)]
    bench = [("b1", " ".join(rng.choices(vocab, k=7))), ("b2", "V1, v2"), ("b3", None), ("b4", "..."), ("b5", " ".join(rng.choices(vocab, k=5))), ("b5", "v3 v3 v3 v3 v3")]
    docs = [(1000 + i, " ".join(rng.choices(vocab + ["other"], k=rng.randint(0, 80)))) for i in range(120)] + ODD
    for n in (2, 4):
        windows = {}
        for item, text in bench:
            w = words(text)
            for k in range(max(1, len(w) - n + 1) if w else 0):
                windows.setdefault(tuple(w[k : k + n]), set()).add(item)
        df, b = table(spark, docs), spark.createDataFrame(bench, "item_id string, text string").withColumn("item", F.lit(0))
        want = []
        for i, text in docs:
            w, hit, items = words(text), set(), set()
            for key, its in windows.items():
                for k in range(len(w) - len(key) + 1):
                    if tuple(w[k : k + len(key)]) == key:
                        hit |= set(range(k, k + len(key)))
                        items |= its
            want.append((i or 0, len(w), len(hit), ",".join(sorted(items))))
        got = decontam.find_leaks(df, b, words=n).collect()
        assert sorted((r.doc_id or 0, r.n_words, sum(e - s for s, e in r.spans), ",".join(r["items"])) for r in got) == sorted(want)
        clean = decontam.remove_leaks(df, b, words=n)
        assert clean.columns == df.columns and all(not r.spans for r in decontam.find_leaks(clean, b, words=n).collect())
        kept = dict((r.doc_id, r.text) for r in clean.collect())
        assert all(kept[i] == t for (i, t), w in zip(docs, want) if not w[2])


def test_blocks_of_a_large_benchmark_agree(spark, monkeypatch):
    docs, bench = texts(spark), spark.read.parquet(f"{DIR}/benchmark.parquet")
    one = sorted(map(str, decontam.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 2000)
    assert sorted(map(str, decontam.find_leaks(docs, bench).collect())) == one


@pytest.mark.parametrize("chars", [2, 3, 4, 10**6])
def test_removal_is_the_same_for_blocks_of_any_size(spark, monkeypatch, chars):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
    bench = spark.createDataFrame([("a", "r1 r2"), ("b", "q s")], "item_id string, text string")
    docs = table(spark, [(1, "p q r1 r2 s t"), (2, "q x s"), (3, None), (4, "")])
    got = decontam.remove_leaks(docs, bench, words=2)
    assert got.columns == docs.columns and {r.doc_id: (r.text or "").split() for r in got.collect()} == {1: ["p", "t"], 2: ["q", "x", "s"], 3: [], 4: []}


def test_packing_places_every_id_once(spark):
    tok = tokens.tokenizer(vocabulary(BYTE))
    rows = [r for r in ODD if r[0] not in (None, 3)] + [(r.doc_id + 100, r.text) for r in texts(spark).collect()]
    got = packing.pack(table(spark, rows).repartition(3), vocabulary(BYTE)).toPandas()
    for i, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        g = got[got.doc_id == i].sort_values("start")
        assert g.length.sum() == len(ids) and (g.doc_tokens == len(ids)).all() and list(g.start) == [0, *g.length.cumsum()[:-1]]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() in {1 << k for k in range(11)}
    assert packing.pack(table(spark).limit(0), vocabulary(BYTE)).count() == 0
    assert packing.pack(table(spark), vocabulary(BYTE)).filter("start = 0").count() == len(ODD)


def test_bm25_prefers_shared_rare_terms():
    a = [np.array(x, np.uint16) for x in ([1, 1, 7, 8], [1, 7, 8, 9], [1, 2, 3], [1, 5, 3])]
    index = packing.Bm25(a)
    assert index.neighbours(0, np.zeros(4, bool), 12, 4)[0] == 1
    assert index.neighbours(2, np.array([0, 0, 0, 1], bool), 12, 4)[:1] != [3]


def test_bm25_goes_on_to_all_neighbours():
    rng = np.random.default_rng(3)
    a = [np.r_[rng.choice(9, 4, replace=False), 100 + k % 2].astype(np.uint16) for k in range(300)]  # short texts: far more neighbours than are asked for at once
    a += [np.r_[np.arange(200, 212), 300].astype(np.uint16), np.arange(200, 212).astype(np.uint16), np.array([300, 301], np.uint16), np.array([300, 302], np.uint16)]
    index = packing.Bm25(a)
    got = list(index.search(0, np.zeros(len(a), bool), 2, 16))
    want = [k for k in range(1, len(a)) if any(index.idf[x] > 0 and x in a[k] for x in set(a[0].tolist()))]
    assert sorted(got) == want and len(want) > 150
    assert sorted(index.search(300, np.zeros(len(a), bool), 12, 64)) == [301, 302, 303]  # 302 and 303 share the 13th term alone


def test_embeddings_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BUCKET", 16)
    monkeypatch.setattr(rabitq, "BLOCK", 20)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 24))
    v = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0, 0.05, 0.12, 0.2)] + [np.repeat(base[:1], 50, 0)])
    rows = [(i, x.tolist(), i % 2 if i < 240 else 0) for i, x in enumerate(v)]
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] * 24, 0), (904, rows[0][1], None), (905, [], 0), (906, rows[0][1][:5], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(1))
    got = {r.vec_id: r for r in rabitq.near_embeddings(df).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (u @ u.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(s, False)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert 0.99 * s.sum() <= found <= s.sum() and all(got[i].n_links <= s[i].sum() for i in range(len(rows)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, *_ in odd)
    assert rabitq.near_embeddings(df.limit(0)).count() == 0


def test_repeated_vectors_count_once(spark):
    a, b, c = [1.0, 0.0], [1.0, 0.05], [0.0, 1.0]
    df = spark.createDataFrame([(1, a, 0), (1, a, 0), (2, b, 0), (3, a, 0), (4, c, 0), (5, a, 1), (6, [2.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rabitq.near_embeddings(df).collect())
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 3, 1, False)]


def test_recall_of_planted_pairs_in_large_groups(spark):
    """Groups far larger than BUCKET, pairs just at the threshold: links found against brute force."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3000, 32))
    near = base + rng.standard_normal(base.shape) * rng.uniform(0.1, 0.2, (3000, 1))
    v = np.concatenate([base, near])
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum() - len(u)
    found = sum(r.n_links for r in rabitq.near_embeddings(df).collect())
    assert len(v) > 16 * rabitq.BUCKET and want > 2000 and 0.985 * want <= found <= want, (found, want)
    print("recall", found, want)


def test_simhash_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps for _ in range(4)] + [fps[0] ^ (1 << k) for k in range(40)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    signed = np.array(fps, np.uint64).astype(np.int64).tolist()
    want = connected_components(spark.createDataFrame([(signed[i], signed[j]) for i, j in pairs], "a long, b long"))
    assert sorted(map(tuple, connected_components(simhash.hamming_links(df)).collect())) == sorted(map(tuple, want.collect()))


def test_simhash_fingerprints_and_odd_rows(spark):
    import xxhash

    def plain(text):
        w = [x for x in re.split(r"[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    for _, t in ODD:
        assert simhash.fingerprint(t) == plain(t)
    got = simhash.simhash_components(table(spark)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == "0" * 16 and {by[1].component_id, by[2].component_id, by[7].component_id} == {1} and by[3].component_id == 3
    assert simhash.simhash_components(table(spark).limit(0)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(5000)]
    rows = []
    for i in range(150):
        w = rng.choices(vocab, k=rng.randint(60, 400))
        rows.append((3 * i, " ".join(w)))
        for p in rng.sample(range(len(w)), max(1, len(w) // 80)):  # a changed word changes five shingles of len(w)
            w[p] = "changed"
        rows.append((3 * i + 1, " ".join(w)))
        rows.append((3 * i + 2, " ".join(rng.choices(vocab, k=100) + w[:40])))
    docs = table(spark, rows + [(None, "same"), (None, "same")])
    left = simhash.near_dedup(docs)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    near = [i for i in range(1, 450, 3) if i not in ids]
    assert len(near) >= 140 and all(i in ids for i in range(450) if i % 3 != 1) and left.filter("doc_id is null").count() == 2
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_near_copies_at_the_threshold_by_brute_force(spark):
    rng, rows, pairs = random.Random(11), [], []
    for k in range(900):
        n = rng.randrange(120, 400)
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for p in rng.sample(range(2, n - 4, 6), round(n * rng.uniform(0.016, 0.03))):
            b[p] = f"v{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (a, b))
        pairs.append((2 * k, len(x & y) / len(x | y)))
    got = {r.doc_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [i in got for i, j in pairs if 0.8 <= j <= 0.85]
    assert len(near) > 150 and np.mean(near) >= 0.99
    assert not [i for i, j in pairs if j < 0.8 and i in got] and len([1 for _, j in pairs if 0.72 < j < 0.8]) > 150


@pytest.mark.parametrize("text, said, open", [
    ("MIT", "mit", True), ("MIT OR GPL-3.0", "mit or gpl-3.0", True), ("(MIT OR GPL-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "(mit or gpl-2.0) and gpl-2.0-only with classpath-exception-2.0", False),
    ("MIT OR B AND C */", "mit or b and c", True), ("((MIT))", "mit", True), ("", None, None), ("AND", None, None), ("(MIT", None, None)])
def test_expressions(text, said, open):
    got = licenses.parse(text)
    assert (licenses.evaluate(got) if got else (None, None)) == (said, open)


def test_expressions_of_many_choices_stay_small():
    text = " AND ".join(f"(A{k} OR MIT)" for k in range(400))
    said, open = licenses.evaluate(licenses.parse(text))
    assert said == text.lower().replace("(", "(") and open


def test_expressions_by_brute_force():
    rng, names = random.Random(12), ["MIT", "ISC", "GPL-3.0", "Foo"]

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(names)
        return f"({make(depth - 1)}) {rng.choice(['AND', 'OR'])} ({make(depth - 1)})"

    for _ in range(300):
        text = make(4)
        plain = re.sub(r"[A-Za-z0-9.-]+", lambda m: {"AND": "and", "OR": "or"}.get(m[0], str(m[0].lower() in licenses.OPEN)), text)
        said, open = licenses.evaluate(licenses.parse(text))
        assert open == eval(plain) and licenses.evaluate(licenses.parse(said)) == (said, open)  # noqa: S307
        assert sorted(set(licenses.licences(licenses.parse(text)))) == sorted({w.lower() for w in re.findall(r"[A-Za-z0-9.-]+", text) if w not in ("AND", "OR")})


def plain_scan(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hits = [(k, x) for phrase, x in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    every = {**licenses.NOTICES, **licenses.BASE}
    longest = {}
    for phrase, x in every.items():
        n = len(phrase.split())
        for k in range(len(w) - n + 1):
            if w[k : k + n] == phrase.split() and n > longest.get(k, (0,))[0]:
                longest[k] = (n, x)
    labels = {x for _, x in hits} | {x for _, x in longest.values()}
    for m in re.finditer(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier:(?=[ \t]*([^\n\r]*))", text or "", re.I):
        if not (m.start() and re.match(r"[0-9A-Za-z\x80-\U0010ffff]", text[m.start() - 1])) and (p := licenses.parse(m[1])):
            labels |= {x for x in licenses.licences(p) if x in ("mit", "isc", "zlib", "mpl-2.0", "apache-2.0")}  # of the tags in these texts, those that are licences
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels))


def test_licenses_by_brute_force(spark):
    rows = [(10, "under the MIT license, under-the mit LICENSE"), (11, "cc by nc by nc"), (12, "CC-BY-NC-SA 4.0"), (13, "// SPDX-License-Identifier: (MIT OR Apache-2.0)"), (14, "Apache License, Version 2.0"), (15, "GNU General Public License, version 3")] + ODD
    rng = random.Random(9)
    parts = [*licenses.BASE, *licenses.NOTICES, "under", "the", "MIT", "cc", "by", "nc", "é", "\n", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: (A OR B) AND C-1.0\n", "SPDX-License-Identifier: (ISC OR Zlib) AND MPL-2.0\n", "SPDX-License-Identifier: see LICENSE\n", "SPDX-License-Identifier", "xSPDX-License-Identifier: Z", "2.0", "...", "license"]
    rows += [(100 + k, rng.choice([" ", ", ", "-"]).join(rng.choices(parts, k=rng.randint(0, 40)))) for k in range(400)]
    for r in licenses.scan_licenses(table(spark, rows)).collect():
        text = {i: t for i, t in rows}[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == plain_scan(text), text
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert got[13].labels == "apache-2.0,mit" and got[13].score == 1.0 and got[13].open and got[14].labels == "apache-2" and got[15].labels == "gpl-3" and got[15].n_base == 0
    assert got[1].n_words == 0 and got[1].first_word is None and got[1].labels == "" and got[1].score == 0 and got[1].open is None
    assert licenses.scan_licenses(table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("text, labels, score", [
    ("SPDX-License-Identifier: see LICENSE file", "", 0.3), ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0", "gpl-2.0+ with classpath-exception-2.0", 1.0), ("SPDX-License-Identifier: LicenseRef-Own-1", "licenseref-own-1", 1.0),
    ("SPDX-License-Identifier: MIT OR Nonsense", "mit", 1.0), ("SPDX-License-Identifier: MIT WITH Nonsense", "", 0.3), ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl-3.0-or-later", 1.0)])
def test_only_licences_are_labels(text, labels, score):
    got = licenses.scan(text)
    assert (got["labels"], got["score"]) == (labels, score)


def test_licenses_of_long_texts_take_time_in_proportion():
    import time

    def took(n):
        began = time.process_time()
        licenses.scan("cc by nc " * n)
        return time.process_time() - began

    assert took(80_000) < 12 * took(20_000) + 0.5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_its_table(spark, name):
    n = {"op1": "pages", "op3": "conversations", "op8": "embeddings", "op11": "conversations", "op13": "conversations"}.get(name.split("_")[0], "documents")
    source = spark.read.parquet(f"{DIR}/{n}.parquet")
    want = source.select("conv_id").distinct().count() + name.startswith("op3_") if n == "conversations" else source.count()
    got = QUERIES[name](spark, DIR)
    if name.startswith("op11"):  # a row for every node; the root has every conversation
        got = got.filter("depth = 0").select("n_convs")
        assert got.first().n_convs == want
        return
    assert (got.filter("start = 0").count() if name.startswith("op7") else got.count()) == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    packed = corpus_pipeline.run(spark, DIR)
    assert 0 < packed.select("doc_id").distinct().count() <= docs.count()


def plain_groups(rows, shingle=5, similarity=0.8):
    """id -> smallest id reachable by exact Jaccard links of word shingles, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if (not a and not b) or (a and b and both >= similarity * (len(a) + len(b) - both)):
                x, y = root(i), root(j)
                low[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicate_stage_by_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(14)
    short = [(10_000 + k, " ".join(f"s{k // 3}x{j}" for j in range(6 + k % 30)) + " end" * (k % 3)) for k in range(120)]
    more = [(i + 20_000, " ".join(w for w in (t or "").split() if rng.random() > 0.01)) for i, t in rows[:60]]
    every = rows + short + more
    groups = plain_groups(every)
    left = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    want = {i for i, g in groups.items() if i == g}
    assert left >= want and len(left - want) <= 0.02 * (len(every) - len(want)) + 1, (len(left), len(want))


def test_pipeline_stages_on_odd_rows_against_plain_versions(spark):
    odd = [(i, t, "en", "web", 1) for i, t in ODD]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"fp": F.lit(1), "low": F.lit("x"), "spans": F.lit(2)})
    documents, labels, bench = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    q, t = quality.fit(documents, quality.graded(labels)), toxicity.fit(documents, labels)
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    got = {n: sorted([(r.doc_id, r.text) for r in stage(spark, docs, DIR).collect()], key=order) for n, stage in corpus_pipeline.STAGES[:-1]}
    assert got["quality_classifier"] == sorted([r for r in ODD if q.tails(r[1], {})[0] >= 0.5], key=order)
    assert got["toxicity"] == sorted([r for r in ODD if t.probability(t.features(t.passages(r[1])[1])) < 0.5], key=order)
    groups = plain_groups([r for r in ODD if r[0] is not None])
    assert got["simhash_near_dedup"] == sorted([r for r in ODD if r[0] is None or groups[r[0]] == r[0]], key=order)
    assert got["decontamination"] == sorted(ODD, key=order)  # none has a benchmark's words
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), DIR)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).filter("start = 0").count() == len(ODD)
    item = next(r for r in bench.collect() if len(words(r.text)) >= 12)
    leak = spark.createDataFrame([(1, f"before {item.text} after", "en", "web", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = corpus_pipeline.decontaminate(spark, leak, DIR).first()
    assert words(r.text) == [b"before", b"after"] and r.n_chars == len(r.text)


def test_bm25_scores_by_the_formula():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 30, rng.integers(3, 40)).astype(np.uint16) for _ in range(40)]
    index = packing.Bm25(texts)
    mean = np.mean([len(x) for x in texts])

    def plain(seed, k):
        out = 0.0
        for term in set(texts[seed].tolist()):
            df = sum(term in x for x in texts)
            tf = int((texts[k] == term).sum())
            if df > 1 and tf:
                out += np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(texts[k]) / mean))
        return out

    for seed in range(10):
        got = index.neighbours(seed, np.zeros(len(texts), bool), 65536, len(texts))
        want = sorted((k for k in range(len(texts)) if k != seed and plain(seed, k) > 0), key=lambda k: (-round(plain(seed, k), 9), k))
        assert got == want


def test_html_deep_pages(spark):
    """A page of unclosed blocks takes time and memory in proportion to its length, with a template and without."""
    import resource
    import time

    def page(i, depth):
        return f"<body><div class=top>menu of all pages</div><div class=main><p>the text of page {i} and more of it</p></div>" + "<div class=a>x" * depth

    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text, _ = html.main_text(page(1, 100_000), None)
    assert time.time() - began < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000 and "the text of page 1" in text
    df = spark.createDataFrame([(i, "http://deep.example/", page(i, 5_000)) for i in range(5)], "page_id long, url string, html string")
    out = html.extract(df).collect()
    assert len(out) == 5 and all(r.template_tokens > 5_000 and f"page {r.page_id}" in r.text for r in out)
    for stray in ("</section>", "</b>", "<li>", "</p>"):
        began = time.time()
        html.main_text("<div>" * 50_000 + stray * 50_000 + "y", None)
        assert time.time() - began < 10
