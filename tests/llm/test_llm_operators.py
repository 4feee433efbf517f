"""Each operator against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat, decontaminate, embeddings, html, minhash, mixing, packing, quality, sharding, shingles, toxicity
from lexmill.llm.graph import components

WORDS = [f"w{i}" for i in range(60)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def closure(nodes, links):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 1), (5, 5), (20, 10), (10, 21), (21, 22)] + [(100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    nodes = {x for l in links if l[0] != l[1] for x in l}
    assert got == closure(nodes, [l for l in links if l[0] != l[1]])
    assert components(df.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        assert (shingles.fast_sketch(rng.integers(0, 1 << 63, n).astype(np.uint64), 64) < np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    a, b = (np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64)) for _ in range(2))
    a = np.unique(np.concatenate([a[:300], b]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((shingles.fast_sketch(a, 2000) == shingles.fast_sketch(b, 2000)).mean() - true) < 0.05


@pytest.mark.parametrize("small, block", [(12, 1_500_000), (2, 400)])
def test_near_duplicates(spark, docs, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rng = random.Random(3)
    base = [text(rng, 80) for _ in range(4)]
    texts = [None, "", " \t\n", "one", "One", "a b", "a b", text(rng, 6000)]
    for b in base:
        for _ in range(14):
            w = b.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(texts), n=3, percent=85, bands=20, rows=6).collect()}
    def own(t):
        w = (t or "").lower().split()
        return set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()
    sets = [own(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = closure(range(len(texts)), links)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}
    assert minhash.near_duplicates(docs(texts).limit(0)).count() == 0
    twice = minhash.near_duplicates(docs(["x y z q w e", "x y z q w e", None, "p"], ids=[4, None, None, 4])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in twice) == [("4", "4"), ("4", "4"), ("None", "None"), ("None", "None")]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    v = [(i, (centre[i % 12] + 0.25 * rng.normal(size=16)).astype(float).tolist(), i % 3) for i in range(300)]
    v += [(300 + i, v[0][1], 0) for i in range(5)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, v[0][1], None), (404, [None] * 16, 1), (405, [], 0), (406, v[0][1][:8], 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int").withColumn("unit", F.lit(1)).withColumn("cluster", F.lit(1))
    good = [(i, embeddings.unit(np.array(x)), l) for i, x, l in v if i < 400]
    links = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[2] == b[2] and a[1] @ b[1] >= 0.93]
    want = closure([x[0] for x in v], links)
    degree = {i: sum(i in l for l in links) for i in want}
    assert len(links) > 300
    # many clusters, and so small shards that clusters are split again by centroids of their own
    for p in (embeddings.GraphParams(), embeddings.GraphParams(per_cluster=30), embeddings.GraphParams(per_cluster=25, shard_rows=20, margin=0.02)):
        out = embeddings.embedding_duplicates(df, params=p)
        got = {r.vec_id: r for r in out.collect()}
        assert len(got) == len(v) and all(got[i].n_links <= degree[i] for i in got)
        assert sum(r.n_links for r in got.values()) >= (1.0 if p.shard_rows > 20 else 0.97) * 2 * len(links)
        assert all(got[i].n_links == 0 and got[i].component_id == i for i in (400, 401, 402, 403, 404, 405, 406))
        if p.shard_rows > 20:
            assert {r.vec_id: r.component_id for r in got.values()} == want
        assert embeddings.audit_recall(df, out) >= 0.97
    assert embeddings.embedding_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_one_id_are_apart(spark):
    """Rows of one id are vectors of their own: one that is like nothing links with nothing."""
    e = lambda *x: [float(c) for c in x]
    df = spark.createDataFrame([(1, e(1, 0, 0), 0), (1, e(0, 1, 0), 0), (2, e(1, 0.1, 0), 0), (2, e(1, 0.1, 0), 0), (None, e(1, 0, 0), 0)], "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.embedding_duplicates(df).collect())
    assert got == [("1", 0, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("2", 2, "1", False), ("None", 0, "None", False)]


def test_graph_search_over_a_flat_graph():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(60, 32))
    x = centre[rng.integers(0, 60, 3000)] + 0.2 * rng.normal(size=(3000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    p = embeddings.GraphParams()
    adj = embeddings.robust_prune(x, p)
    assert adj.shape == (3000, p.degree) and all(len(set(l[l >= 0])) == (l >= 0).sum() and i not in l for i, l in enumerate(adj))
    true = x @ x.T >= p.threshold
    found = seen = 0
    for i, j, s in embeddings.greedy_search(x, x, adj, embeddings.medoids(x, p.entries), p, p.threshold - p.slack):
        assert np.allclose(s, x[j] @ x[i], atol=1e-5) and len(set(j)) == len(j)
        found += int(true[i, j].sum())
        seen += len(j)
    assert found >= 0.99 * true.sum() and seen < 0.5 * 3000 * 3000


def test_mixing(spark, docs):
    rng = random.Random(5)
    texts = [text(rng, rng.randrange(1, 60)) for _ in range(400)] + [None, "", text(rng, 3000)]
    sources = ["a" if i < 150 else rng.choice(["b", "c", "d", None]) for i in range(len(texts))]
    df = docs(texts, sources)
    rows = mixing.mixture(df).collect()
    size = {}
    for t, s in zip(texts, sources):
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s), key=lambda s: s) + [None]
    weight, cap, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {s: 2 * n for s, n in size.items()}, 1.5 * sum(size.values())
    target, open_ = {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > cap[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    taken = {}
    for r in rows:
        s = sources[r.doc_id]
        assert r.target == pytest.approx(target[s]) and r.source_size == size[s] and 0 <= r.taken <= 2 * r.size and r.size == len((texts[r.doc_id] or "").split())
        taken[s] = taken.get(s, 0) + r.taken
    assert taken == {s: int(target[s] + 1e-9) for s in target}
    again = mixing.mixture(df.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    real = mixing.materialise(df).withColumn("n", mixing.size_of(F.col("text"))).groupBy("source").agg(F.sum("n")).collect()
    assert dict(map(tuple, real)) == taken
    assert mixing.mixture(df.limit(0)).count() == 0 and mixing.mixture(docs([None, ""])).agg(F.sum("taken")).first()[0] == 0


def test_row_wise_filters(spark, docs, tmp_path):
    """Rows of null or repeated ids are judged by their own texts."""
    rng = random.Random(31)
    a, b = text(rng, 60), text(rng, 60)
    texts = [a, a, b, b + " more", text(rng, 50), text(rng, 50), None, None, "", a, "you utter idiot"]
    ids = [None, 5, 7, 7, 7, None, 1, 1, None, 3, None]
    path = str(tmp_path / "docs")
    docs(texts, ids=ids).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    left = minhash.without_near_duplicates(df)
    assert left.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    want = [(3, a), (7, texts[4]), (None, texts[5]), (1, None), (1, None), (None, ""), (None, texts[10])]
    assert sorted([x for x in got if x[1] not in (b, b + " more")], key=str) == sorted(want, key=str) and len(got) == len(want) + 1
    assert minhash.without_near_duplicates(df.limit(0)).count() == 0
    clean = toxicity.without_toxic(df, {"": -4.0, "=idiot": 8.0})
    assert clean.count() == 10 and clean.columns == df.columns and clean.where("text like '%idiot%'").count() == 0
    mixed = mixing.materialise(df.select("doc_id", "text", "lang", "source", "n_chars"))
    words = sum(len((t or "").split()) for t in texts)
    assert mixed.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == words * 3 // 2 and mixed.where("text is null").count() == 2


def test_chat_round_trip(spark):
    raw = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", raw), (1, 1, "assistant", "\\\\h \\t ###### </turn></turn>\n"), (2, 0, "assistant", None), (3, 1, None, "x"), (3, 1, None, "x"), (None, 0, "us\ner", "y" * 50_000), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    import hashlib

    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[c]
        assert r.n_turns == len(own) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
    assert [got[c].valid for c in (1, 2, 3, 5)] == [True, False, False, True]
    out = chat.format_chats(df).collect()
    assert all("".join(s.text for s in r.segments) == r.formatted for r in out) and chat.format_chats(df.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=a>Home</a><a href=b>News</a></nav><div class="cookie-notice">We use cookies, a lot of them, really.</div>
<div id=main><h1>Head &amp; line</h1><p>First&nbsp;paragraph of   the article <a href=x>with a link</a> and more text.<p>Second <b>one<br>goes</b> on for quite a while, &lt;so&gt; it is long.</div>
<div class="comments"><p>Great article, thanks for sharing it with all of us here!</p></div><aside>Side</aside><form>Name <input></form><script>var a="</p>";</script><footer>&copy; me</footer>"""


def test_html_keeps_what_the_article_holds():
    links = "".join(f"<li><a href=x>Source {i}</a></li>" for i in range(4))
    page = f"""<body><div class="site-side">Out</div><article><h1>A</h1><div id="related-work"><p>Earlier work.</p></div><div class="side-by-side">Both</div>
<ul>{links}</ul><div class="share">Share</div><nav>Next</nav><div role=navigation>Up</div><ul class="menu">{links}</ul></article><ul>{links}</ul></body>"""
    assert html.main_text(page) == "A\nEarlier work.\nBoth\n" + "\n".join(f"Source {i}" for i in range(4))


def brute_density(x, body):
    """Composite density of one node from its own subtree alone."""
    def all_nodes(n):
        return [m for k in n.kids if isinstance(k, html.Node) and not k.silent for m in [k, *all_nodes(k)]]

    def chars(n):
        return sum(len("".join(k.replace("&amp;", "&").split())) if isinstance(k, str) else 0 if k.silent else chars(k) for k in n.kids)

    def linked(n):
        return chars(n) if n.tag == "a" else sum(linked(k) for k in n.kids if isinstance(k, html.Node) and not k.silent)

    c, lc, t, lt = chars(x), linked(x), len(all_nodes(x)), sum(m.tag == "a" for m in all_nodes(x))
    if not c:
        return 0.0
    if not linked(body):
        return c / (t or 1)
    base = math.log(c / ((c - lc) or 1) * lc + linked(body) / chars(body) * c + math.e)
    return c / (t or 1) * max(0.0, math.log(c / (lc or 1) * (t or 1) / (lt or 1), base))


def test_composite_density_of_every_node():
    rng = random.Random(17)

    def make(depth):
        kids = "".join(rng.choice(["some words &amp; more ", "<a href=x>a link</a>", "<b>bold</b>", "<script>no</script>"] + ([make(depth - 1)] * 3 if depth else [])) for _ in range(rng.randrange(5)))
        tag = rng.choice(["div", "section", "span", "a", "div"])
        return f"<{tag}>{kids}</{tag}>"

    for k in range(60):
        root = html.parse("".join(make(4) for _ in range(3)) + ("" if k % 5 else "<div>no link here</div>"))
        html.measure(root)
        nodes = [n for n in html._post_order(root) if not n.silent]
        for n in nodes:
            assert n.density == pytest.approx(brute_density(n, root))
            assert n.total == pytest.approx(sum(brute_density(m, root) for m in n.kids if isinstance(m, html.Node) and not m.silent))


def test_density_alone_finds_the_article():
    """Without landmarks, names and marks the density picks the article's own text on most pages."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    same = 0
    for page in pages:
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        bare = re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", page).replace(' class="ad"', "")
        want = html.render([html.parse(article)])
        assert html.main_text(page) == want
        same += html.main_text(bare) == want == html.main_text(page, marks=False)
    assert same >= 0.9 * len(pages)


def test_html_parts_beside_and_article_header():
    lines = "".join(f"<p>Some longer words of text that go on, part {i}.</p>" for i in range(6))
    links = "".join(f"<li><a href=x>Elsewhere {i}</a></li>" for i in range(8))
    got = html.main_text(f"<ul>{links}</ul><h1>Headline of the page</h1><div class='post has-sidebar'><div>{lines}</div><div>{lines}</div></div><div class=sidebar>{lines}</div>")
    body = "\n".join(f"Some longer words of text that go on, part {i}." for i in range(6))
    assert got == f"Headline of the page\n{body}\n{body}"
    assert html.main_text(f"<header>Site</header><article><header><h1>Own</h1></header><p>x <math><mi>a</mi><mo>=</mo></math></p></article>") == "Own\nx a="
    assert html.main_text("<div>" * 20_000 + "deep") == "deep"


def test_html(spark):
    assert html.main_text(PAGE) == "Head & line\nFirst paragraph of the article with a link and more text.\nSecond one goes on for quite a while, <so> it is long."
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("plain &am") == "plain &am" and html.main_text("<p>a<p") == "a" and html.main_text("<div>" * 3000 + "deep") == "deep"
    assert html.main_text("<article><h1>A</h1><p>b</p></article><div class=ad>" + "buy now " * 50 + "</div>") == "A\nb"
    df = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted(r.n_chars for r in html.extract_pages(df).collect())[0] == 0 and html.extract_pages(df.limit(0)).count() == 0


def test_sharding(spark, docs):
    rng = random.Random(7)
    texts = ["x" * rng.randrange(1, 200) for _ in range(300)] + [None, "", "y" * 5000]
    ids = [*range(len(texts) - 3), 7, None, 9000]
    df = docs(texts, ids=ids)
    rows = sharding.extendible_shards(df, limit_bytes=600, step=3).collect()
    total, depth = {}, {}
    for r in rows:
        total[r.shard] = total.get(r.shard, 0) + r.n_bytes
        depth[r.shard] = r.depth
    assert len(rows) == len(texts) and all(total[r.shard] == r.shard_bytes for r in rows)
    assert [r.n_bytes for r in rows if r.oversize] == [5000]
    for s, d in depth.items():  # a parent would not have fitted
        if 0 < d < 60:
            assert sum(n for t, n in total.items() if t.startswith(s[:-1])) > 600
    assert sharding.extendible_shards(df, limit_bytes=1 << 30).select("shard").distinct().count() == 1
    tied = sharding.extendible_shards(docs(["z" * 100] * 50, ids=[1] * 50), limit_bytes=600).groupBy("shard").agg(F.sum("n_bytes").alias("b")).collect()
    assert len(tied) > 8 and max(r.b for r in tied) <= 600
    assert sharding.extendible_shards(df.limit(0)).count() == 0


def naive_bfd(lengths, cap):
    bins = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room = [(cap - sum(lengths[j] for j in b), i) for i, b in enumerate(bins)]
        fit = [x for x in room if x[0] >= lengths[k]]
        if fit:
            bins[min(fit)[1]].append(k)
        else:
            bins.append([k])
    return bins


def test_packing(spark, docs):
    rng = random.Random(9)
    for cap in (10, 64, 100):
        lengths = [rng.randrange(1, cap + 1) for _ in range(200)]
        a, b = packing.best_fit_decreasing(lengths, cap), naive_bfd(lengths, cap)
        assert len(a) == len(b) and sorted(sum(lengths[j] for j in x) for x in a) == sorted(sum(lengths[j] for j in x) for x in b)
    texts = [text(rng, rng.randrange(0, 400)) for _ in range(60)] + [None, "", "a  b \n\n c", "é\U0001f600 x", "It's  we'll", text(rng, 5000)]
    p = packing.PackParams(row_tokens=128, window_tokens=3000)
    out = packing.pack(docs(texts), params=p)
    rows = out.collect()
    assert all(len(r.ids) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 128 and r.position_resets == r.cu_seqlens[:-1] for r in rows)
    assert {r.doc_id: r.text for r in packing.unpack(out, params=p).collect()} == {i: t or "" for i, t in enumerate(texts)}
    tok = packing.Tokenizer(open(p.tokenizer, "rb").read())
    assert all(tok.encode(t or "").tolist() == tok.full.encode_ordinary(t or "") for t in texts)
    assert packing.pack(docs(texts).limit(0)).count() == 0


def test_decontamination_of_short_items(spark, docs):
    items = ["Paris", "forty two", "who is it?", "a b c d", "one two three four five", " ", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["paris", "In PARIS: forty, two.", "forty or two", "who is it", "who it is", "x a b c d y a b c d", "a b c", "one two three four five", "one two three four"]
    got = {(r.doc_id, r.item_id, r.matched, r.item_words, r.coverage) for r in decontaminate.contamination(docs(texts), bench).collect()}
    ids = {r.text: r.doc_id for r in docs(texts).collect()}
    want = [(0, 0, 1), (1, 0, 1), (1, 1, 2), (3, 2, 3), (5, 3, 4), (7, 4, 5)]
    assert got == {(ids[texts[t]], i, n, n, 1.0) for t, i, n in want}


def test_decontamination(spark, docs):
    rng = random.Random(11)
    items = [text(rng, 30) + f" tail{i}" for i in range(6)] + ["one two", "", None]
    w = items[2].split()
    texts = [text(rng, 50), text(rng, 40) + " " + items[0].upper().replace(" ", ", ") + " " + text(rng, 9), " ".join(w[18:] + ["zz"] + w[:18]), " ".join(w[:9]), None, "", items[4] * 1 + " " + items[4], text(rng, 8000)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("id", F.lit(1))
    for size in (4 << 20, 10):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs(texts), bench, params=decontaminate.TilingParams(block_words=size)).collect()}
        assert got == {(1, 0), (2, 2), (6, 4)}
    assert decontaminate.contamination(docs(texts), bench.limit(0)).count() == 0 and decontaminate.contamination(docs(texts).limit(0), bench).count() == 0


def naive_tiles(a, b, n):
    """Greedy string tiling as first written down: look for the longest unmarked match, mark, repeat."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < n:
            return total
        total += best[0]
        for k in range(best[0]):
            ma[best[1] + k] = mb[best[2] + k] = True


def test_tiling_is_greedy():
    rng = random.Random(13)
    for _ in range(60):
        item = [rng.choice("abcdef") for _ in range(25)]
        doc = [rng.choice("abcdef") for _ in range(30)]
        at = rng.randrange(20)
        doc[at:at] = item[8:20]
        index = decontaminate.Index([(1, " ".join(item))], 3)
        got = list(index.matches(" ".join(doc)))
        assert len(got) == 1 and got[0][1] == naive_tiles(doc, item, 3) and all(doc[i : i + n] == item[j : j + n] for i, j, n in got[0][3])


def test_tiling_of_repeated_words_is_not_quadratic():
    import time

    words = "again " * 1000
    start = time.time()
    got = list(decontaminate.Index([(1, words), (2, "other words that are not there")], 5).matches("again " * 20_000 + "x " * 20_000))
    assert got[0][:3] == (1, 1000, 1000) and len(got) == 1 and time.time() - start < 2
    half = list(decontaminate.Index([(1, words + "b c d e f g " * 100)], 5).matches(words * 2, 0.7))
    assert half == []  # its seeds cover too little


def test_decontamination_against_brute_force(spark, docs):
    rng = random.Random(23)
    vocabulary = "a b c d e f".split()
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 22))] for _ in range(12)]
    texts = []
    for _ in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        own = rng.choice(items)
        at = rng.randrange(len(t) + 1)
        t[at:at] = own[rng.randrange(len(own)) :]
        texts.append(t)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    df = docs([" ".join(t) for t in texts] + [None, ""], ids=[None if i % 9 == 4 else i % 50 for i in range(len(texts))] + [60, 61])
    got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.contamination(df, bench).collect()}
    want = {}
    for t, i in zip(texts, [None if i % 9 == 4 else i % 50 for i in range(len(texts))]):
        for k, item in enumerate(items):
            m = naive_tiles(t, item, min(5, len(item)))
            if m >= 0.6 * len(item):
                want[i, k] = max(m, want.get((i, k), 0))
    assert got == {(i, k, m) for (i, k), m in want.items()} and len(want) > 20 and any(i is None for i, _ in want)
    clean = [t for t in texts if not any(naive_tiles(t, x, min(5, len(x))) >= 0.6 * len(x) for x in items)]
    left = decontaminate.without_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r.text or "" for r in left.collect()) == sorted([" ".join(t) for t in clean] + ["", ""])
    assert decontaminate.without_contaminated(df, bench.limit(0)).count() == 62 and decontaminate.without_contaminated(df.limit(0), bench).count() == 0


def test_classifiers_edges(spark, docs):
    own = lambda i: chr(97 + i // 10) * 3 + chr(97 + i % 10) * 3
    texts = [f"fine words number {own(i)} here." for i in range(60)] + [f"you idiot moron {own(i)} xqz" for i in range(30)] + [None, "", "%%% !! %%%" * 3000]
    df = docs(texts)
    labels = spark.createDataFrame([(i, int(i < 60), int(60 <= i < 90)) for i in range(90)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    w = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(df, w).collect()}
    assert len(got) == len(texts) and all(got[i].predicted == (60 <= i < 90) for i in range(92))
    again = toxicity.train(df.unionByName(df).unionByName(docs(["x " * 9000] * 500, ids=[5] * 500)), labels)
    assert again and toxicity.score_text(texts[70], again) > 0.5
    assert toxicity.train(df, labels.limit(0))[""] < 0 and toxicity.toxicity_scores(df.limit(0), w).count() == 0
    m = quality.train(df, labels)
    q = quality.quality_scores(df, m).collect()
    assert len(q) == len(texts) and all(0 <= r.score <= 1 for r in q)
    assert quality.quality_scores(df, quality.train(df, labels.limit(0))).count() == len(texts)


def test_label_model_weighs_voters_by_accuracy_and_correlation():
    """Copies of one noisy voter outvote good ones by number, and a model of independent voters, but not this one."""
    rng = np.random.default_rng(4)
    n, y = 4000, rng.random(4000) < 0.3
    v = lambda hit, false: np.where(y, rng.random(n) < hit, rng.random(n) < false)
    noisy = v(0.5, 0.15)
    votes = np.stack([v(0.7, 0.02), noisy, noisy, noisy, v(0.6, 0.05), v(0.5, 0.02), v(0.6, 0.03)], 1)
    row, voter = np.nonzero(votes)
    q, rates, corr = toxicity.label_model(row, voter, n, 7, 0.3)
    assert corr[1, 2] > 0.9 and corr[2, 3] > 0.9 and corr[0, 4] < 0.5
    assert np.abs(rates - [[0.02, 0.15, 0.15, 0.15, 0.05, 0.02, 0.03], [0.7, 0.5, 0.5, 0.5, 0.6, 0.5, 0.6]]).max() < 0.12
    right = lambda p: (p == y).mean()
    independent, _, _ = toxicity.label_model(row, voter, n, 7, 0.3, 2.0)
    assert right(q > 0.5) > 0.92 and right(q > 0.5) > right(votes.sum(1) >= 2) + 0.03 and right(q > 0.5) > right(independent > 0.5) + 0.03


def test_toxicity_ignores_the_label_of_a_row_that_all_voters_contradict():
    own = lambda i: chr(97 + i // 10 % 26) * 3 + chr(97 + i % 10) * 3
    texts = [f"fine words number {own(i)} here" for i in range(300)] + [f"you idiot moron and loser {own(i)}" for i in range(60)]
    labels = [0] * 300 + [1] * 60
    labels[300:303] = [0, 0, 0]  # mislabelled
    w = toxicity.fit(["\n".join(sorted(toxicity.marks(t))) for t in texts], [""] * 360, labels, toxicity.ToxicityParams())
    assert all(toxicity.score_text(t, w) > 0.5 for t in texts[300:]) and all(toxicity.score_text(t, w) < 0.5 for t in texts[:300])


def test_class_prior():
    rng = np.random.default_rng(6)
    p = rng.normal(2, 1, 4000)
    u = np.where(rng.random(8000) < 0.7, rng.normal(2, 1, 8000), rng.normal(-3, 1, 8000))
    assert abs(quality.class_prior(u, p) - 0.7) < 0.06
