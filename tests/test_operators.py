"""Hand-written rows for what the synthetic tables do not hold."""

import io
import math
import sqlite3
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import assembly, audit, checks, chunking, cleaning, cleanup, evaluation, fusion, retrieval, selection, spans, splits, stages
from lexmill.sources import contexts, sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "Nghị  Định Số 15/2020/NĐ-CP", T.fold_accents) == "nghi dinh so 15/2020/nd-cp"
    assert one(spark, "Nghị  Định Số", T.fold_any) == "nghi dinh so"
    assert one(spark, "15/2020/NĐ-CP", T.number_compact) == "152020ndcp"
    assert one(spark, "15 / 2020/NĐ-CP.-", T.number_kept) == "15 / 2020/nd-cp"
    assert one(spark, "Điều 5.:", T.article_key) == "dieu 5"
    assert one(spark, "theo 15/2020/NĐ-CP và 15/2020/nđ-cp", T.legal_numbers) == ["152020ndcp"]
    assert one(spark, "Số: 1/2020/NĐ-CP\nĐiều 1. a\nSố: 2/2", T.source_number) == "1/2020/NĐ-CP"
    assert one(spark, "Số: 1/2 Số: 3/4", T.source_number) is None
    assert one(spark, "b aaaa ccc dddd", lambda c: T.trigram_terms(T.word_list(c), 3, 2)) == ["aaaa", "dddd"]
    assert one(spark, "Việt é x_1", T.rouge_tokens) == ["vi", "t", "x", "1"]
    assert one(spark, "CÁC QUY ĐỊNH CHUNG", T.is_upper_heading) and one(spark, None, T.fold_accents) is None


def test_cleaner(spark):
    raw = "A\r\n<script>if (a) '</p>'</script><p>x&lt;p&gt;</p><img alt='pic'><b>b</b>​  c&nbsp;d\n\n\n\ne"
    assert one(spark, raw, cleaning.clean) == "A\n\nx<p>\npic" + "b c\xa0d\n\ne"
    assert one(spark, "a <li>b</li>", cleaning.clean) == "a <li>b</li>" and one(spark, None, cleaning.clean) is None


def test_bm25_matches_sqlite(spark):
    docs = [(i, t) for i, t in enumerate(["the cat sat", "the dog sat on the cat", "a bird", "dog dog dog bird", "", "cat cat"])]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table d using fts5(t, tokenize = 'unicode61 remove_diacritics 0')")
    con.executemany("insert into d(rowid, t) values (?, ?)", [(i + 1, t) for i, t in docs])
    want = [(r - 1, -s) for r, s in con.execute("select rowid, bm25(d) from d where d match 'cat OR dog' order by bm25(d), rowid")]
    got = retrieval.bm25(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "cat dog cat")], "item_id long, text string"),
        doc_tokens=T.word_list(F.col("text")), query_tokens=T.query_tokens(F.col("text")), k=10).orderBy("rank").collect()
    assert [r.id for r in got] == [i for i, _ in want]
    assert [r.score for r in got] == pytest.approx([s for _, s in want], abs=1e-9)


def test_substring_bm25_reads_whole_texts(spark):
    asked = {1: "abcdefgh abcdefghij ijklmnop qrstuvwx yzabcdef klmnopqr", 2: "yzabcdef", 3: "short words"}
    docs = {
        1: "x " * 1500 + "ABCDEFGH ijklmnop", 2: "abcdefgh", 3: "zzqrstuvwxqrstuvwx, yzabcdef. " + "y " * 2000 + "klmnopqr", 4: "yzabcdefyzabcdef yzabcdefu",
        5: "none", 6: "abcdefghij ijklmnop abcde fghij"} | {i: f"filler {i}" for i in range(7, 20)}
    terms = {q: [w for w in t.split() if len(w) >= 8] for q, t in asked.items()}
    low = {i: t.lower() for i, t in docs.items()}
    mean = sum(len(t) - 2 for t in low.values()) / len(low)
    df = {w: sum(w in t for t in low.values()) for ws in terms.values() for w in ws}
    idf = {w: max(math.log((len(low) - n + 0.5) / (n + 0.5)), 1e-6) for w, n in df.items()}
    want = []
    for q, ws in terms.items():
        scored = []
        for i, t in low.items():
            hits = [w for w in ws if w in t]
            s = sum(idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * (len(t) - 2) / mean)) for w in hits)
            if len(hits) >= min(2, len(ws)) and hits:
                scored.append((-round(s if len(ws) == 1 else s * (len(hits) - 1), 10), i))
        want += [(q, i, n + 1, -s) for n, (s, i) in enumerate(sorted(scored)[:10])]
    got = retrieval.substring_bm25(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(asked.items()), "item_id long, text string"),
        text=F.lower("text"), terms=T.trigram_terms(T.query_tokens(F.col("text")), 8), k=10).collect()
    assert sorted((r.query_id, r.id, r.rank) for r in got) == sorted(x[:3] for x in want) and {1, 3} <= {x[1] for x in want}
    assert [r.score for r in sorted(got)] == pytest.approx([x[3] for x in sorted(want)], abs=1e-9)


def test_fusion_checks(spark):
    r = spark.createDataFrame([(1, "a", 5, 1), (1, "b", 6, 1), (1, "a", 6, 2), (1, "b", 5, 2)], "query_id int, branch string, id int, rank int")
    out = fusion.weighted_rrf(r, {"a": 0.5, "b": 0.5}).orderBy("rank").collect()
    assert [x.id for x in out] == [5, 6] and out[0].branch_ranks == {"a": 1, "b": 2}
    with pytest.raises(Exception, match="twice"):
        fusion.weighted_rrf(r.union(r), {"a": 0.5, "b": 0.5}).collect()
    with pytest.raises(Exception, match="unknown branch"):
        fusion.weighted_rrf(r, {"a": 1.0}).collect()
    with pytest.raises(Exception, match="unknown id"):
        fusion.fetch_in_order(spark.createDataFrame([([1, 9],)], "ids array<int>"), spark.createDataFrame([(1, "x")], "k int, v string"), ids="ids", key="k").collect()


def test_merge_spans_touching(spark):
    s = spark.createDataFrame([("d", 0, 5), ("d", 5, 8), ("d", 9, 10), ("e", 1, 9), ("e", 2, 3)], "g string, start int, end int")
    got = {(r.g, r.start, r.end, r.parts) for r in spans.merge_spans(s, group=["g"]).collect()}
    assert got == {("d", 0, 8, 2), ("d", 9, 10, 1), ("e", 1, 9, 2)}
    u = spark.createDataFrame([(1, "d", "b", 2, 0, 3, ["x"]), (1, "d", "b", 1, 3, 5, ["y"])], "query_id int, document_id string, block_id string, rank int, start int, end int, chunk_ids array<string>")
    m = spans.merge_ranked_spans(u, spark.createDataFrame([("d", "ab😀de")], "document_id string, cleaned_text string")).first()
    assert (m.rank, m.text, m.chunk_ids) == (1, "ab😀de", ["x", "y"])


LAW = "QUỐC HỘI\nSố: 1/2020/QH\n\nĐiều 1. Phạm vi\nNội dung một.\n\nĐiều 12a\n1. Khoản một " + "từ " * 30 + "\n2. Khoản hai " + "chữ " * 30 + "\n3) ngắn"


def test_chunker_covers_all(spark):
    p = chunking.ChunkParams(max_tokens=40, max_chars=300, overlap=5)
    c = chunking.Chunker(p)
    rows = c.rows("d", "T", LAW)
    assert {r[5] for r in rows} >= {"preamble", "article", "clause_group"}
    held = set()
    for r in rows:
        assert LAW[r[8] : r[9]] == r[12]
        held |= set(range(r[8], r[9]))
    assert all(i in held for i, ch in enumerate(LAW) if not ch.isspace())
    docs = spark.createDataFrame([("d", "T", LAW), ("n", None, None), ("b", None, " ")], "document_id string, source_title string, cleaned_text string")
    assert chunking.chunk_documents(docs, p).count() == len(rows)
    assert rows[-1][13].split("\n")[:4] == ["T", "QUỐC HỘI", "Số: 1/2020/QH", "Điều 12a"]  # header lines stay lines
    assert [(x["kind"], x["article_number"]) for x in chunking.sections(LAW)] == [("article", "1"), ("article", "12a")]


PROCEDURES = "Điều 1. Danh mục\nPHẪU THUẬT NỘI SOI Ổ BỤNG\nVÀ CÁC KỸ THUẬT LIÊN QUAN\nI. ĐẠI CƯƠNG CHUNG CỦA PHẪU THUẬT\nthân\nQUY TRÌNH KHÁM CHỮA BỆNH\nthân hai\nĐiều 2. Khác\nthân ba"


def test_sections_and_segments(spark):
    got = [(x["kind"], PROCEDURES[x["start"] : x["end"]].split("\n")[0], x["heading"]) for x in chunking.sections(PROCEDURES)]
    assert got[2:] == [("procedure", "PHẪU THUẬT NỘI SOI Ổ BỤNG", "PHẪU THUẬT NỘI SOI Ổ BỤNG VÀ CÁC KỸ THUẬT LIÊN QUAN"), ("procedure", "QUY TRÌNH KHÁM CHỮA BỆNH", "QUY TRÌNH KHÁM CHỮA BỆNH")]
    last = chunking.sections(PROCEDURES)[-1]
    assert PROCEDURES[last["start"] : last["end"]] == "QUY TRÌNH KHÁM CHỮA BỆNH\nthân hai\n"  # ends with its article
    cut = lambda t, a, b: [t[x:y] for x, y in chunking.split_exact(t, a, b)]
    assert cut("aaaa. bbbb cccc dddd", 3, 10) == ["aaaa. bbbb", "cccc dddd"]  # the last break of the second half, whatever its kind
    assert cut("aaaa bbb. cccc", 1, 11) == ["aaaa bbb.", "cccc"]
    assert cut("ab\n\n  cdefgh  \nij", 4, 20) == ["ab\n\n  cdefgh  \nij"] and cut("x" * 25, 3, 10) == ["x" * 10, "x" * 10, "x" * 5]
    df = spark.createDataFrame([("d", PROCEDURES), ("n", None), ("b", " ")], "document_id string, cleaned_text string")
    assert chunking.document_sections(df).count() == 4 and chunking.exact_segments(df, least=5, most=40).count() > 3


def _pool(n=20):
    return [dict(query_id=1, id=i, rank=i, document_id=f"d{i // 5}", article_number=None if i % 7 == 0 else str(i // 4), body=f"body {i if i != 3 else 2}", start=0 if i not in (8,) else 0, end=10, tier=i % 6) for i in range(1, n + 1)]


def test_selector(spark):
    pool = [dict(x, document_id=f"{x['document_id']}-{x['id'] % 3}") for x in _pool()]
    got = selection.choose(pool).rows
    assert len(got) == 12 and len({x["id"] for x, _, _ in got}) == 12
    assert [(x["id"], t) for x, p, t in got if p == "locked-rrf"][:2] == [(1, None), (2, None)] and 3 not in [x["id"] for x, p, _ in got if p == "locked-rrf"]
    df = spark.createDataFrame(pool, "query_id int, id int, rank int, document_id string, article_number string, body string, start int, end int, tier int")
    assert [r.id for r in selection.select_top(df).orderBy("selected_rank").collect()] == [x["id"] for x, _, _ in got]


def test_selector_passes(spark):
    row = lambda i, **k: dict(dict(query_id=1, id=i, rank=i, document_id=f"d{i}", article_number="1", body=f"b{i}", start=0, end=100, tier=5), **k)
    pool = [row(i) for i in range(1, 21)]
    pool[2].update(document_id="d1", start=20, end=120)  # 80 of 100 characters shared with the first
    pool[3].update(document_id="d1", start=21, end=121)  # 79: no repeat
    pool[10].update(tier=0)
    for i in (12, 13, 14, 15):
        pool[i].update(document_id="x", tier=1, start=i * 1000, end=i * 1000 + 10)
    got = selection.choose(pool)
    assert [x["id"] for x, _, _ in got.rows] == [1, 2, 4, 5, 6, 7, 11, 13, 14, 15, 8, 9] and got.rejected == 2  # the third is refused as an anchor and again by tier
    assert [p for _, p, _ in got.rows] == ["locked-rrf"] * 6 + ["legal-priority"] * 6
    thin = [row(i, body=f"b{i % 11}") for i in range(1, 21)]
    df = spark.createDataFrame(thin, "query_id int, id int, rank int, document_id string, article_number string, body string, start int, end int, tier int")
    with pytest.raises(Exception, match="only 11 distinct rows"):
        selection.select_top(df).collect()
    out = selection.select_top(df, relax=True)
    assert out.count() == 12 and out.where("phase = 'content-relaxed-fill'").select("id").collect()[0].id == 12
    d = selection.selector_diagnostics(out.join(df.select("id", "rank"), "id")).first()
    assert (d.changed_from_ranks, d.unchanged, d.queries_relaxed) == (0, 1, 0)
    crowd = [row(i, document_id="d", start=i * 1000, end=i * 1000 + 10) for i in range(1, 21)]
    assert [p for _, p, _ in selection.choose(crowd).rows] == ["locked-rrf"] * 6 + ["diversity-relaxed-fill"] * 6


def test_tiers_and_references(spark):
    q = "Theo Nghị định 15/2020/NĐ-CP, khoản 2 Điều 5 quy định gì?"
    df = spark.createDataFrame([(q, "khoản 2 nói", "15/2020/NĐ-CP", None, "5"), (q, "x", None, None, None)], "q string, b string, n string, t string, a string")
    assert [r[0] for r in df.select(selection.tier(*map(F.col, "qbnta"))).collect()] == [0, 5]
    r = selection.references(q, "question")
    assert (r[0]["article_number"], r[0]["clause_number"], r[0]["resolution"]) == ("5", "2", "exact_document_number")
    how = lambda t, o, d=None: selection.references(t, o, d)[0]["resolution"]
    assert how("theo Điều 5 luật này", "selected_evidence", "d") == "same_document" and how("theo Điều 5 luật này", "selected_evidence") == "question_without_exact_document_number"
    assert how("theo Điều 5 Luật Đất đai", "selected_evidence", "d") == how("theo Điều 5 Luật Đất đai", "question") == "unresolved_external_document"
    assert how("Điều 5 nói gì", "question") == "question_without_exact_document_number"
    assert how("15/2020/NĐ-CP và 16/2020/NĐ-CP: Điều 5", "question") == "ambiguous_document_numbers"
    assert selection.references("điều 5Đ", "question")[0]["article_number"] == "5d"


def test_cross_references(spark):
    found = spark.createDataFrame(
        [(1, 1, "5", "2", "n1", "exact_document_number", None, 0, 5), (1, 2, "5", None, "n1", "exact_document_number", None, 9, 12), (1, 3, "7", None, None, "same_document", "b", 3, 4),
         (1, 4, "9", None, "twice", "exact_document_number", None, 1, 2), (1, 5, "8", None, None, "same_document", "b", 3, 4), (1, 6, "1", None, None, "unresolved_external_document", "b", 3, 4), (2, 1, "7", None, None, "same_document", "b", 0, 1)],
        "query_id int, order int, article_number string, clause_number string, document_number string, resolution string, source_document_id string, start int, end int")
    docs = spark.createDataFrame([("a", "n1"), ("b", None), ("c", "twice"), ("d", "twice")], "document_id string, document_number string")
    blocks = spark.createDataFrame(
        [("a", "a0", "5", [(1, "a1", ["1"]), (0, "a0", None), (2, "a2", ["2"])]), ("b", "b0", "7", [(0, "b0", [])]), ("b", "b5", "8", [(5, "b5", [])]), ("b", "b6", "8", [(6, "b6", [])]), ("c", "c0", "9", [(0, "c0", [])])],
        "document_id string, block_id string, article_number string, chunks array<struct<chunk_index: int, chunk_id: string, clause_numbers: array<string>>>")
    held = spark.createDataFrame([(2, "b", "b0")], "query_id int, document_id string, block_id string")
    got = selection.resolve_references(found, docs, blocks, held).orderBy("candidate").collect()
    assert [(r.query_id, r.candidate, r.document_id, r.seed_chunk_id, len(r.triggers)) for r in got] == [(1, 1, "a", "a2", 2), (1, 2, "b", "b0", 1)]
    assert selection.resolve_references(found, docs, blocks, held, most=1).count() == 1
    spans = spark.createDataFrame([(1, "b", 0, 5), (1, "b", 2, 9)], "query_id int, document_id string, start int, end int")
    asked = spark.createDataFrame([(1, "b", 3, 4), (1, "b", 4, 10), (2, "b", 3, 4), (1, "b", 3, 3)], "query_id int, document_id string, start int, end int")
    assert [tuple(r) for r in selection.within_spans(asked, spans).collect()] == [(1, "b", 3, 4)]
    have = spark.createDataFrame([(1, "b", 4, "x", 0, 5, "text", ["k2"], "n"), (1, "b", 2, "y", 5, 9, "more", ["k1"], "m"), (1, "c", 1, "z", 0, 1, "t", ["k3"], None), (2, "b", 1, "x", 0, 5, "text", ["k"], None)],
        "query_id int, document_id string, rank int, block_id string, start int, end int, text string, chunk_ids array<string>, document_number string")
    chosen = spark.createDataFrame([(1, "b", 0, 9, "whole")], "query_id int, document_id string, start int, end int, text string")
    got = sorted((r.query_id, r.rank, r.document_id, r.text, r.chunk_ids, r.document_number) for r in selection.replace_with_section(have, chosen).collect())
    assert got == [(1, -1, "b", "whole", ["k1", "k2"], "m"), (1, 1, "c", "t", ["k3"], None), (2, 1, "b", "text", ["k"], None)]
    with pytest.raises(Exception, match="not retrieved"):
        selection.replace_with_section(have, spark.createDataFrame([(2, "q", 0, 9, "w")], chosen.schema)).collect()


def test_promotion(spark):
    ranked = spark.createDataFrame([(k, i, i, "b" if i in (3, 14, 15, 16) else "a") for k in (1, 2) for i in range(1, 21)], "query_id int, id int, rank int, document_id string")
    r = spark.createDataFrame([(1, "b"), (2, None)], "query_id int, document_id string")
    got = selection.promote(ranked, r).orderBy("query_id", "new_rank").collect()
    assert [x.id for x in got if x.query_id == 1] == [1, 2, 3, 14, 15, *range(4, 11)]
    assert [x.id for x in got if x.query_id == 2] == list(range(1, 13))
    q = spark.createDataFrame([(1, "theo 15/2020/NĐ-CP"), (2, "không có")], "query_id int, question string")
    d = spark.createDataFrame([("x", "Luật đất đai", "15/2020/NĐ-CP"), ("y", None, None)], "document_id string, source_title string, document_number string")
    got = {x.query_id: (x.document_id, x.reason) for x in selection.resolve_document(q, d).collect()}
    assert got == {1: ("x", "number"), 2: (None, "no_match")}


def test_packing():
    n = lambda s: len(s.split())
    assert assembly.pack_contexts(["a b c", "d e f g", "h"], " ".join, n, 4) == [0, 2]
    assert assembly.prompt_contexts(["a b c d"], " ".join, n, 2)[1] == "truncated_first"
    text = "x" * 10 + " " + "y" * 10 + " " + "z" * 10
    u = dict(rank=1, document_id="d", block_id="b", article_number="5", article_title=None, source_title="S", document_number=None,
             seed=dict(start=0, end=10, text=text[:10], chunk_ids=["1"]), expansions=[dict(kind="whole", start=0, end=32, text=text, chunk_ids=["1", "2"])])
    spans, made = assembly.pack_parents([u], n, budget=20)
    assert spans[0]["end"] == 32 and made == [{"rank": 1, "kind": "whole"}]
    assert assembly.render_spans(spans) == f"Tên nguồn: S\nĐiều 5\nNội dung:\n{text}"
    assert assembly.render_spans([spans[0] | {"article_number": None, "article_title": "T", "source_title": None, "document_number": "9"}]) == f"Số văn bản: 9\nTrích đoạn: T\nNội dung:\n{text}"
    assert assembly.unit_contexts([spans[0] | {"article_title": "T"}]) == [f"Tên nguồn: S\nTiêu đề Điều: T\nNội dung:\n{text}"]
    small = n(assembly.render_spans([spans[0] | {"text": "x"}]))
    assert assembly.pack_parents([u], n, budget=small)[0][0]["end"] == 10
    with pytest.raises(assembly.SeedsDoNotFit):
        assembly.pack_parents([u], n, budget=0)
    other = u["seed"] | {k: u[k] for k in ("rank", "document_id", "block_id")}
    merged = assembly.merge([other, other | {"start": 10, "end": 13, "text": "abc", "rank": 0, "chunk_ids": ["0"]}, other | {"start": 14, "end": 15, "text": "q"}])
    assert [(s["start"], s["end"], s["rank"], s["chunk_ids"]) for s in merged] == [(0, 13, 0, ["0", "1"]), (14, 15, 1, ["1"])]
    with pytest.raises(ValueError, match="disagree"):
        assembly.merge([other, other | {"start": 5, "end": 8, "text": "abc"}])
    held, added = assembly.pack_more([other], [other | {"end": 3, "text": "xxx"}, other | {"start": 20, "end": 23, "text": "new"}, other | {"start": 40, "end": 43, "text": "one"}], n, most=1)
    assert added == [1] and len(held) == 2
    pieces = assembly.selective_segments([u, dict(u, rank=2)], least=4, most=12)
    assert [(p["start"], p["end"], p["source_seed_ranks"]) for p in pieces] == [(11, 21, [1, 2]), (22, 32, [1, 2])]


def test_packing_operators(spark):
    schema = "q int, units array<struct<rank: int, document_id: string, block_id: string, article_number: string, article_title: string, source_title: string, document_number: string, seed: struct<start: int, end: int, text: string, chunk_ids: array<string>>, expansions: array<struct<kind: string, start: int, end: int, text: string, chunk_ids: array<string>>>>>"
    seed = lambda a, t: (a, a + len(t), t, ["c"])
    unit = (1, "d", "b", None, None, None, None, seed(2, "cc dd"), [("whole", 0, 9, "a cc dd e", ["c", "f"])])
    df = spark.createDataFrame([(1, [unit]), (2, None), (3, [])], schema)
    n = lambda s: len(s.split())
    got = {r.q: r for r in assembly.pack_evidence(df, key="q", count=n, budget=9).collect()}
    assert got[1].text == "Trích đoạn\nNội dung:\na cc dd e" and got[1].spans[0].chunk_ids == ["c", "f"] and got[2].mode == got[3].mode == "empty"
    with pytest.raises(Exception, match="do not fit"):
        assembly.pack_evidence(df, key="q", count=n, budget=1).collect()
    low = {r.q: r for r in assembly.pack_evidence(df, key="q", count=n, budget=1, fallback=True).collect()}
    assert low[1].mode == "seed-budget-fallback" and low[1].text.strip() == "cc" and low[1].expansions == []
    rows = spark.createDataFrame([(1, "q w", "x y", ["a b", "c d e f g h", "i"]), (2, "q", None, None)], "q int, question string, answer string, contexts array<string>")
    enc = lambda s: [len(w) for w in s.split()]
    got = {r.q: r for r in assembly.supervised_rows(rows, key="q", encode=enc, end_id=99, maximum=9, render=lambda q, c: " ".join([*c, q])).collect()}
    assert got[1].contexts_kept == 2 and got[1].input_ids == [1, 1, 1, 1, 1, 1, 1, 99] and got[1].labels == [-100] * 5 + [1, 1, 99] and got[2].input_ids == [1, 99]
    with pytest.raises(Exception, match="does not fit"):
        assembly.supervised_rows(rows, key="q", encode=enc, end_id=99, maximum=3, render=lambda q, c: q).collect()
    m = spark.createDataFrame([("s", " q ", [(" t ", "5"), ("u", None)], "do")], "s string, q string, c array<struct<text: string, article_number: string>>, i string").select(assembly.messages(*map(F.col, "sqci")).alias("m")).first().m
    assert m[1].content == "Câu hỏi:\nq\n\nTài liệu:\n[Tài liệu 1, điều 5]\nt\n\n[Tài liệu 2]\nu\n\nYêu cầu:\ndo"


def test_model_stages(spark):
    import numpy as np

    rows = spark.createDataFrame([(i, f"text {i}", f"c{i % 3}") for i in range(50)] + [(99, None, None)], "id int, t string, c string").repartition(3)
    v = stages.embed(rows, lambda: lambda ts: np.ones((len(ts), 4)), id_col="id", text_col="t", dimension=4).collect()
    assert len(v) == 51 and all(r.embedding == pytest.approx([0.5] * 4) for r in v)
    for bad in (lambda ts: np.ones((len(ts), 3)), lambda ts: np.full((len(ts), 4), np.nan)):
        with pytest.raises(Exception, match="embeddings of shape"):
            stages.embed(rows, lambda bad=bad: bad, id_col="id", text_col="t", dimension=4).collect()
    s = stages.score_pairs(rows, lambda: lambda q, c: [len(a) + len(b) for a, b in zip(q, c)], keep=["id"], question="t", context="c").collect()
    assert {r.id: r.score for r in s}[0] == 8.0 and len(s) == 51
    grid = stages.decoding_grid(rows.where("id < 5"), {"a": {"k": 1}, "b": {"k": 2}})
    g = stages.generate(grid, lambda: lambda ps, how: [p + "!" * how["k"] for p in ps], keep=["id", "variant"], prompt="t", variants={"a": {"k": 1}, "b": {"k": 2}}, variant="variant").collect()
    assert len(g) == 10 and {(r.id, r.variant): r.answer for r in g}[(3, "b")] == "text 3!!"
    with pytest.raises(Exception, match="a blank answer"):
        stages.generate(rows, lambda: lambda ps, how: [" " for _ in ps], keep=["id"], prompt="t").collect()
    ids = spark.createDataFrame([(i, list(range(i)), [-100] * i) for i in range(1, 8)], "k int, input_ids array<int>, labels array<int>")
    b = stages.collate(ids, key="k", batch=3, pad_id=0).collect()
    assert sorted(int(i) for r in b for i in r.ids) == list(range(1, 8)) and all(len({len(x) for x in r.input_ids + r.labels + r.attention_mask}) == 1 for r in b)
    w = stages.work_partitions(spark.range(0, 1000).repartition(7).selectExpr("id", "id % 10 AS n"), order="id", workers=3, length="n", most_short=7).collect()
    for route, own in (("short", [i for i in range(1000) if i % 10 <= 7]), ("long", [i for i in range(1000) if i % 10 > 7])):
        assert {r.id: r.worker for r in w if r.route == route} == {i: k % 3 for k, i in enumerate(own)}


def test_row_checks(spark):
    kind = "question_id int, target string, answer_included boolean, contexts array<struct<chunk_id: string, text: string>>, fused array<struct<chunk_id: string>>"
    good = (1, "dev", False, [("a", "x"), ("b", "y")], [("a",), ("b",), ("c",)])
    check = lambda *rows: checks.validate_context_rows(spark.createDataFrame(list(rows), kind), target="dev", selected=2, fused=3).collect()
    assert len(check(good)) == 1
    for bad in ((2, "train", *good[2:]), (2, "dev", True, *good[3:]), (2, "dev", False, [("a", " "), ("b", "y")], good[4]), (2, "dev", False, [("b", "x"), ("a", "y")], good[4]), (2, "dev", None, *good[3:]), good):
        with pytest.raises(Exception, match="invalid context row"):
            check(good, bad)
    a = spark.createDataFrame([(1, 0, "x"), (2, 1, "y")], "k int, o int, v string")
    assert [tuple(r) for r in checks.lockstep(a, a.withColumn("w", F.lit(7)), key="k", order="o", same=["v"]).orderBy("k").collect()] == [(1, 0, "x", 7), (2, 1, "y", 7)]
    for b in (a.where("k = 1"), a.unionByName(a), a.withColumn("o", F.col("o") + 1), a.withColumn("v", F.lit("z"))):
        with pytest.raises(Exception, match="tables differ"):
            checks.lockstep(a, b, key="k", order="o", same=["v"]).collect()
    assert checks.counted(a, 2).count() == 2
    with pytest.raises(Exception, match="rows: 2"):
        checks.counted(a, 3).collect()
    with pytest.raises(Exception, match="no chunks of"):
        checks.chunks_of_documents(a.withColumnRenamed("k", "document_id"), spark.createDataFrame([(5,)], "document_id int"), order="o").collect()
    e = spark.createDataFrame([("Theo Điều 5 và 15/2020/NĐ-CP", [("nói điều 5", None), ("x", "7")]), ("", [])], "a string, c array<struct<text: string, article_number: string>>")
    got = e.select(*evaluation.answer_derived(F.col("a"), F.col("c"))).collect()
    assert (got[0].references, got[0].reference_hits, got[0].any_hit, got[0].all_hit) == (2, 1, True, False) and (got[1].coverage, got[1].all_hit) == (0.0, False)


def test_publish(spark, tmp_path):
    from lexmill.sources import sinks

    at = str(tmp_path / "out")
    sinks.publish(spark, lambda p: spark.range(3).write.parquet(p), at)
    with pytest.raises(FileExistsError):
        sinks.publish(spark, lambda p: spark.range(4).write.parquet(p), at)
    with pytest.raises(ZeroDivisionError):
        sinks.publish(spark, lambda p: 1 / 0, at, force=True)
    assert spark.read.parquet(at).count() == 3
    sinks.publish(spark, lambda p: spark.range(4).write.parquet(p), at, force=True)
    assert spark.read.parquet(at).count() == 4 and [p.name for p in tmp_path.iterdir() if not p.name.startswith("..")] == ["out"]
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "id int, v array<float>")
    sinks.write_vectors(vec, str(tmp_path / "vec"), id_col="id", vector_col="v", dimension=2)
    assert spark.read.json(str(tmp_path / "vec/manifest")).first().rows == 2
    with pytest.raises(Exception, match="bad vector of 1"):
        sinks.write_vectors(spark.createDataFrame([(1, [float("nan"), 2.0])], vec.schema), str(tmp_path / "bad"), id_col="id", vector_col="v", dimension=2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "b c", "c", "a a a d", ""])], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "c zz"), (3, "")], "item_id long, text string")
    sinks.write_index(docs, T.word_list(F.col("text")), str(tmp_path / "index"))
    saved = sinks.read_index_topk(spark, str(tmp_path / "index"), asked, T.query_tokens(F.col("text")), k=3).collect()
    direct = retrieval.bm25(docs, asked, doc_tokens=T.word_list(F.col("text")), query_tokens=T.query_tokens(F.col("text")), k=3).collect()
    assert sorted(map(tuple, saved)) == sorted(map(tuple, direct)) and len(direct) == 5


def test_substrings_of_words(spark):
    docs = spark.createDataFrame([(1, "abcabc xabcx"), (2, "zabcz abd"), (3, None), (4, "abd abdabd")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, ["abc"]), (2, ["abc", "abd"]), (3, [])], "item_id long, t array<string>")
    got = retrieval.substring_bm25(docs, asked, text=F.col("text"), terms=F.col("t"), k=5).collect()
    assert {(r.query_id, r.id) for r in got} == {(1, 1), (1, 2), (2, 2)}


@pytest.mark.parametrize("raw, want", [
    ("Mở.\n" + "một hai ba bốn năm sáu bảy tám chín.\n" * 2 + "một hai ba bốn năm sáu bảy tá", "Mở.\nmột hai ba bốn năm sáu bảy tám chín."),  # cut in mid-word
    ("- nộp hồ sơ tại cơ quan.\n" * 2 + "- nộp h", "- nộp hồ sơ tại cơ quan."),
    ("- nộp hồ sơ chưa xong\n- khác.\n- nộp hồ sơ chưa xong\n- nộp h", "- nộp hồ sơ chưa xong\n- khác.\n- nộp hồ sơ chưa xong"),  # items need not be finished
    ("a b\nc\na\nb c", "a b\nc"),  # blocks are equal as wholes
    ("x " * 31 + "y " + "x " * 31 + "y", ("x " * 31 + "y").strip()),
])
def test_cleanup_as_text(raw, want):
    assert cleanup.unified(raw.rstrip()) == want


def test_cut_interior():
    line = "câu này khá dài để được xem là một khối có ý nghĩa trong văn bản pháp luật hiện hành của nước ta và còn dài thêm nữa để đủ chữ.\n"
    rest = "phần còn lại của câu trả lời vẫn đủ dài để được giữ nguyên ở cuối."
    assert cleanup.cut_interior("Mở.\n" + line + line + rest) == "Mở.\n" + line.strip() + " " + rest
    apart = line + "khác hẳn.\n" + line + rest
    assert cleanup.cut_interior(apart) == apart and cleanup.cut_interior(line + line + "ngắn") == line + line + "ngắn"
    assert cleanup.cut_interior(line + line + line + rest).count("câu này") == 2  # one cut only


def test_token_periods_like_brute_force():
    import random

    rng = random.Random(2)

    def brute(ids, least, most):
        while True:
            s = next((s for s in range(min(most, len(ids) // 2), least - 1, -1) if ids[-2 * s : -s] == ids[-s:]), 0)
            if not s:
                return ids
            ids = ids[:-s]

    for _ in range(300):
        ids = [rng.choice("ab") for _ in range(rng.randrange(30))]
        ids += ids[-rng.randrange(1, 9) :] * rng.randrange(4)
        assert cleanup.cut_repeated_tokens(3, 8)(" ".join(ids)).split() == brute(ids, 3, 8)


def test_cleaner(spark):
    raw = [("<SCRIPT>a</p></script >b<img src=x alt='q r'><img alt=\"\" alt=z><img>c<style>x</style>",), ("\u3000a \u2003\n\n\n\n b&amp;\u00a0",), ("e\u0301\r\n<p>x</p>",), ("<script>a</style>b</script>c",)]
    got = [r[0] for r in spark.createDataFrame(raw, "t string").select(cleaning.clean(F.col("t"))).collect()]
    assert got == ["bq rc", "a\n\nb&", "é\n\nx", "c"]
    n = spark.createDataFrame(raw, "t string").select(*cleaning.counters(F.col("t"))).collect()
    assert [(r.html_count, r.non_nfc_input, r.crlf_input) for r in n] == [(5, False, False), (0, False, False), (2, True, True), (1, False, False)]


LOOP = "Câu mở đầu.\n"


@pytest.mark.parametrize("raw, want", [
    ("no repeat here.", "no repeat here."),
    (LOOP + "dòng lặp.\ndòng lặp.", LOOP + "dòng lặp."),
    ("a.\nb.\na.\nb.\na.\nb.", "a.\nb."),
    ("Mở. " + "một hai ba bốn năm sáu bảy tám chín mười. " * 2 + "một hai ba bốn năm sáu bảy tám", "Mở. một hai ba bốn năm sáu bảy tám chín mười."),
    ("1. x\n2. x\n3. x\n4.", "1. x"),
    ("1. x\n2. x\n4. x", "1. x\n2. x\n4. x"),
])
def test_unified_clean(raw, want):
    assert cleanup.unified(raw) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a.", "b.", "c d", "1. x", "\n", "a b c."]), min_size=1, max_size=14).map(" ".join).filter(str.strip))
def test_cleanup_cuts_the_end_only(text):
    out = cleanup.unified(text)
    assert text.startswith(out) and cleanup.unified(out) == out


def test_rouge(spark):
    df = spark.createDataFrame([("a b c d", "a c d e"), ("", "a"), ("é", "ê"), ("x", "x")], "r string, p string")
    assert [x[0] for x in df.select(evaluation.rouge_l(F.col("r"), F.col("p"))).collect()] == [0.75, 0.0, 0.0, 1.0]
    q = spark.createDataFrame([("1", "a")], "question_id string, answer string")
    with pytest.raises(Exception, match="one side"):
        evaluation.score_mapping(q, spark.createDataFrame([("2", "a")], "question_id string, answer string")).collect()


def test_splits(spark):
    kind = "question_id string, question string, answer string"
    train = spark.createDataFrame([("1", "Câu A", "x"), ("2", "câu  b", "y"), ("3", "mở", "z")], kind)
    warm = spark.createDataFrame([("9", "CÂU A", "X"), ("8", "mới", "w")], kind)
    public = spark.createDataFrame([("p", "MỞ", None)], kind)
    got = {r.question_id: r.status for r in splits.leakage_safe_splits(train, warm, public, seed="s").collect()}
    assert got == {"1": "kept", "2": "kept", "3": "quarantine", "9": "alias", "8": "kept"}
    with pytest.raises(Exception, match="conflicts"):
        splits.leakage_safe_splits(train, spark.createDataFrame([("9", "câu a", "other")], kind), public, seed="s").collect()


def test_percentile_rounds_half_to_even(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "v int")  # (6 - 1) * 0.5 = 2.5
    assert audit.nearest_ranks(df, "v", {"m": 0.5}).first().m == 2
    df = spark.createDataFrame([(i,) for i in range(8)], "v int")  # 3.5
    assert audit.nearest_ranks(df, "v", {"m": 0.5}).first().m == 4


def test_inventory(spark):
    m = spark.createDataFrame([("a", 5), ("b", 6), ("b", 6)], "key string, parameter_count long")
    s = spark.createDataFrame([("s", ["a", "b"], 12), ("t", ["a", "z"], 5)], "stack_id string, model_keys array<string>, total_parameter_count long")
    got = {tuple(r) for r in audit.inventory_errors(m, s, limit=11).collect()}
    assert got == {("repeated model", "b"), ("unknown model", "z"), ("wrong total", "s"), ("over the limit", "s")}


def test_context_archive(spark, tmp_path):
    def archive(**files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, t in files.items():
                z.writestr(n.replace("__", "/") + ".json", t)
        return b.getvalue()

    good = '{"id": %d, "link": "https://x.y/z", "passage": "p"}'
    (tmp_path / "a.zip").write_bytes(archive(d__context_2=good % 2, context_10=good % 10))
    assert [r.document_id for r in contexts.read_contexts(spark, str(tmp_path / "a.zip")).orderBy("source_name").collect()] == ["10", "2"]
    assert contexts.archive_identity(str(tmp_path / "a.zip"))[1] == 2
    for bad in ('{"id": 1, "id": 1, "link": "https://x.y", "passage": "p"}', '{"id": 1, "link": "http://x.y", "passage": "p"}', '{"id": 1, "link": "https://x.y", "passage": " "}', '{"id": true, "link": "https://x.y", "passage": "p"}'):
        with pytest.raises(ValueError):
            contexts.adapt("context_1.json", contexts.strict_json(bad.encode()))


def test_questions_and_submission(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"10": {"question": "a?", "answer": "x"}, "9": {"question": "b?", "answer": "y"}}')
    q = contexts.read_questions(spark, str(tmp_path / "q.json"), require_answer=True)
    assert q.count() == 2
    with pytest.raises(Exception, match="bad record"):
        contexts.read_questions(spark, str(tmp_path / "q.json"), require_answer=False).collect()
    sinks.write_submission(q, q, str(tmp_path / "s.zip"))
    assert zipfile.ZipFile(tmp_path / "s.zip").read("submission.json") == b'{"10": {"answer": "x"}, "9": {"answer": "y"}}'
    sinks.save_once(q, str(tmp_path / "once"))
    sinks.save_once(q, str(tmp_path / "once"))
    with pytest.raises(ValueError):
        sinks.save_once(q.limit(1), str(tmp_path / "once"))
    sinks.write_index(spark.createDataFrame([(1, "a b a")], "doc_id long, text string"), T.word_list(F.col("text")), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/term_stats")).count() == 2


def test_streaming_windows(spark, tmp_path):
    from lexmill.streaming import events

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    q = events.tumbling(events.read_events(spark, str(tmp_path / "in"), e.schema)).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == e.count()


def test_coverage_identity_and_length_guard(spark):
    rows = spark.createDataFrame([("a", " "), (None, "t"), ("", None)], "number string, title string")
    assert tuple(audit.filled_counts(rows, ["number", "title"]).first()) == (3, 1, 1, 1)
    assert tuple(audit.filled_counts(rows.limit(0), ["title"]).first()) == (0, 0, 0)
    runs = spark.createDataFrame(
        [(1, "x", "p"), (1, "y", "p"), (2, "x", "p"), (2, "y", "q"), (3, "x", "p"), (4, "x", None), (4, "y", None), (5, "x", "p"), (5, "y", "p"), (5, "y", "p"), (6, "x", None), (6, "y", ""), (None, "x", "p")],
        "id int, variant string, prompt string")
    got = audit.differing_inputs(runs, key="id", variant="variant", value="prompt").collect()
    assert sorted(r.id for r in got) == [2, 3, 5, 6]
    texts = spark.createDataFrame([(1, "abc"), (None, None)], "id int, text string")
    assert audit.within_length(texts, F.length("text"), 3, "id").count() == 2
    with pytest.raises(Exception, match="over 2: 1"):
        audit.within_length(texts, F.length("text"), 2, "id").collect()


def test_question_keys_fold_case(spark):
    own = spark.createDataFrame([("Straße  GROSS", "strasse gross"), ("Điều  5", "điều 5"), (None, None)], "a string, b string")
    assert [r[0] for r in own.select(T.normalize_question(F.col("a"))).collect()] == [r.b for r in own.collect()]
    words = spark.createDataFrame([("weiß heiß groß", "HEISS weiss gross und")], "q string, b string")
    none = F.lit(None).cast("string")
    assert words.select(selection.tier(F.col("q"), F.col("b"), none, none, none)).first()[0] == 4


def test_titles_meet_on_rare_words_as_on_all(spark):
    import random

    rng = random.Random(5)
    pool = ["thong", "tu", "luat", "thue", "dat", "xe", "nha", "muoi", "tam", "sau"]
    text = lambda: " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 7)))
    asked = spark.createDataFrame([(i, text()) for i in range(40)], "query_id int, question string")
    docs = spark.createDataFrame([(f"d{i:02d}", None if i == 7 else text(), None) for i in range(60)], "document_id string, source_title string, document_number string")
    keyed = asked.crossJoin(docs).withColumn("k", selection.title_key(F.col("question"), F.col("source_title"))).where("k is not null").collect()
    want = {i: (None, "no_match") for i in range(40)}
    for i in {r.query_id for r in keyed}:
        mine = [r for r in keyed if r.query_id == i]
        best = [r.document_id for r in mine if tuple(r.k) == max(tuple(x.k) for x in mine)]
        want[i] = (best[0], "title") if len(best) == 1 else (None, "ambiguous_title")
    got = {r.query_id: (r.document_id, r.reason) for r in selection.resolve_document(asked, docs).collect()}
    assert got == want and len({r for _, r in want.values()}) == 3


def test_relevance_of_references(spark):
    own = spark.createDataFrame(
        [("Điều 5 khoản 2 theo 12/2019/TT-BTC mức thuế đất", "Mức thuế đất theo 12/2019/tt-btc: khoản 2.", "5", 1), ("mức thuế", None, None, 2), (None, "x", "5", 3)], "q string, c string, a string, rank int")
    got = [(r.score, r.has_reference) for r in selection.relevance(own, question="q", context="c", article="a", rank="rank").collect()]
    assert got == [(1000 + 500 + 100 + 6 + 2 * 4 + 1.5 * 11, True), (None, False), (None, None)]  # six words and two pairs of them are held


def test_references_are_folded_on_both_sides(spark):
    found = selection.extract_references(spark.createDataFrame([("q", "Điều 5đ Nghị định 12/2020/NĐ-CP")], "id string, text string"), origin="question").select(
        F.lit(1).alias("query_id"), F.lit(0).alias("order"), "article_number", "clause_number", "document_number", "resolution", "source_document_id", "start", "end")
    docs = spark.createDataFrame([("d", "12/2020/NĐ-CP."), ("e", None), ("f", "")], "document_id string, document_number string")
    blocks = spark.createDataFrame([("d", "b", "5đ", [(0, "c", ["1."])])], "document_id string, block_id string, article_number string, chunks array<struct<chunk_index: int, chunk_id: string, clause_numbers: array<string>>>")
    held = spark.createDataFrame([], "query_id int, document_id string, block_id string")
    assert [(r.document_id, r.block_id, r.seed_chunk_id) for r in selection.resolve_references(found, docs, blocks, held).collect()] == [("d", "b", "c")]
    got = spark.createDataFrame([(" 15 /  2020 / NĐ-CP. ",), ("",), (None,)], "n string").select(T.number_kept(F.col("n")).alias("k")).collect()
    assert [r.k for r in got] == ["15 / 2020 / nd-cp", None, None]


def test_cut_answers_are_made_again(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(prompts, settings):
            calls.add(len(prompts))
            return [(p[: settings["max_new_tokens"]], [1] * min(len(p), settings["max_new_tokens"]) + ([9] if len(p) < settings["max_new_tokens"] and p.startswith("a") else [])) for p in prompts]
        return model

    rows = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aaaaaa"), (4, "b" * 20)], "k int, p string")
    how = {"keys": ["k"], "prompt": "p", "passes": [{"max_new_tokens": 4}, {"max_new_tokens": 8}], "eos": {9}, "path": f"{tmp_path}/a"}
    want = {1: (0, "eos", "aa", 3), 2: (0, "other", "bb", 2), 3: (1, "eos", "aaaaaa", 7), 4: (1, "length", "b" * 8, 8)}
    for more in (6, 0):  # the second run finds all of it stored
        before = calls.value
        got = stages.generate_until_done(rows, load, **how)
        assert {r.k: (r.attempt, r.finish_reason, r.answer, r.tokens) for r in got.collect()} == want and calls.value - before == more
    with pytest.raises(Exception, match="blank answer"):
        stages.generate_until_done(rows.select("k", F.lit("").alias("p")), load, **how | {"path": f"{tmp_path}/b"})


def test_model_windows(spark):
    import re as _re

    def load():
        pieces = lambda t: [m.span() for m in _re.finditer(r"\s?[^\s]{1,3}", t)]  # noqa: E731  # tokens with a space before, as byte-pair models have
        return pieces, lambda t: len(pieces(t)) + 2

    text = "  một hai bacdefgh  bốn\nnăm " * 9 + "."
    offsets, count = load()
    got = chunking.offset_windows(text, offsets, count, most=12, overlap=3, added=2)
    spans = offsets(text)
    assert got[0][0] == 2 and got[-1][1] == len(text) and all(n == count(text[a:b]) <= 12 and text[a:b] == text[a:b].strip() for a, b, n in got)
    assert all(b1 > a2 for (_, b1, _), (a2, _, _) in zip(got, got[1:])) and len(got) >= len(spans) / 10
    rows = chunking.model_windows(spark.createDataFrame([(1, text), (2, None), (3, " ")], "document_id int, cleaned_text string"), load, most=12, overlap=3, added=2).collect()
    assert [(r.start, r.end, r.tokens) for r in sorted(rows, key=lambda r: r.window)] == got
    with pytest.raises(ValueError, match="no window fits"):
        chunking.offset_windows("abc", offsets, count, most=2, overlap=0, added=0)
    whole = chunking.offset_windows("abc def", offsets, count, most=12, overlap=50, added=2)
    assert whole == [(0, 7, 4)] and chunking.offset_windows("", offsets, count, most=12, overlap=1) == []


def test_spans_out_of_their_text_and_repeated_questions(spark):
    docs = spark.createDataFrame([("d", "abcdef")], "document_id string, cleaned_text string")
    kind = "query_id int, document_id string, block_id string, rank int, start int, end int, chunk_ids array<string>"
    units = lambda *ends: spark.createDataFrame([(1, "d", f"b{i}", 1, a, b, ["c"]) for i, (a, b) in enumerate(ends)], kind)
    assert sorted(r.text for r in spans.merge_ranked_spans(units((0, 2), (3, 6)), docs).collect()) == ["ab", "def"]
    for bad in ((3, 7), (-1, 2), (2, 2)):
        with pytest.raises(Exception, match="out of its text"):
            spans.merge_ranked_spans(units(bad), docs).collect()
    q = spark.createDataFrame([("1", "A  b?"), ("2", "a b?"), ("3", "c")], "question_id string, question string")
    assert [tuple(r) for r in contexts.repeated_questions(q).collect()] == [("a b?", 2, "1")]


def test_texts_of_a_batch_are_strings_a_slice_at_a_time(spark):
    texts = ["é" if i % 3 else None for i in range(T.SLICE * 2 + 5)]
    for f, one in ((T.nfc, "é"), (T.nfkc_casefold, "é"), (T.fold_any, "e")):
        parts = list(f.func(iter([pa.array(texts), pa.array([], pa.string())])))
        assert [len(p) for p in parts] == [T.SLICE, T.SLICE, 5]
        assert [x for p in parts for x in p.to_pylist()] == [None if x is None else one for x in texts]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").repartition(1).select("i", T.nfc(F.col("x")).alias("y"), cleaning.clean(F.col("x")).alias("z"))
    assert all(r.y == r.z == (None if texts[r.i] is None else "é") for r in rows.collect())


def test_terms_are_counted_by_arrays_and_scored_in_bounded_parts():
    import pandas as pd

    vocabulary = {"b": 0, "a": 1, "long": 2}
    tokens = pa.array([["x"], ["a", "b", "a"], None, [], ["b"]]).slice(1)
    key, n, lengths = retrieval._count_tokens(vocabulary)(tokens)
    assert sorted(zip(key.tolist(), n.tolist())) == [(0, 1), (1, 1), (1, 1), (3 << 32, 1)] and lengths.to_pylist() == [3, None, 0, 1]
    key, n, lengths = retrieval._count_substrings(3)({"long": 0, "ong": 1})(pa.array(["a longong b", None, ""]))
    assert sorted(zip(key.tolist(), n.tolist())) == [(0, 1), (1, 2)] and lengths.to_pylist() == [9, None, 0]
    rows = pd.DataFrame({"id": range(1202)})
    parts = list(retrieval._parts(rows, np.array([retrieval.SCORE_PAIRS * 2, retrieval.SCORE_PAIRS, *[1] * 1200])))
    assert [len(p) for p in parts] == [1, 1, 500, 500, 200] and pd.concat(parts)["id"].tolist() == list(range(1202))
