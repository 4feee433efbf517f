"""Fill-in-the-middle, Katz scoring and the schema rewrite against brute force, with nulls, ties, repeats, long and empty texts, empty tables."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexmill.llm import evolve, infill, katz
from lexmill.llm.queries import QUERIES
from lexmill.session import fresh_folder


# ---- fill in the middle ----------------------------------------------------------------------------------


def fim(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs):
    rng = random.Random(2)
    bits = ["ab", "Cde", " ", "\n", "é", "😀", "1", "<", ">", "<P", "S>", "ß", "."]
    texts = [None, "", "a", "é", "<M>", "x<P>y", "<S", "P>", "aaa", " " * 70, "word " * 40_000]
    texts += ["".join(rng.choice(bits) for _ in range(rng.choice([1, 2, 3, 31, 32, 33, 64, 500]))) for _ in range(150)]
    ids = [*range(len(texts)), 3, 3, 3, 20, None, None, None]
    texts += ["aaa bbb", "aaa bbb", "ccc", texts[20], "no id", "no id", None]
    got = infill.fill_in_middle(docs(texts, ids=ids)).select("*", infill.restored(F.col("form"), F.col("output")).alias("back")).collect()
    key = lambda r: tuple((x is not None, x) if not isinstance(x, str) else x for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((fim(i, t) for i, t in zip(ids, texts)), key=key)
    assert Counter(r.back for r in got) == Counter(t or "" for t in texts)
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert infill.fill_in_middle(docs([])).count() == 0


# ---- Katz ------------------------------------------------------------------------------------------------


def katz_model(texts, order):
    """Probability of a word after a history, by dictionaries alone."""
    start, end = "<start>", "<end>"
    seqs = [[start] * (order - 1) + tokens(t) for t in texts]
    counts = [Counter() for _ in range(order + 1)]
    for s in seqs:
        for i in range(order - 1, len(s)):
            for k in range(1, order + 1):
                counts[k][tuple(s[i - k + 1 : i + 1])] += 1
    factor = [None]
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        d = {}
        common = 6 * n[6] / n[1] if n[1] else 1
        for r in range(1, 6):
            f = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and n[r + 1] and common < 1 else 1
            d[r] = f if 0 < f <= 1 else 1
        factor.append(d)
    after = [None] + [{} for _ in range(order)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            after[k].setdefault(g[:-1], {})[g[-1]] = c

    def level(h, k):
        """Seen words' probabilities after a history of k - 1 words, and its weight."""
        own = after[k].get(h, {})
        kept = {w: factor[k].get(c, 1) * c for w, c in own.items()}
        whole = sum(own.values())
        if round(math.fsum(kept.values()), 6) >= whole:
            whole += 1
        return {w: x / whole for w, x in kept.items()}

    def p(w, h):
        own = level(h, len(h) + 1)
        if w in own:
            return own[w]
        if not h:
            return 1 - math.fsum(own.values())
        if not own:
            return p(w, h[1:])
        alpha = (1 - math.fsum(own.values())) / (1 - math.fsum(p(x, h[1:]) for x in own))
        return alpha * p(w, h[1:])

    words = [g[0] for g in counts[1]]
    return p, counts[1], words, start


def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["<end>"]


@pytest.mark.parametrize("order, keys", [(1, 1_500_000), (2, 40), (3, 1_500_000)])
def test_katz(spark, docs, monkeypatch, tmp_path, order, keys):
    monkeypatch.setattr(katz, "RANGE_KEYS", keys)
    rng = random.Random(order)
    words = [f"w{i}" for i in range(25)] + ["É", "İ", "Z", "a b"]
    weight = [1 / (i + 1) for i in range(len(words))]
    texts = [None, "", " \n", "W0 w0 W1"] + [" ".join(rng.choices(words, weight, k=rng.choice([1, 3, 20, 60]))) for _ in range(80)] + ["never seen w0 before w1"]
    texts += [texts[10]] * 3
    ids = [*range(len(texts) - 3), 5, 5, None]
    learn = [i is not None and i % 4 != 0 for i in ids]
    df = docs(texts, ids=ids).repartition(5)
    got = katz.katz_scores(df, f"{tmp_path}/m", learn=F.col("doc_id") % 4 != 0, order=order).collect()
    p, counts, vocabulary, start = katz_model([t for t, x in zip(texts, learn) if x], order)
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in zip(ids, texts):
        s = [start] * (order - 1) + tokens(t)
        own = range(order - 1, len(s))
        want.append((i, len(own), sum((s[k],) in counts for k in own), total, sum(math.log10((counts[(s[k],)] + 0.1) / (total + 0.1 * (distinct + 1))) for k in own),
                     sum(math.log10(p(s[k], tuple(s[k - order + 1 : k]))) for k in own)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    for h in ([start] * (order - 1), ["w0"] * (order - 1), ["w3", "w1"][: order - 1], ["none", "w2"][: order - 1]):  # exactly normalised
        assert math.fsum(p(w, tuple(h)) for w in [*vocabulary, "unknown"]) == pytest.approx(1, abs=1e-9)
    grams = katz.stored_grams(spark, f"{tmp_path}/m")
    assert grams.where("level = 1").agg(F.sum("n")).first()[0] == total + sum(learn)  # start marks are stored as contexts


def test_katz_without_anything_to_learn(spark, docs, tmp_path):
    got = katz.katz_scores(docs(["a b", None]), f"{tmp_path}/m", learn=F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, round(r.score, 9), round(r.base_score, 9)) for r in got} == {(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)}
    assert katz.katz_scores(docs([]), f"{tmp_path}/e", learn=F.lit(True)).count() == 0


def test_katz_beats_single_words_on_held_out_rows(spark):
    x = QUERIES["op12_katz"](spark, "/root/testdata/sf0.001").toPandas()
    held = x[x.held_out]
    assert len(x) == 200 and held.score.sum() > held.base_score.sum()


def test_discounts():
    d = katz.discounts([100, 40, 20, 12, 8, 5])
    common = 6 * 5 / 100
    assert d[1] == pytest.approx((2 * 40 / 100 - common) / (1 - common)) and d[6] == 1 and (d[1:] <= 1).all()
    assert (katz.discounts([0, 5, 0, 0, 0, 0]) == 1).all() and (katz.discounts([3, 9, 1, 1, 1, 9]) == 1).all()


# ---- schema rewrite --------------------------------------------------------------------------------------

KIND = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, row string, file_no string"
NAMES = [c.split()[0] for c in KIND.split(", ")][:10]


def rewritten(rows):
    """What each file must hold in the end, by lists alone."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(("" if r[0] is None else str(r[0])).encode()), *((x is not None, x) for x in r[:10])))
    size, out = 1 + len(rows) // 500, {}
    for k in range(0, len(rows), size):
        n = k // size
        v = zlib.crc32(f"42:{n}".encode()) % 24
        v = 0 if v > 15 else v
        part = [list(r[:10]) for r in rows[k : k + size]]
        for r in part:
            if v & 4:
                r[2], r[7] = "none", -1
            if v & 8 and r[9] is not None:
                r[9] = struct.unpack("f", struct.pack("f", r[9]))[0]
            r[3] = None if r[3] is None else (r[3] - r[3].__class__(1970, 1, 1)) // __import__("datetime").timedelta(microseconds=1)
        cols = [c for c in NAMES if not (v & 4 and c in ("nation_id", "source"))]
        cols = cols[:1] + cols[:0:-1] if v & 2 else cols
        if v & 1:
            cols = [{"name": "email", "email": "name"}.get(c, c) for c in cols]
        say = lambda i, x: "?" if x is None else str(math.floor(1048576 * x)) if i == 9 else str(x)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[n] = (v, len(part), sum(x is None for r in part for x in r), sha(",".join(say(0, r[0]) for r in part)), sha("\n".join("|".join(map(say, range(10), r)) for r in part)), ",".join(cols), ",".join(NAMES), v != 0)
    return out


def described(df):
    return {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in df}


@pytest.mark.parametrize("n", [0, 1, 40, 1300])
def test_evolve(spark, n):
    from datetime import datetime

    rng = random.Random(n)
    maybe = lambda x: rng.choice([None, x, x, x])
    rows = [(rng.choice([i, i, 7, None]), maybe(i), maybe("web"), maybe(datetime(2024, 1, 1 + i % 28, 3, 4, 5, i)), maybe(f"N'\"|{i}"), maybe("é@x"), maybe(""), maybe(i % 25), maybe("s"), maybe(rng.choice([-0.1, 1 / 3, 12345.67, -9.5])), "x", "y") for i in range(n)]
    rows += rows[: n // 4]  # whole rows repeated
    folder = fresh_folder(spark, "evolve")
    got = evolve.evolve_clients(spark.createDataFrame(rows, KIND), folder).collect()
    assert described(got) == rewritten(rows)
    if not n:
        return
    root = os.path.dirname(got[0].path)
    assert sorted(r.path for r in got) == sorted(f"{root}/{f}" for f in os.listdir(root) if not f.startswith((".", "_"))) and os.listdir(os.path.dirname(root)) == ["files"]
    for r in got[:: max(1, len(got) // 20)]:
        own = pq.read_schema(r.path)
        assert [(f.name, str(f.type), f.nullable, int(f.metadata[b"PARQUET:field_id"])) for f in own] == [
            (c, k, True, i) for i, (c, k) in enumerate(zip(NAMES, ["int64", "int64", "string", "timestamp[us]", "string", "string", "string", "int64", "string", "double"]), 1)]
    assert spark.read.parquet(root).count() == len(rows)


def test_evolve_query(spark):
    rows = list(spark.read.parquet("/root/testdata/sf0.001/clients.parquet").select(*NAMES).toLocalIterator())
    assert described(QUERIES["op13_evolve"](spark, "/root/testdata/sf0.001").collect()) == rewritten(rows)


def test_a_repeated_field_id_is_refused(spark, tmp_path):
    import pyarrow as pa

    twice = pa.schema([pa.field(c, pa.int64(), True, {b"PARQUET:field_id": b"1"}) for c in ("a", "b")])
    pq.write_table(pa.table({"a": [1], "b": [2]}, schema=twice), f"{tmp_path}/x.parquet")
    with pytest.raises(ValueError, match="comes twice"):
        evolve.select_by_ids(evolve._connect(), f"{tmp_path}/x.parquet", evolve.CLIENTS)
