"""Splitting documents into articles, clauses and windows, with code-point offsets (Arrow, one pass)."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headings of Vietnamese legal texts.
ARTICLE = r"(?im)^\s*Điều\s+(?P<number>[0-9]+(?:[a-zđ])?)\s*(?:[.:-]\s*)?(?P<title>[^\n]*)"
CLAUSE = r"(?im)^\s*(?P<number>[0-9]+(?:[a-zđ])?)[.)]\s+"

SCHEMA = (
    "chunk_id string, document_id string, article_number string, article_title string, clause_numbers array<string>, section_kind string, "
    "split_method string, chunk_index int, start_char int, end_char int, whitespace_token_count int, model_token_count int, text string, search_text string")


@dataclass(frozen=True)
class ChunkParams:
    max_tokens: int = 400
    max_chars: int = 3000
    overlap: int = 40
    header_chars: int = 400
    article: str = ARTICLE
    clause: str = CLAUSE
    #: Counts model tokens of a text; windows then shrink until they fit ``max_model_tokens``.
    token_counter: Callable[[str], int] | None = None
    max_model_tokens: int | None = None


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    kind: str
    method: str
    number: str | None = None
    title: str | None = None
    heading: str = ""


class Chunker:
    """Preamble windows, then each article whole, or by groups of clauses, or by windows."""

    def __init__(self, params: ChunkParams) -> None:
        self.p, self.article, self.clause = params, re.compile(params.article), re.compile(params.clause)

    def trim(self, text: str, a: int, b: int) -> tuple[int, int]:
        part = text[a:b]
        return a + len(part) - len(part.lstrip()), a + len(part.rstrip())

    def fits(self, text: str) -> bool:
        p = self.p
        if len(text) > p.max_chars or len(text.split()) > p.max_tokens:
            return False
        return p.token_counter is None or p.max_model_tokens is None or p.token_counter(text) <= p.max_model_tokens

    def windows(self, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Windows of whole tokens; each starts ``overlap`` tokens before the last one's end, and moves on."""
        words = [(a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
        i = 0
        while i < len(words):
            j = min(len(words), i + self.p.max_tokens)
            while j > i + 1 and (words[j - 1][1] - words[i][0] > self.p.max_chars or not self.fits(text[words[i][0] : words[j - 1][1]])):
                j -= 1
            yield words[i][0], words[j - 1][1]
            if j == len(words):
                return
            i = max(i + 1, j - self.p.overlap)

    def _windows(self, text: str, a: int, b: int, kind: str, **more) -> Iterator[Piece]:
        method = "model_token_fallback" if self.p.token_counter else "token_fallback"
        for x, y in self.windows(text, a, b):
            yield Piece(x, y, kind, method, **more)

    def _article(self, text: str, a: int, b: int, body: int, more: dict) -> Iterator[Piece]:
        if self.fits(text[a:b]):
            yield Piece(a, b, "article", "article", **more)
            return
        cuts = [m.start() for m in self.clause.finditer(text, body, b)]
        if not cuts:
            yield from self._windows(text, a, b, "article", **more)
            return
        edges = [a, *[c for c in cuts if c > a], b]
        units = [self.trim(text, x, y) for x, y in zip(edges, edges[1:])]
        group: tuple[int, int] | None = None
        for x, y in ((x, y) for x, y in units if x < y):
            if group and self.fits(text[group[0] : y]):
                group = (group[0], y)
                continue
            if group:
                yield Piece(*group, "clause_group", "clause_group", **more)
            group = (x, y) if self.fits(text[x:y]) else None
            if group is None:
                yield from self._windows(text, x, y, "clause", **more)
        if group:
            yield Piece(*group, "clause_group", "clause_group", **more)

    def pieces(self, text: str) -> Iterator[Piece]:
        heads = list(self.article.finditer(text))
        if not heads:
            yield from self._windows(text, 0, len(text), "unstructured")
            return
        a, b = self.trim(text, 0, heads[0].start())
        if a < b:
            yield from self._windows(text, a, b, "preamble")
        for m, end in zip(heads, [*(h.start() for h in heads[1:]), len(text)]):
            a, b = self.trim(text, m.start(), end)
            if a < b:
                yield from self._article(text, a, b, m.end(), {"number": m["number"], "title": m["title"].strip() or None, "heading": m[0].strip()})

    def header(self, text: str) -> str:
        m = self.article.search(text)
        lines = [x.strip() for x in text[: m.start() if m else self.p.header_chars].splitlines()]
        return "\n".join(x for x in lines if x)[: self.p.header_chars].rstrip()

    def rows(self, document_id: str, title: str | None, text: str) -> list[tuple]:
        header, out = self.header(text), []
        for k, p in enumerate(self.pieces(text)):
            body = text[p.start : p.end]
            parts = dict.fromkeys(x for x in (title or "", header, p.heading, body) if x)
            digest = hashlib.sha256(body.encode()).hexdigest()[:12]
            count = self.p.token_counter(body) if self.p.token_counter else None
            out.append((
                f"ctx-{document_id}::{k:05d}::{digest}", document_id, p.number, p.title, [m["number"] for m in self.clause.finditer(body)],
                p.kind, p.method, k, p.start, p.end, len(body.split()), count, body, "\n".join(parts)))
        return out


def chunk_documents(docs: DataFrame, params: ChunkParams = ChunkParams(), *, id_col: str = "document_id", text_col: str = "cleaned_text", title_col: str | None = "source_title") -> DataFrame:
    """Chunks of every document; null and blank texts have none. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Chunker(params)
        for pdf in batches:
            rows = [r for i, t, x in zip(pdf["id"], pdf["title"], pdf["text"]) if x for r in c.rows(i, t, x)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"model_token_count": "Int32"})

    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).cast("string").alias("id"), title.alias("title"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, SCHEMA)


#: What opens a procedure's heading, and an item number that ends it.
PROCEDURE = re.compile(r"^(?:PHẪU THUẬT|KỸ THUẬT|QUY TRÌNH|ĐIỀU TRỊ)\b", re.I)
ITEM_NUMBER = re.compile(r"^(?:[IVX]+|\d+)\s*[.)-]\s+", re.I)


def _tight(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    return a + len(part) - len(part.lstrip()), a + len(part.rstrip()) if part.strip() else a + len(part) - len(part.lstrip())


def _lines_within(text: str, least: int, most: int) -> Iterator[tuple[int, int]]:
    """Trimmed lines; of one longer than ``most`` the longest head of ``least`` to ``most`` that a space ends, over and over."""
    head = re.compile(rf"(?s).{{{least},{most}}}(?= )|.{{{most}}}")
    for m in re.finditer(r"[^\n]+", text):
        a, b = _tight(text, *m.span())
        while b - a > most:
            cut = head.match(text, a, b).end()
            yield _tight(text, a, cut)
            a, b = _tight(text, cut, b)
        if a < b:
            yield a, b


def split_exact(text: str, least: int, most: int) -> list[tuple[int, int]]:
    """Trimmed spans of lines, cut to at most ``most`` characters at the last space of a window's second half.

    Without a space there the cut is at ``most``. A span shorter than ``least`` joins the one before it if both
    fit, as a short first one does the second; what stays short is dropped.
    """
    short = lambda s: s[1] - s[0] < least
    out: list[tuple[int, int]] = []
    for a, b in _lines_within(text, most // 2, most):
        if out and short((a, b)) and b - out[-1][0] <= most:
            a, _ = out.pop()
        out.append((a, b))
    if len(out) > 1 and short(out[0]) and out[1][1] - out[0][0] <= most:
        out[:2] = [(out[0][0], out[1][1])]
    return [s for s in out if not short(s)]


def _upper(s: str) -> bool:
    letters = [c for c in s if c.isalpha()]
    return len(letters) >= 12 and sum(map(str.isupper, letters)) >= 0.9 * len(letters)


def procedure_headings(text: str, most_lines: int = 4, most_chars: int = 220) -> list[tuple[int, str]]:
    """``start, title`` of upper-case headings that name a procedure, with up to three upper-case lines that go on."""
    rows = [(m.start(), m[0].strip()) for m in re.finditer(r"(?m)^[^\n]+", text)]
    out = []
    for i, (start, head) in enumerate(rows):
        if PROCEDURE.match(head) and _upper(head):
            more = itertools.takewhile(lambda x: x and _upper(x) and not ITEM_NUMBER.match(x) and not PROCEDURE.match(x), (x for _, x in rows[i + 1 : i + most_lines]))
            title = " ".join([head, *more])
            if len(title) <= most_chars:
                out.append((start, title))
    return out


def sections(text: str, params: ChunkParams = ChunkParams()) -> list[dict]:
    """Articles, then procedures: ``kind, start, end, heading, article_number``. A procedure ends at the next, or with its article."""
    heads = list(re.finditer(params.article, text))
    ends = [*(m.start() for m in heads[1:]), len(text)]
    out = [{"kind": "article", "start": m.start(), "end": e, "heading": m[0].strip(), "article_number": m["number"]} for m, e in zip(heads, ends)]
    found = procedure_headings(text)
    for (a, title), b in zip(found, [*(x for x, _ in found[1:]), len(text)]):
        around = next((s["end"] for s in out if s["kind"] == "article" and s["start"] <= a < s["end"]), len(text))
        out.append({"kind": "procedure", "start": a, "end": min(b, around), "heading": title, "article_number": None})
    return [s for s in out if s["end"] > s["start"]]


def document_sections(docs: DataFrame, *, id_col: str = "document_id", text_col: str = "cleaned_text") -> DataFrame:
    """``document_id, position, kind, start, end, heading, article_number``; null and blank texts have none. Map-only."""
    names = ["document_id", "position", "kind", "start", "end", "heading", "article_number"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"document_id": i, "position": k, **s} for i, t in zip(pdf["id"], pdf["text"]) if t for k, s in enumerate(sections(t))], columns=names)

    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "document_id string, position int, kind string, start int, end int, heading string, article_number string")


#: Code-point spans of a text's model tokens, in order; and how many tokens a text has with what a model adds to it.
Offsets = Callable[[str], list[tuple[int, int]]]


def offset_windows(text: str, offsets: Offsets, count: Callable[[str], int], *, most: int, overlap: int, added: int = 0) -> list[tuple[int, int, int]]:
    """Windows ``start, end, tokens`` that a model holds whole: spans of text from a token's begin to a token's end.

    A window takes ``most`` less ``added`` tokens if the text between them, trimmed and counted anew, has no more than
    ``most``, else as many as do; the next goes back ``overlap`` tokens, but moves on by one at least. Tokens without
    characters are none. A single token that does not fit is an error.
    """
    spans = [s for s in offsets(text) if s[1] > s[0]]
    out, first = [], 0
    while first < len(spans):
        for last in range(min(len(spans), first + most - added), first, -1):
            a, b = spans[first][0], spans[last - 1][1]
            inner = text[a:b]
            a, b = a + len(inner) - len(inner.lstrip()), a + len(inner.rstrip())
            if a < b and (n := count(text[a:b])) <= most:
                break
        else:
            raise ValueError(f"no window fits at {spans[first][0]}")
        out.append((a, b, n))
        if last == len(spans):
            break
        first = max(first + 1, last - overlap)
    return out


def model_windows(docs: DataFrame, load: Callable[[], tuple[Offsets, Callable[[str], int]]], *, most: int, overlap: int, added: int = 0, id_col: str = "document_id", text_col: str = "cleaned_text") -> DataFrame:
    """``document_id, window, start, end, tokens`` of each text by a tokenizer with offsets, loaded once a task. Null texts have none. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets, count = load()
        for pdf in batches:
            rows = [(i, k, *w) for i, t in zip(pdf["id"], pdf["text"]) if t and t.strip() for k, w in enumerate(offset_windows(t, offsets, count, most=most, overlap=overlap, added=added))]
            yield pd.DataFrame(rows, columns=["document_id", "window", "start", "end", "tokens"])

    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "document_id string, window int, start int, end int, tokens int")


def exact_segments(docs: DataFrame, *, id_col: str = "document_id", text_col: str = "cleaned_text", least: int = 200, most: int = 1200) -> DataFrame:
    """``document_id, position, start, end`` of ``split_exact``; null and blank texts have none. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, k, a, b) for i, t in zip(pdf["id"], pdf["text"]) if t for k, (a, b) in enumerate(split_exact(t, least, most))], columns=["document_id", "position", "start", "end"])

    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "document_id string, position int, start int, end int")
