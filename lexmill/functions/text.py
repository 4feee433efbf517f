"""Text normalisers as native columns; NFC/NFKC, which Spark lacks, as Arrow functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

WORDS = r"[\p{L}\p{N}]+"
LEGAL_NUMBER = r"(?i)\b[0-9]{1,4}\s*/\s*[0-9]{4}\s*/\s*[a-z0-9]+(?:\s*-\s*[a-z0-9]+)*\b"

# Words that three matchers leave out (folded).
CONTENT_STOPWORDS = (
    "ai bao bi cac can co cua duoc gi hay hien khi la lam mot nao nhung phai quy ra sau the thi theo trong tren truoc tu va ve voi").split()
TITLE_STOPWORDS = (
    "ban bo boi cac chi chi-tiet cho co cua duoc hanh huong mot nay nhung quy quy-dinh so sua thi thuc ve va viec").split()
SECTION_STOPWORDS = (
    "ai bao cac can chi cho co cua da de den dieu duoc gi khi la lam mot nao nay nguoi nhieu nhu nhung quy dinh sao sau se theo thi "
    "tren trong tu va ve voi phap luat hien tai thuc hien truong hop doi tuong thanh pho nam bao gom noi dung").split()
LEGAL_TYPES = "bo chi dinh luat nghi phap quyet thong tu".split()


def _fold_pairs() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to one base letter and marks, and their bases; and đ."""
    pairs = {"đ": "d"}
    for code in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _fold_pairs()


#: Rows of an Arrow batch that are Python strings at one time.
SLICE = 256


def each_text(f: Callable[[str], str]):
    """``f`` of each text of a column; null stays null. A task holds an Arrow batch and, as Python strings, a slice of it."""

    @arrow_udf(StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                yield pa.array([None if x is None else f(x) for x in batch.slice(lo, SLICE).to_pylist()], pa.string())

    return run


def _fold_any(x: str) -> str:
    x = unicodedata.normalize("NFC", x).casefold().replace("đ", "d")
    return " ".join("".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn").split())


#: Canonical composition.
nfc = each_text(lambda x: unicodedata.normalize("NFC", x))
#: Compatibility composition, case folding and single spaces.
nfkc_casefold = each_text(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()))
#: Accent folding for any script: case fold, decompose, drop marks, single spaces.
fold_any = each_text(_fold_any)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_question(c: Column) -> Column:
    """Case folded (lower case, ß as ss) and single spaces, for text that is already composed."""
    return squeeze(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


def fold_accents(c: Column) -> Column:
    """Latin accents and đ folded away; native, for composed text."""
    return squeeze(F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), _FROM, _TO))


def word_list(c: Column) -> Column:
    """Letter and digit runs in lower case, in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))


def query_tokens(c: Column) -> Column:
    """Each word once, in order of first sight; ß is ss, as case folding has it."""
    return F.array_distinct(F.regexp_extract_all(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit(WORDS), F.lit(0)))


def folded_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold_accents(c), F.lit(WORDS), F.lit(0)))


def ascii_words(c: Column) -> Column:
    """Folded ``[a-z0-9]+`` words joined by spaces."""
    return F.array_join(F.regexp_extract_all(fold_accents(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def rouge_tokens(c: Column) -> Column:
    """Lower-case ``[a-z0-9]+`` words; other letters separate, as the official score has it."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(c: Column, stopwords: list[str], least: int = 1) -> Column:
    words = F.regexp_extract_all(fold_accents(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(stopwords))


def trigram_terms(tokens: Column, min_chars: int, max_terms: int | None = None) -> Column:
    """The terms of ``min_chars`` on in source order; the longest ``max_terms`` (ties: the earlier), if that is given."""
    if max_terms is None:
        return F.filter(tokens, lambda t: F.length(t) >= min_chars)
    numbered = F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t")))
    longest = F.slice(F.array_sort(F.filter(numbered, lambda x: x["l"] <= -min_chars)), 1, max_terms)
    return F.transform(F.array_sort(F.transform(longest, lambda x: F.struct(x["i"], x["t"]))), lambda x: x["t"])


def number_compact(c: Column) -> Column:
    """A legal number without any separator."""
    return F.regexp_replace(fold_accents(c), r"[^a-z0-9]", "")


def number_kept(c: Column) -> Column:
    """A legal number with its separators, spaces among them as one, without trailing ``.`` or ``-``; null for none."""
    return F.regexp_replace(fold_accents(F.when(c != "", c)), r"[.\-]+$", "")


def article_key(c: Column) -> Column:
    """An article's or clause's number without trailing ``.`` or ``:``."""
    return F.regexp_replace(fold_accents(c), r"[.:]+$", "")


def legal_numbers(c: Column) -> Column:
    """Distinct legal numbers of a text in order, compact."""
    return F.array_distinct(F.transform(F.regexp_extract_all(fold_accents(c), F.lit(LEGAL_NUMBER), F.lit(0)), number_compact))


def source_number(text: Column) -> Column:
    """The one ``Số:`` number of the header that holds a slash; null for none or several.

    The header ends at the first article heading, or after 600 characters if there is none.
    """
    cut = F.regexp_instr(text, F.lit(r"(?im)^\s*Điều\s+[0-9]+"))
    header = F.when(cut > 0, F.element_at(F.split(text, r"(?im)^\s*Điều\s+[0-9]+", 2), 1)).otherwise(F.substring(text, 1, 600))
    found = F.array_distinct(F.transform(F.regexp_extract_all(header, F.lit(r"(?iU)Số\s*:\s*(\S+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"[.\-,;]+$", "")))
    found = F.filter(found, lambda x: x.contains("/"))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def is_upper_heading(c: Column) -> Column:
    """At least 12 letters, nine tenths of them capitals."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (letters >= 12) & (F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) >= letters * 0.9)
