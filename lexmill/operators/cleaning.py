"""The conservative passage cleaner: native rules, then composition and entities in one Arrow step."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import text as T

# The tags that open the HTML rules, those that break a line and those that vanish, the site's
# notice, and the characters that are dropped.
TAG_HINT = r"(?i)<\s*/?\s*(?:br|p|div|span|table|thead|tbody|tr|td|th|strong|em|b|i|img|script|style)\b"
BLOCK_TAG = r"(?i)<\s*/?\s*(?:br|p|div|li|table|thead|tbody|tr|h[1-6])\b[^>]*>"
INLINE_TAG = r"(?i)<\s*/?\s*(?:span|td|th|strong|em|b|i|u|font|a)\b[^>]*>"
NOTICE = (
    r"(?iu)Bạn\s+phải\s+đăng\s+nhập\s+hoặc\s+đăng\s+ký\s+Thành\s+Viên\s+TVPL\s+Pro\s+để\s+sử\s+dụng\s+được\s+đầy\s+đủ\s+các\s+tiện\s+ích\s+gia\s+tăng\s+"
    r"liên\s+quan\s+đến\s+nội\s+dung\s+TCVN\.\s*Mọi\s+chi\s+tiết\s+xin\s+liên\s+hệ:\s*ĐT:\s*\(028\)\s*3930\s*3279\s*DĐ:\s*0906\s*22\s*99\s*66")
ZERO_WIDTH = "\ufeff\u200b\u200c\u200d\u2060"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SCRIPT_STYLE = r"(?is)<\s*(script|style)\b[^>]*>.*?<\s*/\s*\1\s*>"
#: An image with the first of its alt texts, quoted or bare, as group 1, 2 or 3.
IMG = r"(?i)<\s*img\b(?:[^>]*?\balt\s*=\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\s>]+)))?[^>]*>"
_EDGES = r"(?md)^[\p{IsWhite_Space}&&[^\n]]+|[\p{IsWhite_Space}&&[^\n]]+$"


_unescape = T.each_text(html.unescape)


def prepare(raw: Column) -> Column:
    """Line ends, zero-width characters, no-break spaces and controls, before any tag is looked at."""
    c = F.regexp_replace(raw, "\r\n?", "\n")
    return F.regexp_replace(F.translate(F.translate(c, ZERO_WIDTH, ""), "\u00a0", " "), CONTROLS, " ")


def tags_to_text(c: Column) -> Column:
    """Scripts and styles go, images give their alt text, block tags a line end, inline tags nothing."""
    x = F.regexp_replace(F.regexp_replace(c, SCRIPT_STYLE, ""), IMG, "$1$2$3")
    return F.regexp_replace(F.regexp_replace(x, BLOCK_TAG, "\n"), INLINE_TAG, "")


def squeeze_lines(c: Column) -> Column:
    """Spaces within lines as one, lines trimmed of all white space, at most one blank line in a row, ends trimmed."""
    x = F.regexp_replace(F.regexp_replace(c, r"[ \t\x0B\f]+", " "), _EDGES, "")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")


def clean_native(raw: Column) -> Column:
    """All rules but composition and entities, for text that needs neither."""
    c = prepare(raw)
    return squeeze_lines(F.regexp_replace(F.when(c.rlike(TAG_HINT), tags_to_text(c)).otherwise(c), NOTICE, "\n"))


def clean(raw: Column) -> Column:
    """The whole cleaner: composed first, entities last (so what they stand for is left as it is)."""
    return _unescape(clean_native(T.nfc(raw)))


def counters(raw: Column, *, compose: bool = True) -> list[Column]:
    """How often rules fire on the composed text, each on what the ones before left: HTML rules, notices; and
    whether the text was not composed or has CR line ends."""
    whole = T.nfc(raw) if compose else raw
    c = prepare(whole)
    n = lambda x, p: F.regexp_count(x, F.lit(p))
    bare = F.regexp_replace(c, SCRIPT_STYLE, "")
    shown = F.regexp_replace(bare, IMG, "$1$2$3")
    fired = n(c, SCRIPT_STYLE) + n(bare, IMG) + n(shown, BLOCK_TAG) + n(F.regexp_replace(shown, BLOCK_TAG, "\n"), INLINE_TAG)
    left = F.when(c.rlike(TAG_HINT), tags_to_text(c)).otherwise(c)
    return [
        F.when(c.rlike(TAG_HINT), fired).otherwise(0).alias("html_count"), n(left, NOTICE).alias("notice_count"),
        (whole != raw).alias("non_nfc_input"), raw.contains("\r").alias("crlf_input")]
