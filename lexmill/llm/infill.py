"""Fill-in-the-middle by relational units: exploded matches, running sums of their lengths, cuts joined by ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the format: what a unit is, and the three marks.
UNIT, LETTERS = "[A-Za-z]+|[^A-Za-z]", "[A-Za-z]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draw(digest: Column, group: int) -> Column:
    """A group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def cut_requests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", keep_plain: int = 10, spm: int = 20) -> DataFrame:
    """``id, text, n, form, first, second``: how each document is to be cut, at which two unit ordinals.

    Letter runs are one unit each and so is any other character, so the number of units is the length of the
    text with each run shrunk to one letter. ``keep_plain`` and ``spm`` are percentages.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest.alias("digest")).select(
        "id", "text", F.length(F.regexp_replace("text", LETTERS, "a")).cast("long").alias("n"), *(_draw(F.col("digest"), i).alias(f"h{i + 1}") for i in range(4)))
    marked = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when(marked | (F.col("h3") % 100 >= 100 - keep_plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    return d.select("id", "text", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def _key() -> list[Column]:
    """96 bits of what a row's cuts depend on, its id and text: rows alike in both are cut alike, so they may share a key."""
    return [F.xxhash64("id", "text").alias("u"), F.hash("text", "id").alias("v")]


def cut_offsets(asked: DataFrame) -> DataFrame:
    """``u, v, first_at, second_at``: the cuts of each key in code points.

    Units are exploded with their ordinals. Where they are read, units are added up to the largest aligned blocks of
    two to the k that hold no unit before a cut, which keep rows of their own; so a document of n units shuffles
    2 log2(n) rows, not n. A window sums lengths up to each row, the cuts' ordinals are joined to the sums, and the
    two offsets of a key are put together, all in the partitions of the key. Rows that repeat an id and text repeat
    its units too, so a sum is divided by how often its first unit came.
    """
    last = [(F.col(c) - 1).cast("int").alias(f"c{i}") for i, c in enumerate(("first", "second"))]  # the unit that ends where the cut is
    cut = asked.where("form <> 'plain'").select(*_key(), *last, "text")
    # texts end here: a key made beside the generator would be hashed from the whole text for each unit
    matches = cut.select("u", "v", "c0", "c1", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"))
    # the highest bit in which an ordinal differs from the nearer cut's; a cut at 0 has no unit before it and is far from all
    apart = F.least(*(F.when(F.col(c) < 0, 1 << 30).otherwise(F.col("pos").bitwiseXOR(F.col(c))) for c in ("c0", "c1")))
    units = matches.select("u", "v", "c0", "c1", F.posexplode("units").alias("pos", "unit")).select(
        "u", "v", "pos", F.length("unit").alias("size"), F.greatest(F.floor(F.log2(apart + 0.5)), F.lit(0)).cast("int").alias("k"))
    rows = units.select("u", "v", F.expr("shiftleft(shiftright(pos, k), k)").alias("row"), "pos", "size").groupBy("u", "v", "row").agg(
        F.sum("size").alias("sizes"), F.count_if(F.col("pos") == F.col("row")).alias("copies"))
    upto = Window.partitionBy("u", "v").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.select("u", "v", "row", F.sum(F.expr("sizes div copies")).over(upto).alias("end"))
    wanted = cut.groupBy("u", "v").agg(F.first("c0").alias("c0"), F.first("c1").alias("c1"))
    hits = ends.join(wanted, (ends["u"] == wanted["u"]) & (ends["v"] == wanted["v"]) & F.array_contains(F.array("c0", "c1"), F.col("row")), "inner")
    at = lambda c: F.coalesce(F.max(F.when(F.col("row") == F.col(c), F.col("end"))), F.lit(0)).cast("long")  # noqa: E731  # no unit stands before a cut at 0
    return hits.groupBy(ends["u"], ends["v"]).agg(at("c0").alias("first_at"), at("c1").alias("second_at"))


def fill_in_middle(docs: DataFrame, **how) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output``: each document cut and put together anew.

    ``how`` goes to ``cut_requests``. Null texts are empty, null ids are drawn for as empty ids; empty texts,
    and those that hold one of the marks, stay plain. Rows that repeat an id (and text) are each returned.
    An empty table gives no rows; other columns are not read. The units of one document are one array in
    the task that reads it, some twenty times its text; after that its rows are what is stated above.
    """
    asked = cut_requests(docs, **how)
    first, second = (F.coalesce(c, F.lit(0)) for c in ("first_at", "second_at"))
    cut = asked.where("form <> 'plain'").select("*", *_key()).join(cut_offsets(asked), ["u", "v"], "left").select(
        "id", "text", "n", "form", first.alias("prefix_chars"), (second - first).alias("middle_chars"))
    none = F.lit(None).cast("long")
    d = cut.unionByName(asked.where("form = 'plain'").select("id", "text", "n", "form", none.alias("prefix_chars"), none.alias("middle_chars")))  # these are not shuffled
    prefix, middle = (F.expr(e) for e in ("substring(text, 1, int(prefix_chars))", "substring(text, int(prefix_chars) + 1, int(middle_chars))"))
    suffix = F.expr("substring(text, int(prefix_chars + middle_chars) + 1)")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    output = F.when(F.col("form") == "psm", put(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)).when(
        F.col("form") == "spm", put(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)).otherwise(F.col("text"))
    return d.select("id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The document's text, from the output and its form alone: no mark occurs in what lies between them."""
    outer, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def halves(opens: str, divides: str) -> tuple[Column, Column]:
        head = F.substring(F.substring_index(outer, divides, 1), len(opens) + 1, (1 << 31) - 1)
        return head, F.substring_index(outer, divides, -1)

    (prefix, suffix), (suffix_first, prefix_last) = halves(PREFIX, SUFFIX), halves(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_last, middle, suffix_first)).otherwise(output)
