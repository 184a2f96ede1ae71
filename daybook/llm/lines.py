"""Line dedup across documents: a line goes if an earlier one is equal or an edit away.

The near ones are found by a deletion-neighbourhood join: two lines of a length
are one substitution apart if they agree after deleting the same character from
both, and a line is one deletion away from another if it equals one of its
variants. Emitting all variants of all lines would multiply the corpus by the
length of its lines, so lines first have to agree before and after a half, and
then a block of ``BLOCK`` characters, that the edit may lie in; lines a single
edit apart always do. Only DataFrame functions run on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.session import settle

#: Characters of the stretch whose deletions are emitted.
BLOCK = 64
#: Bits of the filter that keeps lines without a partner from being moved: some for each key
#: with a partner, within limits; 64 are a row of 16 bytes, so the largest has 16 MB.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 128, 1 << 23, 1 << 26
BLANK = " \t\r"


def _halves(line: Column, n: Column) -> Column:
    """Keys that lines one edit apart share at least one of: the first or last half, by longer length."""
    keys = []
    for extra in (0, 1):
        longer = n + extra
        half = F.floor(longer / 2).cast("int")
        rest = (longer - half).cast("int")
        keys += [F.xxhash64(F.lit(0), longer, F.substring(line, F.lit(1), half)),
                 F.xxhash64(F.lit(1), longer, F.substring(line, (n - rest + 1).cast("int"), rest))]
    return F.array(*keys)


def _filter_bits(keys: int) -> int:
    return min(max(1 << (BITS_A_KEY * keys).bit_length(), LEAST_BITS), MOST_BITS)


def _bitmap(keys: DataFrame, size: int) -> DataFrame:
    """Rows word, bits of a filter of ``size`` bits over column key: at most a 64th as many."""
    return keys.select(*_place(F.col("key"), size)).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _place(key: Column, size: int) -> tuple[Column, Column]:
    slot = F.pmod(key, F.lit(size))
    # By name, as the number of places to shift is a column.
    return F.floor(slot / 64).alias("word"), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int")).alias("bit")


def _lines(base: DataFrame) -> DataFrame:
    split = base.select("id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return split.where(F.length(F.btrim("line", F.lit(BLANK))) > 0).select(
        "id", "th", "no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _variants(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For lines (me, line) the deletions from each block that another line agrees about.

    Returns ``cut`` (v, i, me), a row for each character i that may be deleted,
    and ``whole`` (v, me), the same blocks of lines a character shorter.
    """
    n = F.length("line")
    short = lines.select("me", "line", n.alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("e"))
    longer = F.col("n") + F.col("e")
    placed = short.withColumn("longer", longer).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.floor((F.col("longer") - 1) / BLOCK).cast("int"))))
    start = F.col("j") * BLOCK
    behind = F.greatest(F.col("longer") - start - BLOCK, F.lit(0))
    blocks = placed.select(
        "me", "e",
        F.xxhash64("longer", "j", F.substring("line", F.lit(1), start),
                   F.substring("line", F.col("n") - behind + 1, behind)).alias("key"),
        F.substring("line", start + 1, F.col("n") - start - behind).alias("rest"))
    blocks = settle(blocks)
    met = blocks.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    blocks = blocks.join(met, "key")
    whole = blocks.where("e = 1").select(F.xxhash64("key", "rest").alias("v"), "me")
    cut = blocks.where("e = 0 AND length(rest) > 0").select("key", "rest", "me", F.explode(
        F.sequence(F.lit(1), F.length("rest"))).alias("i")).select(
        F.xxhash64("key", F.concat(F.substring("rest", F.lit(1), F.col("i") - 1),
                                   F.substring("rest", F.col("i") + 1, F.length("rest")))).alias("v"),
        "i", "me")
    return cut, whole


def _near(lines: DataFrame) -> DataFrame:
    """me, near: lines (me, line; all different) with the earliest one found an edit away and before it.

    Who agrees on a variant is not paired off: each is held against the earliest.
    """
    cut, whole = (settle(v) for v in _variants(lines))
    same = cut.groupBy("v", "i").agg(F.min("me").alias("near"), F.count("*").alias("c")).where("c > 1")
    found = (
        cut.join(same, ["v", "i"]).select("me", "near")
        .union(cut.join(whole.groupBy("v").agg(F.min("me").alias("near")), "v").select("me", "near"))
        .union(whole.join(cut.groupBy("v").agg(F.min("me").alias("near")), "v").select("me", "near"))
        .where("near < me").distinct())
    checked = (found.join(lines, "me")
               .join(lines.select(F.col("me").alias("near"), F.col("line").alias("other")), "near")
               .where(F.levenshtein("line", "other", 1).between(0, 1)))
    return checked.groupBy("me").agg(F.min("near").alias("near"))


def line_drops(base: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """id, th, drops: the numbers (from 0) of the lines that go, of texts (id, th, text)."""
    lines = _lines(base)
    me = F.struct("id", "th", "no")
    n = F.length("line")
    keys = F.when(n >= min_chars, _halves(F.col("line"), n))
    if not max_edits:
        keys = F.lit(None).cast("array<bigint>")
    known = settle(lines.select("h1", "h2", me.alias("me"), keys.alias("keys")).groupBy("h1", "h2").agg(
        F.min("me").alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    gone = known.where("n > 1").select("h1", "h2", "first", F.lit(False).alias("near"))
    if max_edits:
        shared = settle(
            known.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key"))
        size = _filter_bits(shared.count())
        tested = lines.where(n >= min_chars).select(
            "h1", "h2", me.alias("me"), "line", F.explode(_halves(F.col("line"), n)).alias("key"))
        word, bit = _place(F.col("key"), size)
        met = (tested.select("h1", "h2", "me", "line", word, bit)
               .join(F.broadcast(_bitmap(shared, size)), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0))
        lone = settle(met.groupBy("h1", "h2").agg(F.min("me").alias("me"), F.first("line").alias("line")))
        near = _near(lone.select("me", "line"))
        gone = gone.union(lone.join(near, "me").select(
            "h1", "h2", F.col("me").alias("first"), F.lit(True).alias("near")))
    gone = settle(gone.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("near").alias("near")))
    out = lines.select("id", "th", "no", "h1", "h2").join(gone, ["h1", "h2"]).where(
        F.col("near") | (me != F.col("first")))
    return out.groupBy("id", "th").agg(F.collect_set("no").alias("drops"))


def dedup_lines(
    docs: DataFrame, max_edits: int = 1, min_chars: int = 20,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with the lines that an earlier one repeats taken out of text, and two counts.

    Lines are what line feeds separate; blank ones (white space only) always
    stay. A line goes if an equal one comes earlier, by doc_id and then by its
    number, or, with ``max_edits=1`` and at least ``min_chars`` characters, one
    that a single insertion, deletion or substitution of a character turns into
    it. What comes earlier counts whether or not it goes itself. A null text
    stays null and has no lines, an empty one has one blank line. Rows without
    doc_id come before all others. Rows of one doc_id with different texts are
    ordered by a hash of the text; rows equal in both are the same document and
    are treated alike. Other columns are passed on, whatever their names, but for
    those that are called as the two counts: the counts take their place.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in {n.lower() for n in counts}))
    id_, th, gone, split = (_free(n, docs) for n in ("__id", "__th", "__drops", "__split"))
    base = docs.withColumns({
        id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))),
        th: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    drops = line_drops(
        base.where("text IS NOT NULL").select(F.col(id_).alias("id"), F.col(th).alias("th"), "text"),
        max_edits, min_chars)
    drops = drops.select(F.col("id").alias(id_), F.col("th").alias(th), F.col("drops").alias(gone))
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(F.col(split)) - 1), F.col(gone))
    joined = base.join(drops, [id_, th], "left").withColumn(split, F.when(F.col(gone).isNotNull(), lines))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(split, i + 1)), "\n"))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias(counts[0]),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("bigint").alias(counts[1]))


def _free(name: str, df: DataFrame) -> str:
    """The name, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
