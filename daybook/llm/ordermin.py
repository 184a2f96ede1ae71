"""Order MinHash fingerprints: which k-mers occur, how often, and in which order.

A text's k-mers (of words) are numbered by occurrence and ordered by hash, equal
ones by their number. Each part of the signature has a share of the hashes'
range; its two least numbered k-mers are selected, put back into text order,
and the pair is hashed. So moving a passage changes a signature, and not only
other words do. Everything is an expression on one row; no Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.session import broadcast_if_small, settle

#: Words of a k-mer, and bits of a part's number: 32 parts.
WORDS, PART_BITS = 3, 5
#: An entry of a text's list of k-mers is one number: 36 bits of hash, the part first, and the place.
PLACE = 27
WHITE = "\t\n\x0b\f\r"
#: Bytes of neighbouring texts ordered by one task, and groups of them at most (a square).
ORDERED, GROUPS = 4_000_000, 10_000


def with_signature(df: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """``df`` with column ``out``: the signature of column ``text``, part number and hash in each entry.

    Words are what white space separates. A text of fewer words than a k-mer has
    one k-mer, all of them. Parts that no k-mer falls into are missing, so a
    text without words has an empty signature. Up to 2^27 words the order of all
    k-mers is told, which is more than a text of 250 MB can have. Columns named
    ``__s…`` must be free.
    """
    place, part = (1 << PLACE) - 1, 63 - PART_BITS
    spaced = F.col(text)
    for c in WHITE:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    more = "".join(f", get(__sw, i + {k})" for k in range(1, words))
    # Sorted by hash and then by place, so that equal k-mers are in the order of their numbers.
    hashed = (f"slice(transform(__sw, (w, i) -> (shiftrightunsigned(xxhash64(w{more}), {PLACE + 1}) << {PLACE}) "
              f"| (i & {place})), 1, greatest(size(__sw) - {words - 1}, 1))")
    least = (f"filter(__so, (x, i) -> i < 2 OR shiftright(x, {part}) <> "
             f"shiftright(get(__so, i - 2), {part}))")
    # Of two selected for one part, the first makes the entry.
    other = "get(__sl, i + 1)"
    pair = (f"CASE WHEN NOT coalesce(shiftright({other}, {part}) = shiftright(x, {part}), false) "
            f"THEN xxhash64(x >> {PLACE}) WHEN x >> {PLACE} = {other} >> {PLACE} "
            f"THEN xxhash64(x >> {PLACE}, 1) WHEN (x & {place}) < ({other} & {place}) "
            f"THEN xxhash64(x >> {PLACE}, {other} >> {PLACE}) ELSE xxhash64({other} >> {PLACE}, x >> {PLACE}) END")
    entry = (f"filter(transform(__sl, (x, i) -> CASE WHEN i > 0 AND shiftright(get(__sl, i - 1), {part}) = "
             f"shiftright(x, {part}) THEN NULL ELSE (shiftright(x, {part}) << 32) | ({pair} & 4294967295) END), "
             "x -> x IS NOT NULL)")
    keep = [F.col(f"`{c}`") for c in df.columns]
    for name, column in (
        ("__sw", F.array_remove(F.split(spaced, " "), "")), ("__so", F.sort_array(F.expr(hashed))),
        ("__sl", F.expr(least)), (out, F.expr(entry)),
    ):
        df = df.select(*keep, column.alias(name))
    return df


def likeness(a: str, b: str) -> Column:
    """How much of two texts is alike by their signatures: 0 to 1, and 1 if neither has any part.

    It is the square root of the share of parts that agree, among those that any
    of the two has: two k-mers have to agree for a part to do so.
    """
    parts = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda x: F.shiftright(x, 32))))
    return F.when(parts == 0, 1.0).otherwise(F.sqrt(F.size(F.array_intersect(a, b)) / parts))


def written(signature: str) -> Column:
    """A signature as text: ten hexadecimal digits for each part, two of them its number."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def _group(bounds: list) -> Column:
    """How many of the bounds (id, th; in order) are not above the row's, looked up in two steps."""
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)
    pair = lambda b: F.struct(F.lit(b[0]).cast("bigint").alias("id"), F.lit(b[1]).cast("bigint").alias("th"))
    array = lambda bs: F.array(*map(pair, bs))
    own = F.struct("id", "th")
    coarse = F.size(F.filter(array([b[0] for b in blocks]), lambda b: b <= own))
    fine = F.get(F.array(*map(array, blocks)), coarse - 1)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda b: b <= own)))


def _bounds(rows: DataFrame, groups: int) -> list:
    """Where ranges of (id, th) begin: quantiles of id, and of th within an id that spans some of them."""
    shares = [i / groups for i in range(1, groups)]
    ids = rows.agg(F.percentile_approx("id", shares, 20 * groups).alias("q")).first()["q"]
    bounds = {(i, -(2**63)) for i in ids}
    wide = {i: ids.count(i) + 1 for i in set(ids) if ids.count(i) > 1}
    if wide:  # at most ``groups`` ids
        parts = rows.where(F.col("id").isin(list(wide))).groupBy("id").agg(
            F.percentile_approx("th", [k / 64 for k in range(1, 64)], 10_000).alias("q"))
        for row in parts.collect():
            step = max(1, 64 // wide[row["id"]])
            bounds |= {(row["id"], th) for th in row["q"][step - 1::step]}
    return sorted(bounds)


def with_next(rows: DataFrame, columns: list[str], signed=lambda rows: rows) -> DataFrame:
    """``signed(rows)`` (id, th, …) with next_… of each of ``columns``: those of the row with the next smaller id.

    After the last comes the first; rows with equal ids are ordered by falling
    th. No two rows have one (id, th). Rows are dealt by ranges of both, ordered
    within, and the first row of each range is handed to the last one of the
    range before. ``columns`` are never null; columns named ``__…`` must be free.
    """
    seen = rows.agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes")).first()
    groups = max(1, min(GROUPS, (seen["bytes"] or 0) // ORDERED))
    bounds = _bounds(rows, groups) if groups > 1 else []
    part = _group(bounds).cast("int").alias("__g")
    dealt = signed(rows).select("*", part)
    order = Window.partitionBy("__g").orderBy(F.desc("id"), F.desc("th"))
    led = dealt.select("*", *(F.lead(c).over(order).alias(f"__n{c}") for c in columns))
    # At most some GROUPS rows: where a range begins, and which one follows it.
    firsts = settle(rows.select("id", "th", part).groupBy("__g").agg(F.max(F.struct("id", "th")).alias("f"))
                    .select("__g", "f.id", "f.th"))
    down = Window.orderBy(F.desc("__g"))
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = firsts.select(F.col("__g").alias("__of"), *(
        F.coalesce(F.lead(c).over(down), F.first(c).over(every)).alias(c) for c in ("id", "th")))
    # Only these few texts are looked at once more.
    few = settle(rows.join(F.broadcast(follow), ["id", "th"]))
    handed = signed(few).select(F.col("__of").alias("__g"), *(F.col(c).alias(f"__h{c}") for c in columns))
    return led.join(handed, "__g", "left").select(
        *(c for c in dealt.columns if c != "__g"),
        *(F.coalesce(f"__n{c}", f"__h{c}").alias(f"next_{c}") for c in columns))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    ``edited`` is the text with its last third (code points, rounded down)
    replaced by as much from the start of the next document, in descending
    doc_id, or all of that if it is shorter; after the last comes the first. A
    null text is an empty one, and a null doc_id comes after all others. Rows
    with one doc_id follow each other by falling hash of their texts; rows equal
    in both follow each other. A table of one row is its own next. Equal texts
    have equal fingerprints; two texts without words are alike (1), one of them
    and another text are not (0).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("id"),
                       text.alias("text")).withColumn("th", F.xxhash64("text"))
    own = ["id", "th"]
    # Rows equal in doc_id and text are one row and their number while they are ordered.
    many = settle(rows.groupBy(*own).count().where("count > 1").select(*own))
    one = rows.withColumn("times", F.lit(1).cast("bigint"))
    if not many.isEmpty():
        many = broadcast_if_small(many)
        one = one.join(many, own, "left_anti").unionByName(rows.join(many, own, "left_semi").groupBy(*own).agg(
            F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("times")))
    paired = with_next(one, ["text", "fingerprint"], lambda df: with_signature(df, "text", "fingerprint"))
    each = paired.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    last = F.col("__i") == F.col("times")
    each = each.withColumns({f"next_{c}": F.when(last, F.col(f"next_{c}")).otherwise(F.col(c))
                             for c in ("text", "fingerprint")})
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = each.select(
        "doc_id", "fingerprint", "next_fingerprint", F.char_length("text").cast("bigint").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), F.char_length("text") - third),
                 F.substring("next_text", F.lit(1), third)).alias("edited"))
    return with_signature(edited, "edited", "edited_fingerprint").select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"))
