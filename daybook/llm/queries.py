"""One query per operator, over whole tables, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import (
    bpe, language, lines, neighbours, ordermin, packing, repeats, sharding, simhash, spelling, suffixtree, tries, warc)
from daybook.session import scratch


def _vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(_documents(spark, sf_dir), max_edits=1, min_chars=20)
    return left.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_tree(_documents(spark, sf_dir), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_documents(spark, sf_dir), _vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), radius=3, shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(_documents(spark, sf_dir), length=200)
    return cut.select("doc_id", "n_bytes", repeats.removed_bytes().alias("n_removed"),
                      F.size("begins").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, least_bytes=1000)
    return warc.page_records(warc.read_archives(spark, path, payload=False))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordermin.fingerprint_edits(_documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        ordermin.written("fingerprint").alias("fingerprint"),
                        ordermin.written("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _vocabulary(), packing.Capacity(tokens=4096), end_id=1)


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.learn(docs.where(~held_out))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(_documents(spark, sf_dir), least_chars=7, least_count=2, times=10)


def op12_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return suffixtree.suffix_tree_scores(_documents(spark, sf_dir), held_out)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_line_dedup, op2_kd_shards, op3_bpe_codec, op4_simhash, op5_suffix_dedup, op6_warc, op7_order_minhash, op8_best_fit_packing, op9_nn_descent, op10_language_id,
        op11_spelling_variants, op12_suffix_tree_scores, op13_conversation_trie)
}

# The unsigned crc32 of bytes given in hexadecimal: a byte at a time, eight shifts each.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                list_transform(range(0, length({text}) // 2), lambda i: CAST(('0x' || substr({text}, 2 * i + 1, 2)) AS BIGINT))),
                lambda crc, x: list_reduce(list_prepend(xor(crc, x), list_transform(range(8), lambda y: CAST(0 AS BIGINT))),
                    lambda v, y: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""

ORACLES = {
    "op1_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
            FROM documents),
        d AS (
            SELECT line, min({'d': doc_id, 'n': no}) AS f, length(line) AS n
            FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY line),
        k AS (
            SELECT *, n + e AS m, w,
                   CASE WHEN w = 0 THEN substr(line, 1, (n + e) // 2)
                        ELSE substr(line, n - (n + e - (n + e) // 2) + 1) END AS piece
            FROM d, (VALUES (0), (1)) AS x(e), (VALUES (0), (1)) AS y(w) WHERE n >= 20),
        p AS (
            SELECT DISTINCT a.line AS line, b.line AS other, a.n AS n, b.n AS o
            FROM k a JOIN k b ON a.m = b.m AND a.w = b.w AND a.piece = b.piece
            WHERE b.f < a.f AND abs(a.n - b.n) <= 1),
        near AS (
            SELECT DISTINCT line FROM p
            WHERE len(list_filter(range(1, greatest(n, o) + 1), lambda i:
                substr(line, 1, i - 1) || substr(line, CASE WHEN n >= o THEN i + 1 ELSE i END)
                = substr(other, 1, i - 1) || substr(other, CASE WHEN o >= n THEN i + 1 ELSE i END))) > 0),
        j AS (
            SELECT l.*, d.line IS NOT NULL AND (near.line IS NOT NULL OR d.f <> {'d': l.doc_id, 'n': l.no})
                   AS gone
            FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line)
        SELECT x.doc_id, CASE WHEN x.text IS NULL THEN 0 ELSE count(*) END AS n_lines,
               count(*) FILTER (gone) AS n_dropped,
               md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS text_md5
        FROM j JOIN documents x ON j.doc_id = x.doc_id GROUP BY x.doc_id, x.text""",
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
                   sha1(coalesce(html, '')) AS digest
            FROM pages),
        k AS (SELECT digest, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY digest)
        SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN k.keep IS NULL OR p.page_id = k.keep THEN 'response' ELSE 'revisit' END
                   AS record_type,
               CASE WHEN p.page_id <> k.keep THEN k.keep END AS refers_to
        FROM p LEFT JOIN k ON p.digest = k.digest""",
    "op11_spelling_variants": f"""
        WITH r AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')),
                                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
                FROM documents) AS x
            GROUP BY doc_id, run),
        h AS (
            SELECT run, n, {_CRC32.format(text="hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run))")} AS h
            FROM r),
        w AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT n, CASE WHEN h % 31 = 0
                               THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                               ELSE run END AS word FROM h) AS y
            GROUP BY word HAVING sum(n) >= 2 AND length(word) >= 7),
        d AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w) AS z),
        p AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM d AS a JOIN d AS b
            ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
            UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
        b AS (SELECT word, count(*) AS n_near, min({{'m': -near_n, 'w': near}}) AS best FROM p GROUP BY word),
        f AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN -best.m >= 10 * w.n THEN best.w END AS form,
                   CASE WHEN -best.m >= 10 * w.n THEN -best.m END AS form_n
            FROM w LEFT JOIN b ON w.word = b.word),
        -- A form is ten times as frequent, so chains are short.
        g AS (SELECT word, coalesce(form, word) AS root FROM f),
        g2 AS (SELECT a.word, b.root FROM g AS a JOIN g AS b ON a.root = b.word),
        g4 AS (SELECT a.word, b.root FROM g2 AS a JOIN g2 AS b ON a.root = b.word),
        g8 AS (SELECT a.word, b.root FROM g4 AS a JOIN g4 AS b ON a.root = b.word),
        g16 AS (SELECT a.word, b.root FROM g8 AS a JOIN g8 AS b ON a.root = b.word)
        SELECT f.word, f.form, g16.root, f.n, f.n_near, f.form_n FROM f JOIN g16 ON f.word = g16.word""",
    "op13_conversation_trie": f"""
        WITH o AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        h AS (
            SELECT c, c - c % 5 AS base, {_CRC32.format(text="hex(encode(CAST(c AS VARCHAR)))")} % 9 AS h, count(*) AS n
            FROM o GROUP BY c),
        k AS (
            SELECT h.c, h.base, CASE WHEN h.c = h.base THEN 0 ELSE h.h END AS h,
                   CASE WHEN h.c = h.base THEN 0 ELSE least(h.h, coalesce(b.n, 0)) END AS take, h.n
            FROM h LEFT JOIN h AS b ON h.base = b.c),
        r AS (
            SELECT o.c, o.i - k.h + k.take AS i, role, text FROM o JOIN k ON o.c = k.c WHERE o.i >= k.h
            UNION ALL
            SELECT k.c, o.i, role, text FROM k JOIN o ON o.c = k.base WHERE o.i < k.take),
        s AS (
            SELECT k.c, k.take + greatest(k.n - k.h, 0) AS n,
                   coalesce(list({{'r': role, 't': text}} ORDER BY i) FILTER (i IS NOT NULL), []) AS turns
            FROM k LEFT JOIN r ON k.c = r.c GROUP BY ALL),
        p AS (SELECT c, n, unnest(range(0, n + 1)) AS d, turns FROM s),
        m AS (SELECT c, n, d, min(c) OVER (PARTITION BY d, turns[1:d]) AS top, turns[d].t AS t FROM p),
        v AS (
            SELECT top, d, count(*) AS n_convs, coalesce(strlen(any_value(t)), 0) AS size,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends
            FROM m GROUP BY top, d),
        w AS (
            SELECT v.*, a.top AS parent, (SELECT count(DISTINCT x.top) FROM m AS x JOIN m AS y
                   ON x.c = y.c AND x.d = y.d + 1 WHERE y.top = v.top AND y.d = v.d) AS n_children
            FROM v LEFT JOIN m AS a ON a.c = v.top AND a.d = v.d - 1),
        z AS (
            SELECT a.top, a.d, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
                   sum((w.n_convs - 1) * w.size) AS saved
            FROM w JOIN m AS a ON a.c = w.top AND a.d <= w.d GROUP BY a.top, a.d)
        SELECT w.top AS conv_id, w.d AS depth, w.parent AS parent_conv_id, w.n_convs, w.n_children,
               CAST(z.n_leaves AS BIGINT) AS n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens,
               w.ends AS ends_sha256
        FROM w JOIN z ON w.top = z.top AND w.d = z.d""",
}
