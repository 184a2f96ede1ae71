"""The registered queries on the given tables, and the pipeline stage by stage."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from daybook.llm import language, repeats, simhash
from daybook.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert len(QUERIES) == len({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES})


@pytest.mark.parametrize("name", sorted(n for n in QUERIES.keys() - ORACLES.keys() if int(re.match(r"op(\d+)_", n)[1]) <= 10))
def test_query_gives_a_row_for_each_of_its_rows(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    many = duckdb.sql(f"SELECT count(*) FROM '{SF_DIR}/documents.parquet'").fetchall()[0][0]
    assert got.count() >= many if not name.startswith("op9_") else got.groupBy("query_id").count().where(
        "count <> 5").count() == 0


SCHEMAS = {
    2: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    3: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    4: "doc_id bigint, fingerprint string, component_id bigint",
    5: "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    6: "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    7: "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double",
    8: "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    9: "query_id bigint, rank int, vec_id bigint, score double",
    10: "doc_id bigint, held_out boolean, lang_pred string, score double",
    11: "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    12: "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
        "score double",
    13: "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string",
}


@pytest.mark.parametrize("number", sorted(SCHEMAS))
def test_query_has_the_columns_of_its_contract(spark, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    kinds = dict(QUERIES[name](spark, SF_DIR).dtypes)
    wanted = dict(c.split(" ") for c in SCHEMAS[number].split(", "))
    assert {c: kinds.get(c) for c in wanted} == wanted


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF_DIR}/documents.parquet'").fetchall())


def rows_of(spark, number):
    return QUERIES[next(n for n in QUERIES if n.startswith(f"op{number}_"))](spark, SF_DIR).collect()


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def library():
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    own.no_truncation()
    own.no_padding()
    return own


def test_op2_shards_hold_all_rows(spark, texts):
    got = rows_of(spark, 2)
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {
        d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(40))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op3_is_the_library(spark, texts):
    own = library()
    want = {}
    for d, t in texts.items():
        ids = own.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows_of(spark, 3)} == want


def test_op4_against_all_pairs(spark, texts):
    def fingerprint(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall("[^\x20\x09-\x0d]+", words)
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d: fingerprint(t) for d, t in texts.items()}
    least = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if least[b] < least[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    least[a], changed = least[b], True
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows_of(spark, 4)} == {
        d: (f"{p:016x}", least[d]) for d, p in prints.items()}


def test_op5_against_all_strings(spark, texts):
    data = {d: t.encode() for d, t in texts.items()}
    seen = Counter(hash(t[i:i + 200]) for t in data.values() for i in range(len(t) - 199))
    want = {}
    for d, t in data.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[hash(t[i:i + 200])] > 1:
                gone[i:i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[d] = (len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    assert any(w[2] for w in want.values())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(spark, 5)} == want


def test_op7_edits_are_those_by_hand(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in rows_of(spark, 7)}
    prints = {}
    for d, after in zip(order, [*order[1:], order[0]], strict=True):
        t, k = texts[d], len(texts[d]) // 3
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == sha(t[:len(t) - k] + texts[after][:k])
        assert got[d].fingerprint == prints.setdefault(t, got[d].fingerprint)
        a, b = ({f[i:i + 10] for i in range(0, len(f), 10)} for f in (got[d].fingerprint, got[after].fingerprint))
        parts = {x[:2] for x in a | b}
        assert got[d].near_next == pytest.approx((len(a & b) / len(parts)) ** 0.5 if parts else 1.0)


def test_op8_packs_all_tokens(spark, texts):
    own = library()
    want = {}
    for d, t in texts.items():
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at:at + 4096]
            want[d, k] = (at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
    got = rows_of(spark, 8)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    assert len(by) <= -(-sum(w[1] for w in want.values()) // 4096) + 1


def test_op9_finds_the_nearest(spark):
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_DIR}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids = np.array([r[0] for r in table])
    v = np.array([r[1] for r in table], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found, hit = {}, []
    for r in rows_of(spark, 9):
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(found) == [i for i in ids.tolist() if i % 50 == 0]
    for q, near in found.items():
        s = v @ v[np.flatnonzero(ids == q)[0]]
        assert sorted(near) == [1, 2, 3, 4, 5]
        for vec, score in near.values():
            assert score == pytest.approx(s[np.flatnonzero(ids == vec)[0]], abs=1e-12)
        s[ids == q] = -3
        hit.append(len(set(ids[np.argsort(-s)[:5]].tolist()) & {n[0] for n in near.values()}) / 5)
    assert np.mean(hit) >= 0.9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op10_language_id"](spark, SF_DIR).join(docs, "doc_id").where("held_out AND lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_pipeline_against_its_stages_by_hand(spark):
    """Each stage's decisions follow from what the one before kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    awkward = spark.createDataFrame(
        [(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5), (None, "some words of no id", "en", "s", 19)],
        docs.schema)
    docs = docs.union(awkward)
    (_, by_language), (_, by_line), (_, by_print), (_, by_passage), (_, pack) = corpus_pipeline.STAGES
    kept = by_language(spark, docs, SF_DIR).cache()
    assert kept.columns == docs.columns
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    assert kept.count() == lettered.count()
    lined = by_line(spark, kept, SF_DIR).cache()
    assert lined.columns == docs.columns
    lines = [x for r in lined.collect() for x in r.text.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    single = by_print(spark, lined, SF_DIR).cache()
    groups = simhash.near_duplicates(lined).where("doc_id IS NOT NULL")
    assert single.where("doc_id IS NOT NULL").count() == groups.select("component_id").distinct().count()
    cut = by_passage(spark, single, SF_DIR).cache()
    again = repeats.cut_repeats(single).where(F.size("begins") > 0)
    touched = {r.doc_id: bytes(r.kept).decode(errors="ignore") for r in again.collect()}
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in (single, cut))
    for k, text in before.items():
        want = touched.get(k, text)
        assert after.get(k, "") == want if want.strip() else k not in after or after[k] == want
    packed = pack(spark, cut, SF_DIR)
    assert packed.where("piece = 0").count() == cut.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_of_no_documents(spark, tmp_path):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert language.UNKNOWN == "und"


def test_oracle_helper_covers_the_sql(spark):
    connection = oracle.connect(SF_DIR)
    for name, sql in ORACLES.items():
        assert oracle.differences(QUERIES[name](spark, SF_DIR), connection, sql) == [], name
