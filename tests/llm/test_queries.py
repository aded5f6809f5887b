"""Every registered query on its whole table: columns and types of its contract, and its SQL where there is one."""

import zlib

import duckdb
import pytest

from strataspark.llm.queries import llm_oracle_sql, llm_queries

CONTRACT = {
    "op1_ngram_jaccard_join": ("documents", "doc_id bigint, class_id bigint, n_links bigint, kept boolean"),
    "op2_quality_classifier": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op3_language_id": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double"),
    "op4_best_fit_packing": (None, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"),
    "op5_sharding": ("documents", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
    "op6_sentencepiece": ("documents", "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_crc32 bigint, lossless boolean"),
    "op7_secret_scan": (None, "doc_id bigint, word int, value_sha256 string, length int, score double, is_secret boolean"),
    "op8_embedding_near_dedup": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op9_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op10_media_columns": (
        "documents",
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    ),
}
FOLDS = {"op2_quality_classifier": (4, 2), "op3_language_id": (4, 2), "op9_toxicity": (5, 0)}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, sf_dir, name):
    table, columns = CONTRACT[name]
    out = llm_queries()[name](spark, sf_dir)
    types = dict(out.dtypes)
    want = dict(c.split() for c in columns.split(", "))
    assert {c: types.get(c) for c in want} == want
    rows = out.collect()
    if table:
        ids = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select("vec_id" if table == "embeddings" else "doc_id").collect())
        assert sorted(r[0] for r in rows) == ids
    if name in FOLDS:
        parts, held = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held) and 0 <= r["score"] <= 1 for r in rows)
    if name in llm_oracle_sql():
        c = duckdb.connect()
        c.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
        got, want = out.toPandas().convert_dtypes(), c.execute(llm_oracle_sql()[name]).fetch_df().convert_dtypes()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(tuple, got[cols].astype(str).to_numpy().tolist())) == sorted(map(tuple, want[cols].astype(str).to_numpy().tolist()))


def test_every_query_has_a_contract():
    assert llm_queries().keys() == CONTRACT.keys()
