"""The registered queries on the smallest tables: with SQL where there is SQL, else against plain versions."""

import hashlib
import os
import sys
import zlib

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check_oracle  # noqa: E402
from marketladder.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    got = check_oracle.bag(df.columns, [tuple(r) for r in df.collect()])
    result = check_oracle.connect(SF_DIR).execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == check_oracle.bag(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_every_document_is_answered(spark, name):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(texts)
    if name == "op1_bpe":
        assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest() for r in rows)
    elif name == "op3_media":
        assert all(r.n_bytes == len(texts[r.doc_id]) and r.payload_bytes % 192 == 0 for r in rows)
    elif name == "op7_shards":
        assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    elif name == "op8_packing":
        whole = {r.doc_id: r.doc_tokens for r in rows}
        assert sum(r.length for r in rows) == sum(whole.values())
    else:
        assert len(rows) == len(texts)
