"""The registered corpus queries against their SQL."""

import duckdb
import pytest

from lagloom.llm.queries import QUERIES
from lagloom.llm.sql import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = c.sql(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_every_query_gives_its_columns(spark, sf):
    columns = {
        "op4_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op8_merge_dropout": ["doc_id", "n_ids", "ids", "ids_crc32", "lossless"],
        "op10_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    }
    assert set(columns) | set(ORACLE) == set(QUERIES)
    for name, want in columns.items():
        assert QUERIES[name](spark, sf).columns == want
