"""The registered queries of the operators at the smallest scale, against their SQL where they have it."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from loomtext.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"],
    2: ["doc_id", "start", "n_tokens", "ids_crc32"],
    4: ["doc_id", "size", "source_size", "target", "taken"],
    5: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    7: ["doc_id", "n_shingles", "component_id"],
    8: ["query_id", "rank", "vec_id", "score"],
    9: ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    10: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


def test_one_query_for_each_operator():
    names = [k for k in entry.queries() if re.match(r"op\d", k)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    want = COLUMNS.get(int(name[2:].split("_")[0]), [])
    assert df.columns[: len(want)] == want
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        r = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in r.description]
        order = [names.index(c) for c in df.columns]
        assert sorted(rows, key=repr) == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)
