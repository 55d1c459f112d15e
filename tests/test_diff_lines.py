"""What ends a line in diffs and patches, against the SQL of the queries."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomtext.functions import transform
from loomtext.plans import queries

#: Turns that follow one another share no line; one pair is equal.
TURNS = ["one\x0cpage\nnext", "a b c\x85d", "x\x1cy\x1dz\x1e\x0bw\n\nend", "p\rq", "p\rq", "first\nsecond\r\nthird", "é "]


@pytest.mark.parametrize("name", ["diff_patch", "diff_line_offsets"])
def test_separators_within_lines(spark, tmp_path, name):
    t = pa.table({"conv_id": [1] * len(TURNS), "turn": list(range(len(TURNS))), "role": ["user"] * len(TURNS), "text": TURNS})
    pq.write_table(t, tmp_path / "conversations.parquet")
    want = duckdb.connect().sql(f"WITH conversations AS (SELECT * FROM '{tmp_path}/conversations.parquet') {queries.ORACLE_SQL[name]}").fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def test_lines_of_each_kind():
    for kind, a, b, want in (
        ("lines", "a b\nc", "a x\nc", ["a b\n", "a x\n", "c"]), ("lines", "a\rb\r\nc", "a\rx\r\nc", ["a\r", "b\r\n", "x\r\n", "c"]),
        ("trimmed", "a\x0cb \nc", "a\x0cb\nc", ["a\x0cb\nc"]),
    ):
        assert [h["value"] for h in transform.hunks(kind, a, b)] == want


def test_shared_lines_stay():
    """A diff keeps what two texts share; the SQL of the two queries supposes that turns share no line."""
    a, b = "same\nold\nolder", "same\nnew"
    assert transform.patch_text("f", a, b) == "--- f\n+++ f\n@@ -1,3 +1,2 @@\n same\n-old\n-older\n\\ No newline at end of file\n+new\n\\ No newline at end of file\n"
    assert [(o["kind"], o["old_start"], o["old_end"], o["new_start"], o["new_end"]) for o in transform.offsets("lines", a, b)] == [(0, 0, 5, 0, 5), (2, 5, 14, 5, 5), (1, 14, 14, 5, 8)]
