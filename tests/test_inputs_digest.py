"""Digests over the parts of a group: the same as over the joined text, without a row of it."""

import hashlib

import pyarrow as pa

from workload import QUERIES
from workload.inputs import digest_parts

SF = "/root/testdata/sf0.001"


def test_parts_digest_like_their_joined_text():
    rows = [("a", 0, "one"), ("a", 1, ""), ("a", 2, "zwei ü"), ("b", 0, None), ("c", 0, "x"), ("c", 1, None), ("c", 2, "y"), (None, 0, "n")]
    want = {"a": "one\n\nzwei ü", "c": "x\ny", None: "n"}
    for size in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("group_id", "part", "text"), r)) for r in rows[k : k + size]],
                                              pa.schema([("group_id", "string"), ("part", "int32"), ("text", "string")])) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for out in digest_parts(iter(batches)) for r in out.to_pylist()]
        assert got == [(g, hashlib.sha256(want[g].encode()).hexdigest() if g in want else None) for g in ("a", "b", "c", None)]
    assert list(digest_parts(iter([]))) == []


def test_no_row_holds_a_whole_group(spark):
    plan = QUERIES["group_context_whole"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "array_join" not in plan
