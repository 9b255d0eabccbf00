"""The tree against a plain sequential one, over one and several blocks, and odd rows."""

import hashlib
import zlib

import pytest

from farsight.llm import merkle
from farsight.llm.registry import ORACLES, QUERIES
from workload.compare import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(merkle.UPPER, merkle.LOW)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain(rows, fan):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][k:k + fan])) for k in range(0, len(out[-1]), fan)])
        return out

    def sides(tree, at):
        for nodes in tree[:-1]:
            run, slot = divmod(at, fan)
            run = nodes[run * fan:(run + 1) * fan]
            yield "".join(run[:slot]), "".join(run[slot + 1:])
            at //= fan

    leaf = lambda r: h("".join(map(field, r)))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in langs}
    trees = {k: levels([leaf(r) for r in members[k]]) for k in langs}
    top = levels([trees[k][-1][0] for k in langs])
    for place, k in enumerate(langs):
        for at, row in enumerate(members[k]):
            way = [*sides(trees[k], at), *sides(top, place)]
            new = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                new = (*row[:4], row[4].translate(LOWER))
            digest = leaf(new)
            for left, right in way:
                digest = h(left + digest + right)
            yield row[0], leaf(row), trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in way)), digest, digest == top[-1][0]


def by_spark(spark, rows, **shape):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return sorted(map(repr, (tuple(r) for r in merkle.verify_documents(docs, **shape).collect())))


@pytest.mark.parametrize("n, fan, height", [(1, 8, 4), (9, 8, 4), (230, 8, 4), (230, 3, 1), (230, 2, 2)])
def test_equals_a_sequential_tree(llm, n, fan, height):
    langs = ["en", "de", None, "fr", "Zz", "é", "", "es", "pt", "x"]
    rows = [((k * 37) % 1000, f"s{k % 3}", "en" if k % 2 else langs[k % 10], k, f"Text {k} ÀB🙂") for k in range(n)]
    assert by_spark(llm, rows, fan=fan, height=height) == sorted(map(repr, plain(rows, fan)))


def test_nulls_repeats_and_ties(llm):
    rows = [(None, None, None, None, None), (None, "a", "en", 1, "A"), (5, "a", "en", 1, ""), (5, "a", "en", 1, ""), (5, "b", "en", 1, "B"), (6, None, "en", None, "C" * 50_000), (6, "-", "en", None, None)]
    assert by_spark(llm, rows, fan=2, height=1) == sorted(map(repr, plain(rows, 2)))


def test_empty_table_and_extra_columns(llm):
    empty = llm.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.verify_documents(empty).count() == 0
    docs = llm.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as node", "2 as grp", "3 as position", "4 as block", "5 as way")
    assert merkle.verify_documents(docs).count() == docs.count()


def test_a_fold_hashes_nothing_to_the_left():
    parent = merkle.Parent([h(str(k)) for k in range(8)])
    parent.children[:7] = ["lost"] * 7
    assert parent.fold(7, h("new")) == h("".join(h(str(k)) for k in range(7)) + h("new"))


def test_query_equals_its_sql_and_finds_tampering(llm):
    rows = rows_of_spark(QUERIES["op13_merkle_manifest"](llm, SF))
    assert rows == rows_of_sql(connect(SF), ORACLES["op13_merkle_manifest"])
    verified = [r[rows[0].index("verified")] for r in rows[1]]
    assert "True" in verified and "False" in verified
