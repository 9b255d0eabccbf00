"""Merkle manifest of a dataset: a tree of SHA-256 digests in which one changed row costs one path.

Every row is a leaf; leaves of one group (a language) form a tree by runs of ``FAN`` nodes, and the
groups' roots form one above them. A parent keeps a copy of its hash state from before each child, so
a changed child is folded in by resuming that state with the replacement and the children to its right;
what lies to its left is never hashed again.

On Spark a tree is cut into blocks of ``FAN ** HEIGHT`` nodes. Blocks are built bottom-up, each by one
task, until one node is left per group; the sides of a block's way to the root are then joined back top-down,
one short row per block, and every block folds its own leaves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farsight.llm.common import stage
from farsight.llm.registry import query, table
from farsight.operators.numbering import numbered

# Children of a node, and levels that one task builds: 4,096 leaves a block.
FAN, HEIGHT = 8, 4
# What a leaf holds, in this order (fixed by the format).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A step of a way up: the siblings to the left and to the right, hex digests in order.
WAY = "array<struct<left:string,right:string>>"


# --- hashing ------------------------------------------------------------------------


class Parent:
    """A node over consecutive children, with the hash state from before each of them."""

    def __init__(self, children: list[str]) -> None:
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, child: str) -> str:
        """The digest with another child in ``slot``: the state from before it goes on from there."""
        state = self.states[slot].copy()
        state.update(child.encode())
        state.update("".join(self.children[slot + 1 :]).encode())
        return state.hexdigest()

    def sides(self, slot: int) -> tuple[str, str]:
        return "".join(self.children[:slot]), "".join(self.children[slot + 1 :])


@dataclass
class Block:
    """The levels of parents over the ``leaves`` of one block.

    A block that is ``alone`` in its group ends at its first single node; any other one rises all of
    ``height`` levels, as there are further nodes beside it up to there.
    """

    leaves: list[str]
    alone: bool
    fan: int = FAN
    height: int = HEIGHT
    levels: list[list[Parent]] = field(default_factory=list)

    def __post_init__(self) -> None:
        nodes = self.leaves
        while len(self.levels) < self.height and (len(nodes) > 1 or not self.alone):
            parents = [Parent(nodes[k : k + self.fan]) for k in range(0, len(nodes), self.fan)]
            self.levels.append(parents)
            nodes = [p.digest for p in parents]
        self.root = nodes[0]

    def way(self, leaf: int) -> list[tuple[str, str]]:
        """The sides of each level from ``leaf`` to the block's root."""
        sides = []
        for parents in self.levels:
            leaf, slot = divmod(leaf, self.fan)
            sides.append(parents[leaf].sides(slot))
        return sides

    def fold(self, leaf: int, digest: str) -> str:
        """The block's root with ``digest`` in the place of ``leaf``."""
        for parents in self.levels:
            leaf, slot = divmod(leaf, self.fan)
            digest = parents[leaf].fold(slot, digest)
        return digest


class Way:
    """The steps above a block: one kept hash state per step, shared by all leaves below."""

    def __init__(self, sides: list[dict]) -> None:
        self.steps = [(hashlib.sha256(s["left"].encode()), s["right"].encode()) for s in sides]
        self.siblings = "".join(s["left"] + s["right"] for s in sides)

    def fold(self, digest: str) -> str:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest.encode())
            state.update(right)
            digest = state.hexdigest()
        return digest


# --- leaves -------------------------------------------------------------------------


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the values, each as byte count, colon and text, or ``-`` where null."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# --- the tree -----------------------------------------------------------------------


def _blocks(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """Positioned nodes (grp, position, node, total) with their block and whether it is alone."""
    size = fan**height
    return nodes.withColumn("block", F.floor(F.col("position") / size).cast("long")).withColumn("alone", F.col("total") <= size)


def _raised(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """The next nodes: one per block, at the block's position."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        block = Block(rows["node"].to_pylist(), rows["alone"][0].as_py(), fan, height)
        return pa.table({"grp": rows["grp"].slice(0, 1), "position": rows["block"].slice(0, 1), "node": [block.root]})

    schema = f"grp {nodes.schema['grp'].dataType.simpleString()}, position long, node string"
    return nodes.groupBy("grp", "block").applyInArrow(run, schema)


def _with_total(nodes: DataFrame) -> DataFrame:
    """Nodes with the number of nodes in their group."""
    totals = nodes.groupBy(F.col("grp").alias("_grp")).agg(F.count("*").alias("total"))
    return nodes.join(totals, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")


def _lowered(nodes: DataFrame, above: DataFrame, fan: int, height: int) -> DataFrame:
    """The way to the root of each node: in its block, then that of the block (``above``: grp, position, way)."""

    def run(rows: pa.Table, ways: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        block = Block(rows["node"].to_pylist(), rows["alone"][0].as_py(), fan, height)
        rest = [(s["left"], s["right"]) for s in ways["way"][0].as_py()]
        way = [[{"left": a, "right": b} for a, b in block.way(k) + rest] for k in range(len(block.leaves))]
        return pa.table({"grp": rows["grp"], "position": rows["position"], "way": pa.array(way, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})

    schema = f"grp {nodes.schema['grp'].dataType.simpleString()}, position long, way {WAY}"
    ways = above.select("grp", F.col("position").alias("block"), "way")
    return nodes.groupBy("grp", "block").cogroup(ways.groupBy("grp", "block")).applyInArrow(run, schema)


def _grow(nodes: DataFrame, fan: int, height: int) -> list[DataFrame]:
    """Levels of nodes from ``nodes`` (grp, position, node) up to one node per group, each written.

    The number of levels is that of the largest group; a group that is done stays as it is.
    """
    levels, size = [], fan**height
    while True:
        level = stage(_blocks(_with_total(nodes), fan, height), f"merkle-level-{len(levels)}")
        levels.append(level)
        if (level.agg(F.max("total")).head()[0] or 0) <= size:
            return levels
        nodes = _raised(level, fan, height)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows with grp, position, node, total and block; ``ways``: (grp, position, way) per block of
    leaves, from the block's root to the manifest's; ``roots``: (grp, subroot) per group; ``root``: the digest over all, None of an empty table."""

    leaves: DataFrame
    ways: DataFrame
    roots: DataFrame
    root: str | None
    fan: int
    height: int


def build_manifest(rows: DataFrame, group: str, order: list[str], leaf: str, fan: int = FAN, height: int = HEIGHT) -> Manifest:
    """The tree over ``rows`` with one subtree per value of column ``group`` (null is one), digests ``leaf`` in ``order``.

    Groups come by their value, null first and by UTF-8 bytes. Rows alike in group, order and leaf are
    leaves of their own. An empty table has no groups, roots or root.
    """
    placed = numbered(rows.withColumnsRenamed({group: "grp", leaf: "node"}), ["grp"], [*order, "node"])
    levels = _grow(placed, fan, height)
    tops = stage(_raised(levels[-1], fan, height), "merkle-subroots")
    # The tree of the groups' roots: one group of its own.
    upper = numbered(tops.select("grp", F.col("node")).withColumn("all", F.lit(0)), ["all"], ["grp"])
    named = stage(upper.select(F.col("grp").alias("name"), F.col("all").alias("grp"), "position", "node"), "merkle-groups")
    above = _grow(named, fan, height)
    top = stage(_raised(above[-1], fan, height), "merkle-root")
    ways = top.select(F.lit(0).alias("grp"), F.lit(0).cast("long").alias("position"), F.array().cast(WAY).alias("way"))
    for level in reversed(above):
        ways = _lowered(level, ways, fan, height)
    ways = named.join(ways.select(F.col("position").alias("_p"), "way"), F.col("position") == F.col("_p")).select(
        F.col("name").alias("grp"), F.lit(0).cast("long").alias("position"), "way")
    for level in reversed(levels[1:]):
        ways = _lowered(level, ways, fan, height)
    return Manifest(levels[0], stage(ways, "merkle-ways"), tops.select("grp", F.col("node").alias("subroot")), next((r.node for r in top.collect()), None), fan, height)


def fold_leaves(manifest: Manifest, replacement: str) -> DataFrame:
    """Each leaf row with ``proof_sha256`` (of all its siblings up to the root) and ``folded_root``, the root with the
    digest in column ``replacement`` in the leaf's place, or the leaf itself where that is null."""
    leaves = manifest.leaves
    fan, height = manifest.fan, manifest.height

    def run(rows: pa.Table, ways: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        block = Block(rows["node"].to_pylist(), rows["alone"][0].as_py(), fan, height)
        above = Way(ways["way"][0].as_py())
        proofs, folded = [], []
        for k, (leaf, other) in enumerate(zip(block.leaves, rows[replacement].to_pylist(), strict=True)):
            siblings = "".join(left + right for left, right in block.way(k)) + above.siblings
            proofs.append(hashlib.sha256(siblings.encode()).hexdigest())
            folded.append(above.fold(block.fold(k, leaf if other is None else other)))
        return rows.append_column("proof_sha256", pa.array(proofs)).append_column("folded_root", pa.array(folded))

    ways = manifest.ways.select("grp", F.col("position").alias("block"), "way")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema) + ", proof_sha256 string, folded_root string"
    return leaves.groupBy("grp", "block").cogroup(ways.groupBy("grp", "block")).applyInArrow(run, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered) per document; ``tampered`` is null where the document is left as it is.

    A document whose id's crc32 is divisible by 3 is tampered with by lower-casing the A-Z of its text.
    """
    columns = [F.col(c) for c in FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest([*columns[:-1], F.translate("text", UPPER, LOW)]))
    return docs.select("doc_id", "lang", leaf_digest(columns).alias("leaf"), changed.alias("tampered"))


def verify_documents(docs: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, a tampered one against the
    original tree.

    Nulls in any column are part of the leaf; a null id comes first in its language and is not tampered with.
    Repeated rows are leaves of their own. An empty table gives no rows; columns other than ``FIELDS`` are not read.
    """
    rows = stage(document_leaves(docs), "merkle-leaves")
    manifest = build_manifest(rows, "lang", ["doc_id"], "leaf", fan, height)
    folded = fold_leaves(manifest, "tampered").select("doc_id", F.col("grp").alias("lang"), F.col("node").alias("leaf"), "proof_sha256", "folded_root")
    roots = manifest.roots.select(F.col("grp").alias("_grp"), "subroot")
    joined = folded.join(roots, F.col("lang").eqNullSafe(F.col("_grp"))).withColumn("root", F.lit(manifest.root).cast("string"))
    return joined.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# The same in SQL: levels as a recursive table, each document's siblings by step, and the fold step by step.
_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  docs AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 3 = 0 AS changed FROM documents, crc),
  leaves AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      sha256(head || coalesce(strlen(text) || ':' || CASE WHEN changed THEN translate(text, '{UPPER}', '{LOW}') ELSE text END, '-')) AS tampered
    FROM (SELECT *, {" || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS[:-1])} AS head FROM docs)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS cnt FROM leaves),
  low AS (SELECT 0 AS lvl, lang, pos, leaf AS node, cnt FROM placed UNION ALL
    SELECT lvl + 1, lang, pos // {FAN}, sha256(string_agg(node, '' ORDER BY pos)), any_value((cnt + {FAN - 1}) // {FAN}) FROM low WHERE cnt > 1 GROUP BY lvl, lang, pos // {FAN}),
  subs AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS cnt FROM low WHERE cnt = 1),
  high AS (SELECT 0 AS lvl, place AS pos, subroot AS node, cnt FROM subs UNION ALL
    SELECT lvl + 1, pos // {FAN}, sha256(string_agg(node, '' ORDER BY pos)), any_value((cnt + {FAN - 1}) // {FAN}) FROM high WHERE cnt > 1 GROUP BY lvl, pos // {FAN}),
  nodes AS (SELECT lvl, lang, pos, node, cnt FROM low UNION ALL SELECT 1000 + lvl, NULL, pos, node, cnt FROM high),
  sides AS (SELECT lvl, lang, pos, coalesce(string_agg(node, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(node, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM nodes WHERE cnt > 1 WINDOW r AS (PARTITION BY lvl, lang, pos // {FAN} ORDER BY pos)),
  steps AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lvl) AS step, s.l, s.r FROM (
      SELECT doc_id, lvl, l, r FROM placed p JOIN sides s ON s.lvl < 1000 AND s.lang IS NOT DISTINCT FROM p.lang AND s.pos = p.pos // ({FAN} ** s.lvl)::BIGINT
      UNION ALL SELECT doc_id, lvl, l, r FROM placed p JOIN subs u ON u.lang IS NOT DISTINCT FROM p.lang JOIN sides s ON s.lvl >= 1000 AND s.pos = u.place // ({FAN} ** (s.lvl - 1000))::BIGINT) s),
  fold AS (SELECT doc_id, 0 AS step, tampered AS d FROM placed UNION ALL
    SELECT f.doc_id, f.step + 1, sha256(l || d || r) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step + 1),
  proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY step) AS siblings FROM steps GROUP BY doc_id)
  SELECT p.doc_id, leaf, subroot, h.node AS root, sha256(coalesce(siblings, '')) AS proof_sha256, f.d AS folded_root, f.d = h.node AS verified
  FROM placed p JOIN subs u ON u.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT node FROM high WHERE cnt = 1) h ON true LEFT JOIN proofs USING (doc_id)
  JOIN (SELECT doc_id, arg_max(d, step) AS d FROM fold GROUP BY doc_id) f ON f.doc_id = p.doc_id"""


@query("op13_merkle_manifest", _SQL)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and each document's fold."""
    return verify_documents(table(spark, sf_dir, "documents").select(*FIELDS))
