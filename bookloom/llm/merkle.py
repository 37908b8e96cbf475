"""Merkle manifest: digests of all rows, one tree per group, one tree over the groups.

Every row is a leaf. In a group, leaves ascend by id; runs of three consecutive
nodes become their parent until one node is left, the group's root. The roots
of the groups, in the order of the groups, make the same kind of tree.

A tree is cut into aligned subtrees of six levels. One subtree is one row of a
stored table, its nodes in van Emde Boas order: the upper half of its levels
first, then the lower halves one after another, each laid out the same way. Where
a node lies is computed from its level and place, both to build the subtree and
to read siblings from it; roots of subtrees are the leaves of the next round. A
task holds one subtree, at most 729 leaves, however large the group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.llm.common import stored

FAN = 3
# Levels of a whole subtree above its leaves, and its leaves.
HEIGHT = 6
LEAVES = FAN**HEIGHT
SIZE = 32  # bytes of a digest

NODES = "_t long, _b long, _n long, _nodes binary, _root binary"
PATHS = "_t long, _i long, _path binary, _subroot binary"

_KNOWN: dict[int, tuple[np.ndarray, ...]] = {}


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 (32 bytes) of the fields as text: ``-`` for null, else byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    parts = [
        F.when(t.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)
        )
        for t in texts
    ]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(digests: Sequence[bytes]) -> bytes:
    """Digest of a run of nodes: SHA-256 of their hex texts."""
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def height_of(leaves: int) -> int:
    """Levels above the leaves of a tree: none for a lone leaf."""
    height = 0
    while FAN**height < leaves:
        height += 1
    return height


def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Where the nodes of a whole subtree lie, by depth from its root, in van Emde Boas order."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    if levels not in _KNOWN:
        upper, lower = addresses(levels // 2), addresses(levels - levels // 2)
        below = FAN ** len(upper)  # lower subtrees hang under the last upper level
        first = sum(map(len, upper))
        each = sum(map(len, lower))
        starts = first + each * np.arange(below)[:, None]
        _KNOWN[levels] = (*upper, *[(starts + depth).ravel() for depth in lower])
    return _KNOWN[levels]


class Subtree:
    """Nodes of an aligned subtree; a level counts from the leaves."""

    def __init__(self, leaves: int, height: int, cells: bytes | None = None):
        self.height = height
        self.place = addresses(height + 1)[::-1]
        self.counts = [leaves]
        for _ in range(height):
            self.counts.append(-(-self.counts[-1] // FAN))
        whole = sum(map(len, self.place)) * SIZE
        self.cells = bytearray(whole) if cells is None else cells

    def node(self, level: int, at: int) -> bytes:
        start = int(self.place[level][at]) * SIZE
        return bytes(self.cells[start : start + SIZE])

    def put(self, level: int, at: int, digest: bytes) -> None:
        start = int(self.place[level][at]) * SIZE
        self.cells[start : start + SIZE] = digest

    def run(self, level: int, at: int) -> list[bytes]:
        """The run a node belongs to, itself included."""
        first = at - at % FAN
        return [self.node(level, i) for i in range(first, min(first + FAN, self.counts[level]))]

    def build(self, leaves: Sequence[bytes]) -> bytes:
        """Fill in the leaves and every level above them; returns the root."""
        for at, digest in enumerate(leaves):
            self.put(0, at, digest)
        for level in range(1, self.height + 1):
            for at in range(self.counts[level]):
                self.put(level, at, parent(self.run(level - 1, at * FAN)))
        return self.node(self.height, 0)

    def path(self, at: int) -> bytes:
        """Siblings from a leaf to the root: per level its place in the run, their number, them."""
        steps = []
        for level in range(self.height):
            run, mine = self.run(level, at), at % FAN
            del run[mine]
            steps.append(bytes([mine, len(run)]) + b"".join(run))
            at //= FAN
        return b"".join(steps)


def steps(path: bytes) -> list[tuple[int, list[bytes]]]:
    """A path read back: the node's place in its run and its siblings, level by level."""
    found, at = [], 0
    while at < len(path):
        mine, n = path[at], path[at + 1]
        at += 2
        found.append((mine, [path[i : i + SIZE] for i in range(at, at + n * SIZE, SIZE)]))
        at += n * SIZE
    return found


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for mine, siblings in steps(path):
        leaf = parent([*siblings[:mine], leaf, *siblings[mine:]])
    return leaf


def _height(n: int) -> int:
    return HEIGHT if n > LEAVES else height_of(n)


def _build(group: pa.Table) -> pa.Table:
    """One subtree from its leaves (``_t``, ``_i``, ``_n``, ``_d``)."""
    rows = group.sort_by("_i")
    tree, first, n = (rows.column(c)[0].as_py() for c in ("_t", "_i", "_n"))
    subtree = Subtree(rows.num_rows, _height(n))
    root = subtree.build(rows.column("_d").to_pylist())
    row = {"_t": tree, "_b": first // LEAVES, "_n": n, "_nodes": bytes(subtree.cells), "_root": root}
    return pa.Table.from_pylist([row], schema=_arrow_nodes())


def _arrow_nodes() -> pa.Schema:
    kinds = [pa.int64()] * 3 + [pa.binary()] * 2
    return pa.schema(list(zip(("_t", "_b", "_n", "_nodes", "_root"), kinds)))


def _leaves_of(n: int, block: int) -> int:
    return min(LEAVES, n - block * LEAVES)


def _children(batches):
    """The path of every leaf of stored subtrees, on from the path of the subtree's root."""
    for batch in batches:
        for row in batch.to_pylist():
            leaves = _leaves_of(row["_n"], row["_b"])
            subtree = Subtree(leaves, _height(row["_n"]), row["_nodes"])
            first = row["_b"] * LEAVES
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["_t"]] * leaves, pa.int64()),
                    pa.array(range(first, first + leaves), pa.int64()),
                    pa.array([subtree.path(i) + row["_path"] for i in range(leaves)], pa.binary()),
                    pa.array([row["_subroot"]] * leaves, pa.binary()),
                ],
                names=["_t", "_i", "_path", "_subroot"],
            )


def _rounds(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Stored subtrees, round by round: first those of the leaves, last one per tree.

    ``nodes`` has tree, place, the tree's number of nodes and digest (``_t``, ``_i``,
    ``_n``, ``_d``); ``most`` is the largest such number.
    """
    made: list[DataFrame] = []
    while True:
        keyed = nodes.withColumn("_b", F.expr(f"_i div {LEAVES}"))
        blocks = stored(
            keyed.groupBy("_t", "_b").applyInArrow(lambda group: _build(group), NODES),
            f"{name}-{len(made)}",
        )
        made.append(blocks)
        if most <= LEAVES:
            return made
        most = -(-most // LEAVES)
        nodes = blocks.where(F.col("_n") > LEAVES).select(
            "_t",
            F.col("_b").alias("_i"),
            F.expr(f"(_n + {LEAVES - 1}) div {LEAVES}").alias("_n"),
            F.col("_root").alias("_d"),
        )


def _roots(rounds: Sequence[DataFrame]) -> DataFrame:
    """Root of every tree (``_t``, ``_root``)."""
    frames = [b.where(F.col("_n") <= LEAVES).select("_t", "_root") for b in rounds]
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found


def _with_paths(rounds: Sequence[DataFrame], trees: DataFrame) -> DataFrame:
    """Subtrees of the first round, with the path from the root of each on.

    ``trees`` has the path from each tree's root on (``_t``, ``_path``, ``_subroot``).
    """
    below = None
    for blocks in reversed(rounds):
        reached = blocks.where(F.col("_n") <= LEAVES).join(trees, "_t")
        if below is not None:
            inner = blocks.where(F.col("_n") > LEAVES).join(
                below.withColumnRenamed("_i", "_b"), ["_t", "_b"]
            )
            reached = reached.unionByName(inner)
        below = reached.mapInArrow(_children, PATHS)
    return reached


def _placed(frame: DataFrame, order: Sequence[Column], group: Sequence[str], name: str) -> DataFrame:
    """Add ``_i``, the row's place in its group by the order, and ``_n``, the group's rows.

    One range sort; a stored copy fixes the borders of its pieces, so that a lost
    task cannot move them. What is added up over the pieces is one row per piece
    and group. The order must begin with the group's columns.
    """
    pieces = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows would stay together in one piece.
    marked = frame.withColumn("_row", F.monotonically_increasing_id())
    by = [*order, F.col("_row").asc()]
    placed = stored(
        marked.repartitionByRange(pieces, *by)
        .sortWithinPartitions(*by)
        .drop("_row")
        .withColumn("_place", F.monotonically_increasing_id()),
        name,
    ).withColumn("_piece", F.shiftright("_place", 33))
    sums = placed.groupBy(*group, "_piece").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_rows")
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(g).alias(f"{g}_") for g in group],
        F.col("_piece").alias("_piece_"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("_n"),
    )
    same = F.col("_piece") == F.col("_piece_")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_"))
    return placed.join(starts, same).select(
        *frame.columns, (F.col("_place") + F.col("_shift")).alias("_i"), "_n"
    )


@dataclass(frozen=True)
class Manifest:
    """Stored trees of a dataset.

    ``leaves``: per row its id, group number and place, leaf and claimed leaf;
    ``groups`` and ``top``: subtrees round by round; ``root``: 32 bytes, None if
    there are no rows.
    """

    leaves: DataFrame
    groups: list[DataFrame]
    top: list[DataFrame]
    root: bytes | None

    def proofs(self) -> DataFrame:
        """One row per row of the dataset: its digests, its proof, and where its claim leads.

        ``doc_id``, ``leaf``, ``subroot`` and ``root`` (hex), ``proof`` (binary, see
        ``steps``), ``proof_sha256``, ``folded_root`` (from the claimed leaf and the
        siblings) and ``verified``.
        """
        columns = ("doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified")
        doc_id = self.leaves.schema["_id"].dataType
        kinds = f"doc_id {doc_id.simpleString()}, leaf string, subroot string, root string, "
        kinds += "proof binary, proof_sha256 string, folded_root string, verified boolean"
        if self.root is None:
            return self.leaves.sparkSession.createDataFrame([], kinds)
        # The path from the top root on is empty.
        top = self.top[-1].select(
            "_t", F.lit(b"").alias("_path"), F.lit(self.root).alias("_subroot")
        )
        above = _with_paths(self.top, top).mapInArrow(_children, PATHS)
        subroots = _roots(self.groups)
        trees = above.select(F.col("_i").alias("_t"), "_path").join(
            subroots.withColumnRenamed("_root", "_subroot"), "_t"
        )
        blocks = stored(_with_paths(self.groups, trees), "merkle-paths")
        root = self.root.hex()

        def prove(rows: pa.Table, block: pa.Table) -> pa.Table:
            one = block.to_pylist()[0]
            subtree = Subtree(_leaves_of(one["_n"], one["_b"]), _height(one["_n"]), one["_nodes"])
            subroot = one["_subroot"].hex()
            out: list[list] = [[] for _ in columns[1:]]
            for at, leaf, claim in zip(*[rows.column(c).to_pylist() for c in ("_i", "_d", "_claim")]):
                path = subtree.path(at % LEAVES) + one["_path"]
                siblings = "".join([s.hex() for _, run in steps(path) for s in run])
                folded = fold(leaf if claim is None else claim, path).hex()
                proof = sha256(siblings.encode()).hexdigest()
                row = (leaf.hex(), subroot, root, path, proof, folded, folded == root)
                for column, value in zip(out, row):
                    column.append(value)
            ids = rows.column("_id")
            kinds = [pa.string()] * 3 + [pa.binary()] + [pa.string()] * 2 + [pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            return pa.Table.from_arrays([ids, *arrays], names=list(columns))

        keyed = self.leaves.withColumn("_b", F.expr(f"_i div {LEAVES}"))
        return (
            keyed.groupBy("_t", "_b")
            .cogroup(blocks.groupBy("_t", "_b"))
            .applyInArrow(lambda rows, block: prove(rows, block), kinds)
        )


def build_manifest(
    docs: DataFrame,
    doc_id: str = "doc_id",
    group: str = "source",
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    claimed: Sequence[Column] | None = None,
) -> Manifest:
    """Digest all rows and store the trees over them.

    ``columns`` are what a leaf covers, in this order; other columns of the rows
    play no part, whatever their names. ``claimed`` are the same fields as a copy
    to be checked has them; by default the rows themselves.

    Groups come null first, then by their bytes. In a group, rows come by id, null
    first; rows of one id by their digest, so equal rows are next to each other and
    each is a leaf of its own. Null fields, empty and very long texts are digested as
    they are. No rows: no trees, and no root.
    """
    leaf = leaf_digest([F.col(f"`{c}`") for c in columns])
    claim = leaf if claimed is None else leaf_digest(claimed)
    digests = docs.select(
        F.col(f"`{doc_id}`").alias("_id"),
        F.col(f"`{group}`").cast("string").alias("_group"),
        leaf.alias("_d"),
        claim.alias("_claim"),
    ).withColumn("_claim", F.nullif("_claim", "_d"))
    order = [F.col(c).asc_nulls_first() for c in ("_group", "_id", "_d")]
    placed = stored(_placed(digests, order, ["_group"], "merkle-rows"), "merkle-places")
    sizes = placed.groupBy("_group").agg(F.max("_n").alias("_leaves"))
    numbered = _placed(sizes, [F.col("_group").asc_nulls_first()], [], "merkle-groups")
    trees = stored(
        numbered.select("_group", "_leaves", F.col("_i").alias("_t"), F.col("_n").alias("_trees")),
        "merkle-trees",
    )
    listed = trees.select(F.col("_group").alias("_of"), "_t")
    leaves = stored(
        placed.join(listed, F.col("_group").eqNullSafe(F.col("_of"))).drop("_group", "_of"),
        "merkle-leaves",
    )
    largest = trees.agg(F.max("_leaves").alias("leaves"), F.max("_trees").alias("trees")).first()
    if largest.leaves is None:
        return Manifest(leaves, [], [], None)
    groups = _rounds(leaves.select("_t", "_i", "_n", "_d"), largest.leaves, "merkle-nodes")
    roots = _roots(groups).select(
        F.lit(0).cast("long").alias("_t"),
        F.col("_t").alias("_i"),
        F.lit(largest.trees).cast("long").alias("_n"),
        F.col("_root").alias("_d"),
    )
    top = _rounds(roots, largest.trees, "merkle-top")
    return Manifest(leaves, groups, top, bytes(_roots(top).first()["_root"]))
