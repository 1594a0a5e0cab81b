"""Merkle manifest of a table with a witness for every row.

Every row is a leaf.  The leaves of a language, ascending by id, are the leaves of a tree in which every
eight consecutive nodes become one; the languages' roots are the leaves of a last tree of
the same kind.

A tree grows by appends in aligned blocks of ``8 ** BLOCK_LEVELS`` leaves.  A task appends the leaves of
a block one after the other to its open subtrees (:class:`Frontier`).  A node that joins an open
run attaches a partial witness to the leaves below it - the siblings so far - and extends the
partial witnesses of the nodes that wait there; each later sibling extends them further.  The
roots of blocks are appended in the same way to the next round's blocks, until a tree is one node.  Then
the witnesses of later rounds are handed down to the blocks, one joined row per block.

Rows: a null id comes first, equal ids are ordered by their leaves, so repeated rows are leaves of their own;
a null language is a tree of its own and the first; an empty table has no root and no rows.  A text of any length is
hashed whole.  Only the five named columns are read, whatever others a table has.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.llm.common import fold_case, settle, thin
from sceneframe.llm.ordering import numbered_input, positions

ARITY = 8
#: levels of a block; a block of 512 leaves is one row between tasks
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCK = ARITY ** BLOCK_LEVELS
_PATH = "array<struct<before:string,after:string>>"
_PATHS = pa.list_(pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))


def joined_hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels that a block climbs in a tree of n leaves: to the root if the tree is one block."""
    if n > _BLOCK:
        return BLOCK_LEVELS
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Frontier:
    """Open subtrees of one block; ``paths`` holds the witness of each appended leaf, as far as it is known.

    A step of a witness is a pair of lists: the siblings to the left and those to the right.
    """

    def __init__(self, levels: int):
        self.levels, self.root = levels, None
        self.open: list[list] = [[] for _ in range(levels)]
        self.paths: list[list] = []

    def append(self, digest: str) -> None:
        self.paths.append([])
        self._join(0, digest, len(self.paths) - 1)

    def _join(self, level: int, digest: str, first: int) -> None:
        if level == self.levels:
            self.root = digest
            return
        run = self.open[level]
        step = ([d for d, _, _ in run], [])
        for _, waiting, _ in run:
            waiting[1].append(digest)
        for path in self.paths[first:]:
            path.append(step)
        run.append((digest, step, first))
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._join(level + 1, joined_hash([d for d, _, _ in run]), run[0][2])

    def close(self) -> str:
        """Complete the last runs, shorter ones and even single nodes; the block's root."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.root


def grown(digests: list[str], n: int) -> Frontier:
    """A block of a tree of n leaves after all of its appends."""
    block = Frontier(levels_of(n))
    for digest in digests:
        block.append(digest)
    block.close()
    return block


def _roots(batches):
    for batch in thin(batches, 64):
        sizes, digests = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([-(-n // _BLOCK) for n in sizes], pa.int64()), batch.column(2),
             pa.array([grown(d, n).root for d, n in zip(digests, sizes)], pa.string())], names=["tree", "n", "pos", "node"])


def _witnessed(batches):
    for batch in thin(batches, 16):
        sizes, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        paths = [[[{"before": "".join(a), "after": "".join(b)} for a, b in path] for path in grown(d, n).paths]
                 for d, n in zip(digests, sizes)]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(paths, _PATHS)], names=[*batch.schema.names[2:], "paths"])


def _rounds(nodes: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round of appends, and each tree's root.

    ``nodes`` has ``tree, n, pos, node`` and the carried columns; a round has ``tree, n, block, members``.
    """
    rounds: list[DataFrame] = []
    while True:
        blocks = settle(nodes.groupBy("tree", "n", F.floor(F.col("pos") / _BLOCK).alias("block"))
                        .agg(F.array_sort(F.collect_list(F.struct("pos", "node", *carried))).alias("members")))
        rounds.append(blocks)
        nodes, carried = settle(blocks.select("tree", "n", "block", "members.node")
                                .mapInArrow(_roots, "tree string, n long, pos long, node string")), ()
        if nodes.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0] == 1:
            return rounds, nodes


def _handed_down(rounds: list[DataFrame], above: DataFrame, *kept: str) -> DataFrame:
    """The members of the first round with ``path``: their witness up to the root that ``above`` has a path from.

    ``above`` has ``tree, pos, path`` and the kept columns.
    """
    for blocks in reversed(rounds):
        joined = (blocks.join(above.select("tree", F.col("pos").alias("block"), F.col("path").alias("rest"), *kept), ["tree", "block"])
                  .select("n", F.col("members.node").alias("digests"), "tree", "members", "rest", *kept))
        kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
        names = joined.columns[2:]
        made = joined.mapInArrow(_witnessed, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", paths array<{_PATH}>")
        above = (made.select("tree", "rest", *kept, F.explode(F.arrays_zip("members", "paths")).alias("m"))
                 .select("tree", "m.members.*", *kept, F.concat("m.paths", "rest").alias("path")))
    return above


def leaf_hash(text: Column) -> Column:
    """A row's leaf, with the given text in the place of its own."""
    values = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def witnesses(docs: DataFrame) -> DataFrame:
    """Every row's ``doc_id, leaf, lower, subroot, root, path``.

    ``path`` lists, level by level up to the root, the siblings left and right of the leaf's ancestor as concatenated digests;
    ``lower`` is the leaf that the row would have if its text were lower-cased (A-Z).
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))     # null first, then bytewise
    leaves = settle(numbered_input(docs.select(*FIELDS)).select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(F.col("text")).alias("node"),
                                                leaf_hash(fold_case(F.col("text"))).alias("lower"), "_tie"))
    rounds, subroots = _rounds(positions(leaves, "tree", "doc_id", "node", "_tie"), "doc_id", "lower")
    langs = positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node"), "tree", "lang")
    upper, root = _rounds(langs, "lang")
    top = root.select("tree", "pos", F.col("node").alias("root"), F.array().cast(_PATH).alias("path"))
    trees = _handed_down(upper, top, "root").select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "root", "path")
    return (_handed_down(rounds, trees, "subroot", "root")
            .select("doc_id", F.col("node").alias("leaf"), "lower", "subroot", "root", "path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its witness give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def siblings_hash(path: Column) -> Column:
    """One digest of all siblings of a witness, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def verify(found: DataFrame, tampered: Column) -> DataFrame:
    """op12: fold every row's leaf, or the lower-cased one where ``tampered``, with its witness and compare the roots."""
    folded = fold(F.when(tampered, F.col("lower")).otherwise(F.col("leaf")), F.col("path"))
    return (found.select("doc_id", "leaf", "subroot", "root", siblings_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
