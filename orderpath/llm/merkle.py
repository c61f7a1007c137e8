"""Merkle manifest of a table, with retained hash states for folding in changed rows.

A row is a leaf: sha256 over its fields, each ``-`` if null, else byte count, ``:``, value. Per
source, leaves in the order of doc_id are the lowest nodes of a tree; runs of FAN consecutive
nodes become the sha256 of their digests as hex text until one node, the subroot, is left. The
subroots in the order of the sources form a tree of the same kind, whose end is the root.

A parent keeps a copy of its hash state before each child slot. A changed child resumes the
state of its slot and adds only itself and its right siblings, level by level up to the root.

LEVELS levels at a time are built from one block of FAN ** LEVELS consecutive nodes, so a hot
source is many blocks, and a group has a fixed bound. Blocks name their own node for the next
stage; on the way back, each block gets the runs above it (at most FAN digests a level).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpath.llm.common import stage_table
from orderpath.llm.feistel import number_rows
from orderpath.operators.joins import lookup_join

FAN, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
PATH = "array<struct<slot:int,run:string>>"


def height(n: int) -> int:
    """Levels above ``n`` nodes: none above a lone one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def framed(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Runs:
    """The levels over one block of nodes, with the states before every child slot."""

    def __init__(self, digests: Sequence[str], levels: int):
        nodes = [d.encode() for d in digests]
        self.levels: list[list[bytes]] = []
        self.states: list[list] = []
        for _ in range(levels):
            states, runs, above = [], [], []
            for start in range(0, len(nodes), FAN):
                run = nodes[start : start + FAN]
                state = hashlib.sha256()
                for child in run:
                    states.append(state.copy())
                    state.update(child)
                runs.append(b"".join(run))
                above.append(state.hexdigest().encode())
            self.levels.append(runs)
            self.states.append(states)
            nodes = above
        if len(nodes) != 1:
            raise ValueError(f"{len(nodes)} nodes left after {levels} levels")
        self.top = nodes[0]

    def path(self, i: int) -> list[tuple[int, bytes]]:
        """(slot, run) of every level over node ``i``."""
        steps = []
        for runs in self.levels:
            steps.append((i % FAN, runs[i // FAN]))
            i //= FAN
        return steps

    def fold(self, i: int, digest: bytes) -> bytes:
        """The block's own node with node ``i`` replaced: each level resumes the state of the slot."""
        for runs, states in zip(self.levels, self.states):
            state = states[i].copy()
            state.update(digest + runs[i // FAN][HEX * (i % FAN + 1) :])
            digest, i = state.hexdigest().encode(), i // FAN
        return digest


class Above:
    """The runs above a block up to the root, with the state before the block's slot in each."""

    def __init__(self, path: Sequence[tuple[int, bytes]]):
        self.resumed, self.siblings = [], []
        for slot, run in path:
            self.resumed.append((hashlib.sha256(run[: HEX * slot]), run[HEX * (slot + 1) :]))
            self.siblings.append(run[: HEX * slot] + run[HEX * (slot + 1) :])

    def fold(self, digest: bytes) -> bytes:
        for before, right in self.resumed:
            state = before.copy()
            state.update(digest + right)
            digest = state.hexdigest().encode()
        return digest


def siblings(path: Sequence[tuple[int, bytes]]) -> bytes:
    return b"".join(run[: HEX * slot] + run[HEX * (slot + 1) :] for slot, run in path)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one after another: a block may be large, a batch of them need not fit as Python values."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def levels_here(n: int) -> int:
    return min(LEVELS, height(n))


def tops(blocks: DataFrame) -> DataFrame:
    """``tree``, ``pos``, ``n``, ``digest``: the node of each block as a node of the next stage."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (r["tree"], r["block"], -(-r["n"] // FAN**LEVELS), Runs(r["digests"], levels_here(r["n"])).top.decode())
                for r in rows_of(batch)
            ]
            if rows:
                yield as_batch(rows, schema)

    return blocks.select("tree", "block", "n", "digests").mapInArrow(work, "tree string, pos long, n long, digest string")


def blocks_of(nodes: DataFrame, *extra: str) -> DataFrame:
    """Blocks of FAN ** LEVELS consecutive nodes: ``tree``, ``block``, ``n``, ``digests`` and arrays of ``extra``."""
    block = F.floor(F.col("pos") / FAN**LEVELS).cast("long")
    grouped = nodes.groupBy("tree", block.alias("block"), "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", *extra))).alias("items")
    )
    arrays = [F.col("items.digest").alias("digests"), *[F.col(f"items.{e}").alias(e) for e in extra]]
    return grouped.select("tree", "block", "n", *arrays)


def paths_down(blocks: DataFrame, paths: DataFrame | None) -> DataFrame:
    """``tree``, ``pos``, ``path`` of every node of ``blocks``, given the path of each block."""
    schema = pa.schema(
        [("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.string())])))]
    )
    if paths is None:
        given = blocks.withColumn("path", F.array().cast(PATH))
    else:
        given = blocks.join(paths.withColumnRenamed("pos", "block"), ["tree", "block"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                runs = Runs(r["digests"], levels_here(r["n"]))
                rows = []
                for i in range(len(r["digests"])):
                    inner = [{"slot": slot, "run": run.decode()} for slot, run in runs.path(i)]
                    rows.append((r["tree"], r["block"] * FAN**LEVELS + i, inner + r["path"]))
                yield as_batch(rows, schema)

    return given.select("tree", "block", "n", "digests", "path").mapInArrow(work, f"tree string, pos long, path {PATH}")


def climb(nodes: DataFrame, most: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Block tables of all stages over trees of at most ``most`` nodes, and the last nodes."""
    stages = []
    while True:
        stages.append(stage_table(blocks_of(nodes), f"{label}-{len(stages)}"))
        nodes = stage_table(tops(stages[-1]), f"{label}-tops")
        most = -(-most // FAN**LEVELS)
        if most <= 1:
            return stages, nodes


def leaf_rows(docs: DataFrame, changed: Column, change: dict[str, Column], fields: Sequence[str] = FIELDS, group: str = "source") -> DataFrame:
    """``tree``, ``doc_id``, ``digest``, ``replacement``: one row per row of ``docs``, without its text.

    ``replacement`` is the leaf with the columns of ``change`` put in place where ``changed``.
    The name of a tree is the source behind a letter, so that no source (null) comes first.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))
    here = [F.col(f) for f in fields]
    new = [change.get(f, F.col(f)) for f in fields]
    leaf = leaf_digest(here)
    return docs.select(
        tree.alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf.alias("digest"),
        F.when(changed, leaf_digest(new)).otherwise(leaf).alias("replacement"),
    )


def manifest(docs: DataFrame, changed: Column, change: dict[str, Column], fields: Sequence[str] = FIELDS, group: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``tree``, ``pos``, ``leaf``, ``replacement``, ``subroot``,
    ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    The tree is that of the given rows. ``folded_root`` is the root with the row's replacement
    folded in, ``verified`` whether it still is the root. ``changed`` must not be null. Null fields
    are ``-``; an empty text is ``0:``; rows without a source are the first tree, null ids its first
    leaves. Rows that repeat an id come in the order of their leaves, so equal rows have any of
    their places with the same result. Extra columns are not read; an empty table gives no rows.
    """
    numbered, n_rows = number_rows(leaf_rows(docs, changed, change, fields, group), "tree", "doc_id", "digest")
    numbered = stage_table(numbered, "leaves")
    trees = stage_table(numbered.groupBy("tree").agg(F.min("row_number").alias("first"), F.count(F.lit(1)).alias("n")), "trees")
    placed = lookup_join(numbered, trees, ["tree"], spread=["row_number"], written=True)
    nodes = placed.withColumn("pos", F.col("row_number") - F.col("first")).withColumnRenamed("digest", "leaf")
    leaves = stage_table(
        blocks_of(nodes.withColumn("digest", F.col("leaf")), "doc_id", "replacement"), "leaf-blocks"
    )
    most = trees.agg(F.max("n")).first()[0] or 0

    stages, subroots = [leaves], stage_table(tops(leaves), "subtrees")
    if most > FAN**LEVELS:
        upper, subroots = climb(subroots, -(-most // FAN**LEVELS), "subtree")
        stages += upper
    ordered, n_trees = number_rows(subroots.select("tree", "digest"), "tree")
    ordered = stage_table(ordered.withColumnRenamed("row_number", "pos"), "subroots")
    over = ordered.select(F.lit("").alias("tree"), "pos", F.lit(n_trees).cast("long").alias("n"), "digest")
    top_stages, root = climb(over, n_trees, "top")

    paths = None
    for blocks in reversed(top_stages):
        paths = paths_down(blocks, paths)
    paths = ordered.select("tree", "pos").join(paths.select("pos", "path"), "pos").select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for blocks in reversed(stages[1:]):
        paths = paths_down(blocks, paths)
    roots = ordered.select("tree", F.col("digest").alias("subroot")).crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))
    # Hot trees have many blocks: the few columns of a tree are looked up, not shuffled to its blocks.
    rows = lookup_join(leaves.join(paths.withColumnRenamed("pos", "block"), ["tree", "block"]), stage_table(roots, "roots"), ["tree"], ["block"], written=True)
    return rows.mapInArrow(proofs, PROOF)


PROOF = (
    "doc_id long, tree string, pos long, leaf string, replacement string, subroot string, root string, "
    "proof_sha256 string, folded_root string, verified boolean"
)


def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in PROOF.split(", "))])
    for batch in batches:
        for r in rows_of(batch):
            digests = r["digests"]
            runs = Runs(digests, levels_here(r["n"]))
            above = Above([(s["slot"], s["run"].encode()) for s in r["path"]])
            upper = b"".join(above.siblings)
            root, rows, higher = r["root"], [], b""
            for i, (doc_id, leaf, new) in enumerate(zip(r["doc_id"], digests, r["replacement"])):
                steps = runs.path(i)
                if i % FAN == 0:
                    higher = siblings(steps[1:]) + upper
                proof = hashlib.sha256(siblings(steps[:1]) + higher).hexdigest()
                folded = above.fold(runs.fold(i, new.encode())).decode()
                pos = r["block"] * FAN**LEVELS + i
                rows.append((doc_id, r["tree"], pos, leaf, new, r["subroot"], root, proof, folded, folded == root))
            yield as_batch(rows, schema)
