"""A Merkle manifest of a data set: one tree per group of rows, and one tree
over the groups' roots.

A tree is worked on in superblocks of ``fan_out ** block_levels`` consecutive
nodes.  Going up, each superblock is reduced to one node of the next tier, so
a tier is some thousand times smaller than the one below it, until every tree
is a single node.  Going down, the nodes of a superblock are cogrouped with the
one row of outer nodes that their proofs need from above: the task repeats the
short local reduction, joins the local siblings and the outer ones to whole
proofs, and folds every claimed leaf along its proof.  No tree, however large,
is in one task, and no proof is put together by joins level by level.

Positions in a tree come from a range sort of all rows and from sums over the
sorted parts, so a group that holds a third of all rows is spread like any
other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FAN_OUT = 8
BLOCK_LEVELS = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_OUTER = "g string, block long, lefts array<string>, rights array<string>, subroot string, root string"


def leaf_digest(columns: Sequence[str] = COLUMNS, **replaced: Column) -> Column:
    """Lowercase hex sha256 of a row: its columns one after another, each "-"
    if null, else the UTF-8 byte count, ":" and the value as a string.
    ``replaced`` gives other expressions for columns of these names."""
    def field(name: str) -> Column:
        value = replaced.get(name, F.col(f"`{name}`")).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(size: int, fan_out: int) -> int:
    """Levels between ``size`` nodes and the single one."""
    n = 0
    while size > 1:
        size, n = -(-size // fan_out), n + 1
    return n


def _layers(digests: list[str], levels: int, fan_out: int) -> list[list[str]]:
    out = [digests]
    for _ in range(levels):
        cur = out[-1]
        out.append([_hash("".join(cur[i:i + fan_out])) for i in range(0, len(cur), fan_out)])
    return out


def _siblings(layer: list[str], fan_out: int) -> list[tuple[str, str]]:
    """For each node, the others of its run: those before it and those after it."""
    return [("".join(layer[i - i % fan_out:i]), "".join(layer[i + 1:i - i % fan_out + fan_out])) for i in range(len(layer))]


def _placed(scratch: Scratch, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a string column g) and the position ``pos`` of each in
    its tree, by ``order``, and the tree's ``size``."""
    keys = ["g", *order, "tie"]
    ordered = scratch.write(
        rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .drop("tie").withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))
    # A tree has one row here for each part that it touches.
    runs = ordered.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    tree = Window.partitionBy("g")
    shift = F.sum("n").over(tree.orderBy("part")) - F.col("n") - F.col("first")
    place = scratch.write(runs.select("g", "part", shift.alias("shift"), F.sum("n").over(tree).alias("size")))
    return ordered.join(place, ["g", "part"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def _blocked(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {span}"))


def _climb(scratch: Scratch, nodes: DataFrame, fan_out: int, block_levels: int) -> list[DataFrame]:
    """The tiers of all trees: ``nodes`` (g, pos, size, digest), then the
    superblocks of each tier as nodes of the next, until each tree is one."""
    span = fan_out ** block_levels

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        size = int(pdf["size"].iloc[0])
        top = _layers(list(pdf["digest"]), min(block_levels, _levels(size, fan_out)), fan_out)[-1]
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "pos": pdf["block"].iloc[:1], "size": -(-size // span), "digest": top})

    tiers = [nodes]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    for _ in range(max(1, -(-_levels(largest, fan_out) // block_levels))):
        tiers.append(scratch.write(
            _blocked(tiers[-1], span).select("g", "block", "pos", "size", "digest").groupBy("g", "block")
            .applyInPandas(reduce, "g string, pos long, size long, digest string")))
    return tiers


def _descend(nodes: DataFrame, outer: DataFrame, fan_out: int, block_levels: int, extra: Sequence[str],
             rows: Callable[[pd.DataFrame, list, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """Cogroup the superblocks of a tier with their outer nodes.  ``rows``
    gets the block's nodes in order, the sibling pairs of each of its layers,
    and the outer row."""
    def meet(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos").reset_index(drop=True)
        layers = _layers(list(own["digest"]), min(block_levels, _levels(int(own["size"].iloc[0]), fan_out)), fan_out)
        return rows(own, [_siblings(x, fan_out) for x in layers[:-1]], above.iloc[0])

    blocks = _blocked(nodes, fan_out ** block_levels).select("g", "block", "pos", "size", "digest", *extra)
    return blocks.groupBy("g", "block").cogroup(outer.groupBy("g", "block")).applyInPandas(meet, schema)


def _outer_rows(fan_out: int, tree: bool) -> Callable:
    """Outer nodes of the superblocks (or, with ``tree``, of the trees) that
    the nodes of a block stand for."""
    def rows(own: pd.DataFrame, pairs: list, above: pd.Series) -> pd.DataFrame:
        at = [[p[i // fan_out ** k] for k, p in enumerate(pairs)] for i in range(len(own))]
        return pd.DataFrame({
            "g": own["tree"] if tree else own["g"], "block": 0 if tree else own["pos"],
            "lefts": [[x[0] for x in a] + list(above["lefts"]) for a in at],
            "rights": [[x[1] for x in a] + list(above["rights"]) for a in at],
            "subroot": own["digest"] if tree else above["subroot"], "root": above["root"]})

    return rows


def _folded_rows(fan_out: int, with_proof: bool) -> Callable:
    def rows(own: pd.DataFrame, pairs: list, above: pd.Series) -> pd.DataFrame:
        outer = list(zip(above["lefts"], above["rights"]))
        tail = "".join(a + b for a, b in outer)
        proofs, folded, paths = [], [], []
        for i, claim in enumerate(own["claim"]):
            path = [p[i // fan_out ** k] for k, p in enumerate(pairs)]
            proofs.append(_hash("".join([a + b for a, b in path]) + tail))
            for a, b in path:
                claim = _hash(a + claim + b)
            for a, b in outer:
                claim = _hash(a + claim + b)
            folded.append(claim)
            if with_proof:
                paths.append([{"left": a, "right": b} for a, b in path + outer])
        out = pd.DataFrame({"id": own["id"], "leaf": own["digest"], "subroot": above["subroot"], "root": above["root"],
                            "proof_sha256": proofs, "folded_root": folded})
        return out.assign(proof=paths) if with_proof else out

    return rows


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = COLUMNS,
             claim: Column | None = None, with_proof: bool = False, fan_out: int = FAN_OUT,
             block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``docs``: its id, leaf, subroot, root, proof_sha256
    (digest of the siblings, level by level from the leaf to the root, left to
    right), folded_root, verified and, with ``with_proof``, proof (array of
    the siblings' hex digests left and right of the path, by level).

    A group's leaves ascend by id; every ``fan_out`` consecutive nodes become
    the digest of their concatenated hex digests until one is left (a lone
    leaf is its own subroot).  The subroots ascend by group, null first, then
    by UTF-8 bytes, and give the root the same way.  ``claim`` is the leaf
    that a holder of the row presents, an expression over ``docs`` (null: the
    row's own leaf); it is folded along the proof of the original, and
    verified tells whether that gives the root.

    Null values have a mark of their own in the leaf; a null id stands first;
    rows that repeat an id are ordered by their leaf, and equal rows are
    leaves next to each other.  Empty and very long texts are plain values.
    An empty table gives no rows.  Columns that are not named are not read."""
    scratch = Scratch(docs.sparkSession, "merkle")
    id_type = docs.schema[id_col].dataType
    leaf = leaf_digest(columns)
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"), F.col(f"`{id_col}`").alias("id"),
        leaf.alias("digest"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    # Written first: the range sort reads its input twice, once for the bounds.
    nodes = (_placed(scratch, scratch.write(leaves), ["id", "digest"])
             .select("g", "pos", "size", "digest", F.col("id").cast("string"), F.coalesce("claim", "digest").alias("claim")))
    tiers = _climb(scratch, nodes, fan_out, block_levels)

    subroots = tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("tree"), "digest")
    tops = _climb(scratch, _placed(scratch, subroots, ["tree"]), fan_out, block_levels)
    outer = tops[-1].selectExpr("g", "0L AS block", "CAST(array() AS array<string>) AS lefts",
                                "CAST(array() AS array<string>) AS rights", "'' AS subroot", "digest AS root")
    for nodes, extra in [*((t, []) for t in tops[-2:0:-1]), (tops[0], ["tree"]), *((t, []) for t in tiers[-2:0:-1])]:
        outer = scratch.write(_descend(nodes, outer, fan_out, block_levels, extra, _outer_rows(fan_out, bool(extra)), _OUTER))
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = _descend(tiers[0], outer, fan_out, block_levels, ["id", "claim"], _folded_rows(fan_out, with_proof),
                   schema + (", proof array<struct<left:string,right:string>>" if with_proof else ""))
    return out.select(F.col("id").cast(id_type).alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"), *(["proof"] if with_proof else []))
