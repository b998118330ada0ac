"""A Merkle manifest of a dataset, with proofs checked by cogrouped subtree exchange.

Every row is a leaf, the SHA-256 of its fields. Leaves of a group (a source) stand in the order of their ids; runs of
``FAN`` consecutive nodes become their hash until one node, the group's subroot, is left, and the subroots become the
root in the same way. So a group can be checked alone, and the root names the whole dataset.

A group is cut into superblocks of ``SUPER`` consecutive leaves (whole small groups share one). Going up, each
superblock is reduced to its node by one task, and these nodes are the leaves of the next stage; a stage shrinks a
group by ``SUPER``, so there are as many stages as the largest group has powers of it. Going down, the nodes of a
superblock and the outer nodes it needs (the siblings on the way from its own node to the root) are cogrouped by
superblock: one task then has all it takes to finish the local reduction, join the proofs and fold them. No task holds
more than about two superblocks and some hundred outer nodes, however large a group is.

Defined results: a null field is written ``-``, so it differs from an empty one; rows with a null group are a group, the
first one; rows with a null id come first in their group; rows equal in group and id stand in the order of their leaf,
and repeated rows are leaves each; an empty table has no row and no root; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.llm.ranks import ranked
from namesieve.llm.shared import written

FAN = 16
#: Levels that one stage reduces, and the leaves of a superblock.
LEVELS = 3
SUPER = FAN**LEVELS
_NODE = "group_no long, at long, of long, base long, node string"
_OUTER = "group_no long, at long, path string, subroot string"
_SHARD = ["shard", "block"]


def encoded(value: Column) -> Column:
    """A field as its byte count, a colon and its text; a null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels over ``nodes``: up to a single one for a whole group, ``LEVELS`` for a piece of one."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        last = levels[-1]
        levels.append([_hash("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return levels


def _siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Per level the siblings before and after the node over leaf ``at``."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % FAN
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + FAN])))
        at //= FAN
    return out


def _pieces(rows: pd.DataFrame):
    """The pieces of different groups in one superblock, each in order."""
    rows = rows.sort_values(["group_no", "at"], kind="stable")
    for group_no, piece in rows.groupby("group_no", sort=False):
        yield group_no, piece, bool(piece["of"].iloc[0] <= SUPER)


def _sharded(nodes: DataFrame) -> DataFrame:
    large = F.col("of") > SUPER
    return nodes.select(
        "*",
        F.when(large, F.col("group_no")).otherwise(-1 - F.floor(F.col("base") / SUPER)).alias("shard"),
        F.when(large, F.floor(F.col("at") / SUPER)).otherwise(F.lit(0).cast("long")).alias("block"),
    )


def _reduced(rows: pd.DataFrame) -> pd.DataFrame:
    """One node for each piece, as a leaf of the next stage."""
    out = []
    for group_no, piece, whole in _pieces(rows):
        first = piece.iloc[0]
        top = _tree(piece["node"].tolist(), whole)[-1][0]
        out.append((group_no, first["at"] // SUPER, -(-first["of"] // SUPER), first["base"] // SUPER, top))
    return pd.DataFrame(out, columns=["group_no", "at", "of", "base", "node"])


def _stages(nodes: DataFrame, size: int, name: str) -> list[DataFrame]:
    """The tables of nodes from ``nodes`` up to one node per group, the largest of which has ``size`` nodes."""
    tables = [nodes]
    while size > 1:
        up = _sharded(tables[-1].select("group_no", "at", "of", "base", "node"))
        tables.append(written(up.groupBy(*_SHARD).applyInPandas(_reduced, _NODE), name))
        size = -(-size // SUPER)
    return tables


def _as_text(path: list[tuple[str, str]]) -> str:
    return "|".join(f"{left}/{right}" for left, right in path)


def _as_path(text: str) -> list[tuple[str, str]]:
    return [tuple(level.split("/")) for level in text.split("|")] if text else []


def _proofs(rows: pd.DataFrame, outer: pd.DataFrame):
    """Each row with its siblings on the whole way to the root, and what the outer table says of its group."""
    above = {r.outer_group_no: r for r in outer.itertuples()}
    for group_no, piece, whole in _pieces(rows):
        levels = _tree(piece["node"].tolist(), whole)
        rest = above[group_no]
        path = _as_path(rest.path)
        for i, row in enumerate(piece.itertuples()):
            yield row, _siblings(levels, i), path, rest


def _paths(own: bool):
    """Outer nodes for the stage below; with ``own``, the rows are subroots and name themselves."""

    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = [
            (r.group_no, r.at, _as_text(inner + path), r.node if own else rest.subroot)
            for r, inner, path, rest in _proofs(rows, outer)
        ]
        return pd.DataFrame(out, columns=["group_no", "at", "path", "subroot"])

    return run


def _verified(root: str, with_proof: bool):
    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r, inner, path, rest in _proofs(rows, outer):
            folded, proof = r.claim, []
            for left, right in (*inner, *path):
                folded = _hash(left + folded + right)
                proof.append(left + right)
            proof = "".join(proof)
            out.append((r.id, r.node, rest.subroot, root, _hash(proof), folded, proof if with_proof else None))
        return pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"])

    return run


def _cogrouped(rows: DataFrame, outer: DataFrame):
    """``rows`` with the outer nodes of the stage above, each brought to the superblock that it stands for."""
    rows = _sharded(rows)
    pieces = rows.groupBy(*_SHARD, "group_no", F.floor(F.col("at") / SUPER).alias("at")).agg(F.count("*").alias("n"))
    pieces = pieces.select(*[F.col(c).alias(f"outer_{c}") for c in (*_SHARD, "group_no", "at")])
    same = (F.col("outer_group_no") == F.col("group_no")) & (F.col("outer_at") == F.col("at"))
    needed = pieces.join(outer, same).select("outer_shard", "outer_block", "outer_group_no", "path", "subroot")
    return rows.groupBy(*_SHARD).cogroup(needed.groupBy("outer_shard", "outer_block"))


def _down(stages: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The outer nodes that the lowest stage needs, from those of its single nodes at the top."""
    for nodes in reversed(stages[1:-1]):
        found = _cogrouped(nodes.select("group_no", "at", "of", "base", "node"), outer)
        outer = written(found.applyInPandas(_paths(False), _OUTER), "merkle-outer")
    return outer


def manifest(
    docs: DataFrame, fields: Sequence[str], id_col: str, group_col: str, claims: dict[str, Column] | None = None
) -> DataFrame:
    """The leaves of a table: ``id``, ``group``, ``node`` and ``claim``.

    ``claim`` is the leaf of the data at hand: ``claims`` gives the fields whose values are to be taken from there.
    """
    own = [F.col(f"`{f}`") for f in fields]
    now = [(claims or {}).get(f, c) for f, c in zip(fields, own)]
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("group"),
        leaf(own).alias("node"), leaf(now).alias("claim"),
    )


def verify(leaves: DataFrame, with_proof: bool = False) -> DataFrame:
    """Per leaf its proof, and the root that folding the claimed leaf with that proof gives.

    ``leaves`` is what ``manifest`` returns. The result has ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``,
    ``folded_root``, ``verified``, and ``proof`` (all siblings, level by level) if asked for, else null.
    """
    spark = leaves.sparkSession
    id_type = leaves.schema["id"].dataType
    placed = ranked(written(leaves, "merkle-leaves"), "group", ["id", "node"], "merkle-order")
    # Python sees the ids as texts, as its integers know no null.
    placed = written(placed.withColumn("id", F.col("id").cast("string")).drop("group"), "merkle-placed")
    largest, groups = placed.agg(F.max("of"), F.max("group_no") + 1).first()
    if largest is None:
        groups, largest = 0, 0
    zero = F.lit(0).cast("long")
    stages = _stages(placed, largest, "merkle-nodes")
    subroots = stages[-1].select(
        zero.alias("group_no"), F.col("group_no").alias("at"), F.lit(groups).cast("long").alias("of"),
        zero.alias("base"), "node",
    )
    tops = _stages(subroots, groups, "merkle-subroots")
    top = tops[-1].first()
    end = spark.range(1).select(zero.alias("group_no"), zero.alias("at"), F.lit("").alias("path"), F.lit("").alias("subroot"))
    above = _cogrouped(subroots, _down(tops, end)).applyInPandas(_paths(True), _OUTER)
    above = above.select(F.col("at").alias("group_no"), zero.alias("at"), "path", "subroot")
    above = _down(stages, written(above, "merkle-outer"))
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, proof string"
    out = _cogrouped(placed, above).applyInPandas(_verified(top and top["node"], with_proof), schema)
    return out.select(F.col("id").cast(id_type).alias("id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"), "proof")
