"""Merkle manifest of a table, with a version for every leaf that claims something else.

A row is a leaf: the digest of its columns. The leaves of a group, by id, and in the end the roots of the groups, by group, are hashed two
by two until one node is left. Each group is cut into aligned blocks of 2 ** ``BITS`` nodes; a block keeps its part of the tree, level by
level, and its top node is a node of the blocks above, so a tree of any size is built by a few aggregations of bounded groups.

The tree is persistent: a changed leaf makes a version that copies its ancestors only and shares every other node with the base tree. The
copies within the leaf's block are made there; the version then goes on, row by row, along the path of its block in the upper blocks.

Defined results: a null in a column counts as ``-``; a null id or group comes first; equal ids are ordered by their leaves and equal leaves
stand in any order, which changes no digest; a group of one leaf is that leaf; a single group is the root; an empty table gives an empty
result. Input columns of other names are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import quoted
from rillmark.operators.scan import null_safe_join, positions
from rillmark.session import materialise

#: Levels of a block: it holds up to 1024 nodes and what is above them.
BITS = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Digest of values: ``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    texts = [value.cast("string") for value in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts])


def _above(nodes: Column) -> Column:
    """Digests of each two consecutive nodes, of the last one alone if their number is odd."""
    pairs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1))
    return F.transform(pairs, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def blocks(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``block``, ``total`` (nodes of the key), ``nodes`` and ``levels`` (digests, from the nodes up) of the aligned blocks of
    ``nodes``: ``keys``, ``index`` from 0, ``total``, ``digest`` and any more columns."""
    more = [name for name in nodes.columns if name not in (*keys, "index", "total")]
    out = nodes.groupBy(*keys, F.shiftright("index", BITS).alias("block"), "total").agg(
        F.sort_array(F.collect_list(F.struct("index", *more))).alias("nodes"))
    out = out.withColumn("level_0", F.transform("nodes", lambda node: node["digest"]))
    for level in range(BITS):  # columns of their own, so that each is evaluated once
        own = F.col(f"level_{level}")
        out = out.withColumn(f"level_{level + 1}", F.when(F.col("total") > (1 << level), _above(own)).otherwise(own))
    return out.select(*keys, "block", "total", "nodes", F.array(*[f"level_{level}" for level in range(BITS + 1)]).alias("levels"))


def _path(index: Column) -> Column:
    """Siblings of a node, up to the top of its block: array<struct<sibling, right>>; ``''`` if there is none, ``right`` if the node comes second."""
    steps = []
    for level in range(BITS):
        at = F.shiftright(index.bitwiseAND((1 << BITS) - 1), level).cast("int")
        sibling = F.coalesce(F.get(F.get(F.col("levels"), level), at.bitwiseXOR(F.lit(1))), F.lit(""))
        steps.append(F.when(F.col("total") > (1 << level), F.struct(sibling.alias("sibling"), (at.bitwiseAND(1) == 1).alias("right"))))
    return F.filter(F.array(*steps), lambda step: step.isNotNull())


def copies(first: Column, path: Column) -> Column:
    """The nodes of a version along a path: ``first`` and its copied ancestors, with the shared siblings."""

    def copied(own: Column, step: Column) -> Column:
        node = F.element_at(own, -1)
        return F.concat(own, F.array(F.when(step["right"], digest(step["sibling"], node)).otherwise(digest(node, step["sibling"]))))

    return F.aggregate(path, F.array(first), copied)


def ascend(nodes: DataFrame, keys: Sequence[str], finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` with ``path``, the siblings up to the root, and what ``finish`` adds to the last node of each key.

    A ``claimed`` digest among the columns gives ``version``: the nodes copied on the way to the root of the key.
    """
    if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
        return finish(nodes)
    whole = materialise(blocks(nodes, keys), "merkle-blocks")
    parents = whole.select(*keys, F.col("block").alias("index"), F.ceil(F.col("total") / (1 << BITS)).alias("total"),
                           whole["levels"][BITS][0].alias("digest"))
    upper = ascend(parents, keys, finish).drop("total", "digest").withColumnsRenamed({"index": "block", "path": "upper_path"})
    both = null_safe_join(whole, upper, [*keys, "block"])  # one row for each block
    own = [name for name in nodes.columns if name not in (*keys, "total")]
    versions = "claimed" in own

    def placed(node: Column) -> Column:
        return F.struct(*[node[name].alias(name) for name in own], _path(node["index"]).alias("path"))

    more = [name for name in upper.columns if name not in (*keys, "block", "upper_path")]
    each = both.select(*keys, "total", "upper_path", *more, F.explode(F.transform("nodes", placed)).alias("node"))
    each = each.select(*keys, "total", "upper_path", *more, "node.*")
    if versions:
        each = each.withColumn("version", copies(F.col("claimed"), F.col("path")))
        each = each.withColumn("version", F.concat("version", F.slice(copies(F.element_at("version", -1), F.col("upper_path")), 2, 1 << 20)))
    return each.withColumn("path", F.concat("path", "upper_path")).drop("upper_path")


_NO_PATH = "array<struct<sibling:string,right:boolean>>"


def manifest(df: DataFrame, claims: Mapping[str, Column] | None = None, columns: Sequence[str] = COLUMNS, doc_id: str = "doc_id",
             group: str = "lang") -> DataFrame:
    """``doc_id``, ``group``, ``leaf``, ``subroot``, ``root``, ``path``, ``claimed`` and ``version``.

    ``claims`` gives other values of some columns; the version of a row holds its claimed leaf and all its copied ancestors, the last of
    which is the root that the claim leads to.
    """
    claims = dict(claims or {})
    rows = df.select(quoted(doc_id).alias("doc_id"), quoted(group).alias("group"), leaf([quoted(name) for name in columns]).alias("digest"),
                     leaf([claims.get(name, quoted(name)) for name in columns]).alias("claimed"))
    leaves = positions(materialise(rows, "merkle-leaves"), ["group"], ["doc_id", "digest"], "index", "total")
    leaves = leaves.withColumn("index", F.col("index") - 1)
    empty = F.array().cast(_NO_PATH)

    def finish_all(tops: DataFrame) -> DataFrame:
        return tops.withColumns({"path": empty, "root": F.col("digest")})

    def finish_group(tops: DataFrame) -> DataFrame:
        tops = materialise(tops, "merkle-subroots")
        roots = positions(tops.select("group", F.col("digest")), [], ["group"], "index", "total").withColumn("index", F.col("index") - 1)
        paths = ascend(roots, [], finish_all).select("group", "path", "root", F.col("digest").alias("subroot"))
        found = null_safe_join(tops, paths, ["group"])
        if "claimed" in tops.columns:  # every group is a single leaf
            found = found.withColumn("version", copies(F.col("claimed"), F.col("path")))
        return found

    return ascend(leaves, ["group"], finish_group).select(
        "doc_id", "group", F.col("digest").alias("leaf"), "subroot", "root", "path", "claimed", "version")
