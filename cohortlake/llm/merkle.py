"""Merkle manifest of a dataset: one tree per group, one tree over the groups' roots.

Leaves stand in order inside their group and are cut into aligned blocks of
``2 ** height``. A block's subtree is one byte string in van Emde Boas layout: a tree
is cut at half its height, the upper part is stored first, then each lower subtree,
every one of them by the same rule. The address of a node follows by arithmetic
(:func:`address`), for building as for fetching siblings, so that a path touches few
stretches of the string whatever the size of a cache line. Roots of blocks are the
leaves of the next layer, until a group has one block; the roots of the groups go
through the same layers. Blocks are rows: no task holds more than one of them at a time.

A node with no sibling (the last of an odd level) becomes the hash of itself alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import row_index
from .common import fold, save

DIGEST = 32
HEIGHT = 12
_BLOCK = "g long, n_blocks long, block long, n long, levels int, tree binary, root binary"


def field_hash(columns: list[str] | dict[str, Column]) -> Column:
    """sha256 (hex) of the columns' UTF-8 byte counts, ``:`` and values; ``-`` where null."""
    values = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
             for v in values.values()]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Slot of the ``index``-th node of ``depth`` (0: the root) in the van Emde Boas
    layout of a complete tree of ``levels`` levels."""
    index = np.asarray(index, np.int64)
    base = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        bottom = levels - top
        base += (1 << top) - 1 + (index >> (depth - top)) * ((1 << bottom) - 1)
        index = index & ((1 << (depth - top)) - 1)
        levels, depth = bottom, depth - top
    return base


def _parent(pair: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in pair).encode()).digest()


def build_subtree(digests: list[bytes], levels: int) -> bytes:
    """The subtree over up to ``2 ** (levels - 1)`` leaves, in van Emde Boas layout; absent nodes are zero."""
    out = bytearray(((1 << levels) - 1) * DIGEST)
    for depth in range(levels - 1, -1, -1):
        for slot, digest in zip(address(levels, depth, np.arange(len(digests))).tolist(), digests, strict=True):
            out[slot * DIGEST:(slot + 1) * DIGEST] = digest
        if depth:
            digests = [_parent(digests[i:i + 2]) for i in range(0, len(digests), 2)]
    return bytes(out)


def block_paths(tree: bytes, levels: int, n: int, places: list[int]) -> list[bytes]:
    """For each of the ``places`` among a subtree's ``n`` leaves its siblings, from the leaf's level
    upwards: ``L`` or ``R`` (where the sibling stands) and 32 bytes, or ``0`` where a level has none."""
    out = [[] for _ in places]
    at = np.array(places, np.int64)
    for depth in range(levels - 1, 0, -1):
        other = at ^ 1
        slots = (address(levels, depth, other) * DIGEST).tolist()
        for path, i, j, slot in zip(out, at.tolist(), other.tolist(), slots, strict=True):
            path.append(b"0" if j >= n else (b"L" if j < i else b"R") + tree[slot:slot + DIGEST])
        at, n = at >> 1, (n + 1) >> 1
    return [b"".join(path) for path in out]


def steps(path: bytes) -> list[tuple[str, bytes]]:
    """A path as ``(side, digest)`` pairs; the digest of side ``0`` is empty."""
    out, at = [], 0
    while at < len(path):
        side = chr(path[at])
        size = 0 if side == "0" else DIGEST
        out.append((side, path[at + 1:at + 1 + size]))
        at += 1 + size
    return out


def fold_path(digest: bytes, path: bytes) -> bytes:
    """The root that ``digest`` leads to along ``path``."""
    for side, other in steps(path):
        digest = _parent([other, digest] if side == "L" else [digest, other] if side == "R" else [digest])
    return digest


def _layer(members: DataFrame, height: int) -> DataFrame:
    """Blocks of ``members (g, n_members, idx, digest)``: one row with a subtree for each."""
    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        digests = [table.column("digest")[int(i)].as_py() for i in order]
        total, first = table.column("n_members")[0].as_py(), table.column("idx")[int(order[0])].as_py()
        n_blocks = ((total - 1) >> height) + 1
        levels = height + 1 if n_blocks > 1 else (total - 1).bit_length() + 1
        tree = build_subtree(digests, levels)
        row = {"g": table.column("g")[0].as_py(), "n_blocks": n_blocks, "block": first >> height, "n": len(digests), "levels": levels,
               "tree": tree, "root": tree[:DIGEST]}
        return pa.Table.from_pylist([row], schema=pa.schema([
            ("g", pa.int64()), ("n_blocks", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("levels", pa.int32()),
            ("tree", pa.binary()), ("root", pa.binary())]))

    keyed = members.select("g", "n_members", "idx", "digest", F.shiftright("idx", height).alias("block"))
    return save(keyed.groupBy("g", "block").applyInArrow(build, _BLOCK), "merkle-blocks")


def build_layers(members: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """All layers over ``members (g, n_members, idx, digest)`` and the roots ``(g, root)``."""
    layers, roots = [], None
    while True:
        blocks = _layer(members, height)
        done = blocks.where("n_blocks = 1").select("g", "root")
        layers.append(blocks)
        roots = done if roots is None else roots.unionAll(done)
        members = blocks.where("n_blocks > 1").select("g", F.col("n_blocks").alias("n_members"), F.col("block").alias("idx"),
                                                      F.col("root").alias("digest"))
        if members.isEmpty():
            return layers, roots


def _retrieve(members: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """``members (g, idx, ...)`` with ``path``: siblings inside their block, then the block's own path."""
    names = members.columns

    def walk(rows: pa.Table, block: pa.Table) -> pa.Table:
        tree, levels, n, above = (block.column(c)[0].as_py() for c in ("tree", "levels", "n", "path"))
        first = block.column("block")[0].as_py() << height
        paths = [p + above for p in block_paths(tree, levels, n, [i - first for i in rows.column("idx").to_pylist()])]
        return rows.select(names).append_column("path", pa.array(paths, pa.binary()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema) + ", path binary"
    left = members.withColumn("block", F.shiftright("idx", height)).groupBy("g", "block")
    return left.cogroup(blocks.groupBy("g", "block")).applyInArrow(walk, schema)


def sibling_paths(members: DataFrame, layers: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``members (g, idx, ...)`` of the lowest layer with their ``path`` up to the root of
    ``g`` and on along ``above (g, path)``."""
    found = None
    for i in range(len(layers) - 1, -1, -1):
        blocks = layers[i]
        paths = blocks.where("n_blocks = 1").join(above, "g").select(*blocks.columns, "path")
        if found is not None:
            upper = blocks.where("n_blocks > 1").join(found.select("g", F.col("idx").alias("block"), "path"), ["g", "block"])
            paths = paths.unionByName(upper.select(*paths.columns))
        below = layers[i - 1].where("n_blocks > 1").select("g", F.col("block").alias("idx")) if i else members
        found = _retrieve(below, paths, height)
    return found


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
             id_col: str = "doc_id", tamper: Column | None = None, tampered: dict[str, Column] | None = None,
             height: int = HEIGHT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` (and ``path``, the
    proof itself), one row per row of ``docs``.

    ``folded_root`` is what the leaf leads to along its original siblings; for rows where
    ``tamper`` holds, the leaf is hashed again with the ``tampered`` expressions in place
    of the columns they name. ``verified`` compares it with ``root``.

    A null field hashes as ``-``, an empty text as ``0:``; a null group is a group of its
    own and stands first, null ids stand first in their group; rows with equal ids stand
    by their leaf, and repeated rows are a leaf each. An empty table gives no rows.
    Columns that are not named are not read, so their names cannot clash.
    """
    values = {c: F.col(c) for c in columns}
    changed = field_hash({**values, **(tampered or {})})
    leaves = save(docs.select(F.col(id_col).alias("doc_id"), F.col(group).alias("grp"), F.unhex(field_hash(values)).alias("leaf"),
                              F.when(F.lit(False) if tamper is None else tamper, F.unhex(changed)).alias("changed")), "merkle-leaves")
    ordered = row_index(leaves, ["grp", "doc_id", "leaf"], "gi")
    sizes = ordered.groupBy("grp").agg(F.min("gi").alias("g"), F.count(F.lit(1)).alias("n_members"))
    groups = row_index(sizes, ["g"], "idx")  # a group is known by the index of its first leaf
    members = save(ordered.join(groups.select(F.col("grp").alias("_grp"), "g", "n_members"), F.col("grp").eqNullSafe(F.col("_grp")))
                   .select("g", "n_members", (F.col("gi") - F.col("g")).alias("idx"), F.col("leaf").alias("digest"), "doc_id", "changed"),
                   "merkle-members")
    layers, subroots = build_layers(members, height)
    n_groups = groups.count()
    tops = groups.select("g", "idx").join(subroots, "g").select(F.lit(0).cast("long").alias("g"), F.lit(n_groups).cast("long").alias("n_members"),
                                                                "idx", F.col("root").alias("digest"), F.col("g").alias("member"))
    top_layers, roots = build_layers(tops, height)
    nothing = roots.select("g", F.lit(b"").alias("path"))
    above = sibling_paths(tops.select("g", "idx", F.col("member"), F.col("digest").alias("subroot")), top_layers, nothing, height)
    above = save(above.join(roots, "g").select(F.col("member").alias("g"), "subroot", "root", "path"), "merkle-groups")
    found = sibling_paths(members.select("g", "idx", "doc_id", F.col("digest").alias("leaf"), "changed"), layers, above.select("g", "path"), height)
    found = found.join(above.drop("path"), "g")

    def judge(batches):
        for batch in batches:
            proofs, folded = [], []
            for leaf, new, path in zip(*(batch.column(c).to_pylist() for c in ("leaf", "changed", "path")), strict=True):
                proofs.append(hashlib.sha256("".join(d.hex() for _, d in steps(path)).encode()).hexdigest())
                folded.append(fold_path(leaf if new is None else new, path).hex())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array([x.hex() for x in batch.column(c).to_pylist()]) for c in ("leaf", "subroot", "root")]
                + [pa.array(proofs, pa.string()), pa.array(folded, pa.string()), batch.column("path")],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "path"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = found.mapInArrow(judge, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, path binary")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc_tampers(id_col: str = "doc_id", modulus: int = 7) -> Column:
    """Rows whose ``crc32`` of the decimal id is divisible by ``modulus``; never a null id."""
    return F.coalesce(fold(F.col(id_col), modulus) == 0, F.lit(False))
