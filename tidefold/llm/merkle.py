"""Merkle manifest: a tree of digests over the rows of each group and over the groups, and the proofs of its leaves.

The tree is built by supersteps over RDDs: every node sends its digest to its parent, a parent that has all its children
hashes them and goes on to the next step. Steps in reverse send each node what is beside and above it, down to the
leaves, which fold their digests up to the root again. A step's nodes are written to the shared folder, so a lost
executor costs that step; no node has more than ARITY children, so no key is hot, however large a group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts_of, shared_dir

ARITY = 8
#: Rows of a partition of sorted leaves, and children of a partition of a step, about. A step of so few needs no shuffle.
SORTED, STEP = 200_000, 20_000
#: A step of a path: a node's place among its siblings, and their digests in order, joined.
Step = tuple[int, bytes]


def field(c: Column) -> Column:
    """A value as it's hashed: its bytes' number, a colon and its text, or `-` for null."""
    v = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Digest of a row's values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def digest_of(children: Iterable[bytes]) -> bytes:
    """A parent's digest: of its children's in hex, joined."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def fold(digest: bytes, steps: Iterable[Step]) -> bytes:
    """What a leaf's digest comes to along a path."""
    for slot, others in steps:
        digest = digest_of([others[: 32 * slot], digest, others[32 * slot :]])
    return digest


def steps_of(n: int) -> int:
    """Supersteps that a tree of n leaves takes: one at least, which tells a lone leaf that it's the top."""
    k = 1
    while n > ARITY:
        n, k = -(-n // ARITY), k + 1
    return k


@dataclass
class Tree:
    """A built tree: the stored steps of the groups' trees and of the one above them, from the leaves up."""

    groups: list[RDD]
    top: list[RDD]
    root: bytes


def _by_key(rdd: RDD, parts: int) -> RDD:
    """(key, values) of (key, value) pairs, by a shuffle to some partitions, or within the one that holds STEP children at most."""

    def own(items: Iterable[tuple]) -> Iterable[tuple]:
        found: dict = {}
        for key, value in items:
            found.setdefault(key, []).append(value)
        return found.items()

    return rdd.groupByKey(parts).coalesce(parts) if parts > 1 else rdd.coalesce(1).mapPartitions(own)


def _family(item: tuple) -> tuple:
    """A node of the next level: (group, index, nodes of its children's level, children in order)."""
    (group, index), found = item
    children = sorted(found, key=lambda c: c[0])
    n = children[0][1]
    if [c[0] for c in children] != list(range(min(ARITY, n - ARITY * index))):
        raise RuntimeError(f"node {index} of group {group} has children {[c[0] for c in children]} of {n} nodes")
    return group, index, n, [c[2:] for c in children]


def _node(family: tuple) -> tuple:
    """(group, index, nodes of its level, digest) of a node that has its children; one alone stands for itself."""
    group, index, n, children = family
    return group, index, -(-n // ARITY), children[0][0] if n == 1 else digest_of(c[0] for c in children)


def _upward(messages: RDD, steps: int, children: int, folder: str) -> list[RDD]:
    """The stored supersteps; messages are ((group, index of the parent), (place, nodes of this level, digest, ...))."""
    out = []
    for k in range(steps):
        parts = -(-children // STEP)
        _by_key(messages, parts).map(_family).saveAsPickleFile(f"{folder}-{k}")
        out.append(messages.context.pickleFile(f"{folder}-{k}").coalesce(parts))
        going = out[-1].map(_node).filter(lambda x: x[2] > 1)
        messages = going.map(lambda x: ((x[0], x[1] // ARITY), (x[1] % ARITY, x[2], x[3])))
        children = -(-children // ARITY)
    return out


def _runs(index: int, rows: Iterable[tuple]) -> Iterator[tuple]:
    """(partition, groups, first group, its rows, last group, its rows, most rows of a group) of a sorted partition."""
    runs, most, first, last = 0, 0, None, None
    for group, own in groupby(rows, key=lambda r: r[0]):
        n = sum(1 for _ in own)
        first, last, runs, most = first or (group, n), (group, n), runs + 1, max(most, n)
    if runs:
        yield index, runs, *first, *last, most


def _placed(rows: RDD) -> tuple[RDD, int, int]:
    """Messages of sorted (group, ...) rows to their first parents; groups in all, and rows of the largest.

    Partitions are counted first. The driver adds up their ends, some numbers each, so that each partition knows the
    number of its first group, the rows of that group before it, and the rows of its first and its last group in all.
    """
    ends = sorted(rows.mapPartitionsWithIndex(_runs).collect(), key=lambda e: e[0])
    known, totals, groups, before, last = {}, {}, 0, 0, ()
    for index, runs, first, n_first, own_last, n_last, _ in ends:
        if last != (first,):
            groups, before = groups + 1, 0
        known[index] = (groups - 1, before, groups - 2 + runs)
        totals[groups - 1] = totals.get(groups - 1, 0) + n_first
        if runs > 1:
            groups, before = groups + runs - 1, 0
            totals[groups - 1] = n_last
        before, last = before + n_last, (own_last,)
    largest = max([*(e[6] for e in ends), *totals.values()], default=0)
    parts = {i: (g, b, totals[g], totals[g_last], g_last) for i, (g, b, g_last) in known.items()}
    shared = rows.context.broadcast(parts)

    def place(index: int, own: Iterable[tuple]) -> Iterator[tuple]:
        if index not in shared.value:
            return
        group, before, n_first, n_last, last = shared.value[index]
        for k, (_, run) in enumerate(groupby(own, key=lambda r: r[0])):
            g = group + k
            if k and g != last:
                run = list(run)  # a group that lies within the partition
            n = n_first if not k else n_last if g == last else len(run)
            for i, r in enumerate(run, 0 if k else before):
                yield (g, i // ARITY), (i % ARITY, n, bytes(r[2]), r[1], None if r[3] is None else bytes(r[3]))

    return rows.mapPartitionsWithIndex(place), groups, largest


def build(leaves: DataFrame, key: str = "doc_id", group: str = "lang", digest: str = "leaf", claimed: str | None = None) -> Tree | None:
    """The tree over a table of leaves' digests (32 bytes): by group in the order of the key, then over the groups in order.

    Null groups and keys come first, strings go by their bytes; leaves that share a key are in the order of their digests. A
    leaf may carry a second digest, `claimed`, that proofs() hands on beside it. None for an empty table.
    """
    spark = leaves.sparkSession
    other = F.col(claimed) if claimed else F.lit(None)
    rows = cut(leaves.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(digest).alias("d"), other.cast("binary").alias("c")), "leaves")
    n = rows.count()
    if not n:
        return None
    order = [F.col("g").asc_nulls_first(), F.col("k").asc_nulls_first(), F.col("d")]
    salt = F.monotonically_increasing_id()  # equal rows may be many, and are interchangeable
    ranges = rows.withColumn("s", salt).repartitionByRange(parts_of(rows, n, SORTED), *order, "s").sortWithinPartitions(*order).drop("s")
    messages, groups, largest = _placed(ranges.rdd.map(tuple))
    folder = shared_dir(spark)
    found = _upward(messages, steps_of(largest), n, f"{folder}/group")
    tops = [f.map(_node).filter(lambda x: x[2] == 1).map(lambda x, k=k: ((0, x[0] // ARITY), (x[0] % ARITY, groups, x[3], k))) for k, f in enumerate(found)]
    top = _upward(spark.sparkContext.union(tops), steps_of(groups), groups, f"{folder}/top")
    return Tree(found, top, _node(top[-1].first())[3])


def _below(families: RDD, above: RDD, parts: int) -> RDD:
    """(group, index, child, path) of every child: its place and siblings before the path of its parent."""

    def send(item: tuple) -> Iterator[tuple]:
        (group, index), found = item
        path, (n, children) = sorted(found, key=lambda x: isinstance(x, tuple))
        joined = b"".join(c[0] for c in children)
        for slot, c in enumerate(children):
            own = [] if n == 1 else [(slot, joined[: 32 * slot] + joined[32 * slot + 32 :])]
            yield group, ARITY * index + slot, c, own + path

    return _by_key(families.map(lambda f: ((f[0], f[1]), (f[2], f[3]))).union(above), parts).flatMap(send)


def _paths(spark: SparkSession, tree: Tree) -> RDD:
    """(key, digest, claimed digest, subroot, path to the root) of every leaf, by supersteps from the root down."""
    paths = spark.sparkContext.parallelize([((0, 0), [])], 1)
    for k in reversed(range(len(tree.top))):
        below = _below(tree.top[k], paths, tree.top[k].getNumPartitions())
        paths = below.map(lambda x: ((x[0], x[1]), x[3]))
    # a group's subroot starts at the step in which its tree was done
    starts = below.map(lambda x: (x[1], x[2][1], x[2][0], x[3]))
    down = None
    for k in reversed(range(len(tree.groups))):
        own = starts.filter(lambda x, k=k: x[1] == k).map(lambda x: ((x[0], 0), [(None, x[2]), *x[3]]))
        families = tree.groups[k]
        below = _below(families, own if down is None else own.union(down), families.getNumPartitions())
        down = below.map(lambda x: ((x[0], x[1]), x[3]))

    def leaf_of(x: tuple) -> tuple:
        digest, key, claimed = x[2]
        at = next(i for i, s in enumerate(x[3]) if s[0] is None)
        return key, digest, claimed, x[3][at][1], x[3][:at] + x[3][at + 1 :]

    return below.map(leaf_of)


def proofs(leaves: DataFrame, tree: Tree, key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot binary, steps): a leaf's place among its siblings and their digests joined, up to the root."""
    rows = _paths(leaves.sparkSession, tree).map(lambda x: (x[0], x[1], x[3], x[4]))
    kind = leaves.schema[key].dataType.simpleString()
    return leaves.sparkSession.createDataFrame(rows, f"`{key}` {kind}, leaf binary, subroot binary, steps array<struct<slot int, others binary>>", verifySchema=False)


def manifest(leaves: DataFrame, key: str = "doc_id", group: str = "lang", digest: str = "leaf", claimed: str | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf; digests in lowercase hex.

    proof_sha256 is the digest of all siblings' digests from the leaf up; folded_root is what the claimed digest, or where that
    is null the leaf's own, comes to along the proof, and verified whether it's the root. Null keys and groups, repeated
    rows and groups of one row are leaves like others; an empty table gives no rows; extra columns are not read.
    """
    spark, kind = leaves.sparkSession, leaves.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    tree = build(leaves, key, group, digest, claimed)
    if tree is None:
        return spark.createDataFrame([], schema)
    root = tree.root

    def verify(x: tuple) -> tuple:
        own, leaf_, other, subroot, steps = x
        end = fold(leaf_ if other is None else other, steps)
        return own, leaf_.hex(), subroot.hex(), root.hex(), digest_of(s[1] for s in steps).hex(), end.hex(), end == root

    return spark.createDataFrame(_paths(spark, tree).map(verify), schema, verifySchema=False)


def document_manifest(docs: DataFrame, changed: Column | None = None, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang") -> DataFrame:
    """manifest() of a table's rows over some columns; where `changed` holds, a row with A-Z of its text lower-cased is claimed.

    Rows are hashed where they are read; only digests, keys and groups are shuffled. Empty texts differ from null ones.
    """
    own = [F.col(c) for c in columns]
    low = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in columns]
    claimed = F.lit(None).cast("binary") if changed is None else F.when(changed, leaf(*low))
    leaves = docs.select(F.col(key), F.col(group), leaf(*own).alias("_leaf"), claimed.alias("_claimed"))
    return manifest(leaves, key, group, "_leaf", "_claimed")
