"""A dataset manifest as a Merkle tree that is built by a butterfly exchange.

Leaves are numbered in order within their group and cut into aligned blocks of ``fanout ** levels`` leaves. A block hashes
its own subtree. Then, round by round, the ``fanout`` blocks whose numbers differ in one digit swap the roots of their
subtrees; each of them hashes the parent itself and appends the roots that it was sent to its proof. After the last round
every block holds the root and all upper siblings, so nothing is handed down from the root. A group whose number of blocks
is no power of the fanout is filled up with blocks without leaves: they hash like the others and hold no node where their
whole subtree is empty. The roots of the groups are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regspan.llm.common import map_slices
from regspan.session import durable

FANOUT, LEVELS = 2, 12
#: Fields of a document in the order in which its leaf holds them.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(fields: Iterable[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256))


def group_key(value: Column) -> Column:
    """A string that is never null and sorts like ``value`` by its bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(k, doc_id, leaf, told) of every row: its group, its true leaf, and the leaf that is told where it differs.

    Where ``tampered`` is true, the told row has one more n_chars; a null n_chars stays null.
    """
    as_text = {c: F.col(c).cast("string") for c in FIELDS}
    more = as_text | {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")}
    return docs.select(group_key(F.col("lang")).alias("k"), F.col("doc_id").cast("bigint").alias("doc_id"), _leaf(as_text.values()).alias("leaf"),
                       F.when(tampered, _leaf(more.values())).alias("told"))


def places(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, in ``order`` within k) and ``n`` (rows of that k).

    One range shuffle; equal rows may fall into several partitions, as each has a number of its own. Rows are numbered
    inside a partition, and counts per (partition, k) carry the offsets.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["k", *order, "_tie"]
    dealt = durable(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        *rows.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    of_part = dealt.groupBy("_part", "k").agg(F.count("*").alias("m"), F.min("_row").alias("first"))
    before = W.partitionBy("k").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = durable(of_part.select("_part", "k", (F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")).alias("_shift"),
                                   F.sum("m").over(W.partitionBy("k")).alias("n")))
    return dealt.join(shift, ["_part", "k"]).select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("place"), "n")


def _rise(level: list[bytes], fanout: int) -> list[bytes]:
    """The parents of nodes; nodes are digests in hex."""
    return [sha256(b"".join(level[i:i + fanout])).hexdigest().encode() for i in range(0, len(level), fanout)]


def _levels_inside(n: int, fanout: int, levels: int) -> int:
    """How many levels a block hashes: all of them, or those of a tree that is smaller than a block."""
    need = 0
    while need < levels and fanout ** need < n:
        need += 1
    return need


def _hex_nodes(table: pa.Table) -> list[bytes]:
    return [x.hex().encode() for x in table.column("leaf").to_pylist()]


def _block_roots(ranked: DataFrame, fanout: int, levels: int) -> DataFrame:
    size = fanout ** levels

    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n, nodes = table.column("n")[0].as_py(), _hex_nodes(table)
        for _ in range(_levels_inside(n, fanout, levels)):
            nodes = _rise(nodes, fanout)
        blocks, depth = -(-n // size), 0
        while fanout ** depth < blocks:
            depth += 1
        return pa.table({"k": [table.column("k")[0].as_py()], "n": pa.array([n], pa.int64()), "blocks": pa.array([blocks], pa.int64()),
                         "depth": pa.array([depth], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
                         "node": pa.array([bytes.fromhex(nodes[0].decode())], pa.binary())})

    return ranked.select("k", "place", "n", "leaf", "block").groupBy("k", "block").applyInArrow(
        root, "k string, n bigint, blocks bigint, depth int, block bigint, node binary")


def butterfly(roots: DataFrame, fanout: int) -> DataFrame:
    """(k, n, block, node, proof) of every block: the root of its group and the siblings from the block upwards.

    ``roots`` has (k, n, blocks, depth, block, node): a group of ``blocks`` blocks takes ``depth`` rounds. One round is one
    shuffle of narrow rows in groups of ``fanout`` and is written to the shared folder.
    """
    turns = F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("turn")  # real blocks are turn 0, others fill the group up
    filled = roots.select("*", turns).select("k", "n", "blocks", "depth", (F.col("block") + F.col("turn") * F.col("blocks")).alias("block"),
                                             F.when(F.col("turn") == 0, F.col("node")).alias("node"), F.array().cast("array<binary>").alias("proof"))
    state = durable(filled.where(F.col("block") < F.pow(F.lit(float(fanout)), "depth")))
    for step in range(state.agg(F.max("depth")).first()[0] or 0):
        apart = fanout ** step
        member = F.struct((F.expr(f"block div {apart}") % fanout).alias("digit"), "block", "node", "proof")
        run = state.where(F.col("depth") > step).groupBy(
            "k", "n", "blocks", "depth", F.expr(f"block div {apart * fanout}").alias("_up"), (F.col("block") % apart).alias("_low")).agg(
            F.array_sort(F.collect_list(member)).alias("run"))
        real = run.withColumn("real", F.filter("run", lambda m: m["node"].isNotNull()))
        text = F.array_join(F.transform("real", lambda m: F.lower(F.hex(m["node"]))), "")
        parent = real.withColumn("parent", F.when(F.size("real") > 0, F.unhex(F.sha2(text.cast("binary"), 256))))
        each = parent.select("k", "n", "blocks", "depth", "real", "parent", F.explode("run").alias("me"))
        sent = F.transform(F.filter("real", lambda m: m["digit"] != F.col("me.digit")), lambda m: m["node"])
        moved = each.select("k", "n", "blocks", "depth", F.col("me.block").alias("block"), F.col("parent").alias("node"), F.concat("me.proof", sent).alias("proof"))
        state = durable(moved.unionByName(state.where(F.col("depth") <= step)))
    return state.where("block < blocks").select("k", "n", "block", "node", "proof")


def _proofs(ranked: DataFrame, state: DataFrame, payload: list[str], fanout: int, levels: int) -> DataFrame:
    """Every leaf with the columns of its block's ``state`` and its whole ``proof``, siblings left to right, level by level."""
    sides, carried = ["place", "n", "leaf", *payload], [c for c in state.columns if c not in ("k", "block", "proof", "n")]
    kinds = {f.name: f.dataType.simpleString() for f in [*ranked.schema, *state.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*sides, *carried]) + ", proof array<binary>"

    def prove(mine: pa.Table, above: pa.Table) -> pa.Table:
        mine = mine.select(sides).sort_by("place")
        level = _hex_nodes(mine)
        proofs: list[list[bytes]] = [[] for _ in level]
        span = 1
        for _ in range(_levels_inside(mine.column("n")[0].as_py(), fanout, levels)):
            for i, proof in enumerate(proofs):
                at = i // span
                lo = at - at % fanout
                proof.extend(level[lo:at])
                proof.extend(level[at + 1:lo + fanout])
            level, span = _rise(level, fanout), span * fanout
        upper = above.column("proof")[0].as_py()
        whole = pa.array([[bytes.fromhex(x.decode()) for x in proof] + upper for proof in proofs], pa.list_(pa.binary()))
        for c in carried:
            mine = mine.append_column(c, pa.array([above.column(c)[0].as_py()] * len(proofs), above.schema.field(c).type))
        return mine.append_column("proof", whole)

    one = ranked.select("k", "block", *sides).groupBy("k", "block")
    return one.cogroup(state.drop("n").groupBy("k", "block")).applyInArrow(prove, schema)


def _blocked(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    return durable(places(rows, order).withColumn("block", F.expr(f"place div {size}")))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, told, place, n, subroot, root, top_place, top_n, proof) of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Leaves ascend by doc_id within their lang, null ids first and equal ids by their leaves; a null lang is a group of its
    own. Rows that repeat are leaves of their own. Null fields and empty texts have leaves like others; a text is hashed
    whole whatever its length. ``told`` is the leaf that a row shows, other than ``leaf`` only where ``tampered`` holds
    (null counts as false). Other columns are ignored, also those with names that the result uses. An empty table gives no
    rows.
    """
    size = fanout ** levels
    flag = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    ranked = _blocked(durable(leaves(docs, flag)), ["doc_id", "leaf"], size)
    state = butterfly(_block_roots(ranked, fanout, levels), fanout)
    groups = state.where("block = 0").select(F.lit("").alias("k"), F.col("k").alias("name"), F.col("node").alias("leaf"))
    top_ranked = _blocked(groups, ["name"], size)
    top_state = butterfly(_block_roots(top_ranked, fanout, levels), fanout)
    top = durable(_proofs(top_ranked, top_state, ["name"], fanout, levels).select(
        F.col("name").alias("k"), F.col("node").alias("root"), F.col("place").alias("top_place"), F.col("n").alias("top_n"), F.col("proof").alias("top_proof")))
    with_top = state.join(top, "k").select("k", "block", F.col("node").alias("subroot"), "root", "top_place", "top_n",
                                           F.concat("proof", "top_proof").alias("proof"))
    return _proofs(ranked, with_top, ["doc_id", "told"], fanout, levels)


def fold(leaf: bytes, proof: list[bytes], *trees: tuple[int, int], fanout: int = FANOUT) -> bytes:
    """The root (hex) that a leaf and its siblings (both hex) give; ``trees`` are (place, number of leaves) from the inner tree out."""
    node, used = leaf, 0
    for place, n in trees:
        while n > 1:
            own = place % fanout
            others = proof[used:used + min(fanout, n - place + own) - 1]
            used += len(others)
            node = sha256(b"".join([*others[:own], node, *others[own:]])).hexdigest().encode()
            place, n = place // fanout, -(-n // fanout)
    return node


def verify(proved: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) in hex, for rows of ``manifest``."""
    kept = ["leaf", "subroot", "root"]

    def run(batches):
        for b in batches:
            col = {name: b.column(name).to_pylist() for name in b.schema.names}
            digests, folded = [], []
            for i, proof in enumerate(col["proof"]):
                proof = [x.hex().encode() for x in proof]
                digests.append(sha256(b"".join(proof)).hexdigest())
                shown = (col["leaf"][i] if col["told"][i] is None else col["told"][i]).hex().encode()
                folded.append(fold(shown, proof, (col["place"][i], col["n"][i]), (col["top_place"][i], col["top_n"][i]), fanout=fanout).decode())
            shown = {name: [x.hex() for x in col[name]] for name in kept}
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(shown[name], pa.string()) for name in kept], pa.array(digests, pa.string()), pa.array(folded, pa.string()),
                 pa.array([a == b for a, b in zip(folded, shown["root"])], pa.bool_())],
                ["doc_id", *kept, "proof_sha256", "folded_root", "verified"])

    return map_slices(proved, run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
