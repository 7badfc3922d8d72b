"""Merkle manifest of a dataset: one digest for all rows, and a proof for each.

H is the lower-case hex SHA-256 of its inputs concatenated, digests as hex text.  A
leaf is H of the row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and
its value.  The leaves of a group (lang) ascend by doc_id, rows that repeat a doc_id
by their leaf; while a group has several nodes, every ``FANOUT`` consecutive ones
become their H, the last run possibly of fewer or of one.  What remains is the
group's subroot.  Subroots, ordered by group (null first, then bytewise), give the
root in the same way.

Method: sibling-shift self-joins.  A level is a table of nodes with a group and an
index.  A node's slot is its index modulo ``FANOUT``; the table of the nodes with slot s
is shifted back by s, so that it equijoins the nodes with slot zero by (group, index),
once for each s.  The rows with slot zero then hold their run and emit the parent;
each level is written, an eighth of the one below.  The key spreads a hot group over
all tasks.  Indices come from a running count over range-sorted rows, so no task
orders a whole group.

Proofs go the way back: the siblings above a node are its parent's siblings too, so a
run joins the path of its parent, and each of its nodes takes that path with its own
siblings in front.  What is shuffled for this is one path for each run, not for each
row.  A path is a list of (digests to the left, digests to the right) by level.

Defined cases: missing lang -> a group of its own, the first; missing doc_id -> ahead
of all others, never tampered with; missing text, source or n_chars -> ``-``; equal
rows -> a leaf each, in any order, since they are equal; a lone leaf is the subroot of
its group; a lone subroot is the root; empty table -> no rows; further columns are
not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from firmweave.llm.ordering import running
from firmweave.llm.tables import materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: dict[str, Column]) -> Column:
    """H of the fields: byte count, ``:`` and value each, ``-`` for null."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        framed = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(framed, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a check tampers with the row: where 3 divides crc32 of its decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _hash_all(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place within ``grp``, and ``n``, the rows of that group."""
    placed = running(rows, ["grp", *order])
    # written, so that Spark knows its size: broadcast while small, else joined by sorting
    groups = materialize(
        placed.groupBy("grp").agg(F.min("before").alias("first"), F.count("*").alias("n")), "merkle-groups"
    )
    return placed.join(groups, "grp").withColumn("idx", F.col("before") - F.col("first")).drop("before", "first")


class Tree:
    """The levels above some numbered nodes: (grp, idx, n, hash) and further columns."""

    def __init__(self, nodes: DataFrame, fanout: int = FANOUT):
        self.fanout = fanout
        self.items = [c for c in nodes.columns if c not in ("grp", "idx", "n", "hash")]
        self.nodes = materialize(nodes, "merkle-nodes")
        self.levels: list[DataFrame] = []
        most = self.nodes.agg(F.max("n")).first()[0] or 0
        level, items = self.nodes, self.items
        tops = []
        while True:
            tops.append(
                level.where("n = 1").select("grp", "hash", F.lit(len(self.levels)).alias("height"))
            )
            if most <= 1:
                break
            level, items = self._parents(level, items), []
            self.levels.append(level)
            most = -(-most // fanout)
        self.tops = materialize(_union(tops), "merkle-tops")

    def _parents(self, level: DataFrame, items: list[str]) -> DataFrame:
        """The next level: rows with slot zero meet their siblings and emit the parent."""
        many = level.where("n > 1").select(
            "grp", "idx", "n", F.struct("hash", *items).alias("node")
        )

        def slot(s: int) -> DataFrame:
            return many.where(F.col("idx") % self.fanout == s)

        run = slot(0).withColumnRenamed("node", "node_0")
        for s in range(1, self.fanout):
            sibling = slot(s).select(
                "grp", (F.col("idx") - s).alias("idx"), F.col("node").alias(f"node_{s}")
            )
            run = run.join(sibling, ["grp", "idx"], "left")
        held = F.array_compact(F.array(*[F.col(f"node_{s}") for s in range(self.fanout)]))
        return materialize(
            run.select(
                "grp",
                F.expr(f"idx div {self.fanout}").alias("idx"),
                F.expr(f"(n + {self.fanout - 1}) div {self.fanout}").alias("n"),
                held.alias("run"),
            ).withColumn("hash", _hash_all(F.col("run.hash"))),
            "merkle-level",
        )

    def paths(self, above: DataFrame) -> DataFrame:
        """The nodes with ``path``: their siblings by level, and what lies above their group.

        ``above`` has grp, path and further columns that every node of the group takes over.
        """
        given = [c for c in above.columns if c not in ("grp", "path")]
        tops = self.tops.join(above, "grp")
        reached = None
        for height in range(len(self.levels), -1, -1):
            own = tops.where(F.col("height") == height).select(
                "grp", F.lit(0).cast("long").alias("idx"), "path", *given
            )
            reached = own if reached is None else reached.unionByName(own)
            if not height:
                break
            level = self.levels[height - 1]
            runs = level.select("grp", "idx", "run").join(reached, ["grp", "idx"])
            each = runs.select("*", F.posexplode("run").alias("slot", "node"))
            left = F.array_join(F.slice("run.hash", F.lit(1), F.col("slot")), "")
            right = F.array_join(F.slice("run.hash", F.col("slot") + 2, F.lit(self.fanout)), "")
            items = [F.col(f"node.{c}").alias(c) for c in (["hash", *self.items] if height == 1 else [])]
            reached = each.select(
                "grp",
                (F.col("idx") * self.fanout + F.col("slot")).alias("idx"),
                F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "path").alias("path"),
                *given, *items,
            )
            if height == 1:
                lone = self.nodes.where("n = 1").select("grp", "idx", "hash", *self.items)
                alone = tops.where("height = 0").select("grp", "path", *given).join(lone, "grp")
                return reached.unionByName(alone)
        return reached.join(self.nodes.select("grp", "idx", "hash", *self.items), ["grp", "idx"])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def fold(start: Column, path: str) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, start, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per document: its leaf, subroot, the root, its path, and a check after tampering.

    Columns: doc_id, lang, leaf, subroot, root, path, proof_sha256 (H of the siblings by
    level, left to right), folded_root (recomputed from the leaf after tampering and the
    original siblings), verified (whether that is the root).
    """
    fields = {c: docs[c] for c in FIELDS}
    lowered = F.translate(docs["text"], UPPER, LOWER)
    hit = tampered(docs["doc_id"]) & (docs["text"] != lowered)
    leaves = materialize(
        docs.select(
            F.coalesce(F.concat(F.lit("="), docs["lang"]), F.lit("")).alias("grp"),
            docs["doc_id"].cast("long").alias("doc_id"),
            docs["lang"],
            leaf(fields).alias("hash"),
            F.when(hit, leaf({**fields, "text": lowered})).alias("changed"),
        ),
        "merkle-leaves",
    )
    tree = Tree(numbered(leaves, ["doc_id", "hash"]), fanout)
    top = Tree(
        numbered(
            tree.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash"), ["name"]
        ),
        fanout,
    )
    found = top.tops.select("hash").first()
    root = F.lit(found[0] if found else None).cast("string")
    nothing = top.tops.select(
        "grp", F.expr("CAST(array() AS array<struct<left: string, right: string>>)").alias("path")
    )
    subroots = top.paths(nothing).select(F.col("name").alias("grp"), "path", F.col("hash").alias("subroot"))
    rows = tree.paths(materialize(subroots, "merkle-subroots"))
    proof = _hash_all(F.transform("path", lambda p: F.concat(p["left"], p["right"])))
    return rows.select(
        "doc_id", "lang", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "path",
        proof.alias("proof_sha256"),
        fold(F.coalesce("changed", "hash"), "path").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
