"""A Merkle manifest of a dataset: a tree of sha256 digests over its rows, with a proof for each row.

Rows are leaves, in the order of their ids within a group (a language); every eight
consecutive nodes make a parent, until one is left, and the groups' roots are joined the same
way. Several levels at once are taken in windows over ``SPAN`` leaves: a node of a level is
at the row of its first leaf, its siblings are at fixed offsets before and after it (lag and
lead), masked by its slot in its run of eight and by the number of nodes of the level, and
the row of a run's first child hashes the parent. Rows between take their ancestors'
siblings from the last such row. The nodes that are left after a span's levels, one for each
span, are the leaves of the next round, and what it finds comes back by a join.

So no window is larger than a span, however many rows a group has; leaves travel as digests,
not as texts. Rows are numbered by ranges: each range counts its own, and a sum over the
ranges tells where it begins.

Defined results: a null field is ``-``; a null group comes first, as does a null id; rows of
one id are ordered by their digests, and equal rows are leaves each; a null id counts as the
empty text where an id's checksum is asked; no rows make an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.tables import cut_lineage, key_remainder

ARITY = 8
#: Levels that one window takes, and the leaves of such a window.
LEVELS = 3
SPAN = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def field_text(column: Column) -> Column:
    """UTF-8 byte count, a colon and the value; ``-`` for null."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in columns]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in the group (column group, not null) from 0, and ``total``, the rows of the group.

    Rows that agree in ``order`` are told apart by a number that is written down with them.
    """
    told = cut_lineage(rows.withColumn("_told", F.monotonically_increasing_id()))
    keys = ["group", *order, "_told"]
    # the upper bits of this number are the partition, the lower ones the place in it
    ranged = cut_lineage(told.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_told").withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy("_part", "group").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_part", "group", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("group")).alias("total"))
    return ranged.join(begins, ["_part", "group"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_shift", "_at")


def _children(digest: Column, level: int, over) -> list[Column]:
    """The digests at the slots after the first, for the row of a first child."""
    return [F.lead(digest, k * ARITY**level).over(over) for k in range(1, ARITY)]


def _climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (group, idx, total, digest) with the digest of each level at the rows of its nodes: d0, d1, ..."""
    over = Window.partitionBy("group", "_span").orderBy("idx")
    out = nodes.withColumn("_span", F.floor(F.col("idx") / SPAN).cast("long")).withColumn("d0", F.col("digest"))
    for level in range(LEVELS):
        step, d = ARITY**level, f"d{level}"
        joined = F.sha2(F.concat_ws("", F.col(d), *_children(F.col(d), level, over)), 256)
        # a level of one node is the top; its digest goes on as it is
        up = F.when(F.col("total") > step, joined).otherwise(F.col(d))
        out = out.withColumn(f"d{level + 1}", F.when(F.col("idx") % (ARITY * step) == 0, up))
    return out


def _with_path(climbed: DataFrame) -> DataFrame:
    """Each row with ``path``, the siblings (those before joined, those after joined) of its ancestor at each level that has any parent."""
    over = Window.partitionBy("group", "_span").orderBy("idx")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    sides = []
    for level in range(LEVELS):
        step, d = ARITY**level, F.col(f"d{level}")
        slot = F.floor(F.col("idx") / step) % ARITY
        left = F.concat_ws("", *[F.when(slot >= k, F.lag(d, k * step).over(over)) for k in range(ARITY - 1, 0, -1)])
        right = F.concat_ws("", *[F.when(slot + k < ARITY, F.lead(d, k * step).over(over)) for k in range(1, ARITY)])
        sides.append((F.when(d.isNotNull() & (F.col("total") > step), F.struct(left.alias("left"), right.alias("right")))).alias(f"_s{level}"))
    kept = [c for c in climbed.columns if c not in {f"d{k}" for k in range(LEVELS + 1)}]
    found = climbed.select(*kept, *sides)
    path = F.filter(F.array(*[F.last(f"_s{k}", ignorenulls=True).over(upto) for k in range(LEVELS)]), lambda s: s.isNotNull())
    return found.select(*kept, path.cast(_PATH).alias("path"))


def climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(the levels in rounds, each with the digests of its nodes; (group, subroot))."""
    rounds, nodes = [], leaves
    most = leaves.agg(F.max("total").alias("n")).first()["n"] or 0
    while True:
        rounds.append(_climbed(nodes))
        nodes = cut_lineage(rounds[-1].where(F.col("idx") % SPAN == 0).select("group", F.col("_span").alias("idx"), F.ceil(F.col("total") / SPAN).cast("long").alias("total"), F.col(f"d{LEVELS}").alias("digest")))
        if most <= SPAN:
            return rounds, nodes.select("group", F.col("digest").alias("subroot"))
        most = -(-most // SPAN)


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``path``, the siblings from the leaf's level up, and the other columns of ``above``.

    ``above`` has group and path, what is over the group's root. It meets the few nodes of
    the last round; from there, each span takes what is above it from the round before, so
    that leaves stay where their windows are.
    """
    keys = ["group"]
    for climbed in reversed(rounds):
        found = _with_path(climbed).join(above.withColumnRenamed("path", "_above"), keys)
        found = found.withColumn("path", F.concat("path", "_above")).drop("_above", "_span")
        if climbed is not rounds[0]:
            above = cut_lineage(found.drop("total", "digest").withColumnRenamed("idx", "_span"))
            keys = ["group", "_span"]
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def manifest(docs: DataFrame, group: str = "lang", tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path (siblings level by level) and folded_root of each row.

    ``tampered`` says which rows are folded as they would be with their texts' A-Z lower-cased.
    """
    columns = [F.col(c) for c in FIELDS]
    leaf = leaf_digest(columns)
    given = leaf if tampered is None else F.when(tampered, leaf_digest([*columns[:-1], F.translate("text", _UPPER, _LOWER)])).otherwise(leaf)
    # null comes first, in order and as a key that joins by equality
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("group"), leaf.alias("digest"), given.alias("given"))
    rounds, subroots = climb(cut_lineage(numbered(leaves, ["doc_id", "digest"])))
    tops = numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("_of"), F.col("subroot").alias("digest")), ["_of"])
    top_rounds, root = climb(cut_lineage(tops))
    over_root = root.select("group", F.col("subroot").alias("root"), F.array().cast(_PATH).alias("path"))
    groups = descend(top_rounds, over_root).select(F.col("_of").alias("group"), F.col("digest").alias("subroot"), "root", "path")
    found = descend(rounds, cut_lineage(groups))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", fold(F.col("given"), F.col("path")).alias("folded_root"))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, a third of the rows (by crc32 of the id) tampered with."""
    found = manifest(docs, tampered=key_remainder(F.col("doc_id"), 3) == 0)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
