"""Sharding by a hierarchical weighted hash tree.

A row descends from the root: at each level every child of the current node
draws ``-ln(u) / weight`` with ``u`` hashed from (row id, child name), and the
smallest draw wins.  A draw depends on nothing but the id, the child and its
weight, so a change of weights moves rows only between that child and the rest
of its level: growth by a node with a subtree of its own takes rows only into
that subtree.

Everything is built-in column expressions and one shuffle of narrow rows; the
text never moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import stage

#: Rows that one numbering bucket should hold.
BUCKET_ROWS = 250_000


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """``shards`` equal shards, ``per_rack`` in a rack and ``racks`` racks in a region."""
    per_region = racks * per_rack
    return [Shard(f"g{s // per_region}", f"k{s % per_region // per_rack}", s) for s in range(shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own: no other subtree's weight changes."""
    n = max((s.shard for s in tree), default=-1) + 1
    return [*tree, Shard(f"g+{n}", "k0", n, weight)]


def _draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u) / weight for u in (0, 1) from 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + node)).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def _descend(key: Column, tree: Sequence[Shard], level: int = 0, path: str = "") -> Column:
    parts: dict[str, list[Shard]] = {}
    for s in tree:
        parts.setdefault((s.region, s.rack, str(s.shard))[level], []).append(s)
    below = {n: (F.lit(p[0].shard).cast("int") if level == 2 else _descend(key, p, level + 1, f"{path}/{n}")) for n, p in parts.items()}
    if len(parts) == 1:
        return next(iter(below.values()))
    draws = F.least(*[F.struct(_draw(key, f"{path}/{n}", sum(s.weight for s in p)).alias("d"), F.lit(i).alias("i"))
                      for i, (n, p) in enumerate(parts.items())])["i"]
    names = list(parts)
    out = below[names[-1]]
    for i in reversed(range(len(names) - 1)):
        out = F.when(draws == i, below[names[i]]).otherwise(out)
    return out


def shard_of(key: Column, tree: Sequence[Shard]) -> Column:
    """The shard of a row by its id; a null id counts as the text ``null``.

    Nodes of weight 0 are left out; a tree without weight is an error."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), live)


def shard_rows(docs: DataFrame, tree: Sequence[Shard], grown_tree: Sequence[Shard], id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Place every row of ``docs`` on a shard and number the rows of each shard.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row
    per row of ``docs``, whatever other columns it has: ``size`` is the text's
    UTF-8 bytes (null: none) plus 1, ``text_crc32`` that of the bytes (null: of
    none), ``slot`` counts the rows of a shard from 0 without gaps, in the order
    of a hash bucket and the id.  Equal ids share a shard and have slots of their
    own; null ids are placed together.  An empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.col(id_col)
    rows = docs.select(key.alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), tree), "grown_shard": shard_of(F.col("doc_id"), grown_tree)})
    rows = stage(rows, "placed")
    n = rows.count()
    buckets = max(1, -(-n // (BUCKET_ROWS * max(1, len(tree)))))
    buckets = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, len(tree)) + 1)
    # equal rows (also rows with a null id) are dealt by their whole content
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("k"))
    # one row per shard and bucket: the running sum is over counts, not rows
    starts = counts.select("shard", "bucket", F.expr("coalesce(sum(k) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    numbered = rows.withColumn("at", F.expr("row_number() over (partition by shard, bucket order by doc_id, size, text_crc32)"))
    return (numbered.join(starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard"))
