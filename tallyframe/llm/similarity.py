"""N-gram Jaccard join: blocked sparse products of documents by n-grams.

The full incidence matrix has a row per document and a column per n-gram hash.
Which row blocks can hold a link at all is settled first, exactly:

1. *Column sums.*  Tasks count n-grams into ``SLOTS`` counters; columns whose summed
   counter stands out are common.
2. *Size-derived bound.*  A pair that links at similarity t differs in at most
   ``(1 - t) / (1 + t) * (|A| + |B|)`` columns.  The hash space is cut into more
   parts than that, so a linked pair has a number of identical non-empty parts, also
   when common columns are left out; a document that is left with too few parts
   uses its full parts as well.  Sizes are banded (ratio t), a document hashes
   its parts for its own band and for the next, so both sides of a pair meet in
   the band of the larger one.  How many equal parts a linked pair has at least
   (the same for all parts of a band) travels in the low bits of their hashes.
   Of parts that up to ``GROUP`` documents share, equal ones are counted by pair, and
   pairs below that number are discarded; documents with a part that more share are
   chained to the smallest id (combined before the shuffle, so a hot part costs a
   few entries a task).  The connected components of both are the candidate
   clusters: no link leaves one, and neither lines that many documents share nor
   what two unrelated documents happen to share chains anything.
3. Documents with equal n-gram sets are one class, only its smallest id goes on.
4. A cluster is cut into blocks of bounded rows and columns (by size band and a
   hash).  For each pair of blocks whose bands are compatible, one task
   accumulates the overlap counts as a product over column blocks and discards
   pairs below the bound.  A spanning forest of the block's links is returned,
   never all pairs of a group.
5. Components of the links, with the classes added back, are the result.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import blobs
from tallyframe.llm.graph import connected_components
from tallyframe.llm.words import Words, mix, plain, shingle_sets, spans
from tallyframe.session import stage

#: Rows and n-grams of a block of the product.
BLOCK_ROWS = 1024
BLOCK_GRAMS = 1_500_000
#: Columns multiplied at a time.
COLUMN_BLOCK = 4096
#: Counters of the column sums (a power of two); a bit for each is broadcast.
SLOTS = 1 << 21
_SLOT_SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)
#: Rows that a task's counters are sent in.
SLICES = 16
#: Documents of an equal part whose pairs are counted; more are chained.
GROUP = 8
#: Low bits of a part's hash: the equal parts asked of a pair.
_ASKED = np.uint64(63)


def band_of(n: int, percent: int) -> int:
    """Size band: linked sizes lie in the same or in neighbouring bands."""
    return int(math.log(n) / math.log(100 / (percent - 1)))


@lru_cache(None)
def band_parts(band: int, percent: int) -> tuple[int, int, int]:
    """(parts, largest size, equal parts asked of a pair) for pairs whose larger is
    in ``band``."""
    top = math.ceil((100 / (percent - 1)) ** (band + 1)) + 1
    differ = (100 - percent) * 2 * top // (100 + percent)
    return math.ceil(differ * 1.1) + 3, top, min(2 + differ // 16, int(_ASKED)) if differ else 1


def asked(h: np.ndarray) -> np.ndarray:
    """How many equal parts a pair must have to be linked, by a part's hash."""
    return (h & _ASKED).astype(np.int64)


def _parts_of(grams: np.ndarray, parts: int, tag: int) -> np.ndarray:
    """A hash of each non-empty part of a sorted set."""
    if not len(grams):
        return grams
    which = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    return mix(np.add.reduceat(mix(grams), at) + which[at] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(tag * 0x9E3779B1 + 7))


def part_hashes(grams: np.ndarray, common: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Part hashes of a sorted set for pairs of ``band``: of the parts without
    common columns, and where these are too few to be sure of as many identical ones
    as are asked, of the full parts; if these are too few as well, of the full parts
    with a single one asked, and if not even that is sure, one that such sets share.

    Of two linked sets, the one that stops first has so many parts of its last
    kind that those asked are among the other's, whatever differs."""
    parts, top, ask = band_parts(band, percent)
    n = len(grams)
    differ = (100 - percent) * (n + min(top, 100 * n // percent)) // (100 + percent)

    def asking(h, number):
        return (h & ~_ASKED) | np.uint64(number)

    out = _parts_of(grams[~common], parts, 4 * band)
    hashes = [asking(out, ask)]
    if len(out) >= differ + ask:
        return hashes[0]
    full = _parts_of(grams, parts, 4 * band + 1)
    hashes.append(asking(full, ask))
    if len(full) < differ + ask:
        if ask > 1:
            hashes.append(asking(mix(full), 1))
        if len(full) <= differ:
            hashes.append(asking(mix(np.array([4 * band + 2], dtype=np.uint64)), 1))
    return np.concatenate(hashes)


def common_slots(counts: np.ndarray, entries: int) -> np.ndarray:
    """Whether a counter stands out from the noise of an even spread of all
    ``entries`` over ``SLOTS``."""
    mean = entries / SLOTS
    return counts > mean + 4 * math.sqrt(mean) + 8


def _sets_of(batch: pa.RecordBatch, k: int):
    """(id, set) of a batch of (id, text); rows without an id are passed over."""
    ids, text = batch.column(0), plain(batch.column(1))
    for lo, hi in spans(text):
        sets = shingle_sets(Words(text, lo, hi, lower=True), k)
        for d, s in zip(ids.slice(lo, hi - lo).to_pylist(), sets, strict=True):
            yield d, s


_PROFILE = "doc_id long, n long, f1 long, f2 long, slice int, counts binary"
_PROFILE_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                            ("slice", pa.int32()), ("counts", pa.binary())])


def packed_counts(part: np.ndarray) -> bytes:
    """Counters up to 65,535, as their low bytes and their high bytes, deflated: a
    task's counters are mostly small and would be as large as its text."""
    return zlib.compress(np.minimum(part, 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def unpacked_counts(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(2, -1).T).view("<u2").ravel()


def _profiles(k: int):
    """A row per document (size and fingerprint of its set), and at last the
    task's counters, in slices (without those that are all zero)."""
    def run(batches):
        counts = np.zeros(SLOTS, dtype=np.uint32)
        waiting, held = [], 0

        def count():
            slots, times = np.unique(np.concatenate(waiting) >> _SLOT_SHIFT, return_counts=True)
            counts[slots] += times.astype(np.uint32)

        for batch in batches:
            rows = []
            for d, s in _sets_of(batch, k):
                rows.append((d, len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s).sum(dtype=np.uint64).view(np.int64))))
                waiting.append(s)
                held += len(s)
                if held > 500_000:
                    count()
                    waiting, held = [], 0
            yield _profile_rows([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], len(rows))
        if held:
            count()
        size = SLOTS // SLICES
        for i in range(SLICES):
            part = counts[i * size: (i + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"slice": i, "counts": packed_counts(part)}], schema=_PROFILE_ARROW)
    return run


def _profile_rows(columns, n: int) -> pa.RecordBatch:
    rest = [pa.nulls(n, f.type) for f in list(_PROFILE_ARROW)[4:]]
    return pa.RecordBatch.from_arrays([*columns, *rest], schema=_PROFILE_ARROW)


def _common(entries: int):
    """Bits of the counters of a slice that stand out."""
    def run(table: pa.Table) -> pa.Table:
        size = SLOTS // SLICES
        total = np.zeros(size, dtype=np.int64)
        for counts in table.column("counts"):
            total += unpacked_counts(counts.as_buffer())
        bits = np.packbits(common_slots(total, entries)).tobytes()
        return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([bits], pa.binary())})
    return run


def _parts(k: int, percent: int, buckets: int, slots):
    def run(batches):
        box = blobs.Combiner(buckets, keep="id", most=lambda h: np.where(asked(h) > 1, GROUP + 1, 1))
        stands_out = np.unpackbits(np.frombuffer(slots.value, dtype=np.uint8)).astype(bool)
        for batch in batches:
            for d, s in _sets_of(batch, k):
                if d is None or not len(s):
                    continue
                band, common = band_of(len(s), percent), stands_out[s >> _SLOT_SHIFT]
                h = np.concatenate([part_hashes(s, common, band + i, percent) for i in (0, 1)])
                box.add(h, np.full(len(h), d, dtype=np.int64))
                if box.full:
                    yield from box.flush()
        yield from box.flush()
    return run


_PAIRS = "lot int, a binary, b binary, equal binary, asked binary"
_PAIRS_ARROW = pa.schema([("lot", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("equal", pa.binary()), ("asked", pa.binary())])


def _chain(lots: int):
    """What a bucket's equal parts connect, packed by lot of pairs."""
    def run(table: pa.Table) -> pa.Table:
        a, b, equal, ask = _chained(table)
        lot = blobs.bucket_of(mix(mix(a.view(np.uint64)) + b.view(np.uint64)), lots)
        order = np.lexsort((b, a, lot))
        a, b, equal, ask = a[order], b[order], np.minimum(equal[order], 255).astype(np.uint8), ask[order].astype(np.uint8)
        cut = np.searchsorted(lot[order], np.arange(lots + 1))
        rows = [(k, blobs.planes(a[i:j]), blobs.planes(b[i:j]), equal[i:j].tobytes(), ask[i:j].tobytes()) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if i < j]
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PAIRS_ARROW)], schema=_PAIRS_ARROW)
    return run


def _settle(table: pa.Table) -> pa.Table:
    """The pairs of a lot that have as many equal parts in all as are asked."""
    a, b = (blobs.unpack(table, name, np.int64) for name in ("a", "b"))
    equal, ask = (np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=np.uint8).astype(np.int64) for name in ("equal", "asked"))
    a, b, equal, ask = _summed(a, b, equal, ask)
    enough = equal >= ask
    return pa.table({"a": pa.array(a[enough], pa.int64()), "b": pa.array(b[enough], pa.int64())})


def _summed(a, b, equal, ask):
    """Each pair once: its equal parts in all, the least number asked."""
    if not len(a):
        return a, b, equal, ask
    order = np.lexsort((b, a))
    a, b, equal, ask = a[order], b[order], equal[order], ask[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[at], b[at], np.add.reduceat(equal, at), np.minimum.reduceat(ask, at)


def _chained(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Stars on the smallest ids (one equal part, one asked), and pairs that are still
    to be settled, with how many equal parts they have here and must have in all."""
    h, d, lead, place, size = blobs.distinct(blobs.unpack(table, "hash", np.uint64), blobs.unpack(table, "id", np.int64))
    shared = size > 1
    h, d, lead, place, size = h[shared], d[shared], lead[shared], place[shared], size[shared]
    ask = asked(h)
    del h
    pairs = (size <= GROUP) & (ask > 1)
    x, y, number = [], [], []
    for k in range(1, GROUP):
        i = np.flatnonzero(pairs & (place + k < size))
        x.append(d[i])
        y.append(d[i + k])
        number.append(ask[i])
    x, y, number = np.concatenate(x), np.concatenate(y), np.concatenate(number)
    x, y, equal, number = _summed(x, y, np.ones(len(x), dtype=np.int64), number)
    more, sure = ~pairs & (place > 0), equal >= number
    root, node = blobs.stars(np.concatenate([blobs.unpack(table, "a", np.int64), lead[more], x[sure]]),
                             np.concatenate([blobs.unpack(table, "b", np.int64), d[more], y[sure]]))

    def root_of(ids):
        i = np.minimum(np.searchsorted(node, ids), max(len(node) - 1, 0))
        return np.where(node[i] == ids, root[i], ids) if len(node) else ids

    left = root_of(x) != root_of(y)
    one = np.ones(len(root), dtype=np.int64)
    return tuple(np.concatenate(c) for c in ((root, x[left]), (node, y[left]), (one, equal[left]), (one, number[left])))


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Counts of common n-grams of every row with every column set: the product
    of the two incidence blocks, over blocks of the columns that both use.  With
    ``rows is cols`` a row's count with itself is of no use."""
    if rows is cols:  # an n-gram of one row alone meets no other
        used, times = np.unique(np.concatenate(rows), return_counts=True)
        used = used[times > 1]
    else:
        used = np.intersect1d(np.concatenate(rows), np.concatenate(cols))
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)

    def entries(sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        g = np.concatenate(sets)
        at = np.minimum(np.searchsorted(used, g), max(len(used) - 1, 0))
        hit = used[at] == g if len(used) else np.zeros(len(g), dtype=bool)
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (r, x) = entries(rows)
    (c, y) = (r, x) if rows is cols else entries(cols)
    for lo in range(0, len(used), COLUMN_BLOCK):
        width = min(COLUMN_BLOCK, len(used) - lo)
        m = np.zeros((len(rows), width), np.float32)
        i, j = np.searchsorted(x, [lo, lo + width])
        m[r[i:j], x[i:j] - lo] = 1
        if rows is cols:
            out += m @ m.T
            continue
        n = np.zeros((len(cols), width), np.float32)
        i, j = np.searchsorted(y, [lo, lo + width])
        n[c[i:j], y[i:j] - lo] = 1
        out += m @ n.T
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a[i], b[i])."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _product(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()]
        left = [i for i in range(len(ids)) if side[i] == 0]
        right = [i for i in range(len(ids)) if side[i] == 1] or left
        a, b = [], []
        if left:
            size = np.array([len(s) for s in sets], dtype=np.int64)
            lefts = [sets[i] for i in left]
            n = overlaps(lefts, lefts if right is left else [sets[i] for i in right]).astype(np.int64)
            union = size[left][:, None] + size[right][None, :] - n
            i, j = np.nonzero(100 * n >= percent * union)
            a, b = ids[left][i], ids[right][j]
            keep = a != b
            a, b = a[keep], b[keep]
        links = _forest(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})
    return run


def _grams(k: int):
    """(doc_id, text, n, component, tasks) to (doc_id, component, tasks, grams);
    of an id with several texts, each takes the place of its own size."""
    def run(batches):
        for batch in batches:
            for lo, hi in spans(plain(batch.column(1))):
                part = batch.slice(lo, hi - lo)
                sets = [s for _, s in _sets_of(part.select([0, 1]), k)]
                at = pa.array([i for i, n in enumerate(part.column(2).to_pylist()) if len(sets[i]) == n], pa.int64())
                blob = pa.array([sets[i].tobytes() for i in at.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in (0, 3, 4)), blob], ["doc_id", "component", "tasks", "grams"])
    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       percent: int = 80) -> DataFrame:
    """Components under Jaccard similarity >= ``percent``/100 of ``words``-word
    shingle sets (A-Z lower-cased).

    Returns (doc_id, n_shingles, component_id): one row per row of ``docs``,
    whatever other columns it has.  Null or empty text: an empty set, linked
    with nothing.  Fewer words than ``words``: the whole sequence is one
    shingle.  Null id: kept, its component is null, it links nothing.  An
    id on several rows: each text links, and the id is one node.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = stage(own.mapInArrow(_profiles(words), _PROFILE), "profiles")
    total = profile.agg(F.sum("n")).first()[0] or 0
    bits = (profile.filter("slice is not null").select("slice", "counts").groupBy("slice")
            .applyInArrow(_common(total), "slice int, bits binary").collect())  # a bit a slot, whatever the input
    found = {r["slice"]: bytes(r["bits"]) for r in bits}
    slots = spark.sparkContext.broadcast(b"".join(found.get(i, bytes(SLOTS // SLICES // 8)) for i in range(SLICES)))
    profile = profile.filter("slice is null").select("doc_id", "n", "f1", "f2")

    known = profile.filter("doc_id is not null and n > 0")
    classes = known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    copies = known.join(classes.filter("rep < last"), ["n", "f1", "f2"]).filter("doc_id <> rep").select("rep", "doc_id", "n", "f1").distinct()
    copies = stage(copies, "copies")

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = blobs.n_buckets(total * (100 - percent) // 30, min(shuffles, 12))
    chains = (own.mapInArrow(_parts(words, percent, buckets, slots), blobs.SCHEMA).groupBy("bucket")
              .applyInArrow(_chain(max(min(shuffles, 12), buckets // 4)), _PAIRS).groupBy("lot").applyInArrow(_settle, "a long, b long"))
    clusters = stage(connected_components(chains), "clusters")

    # members that stand for a class, with their blocks
    member = (known.select("doc_id", "n", "f1").distinct().join(clusters.withColumnRenamed("node", "doc_id"), "doc_id")
              .join(copies, ["doc_id", "n", "f1"], "left_anti")
              .withColumn("band", F.floor(F.log("n") / math.log(100 / (percent - 1))).cast("int")))
    member = stage(member, "members")
    whole = member.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("g")).filter("k > 1")
    bands = (member.groupBy("component", "band").agg(F.count("*").alias("k"), F.sum("n").alias("g"))
             .select("component", "band", F.ceil(F.greatest(F.col("k") / BLOCK_ROWS, F.col("g") / BLOCK_GRAMS)).cast("int").alias("blocks")))
    small = (F.col("k") <= BLOCK_ROWS) & (F.col("g") <= BLOCK_GRAMS)
    below, above = (bands.select("component", (F.col("band") + d).alias("band"), F.col("blocks").alias(n)) for d, n in ((1, "below"), (-1, "above")))
    placed = (member.join(whole.select("component", small.alias("small")), "component")
              .join(bands, ["component", "band"]).join(below, ["component", "band"], "left").join(above, ["component", "band"], "left")
              .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    # side 0 is the lower band or block; a product is named by (band, block) of both sides
    own_block = F.struct(F.col("band").alias("p"), F.col("block").alias("i"), F.col("band").alias("q"), F.col("block").alias("j"), F.lit(0).alias("side"))

    def with_others(lo, hi, p, q, side):
        def make(x):
            i, j = (F.col("block"), x) if side == 0 else (x, F.col("block"))
            return F.struct(p.alias("p"), i.cast("int").alias("i"), q.alias("q"), j.cast("int").alias("j"), F.lit(side).alias("side"))
        return F.when(hi >= lo, F.transform(F.sequence(lo, hi), make)).otherwise(F.array().cast("array<struct<p:int,i:int,q:int,j:int,side:int>>"))

    band, block, zero = F.col("band"), F.col("block"), F.lit(0)
    tasks = F.concat(
        F.array(own_block),
        with_others(block + 1, F.col("blocks") - 1, band, band, 0),
        with_others(zero, block - 1, band, band, 1),
        with_others(zero, F.coalesce("above", zero) - 1, band, band + 1, 0),
        with_others(zero, F.coalesce("below", zero) - 1, band - 1, band, 1))
    one = F.array(F.struct(zero.alias("p"), zero.alias("i"), zero.alias("q"), zero.alias("j"), zero.alias("side")))
    placed = placed.select("doc_id", "n", "component", F.when(F.col("small"), one).otherwise(tasks).alias("tasks"))

    text = own.filter("doc_id is not null").join(placed.hint("shuffle_hash"), "doc_id")
    grams = text.select("doc_id", "text", "n", "component", "tasks").mapInArrow(
        _grams(words), "doc_id long, component long, tasks array<struct<p:int,i:int,q:int,j:int,side:int>>, grams binary")
    links = (grams.select("doc_id", "component", "grams", F.explode("tasks").alias("t")).select("doc_id", "component", "grams", "t.*")
             .groupBy("component", "p", "i", "q", "j").applyInArrow(_product(percent), "a long, b long"))
    links = links.unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    found = connected_components(links)
    return (profile.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
