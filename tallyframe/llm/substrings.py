"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The references of a document are the documents with a smaller id.  Only those that
hold a window of it can give a factor, so seeds are found first, and a document is
parsed against the blocks that its seeds lead to:

1. *Phrase index.*  Each window of ``window`` words is named by the smallest hash
   among its 5-word phrases.  Blocks of the phrase index tell which phrases occur in
   two or more documents; only windows named by such a phrase can repeat.
2. *Seeds.*  The hash of each remaining window is looked up in the blocks of the
   window index, which name a document with a smaller id that holds it.
3. *Parse.*  A reference block holds the whole texts of the documents that seeds
   name (a hash of the id deals them into blocks) and indexes all their windows.  A
   document sends each block the stretches whose seeds lead there.  The block factors
   them greedily: at the first window that the index has, the factor grows as far as
   the words agree with the reference; words are compared, hashes only find the place.
   A factor shorter than a window is none.
4. *Boundaries.*  Windows that cross the end of a factor are not inside it: the parse
   goes on with the first of them, so the next factor may overlap the last one, and
   every window of a stretch is either inside a factor or looked up itself.
5. *Spans.*  The factors of all blocks are united; the words of a span go.

Phrases and windows are combined per task before they are shuffled, so a passage
that a third of all documents holds costs one entry per task in its block, and the
documents that share it name the smallest id of their own task's flush: its text is
compared with as many references as there are flushes, not with one.  The text itself
is shuffled once (the exchange is shared by all joins).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import blobs
from tallyframe.llm.words import Words, grams, mix, plain, spans

PHRASE = 5
#: Bytes of text for which a reference block is made; it holds the part that seeds name.
BLOCK_BYTES = 32 << 20

_HITS = "doc_id long, hashes binary"


def _window_names(h: np.ndarray, window: int) -> np.ndarray:
    """The smallest phrase hash of every window (also across rows)."""
    k = min(PHRASE, window)
    g = grams(h, k)
    left, have = window - k + 1, 1
    while have < left:  # minimum over `left` neighbours by doubling
        step = min(have, left - have)
        g = np.minimum(g[:-step], g[step:]) if len(g) > step else g[:0]
        have += step
    return g


def _rows(batch: pa.RecordBatch, window: int, names: bool = True):
    """Per row of (id, text, ...): (row, id, words, word hashes, first word, end, names
    of its windows); the last and the hashes only if asked for."""
    ids, text = batch.column(0), plain(batch.column(1))
    for lo, hi in spans(text):
        words = Words(text, lo, hi)
        h = words.hashes() if names else np.zeros(0, np.uint64)
        named = _window_names(h, window) if names else h
        for i, d in enumerate(ids.slice(lo, hi - lo).to_pylist()):
            a, b = int(words.first[i]), int(words.first[i + 1])
            n = max(0, b - a - window + 1)
            yield lo + i, d, words, i, h, a, b, named[a: a + n]


def _phrases(window: int, buckets: int):
    def run(batches):
        box = blobs.Combiner(buckets, keep="hash", lead=True)
        for batch in batches:
            for _, d, _, _, _, _, _, names in _rows(batch, window):
                if d is None or not len(names):
                    continue
                u = np.unique(names)
                box.add(u, np.full(len(u), d, dtype=np.int64))
                if box.full:
                    yield from box.flush()
        yield from box.flush()
    return run


def _by_doc(docs: np.ndarray, hashes: np.ndarray, refs: np.ndarray | None = None) -> pa.Table:
    """A row per document with its hashes (and a reference for each)."""
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    ends = pa.py_buffer(np.append(at, len(docs)).astype(np.int32) * 8)

    def packed(x: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(x[order])])

    out = {"doc_id": pa.array(docs[at], pa.int64()), "hashes": packed(hashes)}
    return pa.table(out if refs is None else out | {"refs": packed(refs)})


def _entries(table: pa.Table):
    return (*blobs.grouped(blobs.unpack(table, "hash", np.uint64), blobs.unpack(table, "id", np.int64)),
            blobs.unpack(table, "a", np.uint64), blobs.unpack(table, "b", np.int64))


def _shared(table: pa.Table) -> pa.Table:
    """Phrases that two or more documents hold, for each of them; (a, b) are those
    that a task has already seen twice."""
    h, d, lead, a, b = _entries(table)
    keep = d != lead
    if len(h):  # the first holder as well
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        keep = np.repeat(np.logical_or.reduceat(keep, at), np.diff(np.append(at, len(h))))
    d, h = d[keep], h[keep]
    return _by_doc(np.concatenate([d, b]), np.concatenate([h, a]))


def _repeats(table: pa.Table) -> pa.Table:
    """Windows of a document that also start in a document with a smaller id, and
    such a document."""
    h, d, lead, a, b = _entries(table)
    later = d > lead
    return _by_doc(np.concatenate([d[later], b]), np.concatenate([h[later], a]), np.concatenate([lead[later], blobs.unpack(table, "c", np.int64)]))


def _windows(window: int, buckets: int):
    def run(batches):
        box = blobs.Combiner(buckets, keep="lead")
        for batch in batches:
            shared = batch.column(2).to_pylist()
            for row, d, _, _, h, a, b, names in _rows(batch, window):
                if not len(names):
                    continue
                known = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in shared[row]]))
                at = np.minimum(np.searchsorted(known, names), len(known) - 1)
                hit = known[at] == names
                if not hit.any():
                    continue
                u = np.unique(grams(h[a:b], window)[hit])
                box.add(u, np.full(len(u), d, dtype=np.int64))
                if box.full:
                    yield from box.flush()
        yield from box.flush()
    return run


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The reference block of a document."""
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(blocks)).astype(np.int32)


def _references(blocks: int):
    """(doc_id, block) of the documents that seeds name."""
    def run(batches):
        for batch in batches:
            rows = [np.frombuffer(x["refs"], dtype=np.int64) for found in batch.column(0).to_pylist() for x in found]
            ids = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_block_of(ids, blocks), pa.int32())], ["doc_id", "block"])
    return run


def _plain_words(batches):
    """Whole references with their words joined by one blank."""
    for batch in batches:
        out = []
        text = plain(batch.column(1))
        for lo, hi in spans(text):
            words = Words(text, lo, hi)
            out += [_joined(words, int(a), np.ones(int(b - a), dtype=bool)) for a, b in zip(words.first[:-1], words.first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(out, pa.binary())], ["block", "doc_id", "words"])


def _text_key(words: Words, row: int) -> int:
    """Tells apart rows that share an id."""
    raw = words.data[words.rows[row]: words.rows[row + 1]]
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _stretches(window: int, blocks: int):
    """Per document and block: the stretches whose seeds lead there."""
    schema = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            seeds = batch.column(2).to_pylist()
            rows = []
            for row, d, words, own, h, a, b, names in _rows(batch, window):
                if not len(names):
                    continue
                known = np.concatenate([np.frombuffer(x["hashes"], dtype=np.uint64) for x in seeds[row]])
                refs = np.concatenate([np.frombuffer(x["refs"], dtype=np.int64) for x in seeds[row]])
                order = np.lexsort((refs, known))  # of several references the smallest
                known, refs = known[order], refs[order]
                w = grams(h[a:b], window)
                at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                place = np.flatnonzero(known[at] == w)
                if not len(place):
                    continue
                block = _block_of(refs[at[place]], blocks)
                key = _text_key(words, own)
                for k in np.unique(block).tolist():
                    mine = place[block == k]
                    cut = np.flatnonzero(np.diff(mine) > window)  # nearer ones share words
                    for lo, hi in zip(mine[np.append(0, cut + 1)].tolist(), mine[np.append(cut, len(mine) - 1)].tolist()):
                        keep = np.zeros(b - a, dtype=bool)
                        keep[lo: hi + window] = True
                        rows.append((k, d, key, lo, _joined(words, a, keep)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


class _Block:
    """Texts of a block as one run of words."""

    def __init__(self, column):
        text = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.words = Words(text, 0, len(text))
        self.hash, self.first = self.words.hashes(), self.words.first

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, inside one text) of the window at every word."""
        g = grams(self.hash, window)
        inside = np.zeros(len(self.hash), dtype=bool)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            inside[a: max(a, b - window + 1)] = True
        return g, inside[: len(g)]

    def bytes(self, lo: int, hi: int) -> np.ndarray:
        return self.words.data[self.words.start[lo]: self.words.end[hi - 1]]


def _agree(x: _Block, i: int, y: _Block, j: int, most: int) -> int:
    """How many words from ``i`` and from ``j`` on are the same, at most ``most``."""
    n, step = 0, 64
    while n < most:
        step = min(step, most - n)
        differ = np.flatnonzero(x.hash[i + n: i + n + step] != y.hash[j + n: j + n + step])
        if len(differ):
            n += int(differ[0])
            break
        n, step = n + step, 2 * step
    if n and np.array_equal(x.bytes(i, i + n), y.bytes(j, j + n)):
        return n
    # words of equal hash that differ: up to the first of them
    return next((k for k in range(n) if x.words.word(i + k) != y.words.word(j + k)), n)


def parse_block(window: int, asked: pa.Table, references: pa.Table) -> list[tuple]:
    """Factors (doc_id, key, from, to, reference, reference_from) of the stretches
    ``asked`` (doc_id, key, start, words) against the ``references`` (doc_id, words)."""
    if not len(asked) or not len(references):
        return []
    references = references.sort_by("doc_id")
    ids = references.column("doc_id").to_numpy()
    own, other = _Block(asked.column("words")), _Block(references.column("words"))
    g, inside = other.windows(window)
    place = np.flatnonzero(inside)
    order = place[np.argsort(g[place], kind="stable")]  # of equal windows that of the smallest id comes first
    index = g[order]
    if not len(index):
        return []
    w, whole = own.windows(window)
    found = np.searchsorted(index, w, "left")
    hit = np.flatnonzero(whole & (index[np.minimum(found, len(index) - 1)] == w))
    at = order[np.minimum(found[hit], len(index) - 1)]
    source = np.searchsorted(other.first, at, "right") - 1
    docs, keys, starts = (asked.column(c).to_numpy() for c in ("doc_id", "key", "start"))
    out = []
    edges = np.searchsorted(hit, own.first)
    for k in range(len(docs)):
        a, b, d = int(own.first[k]), int(own.first[k + 1]), int(docs[k])
        h, last = int(edges[k]), int(edges[k + 1])
        while h < last:
            i, j, r = int(hit[h]), int(at[h]), int(source[h])
            n = _agree(own, i, other, j, min(b - i, int(other.first[r + 1]) - j)) if ids[r] < d else 0
            if n < window:
                h += 1
                continue
            out.append((d, int(keys[k]), int(starts[k]) + i - a, int(starts[k]) + i - a + n, int(ids[r]), j - int(other.first[r])))
            # the first window that is not inside the factor
            h += int(np.searchsorted(hit[h:last], i + n - window + 1))
    return out


_FACTOR = pa.schema([(c, pa.int64()) for c in ("doc_id", "key", "from", "to", "reference", "reference_from")])


def _parsed(window: int, asked: pa.Table, references: pa.Table) -> pa.Table:
    rows = parse_block(window, asked, references)
    return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_FACTOR) if rows else _FACTOR.empty_table()


def united(factors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Factors [from, to) that overlap or touch as spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(factors):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cut(window: int, as_is: bool):
    def run(batches):
        for batch in batches:
            found = batch.column(2).to_pylist()
            text = batch.column(1)
            ids, n_words, n_removed, spans_out, factors, kept = [], [], [], [], [], []
            for row, d, words, own, _, a, b, _ in _rows(batch, window, names=False):
                mine = found[row] or []
                if mine:
                    key = _text_key(words, own)
                    mine = sorted((f for f in mine if f["key"] == key), key=lambda f: (f["from"], f["to"], f["reference"], f["reference_from"]))
                    mine = [f for f, before in zip(mine, [None, *mine]) if f != before]  # rows that repeat find the same
                cut = united([(f["from"], f["to"]) for f in mine])
                keep = np.ones(b - a, dtype=bool)
                for lo, hi in cut:
                    keep[lo:hi] = False
                ids.append(d)
                n_words.append(b - a)
                n_removed.append(int(b - a - keep.sum()))
                spans_out.append([{"from": lo, "to": hi} for lo, hi in cut])
                factors.append([{c: f[c] for c in _FACTOR.names[2:]} for f in mine])
                kept.append(text[row].as_py() if as_is and not cut else _joined(words, a, keep).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(spans_out, _SPANS), pa.array(factors, _FACTORS), pa.array(kept, pa.string()), batch.column(3)],
                ["doc_id", "n_words", "n_removed", "spans", "factors", "kept", "row"])
    return run


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_FACTORS = pa.list_(pa.struct([(c, pa.int64()) for c in _FACTOR.names[2:]]))


def _joined(words: Words, a: int, keep: np.ndarray) -> bytes:
    at = np.flatnonzero(keep) + a
    if not len(at):
        return b""
    # neighbours that one space separates are copied in one piece
    joint = np.flatnonzero((words.start[at[1:]] != words.end[at[:-1]] + 1) | (words.data[np.minimum(words.end[at[:-1]], len(words.data) - 1)] != 0x20)) + 1
    first, last = np.concatenate([[0], joint]), np.concatenate([joint - 1, [len(at) - 1]])
    pieces = [words.data[s:e].tobytes() for s, e in zip(words.start[at[first]].tolist(), words.end[at[last]].tolist(), strict=True)]
    return b" ".join(pieces)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                    carry: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """Cut from every document the words of factors of at least ``window`` words
    that also start in a document with a smaller id (words unchanged).

    Returns (doc_id, n_words, n_removed, spans, factors, kept, row): one row per row of
    ``docs``; ``kept`` joins the words left by one space (``as_is``: a text without
    a cut stays as it is, null too), ``factors`` are (from, to, reference,
    reference_from) in word positions, each equal to that stretch of the reference word
    by word, ``spans`` their union, ``row`` is a struct of the columns ``carry`` (null:
    none asked for).  All factors are judged on the
    input.  Null or empty text: no words.  Null id: kept whole, and it is nobody's
    reference.  Rows with equal id are no reference for each other.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    shuffles = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    # as computed columns both uses of this frame plan alike, and the exchange of the texts is shared
    some = own.filter("doc_id is not null").select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.concat("text", F.lit("")).alias("text"),
                                                   F.coalesce("row", F.lit(None)).alias("row"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = blobs.n_buckets(size // 10, shuffles)  # a fifth of the words, and the windows in the same order

    shared = (own.select("doc_id", "text").mapInArrow(_phrases(window, buckets), blobs.SCHEMA).groupBy("bucket").applyInArrow(_shared, _HITS)
              .groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes")))
    again = (some.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "hashes", "row")
             .mapInArrow(_windows(window, buckets), blobs.LEAD_SCHEMA).groupBy("bucket").applyInArrow(_repeats, "doc_id long, hashes binary, refs binary")
             .groupBy("doc_id").agg(F.collect_list(F.struct("hashes", "refs")).alias("seeds")))
    blocks = max(shuffles, -(-size // BLOCK_BYTES))
    named = again.select("seeds").mapInArrow(_references(blocks), "doc_id long, block int").distinct()
    library = (some.join(named.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "block", "row")
               .mapInArrow(_plain_words, "block int, doc_id long, words binary"))
    asked = (some.join(again.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "seeds", "row")
             .mapInArrow(_stretches(window, blocks), "block int, doc_id long, key long, start long, words binary"))
    numbers = T.StructType([T.StructField(c, T.LongType()) for c in _FACTOR.names])
    found = (asked.groupBy("block").cogroup(library.groupBy("block")).applyInArrow(lambda x, y: _parsed(window, x, y), numbers)
             .groupBy("doc_id").agg(F.collect_list(F.struct(*_FACTOR.names[1:])).alias("found")))
    joined = some.join(found.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "found", "row")
    rest = own.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast(joined.schema["found"].dataType).alias("found"), "row")
    span = T.StructType([T.StructField(c, T.LongType()) for c in ("from", "to")])
    factor = T.StructType([T.StructField(c, T.LongType()) for c in _FACTOR.names[2:]])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", T.ArrayType(span)), T.StructField("factors", T.ArrayType(factor)),
                           T.StructField("kept", T.StringType()), own.schema["row"]])
    return joined.unionByName(rest).mapInArrow(_cut(window, as_is), schema)
