"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from itertools import combinations

WORD = re.compile("[^\x20\x09-\x0d]+")

#: Columns that a table may have besides, called like columns of the operators.
CLASH = ["score", "n", "component", "bucket", "words", "path", "hash", "size", "shard", "text_crc32", "row", "kept", "p", "host"]


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def shingles(text, k):
    w = words(text, lower=True)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(docs, k, percent):
    """{id: (set size, component)} of {id: text}."""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {d: (len(sets[d]), root(d)) for d in docs}


def cut(rows, window):
    """[(n_words, n_removed, sha256)] of [(id, text)]."""
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            if d is not None:
                least[g] = min(least.get(g, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i:i + window])] < d:
                keep[i:i + window] = [False] * window
        left = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((len(w), len(w) - sum(keep), hashlib.sha256(left.encode()).hexdigest()))
    return out


def with_clash(df):
    """The table with columns of clashing names."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])
