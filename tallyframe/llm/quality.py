"""Quality by hierarchical empirical Bayes over a document classifier.

1. A logistic classifier on statistics of the text (lengths, character classes,
   repetition) gives each document its own evidence p.  It is fitted on at most
   ``MAX_LABELLED`` labelled rows outside the held-out quarter.
2. A host's rate is the mean evidence of its documents, shrunk towards the global
   rate; a path's rate is shrunk towards its host's.  Sums are grouped
   aggregations with map-side combine.  How strongly to shrink is estimated from
   the spread of the group means beyond sampling noise (method of moments).
3. The posterior of a document multiplies the odds of its evidence with the ratio
   of its path's odds to the global odds; a document's own evidence is taken out of
   its path's sums first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.toxicity import held_out
from tallyframe.llm.words import Words, plain, spans
from tallyframe.session import stage

#: Labelled rows that the classifier is fitted on (smallest hash first).
MAX_LABELLED = 20_000
FEATURES = ("log_words", "mean_word", "upper", "digits", "symbols", "sentence_marks", "other_marks", "long_words", "short_words",
            "distinct_words", "distinct_lines", "log_line", "symbol_ends", "spaces")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.float32)
    out[list(chars)] = 1
    return out


_UPPER = _class(bytes(range(65, 91)))
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_DIGIT = _class(b"0123456789")
_SYMBOL = _class(b"#$%&*+/<=>@[\\]^_`{|}~!")
_MARK = _class(b".,;:?")
_OTHER = _class(b"\"'()-")
_BLANK = _class(b" \t\n\x0b\x0c\r")


def _sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[rows[1:]] - total[rows[:-1]]


def features(text: pa.Array, lo: int, hi: int) -> np.ndarray:
    """One row of ``FEATURES`` per text; a text without words has zeros."""
    w = Words(text, lo, hi)
    n_words = np.diff(w.first).astype(np.float64)
    n_bytes = np.maximum(np.diff(w.rows), 1)
    size = (w.end - w.start).astype(np.float64)
    some = np.maximum(n_words, 1)
    per = lambda table: _sums(table[w.data], w.rows)
    letters = per(_LETTER)
    h = w.hashes()
    newline = w.data == 0x0A
    lines = _sums(newline, w.rows) + 1
    ends = _SYMBOL[w.data[w.end - 1]] if len(w) else np.zeros(0)
    distinct_words, distinct_lines = np.ones(hi - lo), np.ones(hi - lo)
    at = np.flatnonzero(newline)
    line_of = np.searchsorted(at, w.start)  # words of a line share its number
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b > a:
            distinct_words[i] = len(np.unique(h[a:b])) / (b - a)
            first = np.flatnonzero(np.concatenate([[True], line_of[a + 1: b] != line_of[a: b - 1]]))
            weight = (np.arange(b - a) - np.repeat(first, np.diff(np.append(first, b - a))) + 1).astype(np.uint64)
            distinct_lines[i] = len(np.unique(np.add.reduceat(h[a:b] * weight, first))) / len(first)
    out = np.stack([
        np.log1p(n_words), _sums(size, w.first) / some, per(_UPPER) / np.maximum(letters, 1), per(_DIGIT) / n_bytes, per(_SYMBOL) / n_bytes,
        per(_MARK) / some, per(_OTHER) / some, _sums(size > 14, w.first) / some, _sums(size < 3, w.first) / some,
        distinct_words, distinct_lines, np.log1p(n_words / lines), _sums(ends, w.first) / some, per(_BLANK) / n_bytes], axis=1)
    out[n_words == 0] = 0
    return out


def _with_features(batches):
    for batch in batches:
        text = plain(batch.column(batch.num_columns - 1))
        for lo, hi in spans(text):
            x = features(text, lo, hi)
            flat = pa.array(x.reshape(-1), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)), lists],
                                             [*batch.schema.names[:-1], "x"])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients) of a ridge logistic regression by Newton steps,
    with squares of the standardised features; the last coefficient is the constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = _design(x, mean, scale)
    beta = np.zeros(z.shape[1])
    penalty = np.diag(np.append(np.full(z.shape[1] - 1, ridge), 1e-6))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def _design(x, mean, scale):
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z, z * z / 8, np.ones((len(x), 1))], axis=1)


def _evidence(model):
    """The last column, a text, becomes ``p``."""
    def run(batches):
        for batch in batches:
            text = plain(batch.column(batch.num_columns - 1))
            for lo, hi in spans(text):
                z = _design(features(text, lo, hi), model[0], model[1]) @ model[2]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)), pa.array(p, pa.float64())],
                                                 [*batch.schema.names[:-1], "p"])
    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = MAX_LABELLED):
    """The classifier, from at most ``limit`` labelled rows (narrow, so they are
    broadcast); None if they hold one label only."""
    chosen = (labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
              .select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).dropDuplicates(["k"])
              .orderBy(F.xxhash64("k"), "k").limit(limit))
    rows = (docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text")).dropna(subset=["k"]).join(F.broadcast(chosen), "k")
            .select("k", "y", "text").mapInArrow(_with_features, "k long, y int, x array<double>"))
    got = rows.limit(2 * limit).toPandas()  # ids may repeat, so a little more
    if got["y"].nunique() < 2:
        return None
    got = got.sort_values("k", kind="stable")
    return fit(np.stack(got["x"].to_list()), got["y"].to_numpy(dtype=np.float64))


def _strength(groups: DataFrame, rate: str, prior: Column) -> float:
    """Pseudo-count of the prior from group counts ``n`` and ``rate``: the spread of
    the rates around their prior beyond the noise of their samples."""
    v = prior * (1 - prior)
    got = (groups.filter("n >= 2").agg(F.sum(F.col("n") * F.pow(F.col(rate) - prior, 2)).alias("between"), F.sum(v).alias("noise"),
                                       F.sum(F.col("n") * v).alias("weight")).first())
    if not got or not got.weight:
        return 10.0
    excess = max((got.between or 0.0) - (got.noise or 0.0), 0.0) / got.weight
    return min(max(1.0 / excess - 1.0, 1.0), 1000.0) if excess > 1e-6 else 1000.0


def _odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def hierarchical_quality(docs: DataFrame, model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
                         threshold: float = 0.5) -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, posterior, keep) for
    every row of ``docs``.

    Null or empty texts have the evidence of a text without words; null hosts
    and paths are groups of their own; without a model all evidence is one half.
    Rows with equal id are separate documents.  An empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                       F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    if model is None:
        scored = rows.select("doc_id", "host", "path", F.lit(0.5).alias("p"))
    else:
        scored = rows.mapInArrow(_evidence(model), "doc_id long, host string, path string, p double")
    scored = stage(scored, "evidence")
    paths = stage(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = float(total.s / total.n) if total.n else 0.5
    overall = min(max(overall, 1e-6), 1 - 1e-6)
    k_host = _strength(hosts.withColumn("m", F.col("s") / F.col("n")), "m", F.lit(overall))
    hosts = hosts.select("host", ((F.col("s") + k_host * overall) / (F.col("n") + k_host)).alias("host_rate"))
    paths = stage(paths.join(hosts, "host"), "rates")
    k_path = _strength(paths.withColumn("m", F.col("s") / F.col("n")), "m", F.col("host_rate"))
    joined = scored.join(paths, ["host", "path"])
    path_rate = (F.col("s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    out = joined.withColumn("path_rate", path_rate)
    z = _odds(F.col("p")) + _odds(F.col("path_rate")) - _odds(F.lit(overall))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).cast("int").alias("keep"))
