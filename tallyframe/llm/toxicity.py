"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, accents and look-alike letters of other
scripts to Latin, digit and sign substitutions to letters, zero-width characters
gone.  The lexicon holds words and word beginnings with a weight each; exception
phrases are longer entries whose match cancels the terms inside it.  A text's
evidence is the summed weight per (damped) length, squashed to 0..1.

The lexicon can be learned from labelled texts: tasks count in how many toxic
and clean texts each folded word and word beginning occurs,
counts are added up by a grouped aggregation, and only terms that clearly lean to
toxic texts travel on (the bounded sample bounds them).  Rarer terms are then looked for in
the toxic texts that the terms so far do not explain, until none is significant;
how far to go is chosen by cross-validation.  A last pass over the same texts
finds exception phrases and the evidence at which to call a text toxic.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from dataclasses import dataclass
from statistics import NormalDist

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.words import plain
from tallyframe.session import stage

#: Labelled texts that the lexicon is learned from (smallest hash first).
MAX_LABELLED = 20_000
#: Lengths of word beginnings.
STEMS = range(4, 8)
#: Parts of the labelled texts for cross-validation, by a hash of the text.
FOLDS = 3
#: Rounds of looking for terms; each lowers the bar to ``least_share`` of the last.
ROUNDS = 6
#: Chance that any term is kept without leaning to toxic texts.
ALPHA = 0.01

# Letters that look like Latin ones, by script, and characters read as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "i"}
IGNORED = "​‌‍⁠﻿­"

_DROP = dict.fromkeys(map(ord, IGNORED))


class _Table(dict):
    """Code point to folded text, filled as characters turn up."""

    def __missing__(self, code: int):
        c = chr(code)
        out = []
        for x in unicodedata.normalize("NFKD", c.lower()):
            if unicodedata.combining(x):
                continue
            x = LOOKALIKES.get(x, SUBSTITUTES.get(x, x))
            out.append(x if x.isalpha() else " ")
        self[code] = "".join(out)
        return self[code]


_FOLD = _Table(_DROP)


def fold(text: str) -> str:
    """A text as folded words, one space between them and around."""
    return " " + " ".join(text.translate(_FOLD).split()) + " "


def _features(words: list[str]) -> set[str]:
    """Words `` w `` and beginnings `` stem``."""
    own = set(words)
    out = {f" {w} " for w in own}
    for n in STEMS:
        out.update(" " + w[:n] for w in own if len(w) > n)
    return out


def _fold_of(text: str) -> int:
    """The part of a text: copies are in one part."""
    return zlib.crc32(text.encode()) % FOLDS


def _tallied(of, columns: list[str]):
    """Counts by term of the places that ``of(text, label)`` names in ``columns``;
    the empty term counts texts."""
    def run(batches):
        tally: dict[str, list[int]] = {"": [0] * len(columns)}
        for batch in batches:
            for text, label in zip(plain(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places = of(text, label)
                for t in ["", *_features(fold(text).split())] if places else ():
                    row = tally.setdefault(t, [0] * len(columns))
                    for i in places:
                        row[i] += 1
            if len(tally) > 200_000:
                yield _counts(tally, columns)
                tally = {}
        yield _counts(tally, columns)
    return run


def _counts(tally, columns):
    return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), *(pa.array([v[i] for v in tally.values()], pa.int64()) for i in range(len(columns)))],
                                      ["term", *columns])


def _sums(rows: DataFrame, of, columns: list[str]) -> DataFrame:
    schema = ", ".join(["term string", *(f"{c} long" for c in columns)])
    return rows.mapInArrow(_tallied(of, columns), schema).groupBy("term").agg(*[F.sum(c).alias(c) for c in columns])


def _unexplained(lexica: list[dict[str, float]]):
    """Which lexica were not learned from a toxic text's part and have no term of
    half their heaviest weight in it."""
    heaviest = [max(terms.values(), default=0.0) for terms in lexica]
    strong = [{t: w for t, w in terms.items() if 2 * w >= top} for terms, top in zip(lexica, heaviest, strict=True)]
    autos: list = []

    def of(text: str, label: int) -> list[int]:
        if not autos:
            autos.extend(matcher(Lexicon(terms)) for terms in strong)
        if not label:
            return []
        own, folded = _fold_of(text), fold(text)
        return [v for v, auto in enumerate(autos) if v != own and strong[v] and not evidence(auto, folded)]
    return of


@dataclass(frozen=True)
class Lexicon:
    """Weighted terms, exception phrases and the rate of evidence that scores 0.3."""

    terms: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    cut: float = 1.0


def _leaning(toxic, clean, n_toxic: int, n_clean: int) -> Column:
    """G-squared of a term's counts against the two totals."""
    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, k = n_toxic + n_clean, toxic + clean
    return 2 * (part(toxic, k * n_toxic / n) + part(clean, k * n_clean / n)
                + part(n_toxic - toxic, (n - k) * n_toxic / n) + part(n_clean - clean, (n - k) * n_clean / n))


def _rates(lexica: list[dict[str, float]]):
    """Per text: its label, part, and rate of evidence under each lexicon."""
    def run(batches):
        autos = [matcher(Lexicon(terms)) for terms in lexica]
        for batch in batches:
            parts, rates = [], []
            for text in plain(batch.column(0)).to_pylist():
                f = fold(text)
                parts.append(_fold_of(text))
                rates.append([rate(evidence(auto, f), f.count(" ") - 1) for auto in autos])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(parts, pa.int32()), pa.array(rates, pa.list_(pa.float64()))], ["label", "part", "rates"])
    return run


def _second_look(terms: dict[str, float]):
    """Per text: its label, rate of evidence, and neighbours of matched whole words."""
    def run(batches):
        auto = matcher(Lexicon(terms))
        for batch in batches:
            rates, pairs = [], []
            for text in plain(batch.column(0)).to_pylist():
                f = fold(text)
                rates.append(rate(evidence(auto, f), f.count(" ") - 1))
                words = f.split()
                hit = [i for i, w in enumerate(words) if f" {w} " in terms]
                pairs.append(sorted({f" {words[j]} {words[j + 1]} " for i in hit for j in (i - 1, i) if 0 <= j < len(words) - 1}))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rates, pa.float64()), pa.array(pairs, pa.list_(pa.string()))], ["label", "rate", "pairs"])
    return run


def best_cut(rates: list[tuple[float, int]]) -> float:
    """The rate that parts the labels best (F1); of equally good ones the
    geometric middle."""
    rates = sorted((r, t) for r, t in rates)
    hits = total = sum(t for _, t in rates)
    best, span, i = -1.0, (1.0, 1.0), 0
    below = 0.0
    while i < len(rates):
        r = rates[i][0]
        f1 = 2 * hits / max(1, hits + len(rates) - i + total - hits)
        if r > 0 and f1 > best:
            best, span = f1, (below or r / 4, r)
        below = r
        while i < len(rates) and rates[i][0] == r:
            hits -= rates[i][1]
            i += 1
    return math.sqrt(span[0] * span[1])


def _rounds(rows: DataFrame, least_toxic: int, least_leaning: float, least_share: float) -> list[list[dict[str, float]]]:
    """By round, the terms learned without part 0, 1, ..., and from all parts."""
    parts = [(f"clean{i}", f"toxic{i}") for i in range(FOLDS)]
    columns = [c for pair in parts for c in pair]
    counts = _sums(rows, lambda text, label: [2 * _fold_of(text) + label], columns)
    some = sum((F.col(t) for _, t in parts[1:]), F.col(parts[0][1]))
    counts = stage(counts.filter((F.col("term") == "") | (some >= least_toxic)), "counts")
    n_texts = counts.filter("term = ''").first()
    tested = max(1, counts.count() - 1)
    # a term's chance is shared out over all terms tested
    bar = max(least_leaning, NormalDist().inv_cdf(1 - ALPHA / max(2, tested)) ** 2)
    used = [[i for i in range(FOLDS) if i != v] for v in range(FOLDS + 1)]  # of the last one: all
    clean, toxic = ([sum((F.col(f"{name}{i}") for i in u[1:]), F.col(f"{name}{u[0]}")) for u in used] for name in ("clean", "toxic"))
    n_clean, n_toxic = ([sum(n_texts[f"{name}{i}"] for i in u) for u in used] for name in ("clean", "toxic"))
    terms: list[dict[str, float]] = [{} for _ in used]
    out = []
    left = [f"left{v}" for v in range(FOLDS + 1)]
    while len(out) < ROUNDS:
        if not out:
            table, seen, n_seen = counts, toxic, n_toxic
        else:
            rest = stage(_sums(rows, _unexplained(terms), left), "left")
            n_rest = rest.filter("term = ''").first()
            table, seen, n_seen = counts.join(rest, "term"), [F.col(c) for c in left], [n_rest[c] for c in left]
        new = [_significant(table, seen[v], n_seen[v], clean[v], n_clean[v], toxic[v], n_toxic[v], least_toxic, bar, least_share)
               if n_seen[v] >= least_toxic and n_clean[v] else {} for v in range(FOLDS + 1)]
        grown = [{**more, **old} for old, more in zip(terms, new, strict=True)]
        if out and len(grown[-1]) == len(terms[-1]):
            break
        terms = grown
        out.append(terms)
    return out


def _significant(table: DataFrame, seen, n_seen: int, clean, n_clean: int, toxic, n_toxic: int, least_toxic: int, bar: float, least_share: float) -> dict[str, float]:
    """Terms whose ``seen`` toxic texts lean against the clean ones, with their log
    odds over all texts."""
    leaning = _leaning(seen, clean, n_seen, n_clean)
    weight = F.log((toxic + 0.1) / (n_toxic + 1.0)) - F.log((clean + 0.1) / (n_clean + 1.0))
    kept = (table.filter((F.col("term") != "") & (seen >= least_toxic) & (seen * n_clean > clean * n_seen) & (weight > 0) & (leaning >= bar))
            .select("term", weight.alias("w"), leaning.alias("leaning")).orderBy(F.desc("leaning"), "term")).collect()  # of the bounded sample
    return {r.term: float(r.w) for r in kept if r.leaning >= least_share * kept[0].leaning}


def _deepest(rows: DataFrame, rounds: list[list[dict[str, float]]]) -> int:
    """The round whose lexica part the labels of the texts left out best (F1);
    the last of equally good ones."""
    if len(rounds) == 1:
        return 0
    seen = rows.mapInArrow(_rates([lexicon for r in rounds for lexicon in r[:FOLDS]]), "label int, part int, rates array<double>").limit(MAX_LABELLED).collect()
    found = []
    for d in range(len(rounds)):
        right = wrong = 0
        for v in range(FOLDS):
            i = d * FOLDS + v
            train = [(r.rates[i], r.label) for r in seen if r.part != v]
            cut = best_cut(train) if any(t for _, t in train) else math.inf
            called = [(r.rates[i] >= cut, r.label == 1) for r in seen if r.part == v]
            right += sum(a and b for a, b in called)
            wrong += sum(a != b for a, b in called)
        found.append(2 * right / max(1, 2 * right + wrong))
    return max(range(len(rounds)), key=lambda d: (found[d], d))


def learn_lexicon(texts: DataFrame, text_col: str = "text", label_col: str = "label", least_toxic: int = 3,
                  least_leaning: float = 30.0, least_share: float = 0.04) -> Lexicon:
    """A lexicon from texts with a 0/1 label.

    A term is kept if ``least_toxic`` toxic texts have it and its counts lean to
    them with a G-squared of ``least_leaning``, or more if so many terms are tested
    that chance reaches it, and of ``least_share`` of the best term's.  Then the
    same test is made against the toxic texts alone that hold no term of weight
    so far, and so on: words of a topic that others explain stay out, rare toxic
    words come in.  Rounds that don't help on parts of the texts left out are
    not used.  A term's weight is its log odds.  An
    exception is a pair of neighbours around a kept word that three clean texts
    have and no toxic one.  Null labels are passed over; null texts are empty;
    without toxic or clean texts the lexicon is empty.
    """
    rows = texts.filter(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = stage(rows, "labelled")
    total = rows.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    if not total.toxic or not total.clean:
        return Lexicon({})
    rounds = _rounds(rows, least_toxic, least_leaning, least_share)
    terms = rounds[_deepest(rows, rounds)][-1]
    if not terms:
        return Lexicon({})
    seen = stage(rows.mapInArrow(_second_look(terms), "label int, rate double, pairs array<string>"), "seen")
    pairs = (seen.select("label", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
             .filter("toxic = 0 and n >= 3"))
    return Lexicon(terms, frozenset(r.pair for r in pairs.collect()),
                   best_cut([(r.rate, r.label) for r in seen.select("rate", "label").limit(MAX_LABELLED).collect()]))


def matcher(lexicon: Lexicon) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for t, w in lexicon.terms.items():
        auto.add_word(t, (len(t), w))
    for t in lexicon.exceptions:
        auto.add_word(t, (len(t), None))
    if len(auto):
        auto.make_automaton()
    return auto


def evidence(auto: ahocorasick.Automaton, folded: str) -> float:
    """Summed weight of the matched terms outside exception phrases; of the
    terms that start at one place only the heaviest counts."""
    if not len(auto):
        return 0.0
    at: dict[int, float] = {}
    excepted = []
    for end, (n, w) in auto.iter(folded):
        start = end - n + 1
        if w is None:
            excepted.append((start, end))
        elif w > at.get(start, 0.0):
            at[start] = w
    if excepted:
        at = {s: w for s, w in at.items() if not any(a <= s < b for a, b in excepted)}
    return sum(at.values())


def rate(weight: float, n_words: int) -> float:
    """Evidence per damped length."""
    return weight / math.sqrt(n_words + 30)


def _score(lexicon: Lexicon):
    half = lexicon.cut * math.sqrt(0.7 / 0.3)  # the cut scores 0.3

    def run(batches):
        auto = matcher(lexicon)
        for batch in batches:
            out = []
            for text in plain(batch.column(batch.num_columns - 1)).to_pylist():
                f = fold(text)
                r = rate(evidence(auto, f), f.count(" ") - 1)
                out.append(r * r / (r * r + half * half))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(out, pa.float64())],
                                             [*batch.schema.names[:-1], "score"])
    return run


def toxicity(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with its ``score``, 0 to 1.

    Null and empty texts, and any text under an empty lexicon, score 0.  A
    column that is called score is replaced.  Whole texts are matched.
    """
    cols = [c for c in (keep or ["doc_id"]) if c != "score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(lexicon), schema)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", limit: int = MAX_LABELLED) -> DataFrame:
    """(text, label) of at most ``limit`` labelled rows outside the held-out
    quarter, by the order of a hash of the id.

    The labels chosen are at most ``limit`` narrow rows, so they are broadcast
    and no text is shuffled."""
    chosen = (labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id")))
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def held_out(doc_id) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
