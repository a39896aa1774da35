"""Risk-controlled quality rules, in DataFrame functions only.

1. Every document gets counts (`counted`) and a base rule on them (`base_failed`).
2. From one half of the labelled documents, binned features get log-odds of being bad; their sum is
   a document's score (`fit`, first half). Whole numbers (hundredths), so that sums are exact.
3. On the other half, the holdout, cutoffs are tested from the strictest to the loosest in each stratum
   (a band of word counts). A cutoff passes if the exact binomial tail P(Bin(n, alpha) <= k) is at most
   delta / strata, where k of n good documents lie above it: the false rejections of good documents in
   that stratum then exceed alpha with probability delta at most, over all strata (Bonferroni across
   strata; inside one, testing in a fixed order and stopping at the first failure needs no correction).
   Without labels enough to prove that, no cutoff passes and nothing is rejected by score.
4. With `pooled`, the good documents of all strata together are one more hypothesis of the correction
   (delta / (strata + 1) for each). A stratum without a cutoff of its own takes the one proved there, which
   rejects more than alpha of all good documents with probability delta at most, but has no bound inside
   that stratum. Even alone a hypothesis needs log(delta) / log(1 - alpha) good holdout documents: 598.

What reaches the driver is the model: FEATURES x bins log-odds and a cutoff for each stratum, whatever
the input's size. Labels that are null, and labelled ids without a document, don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE

ALPHA, DELTA = 0.005, 0.05
#: feature: (numerator, denominator, upper bounds of the bins in thousandths)
FEATURES = {
    "symbols": ("n_symbols", "word_chars", (0, 5, 10, 20, 40, 80, 160, 320)),
    "repeats": ("n_repeat_words", "n_words", (0, 20, 50, 100, 200, 300, 500, 800)),
    "dup_lines": ("n_dup_lines", "n_lines", (0, 20, 50, 100, 200, 300, 500, 800)),
    "capitals": ("n_upper", "word_chars", (0, 10, 30, 60, 100, 200, 400, 700)),
    "word_length": ("word_chars", "n_words", (2000, 3000, 4000, 5000, 6000, 7000, 9000, 15000)),
}
#: Word counts at which the next stratum starts.
STRATA = (100, 1000)
#: Scores that are tried as cutoffs, strictest first: a document goes if its score is above.
CUTOFFS = tuple(range(2000, -1, -100))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 8-word windows that the text has twice or more. Windows are compared by 64-bit hash."""
    pair = lambda a, b: F.xxhash64(a, b)
    shifted = lambda h, k: F.zip_with(h, F.slice(h, k + 1, F.size(h)), pair)
    tagged = lambda keys: F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    both = lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))
    twice = lambda s: F.array_sort(F.array_distinct(F.flatten(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), both))))
    spans = lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(8)), F.lit(8))), F.lit(0), lambda x, y: x + y)
    covered = lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(tagged(keys), lambda s: let(twice(s), spans)))
    eights = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h1: let(shifted(h1, 1), lambda h2: let(shifted(h2, 2), lambda h4: F.slice(shifted(h4, 4), 1, F.size(h4) - 7))))
    return F.when(F.size(words) < 9, F.lit(0)).otherwise(let(eights, covered))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def counts_of(text: Column) -> Column:
    """A struct of counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper.

    Null text counts as none: all are 0.
    """
    text = F.coalesce(text, F.lit(""))

    def counts(words: Column, lines: Column) -> Column:
        values = {
            "n_words": F.size(words), "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)), "n_symbols": _count(text, r"[#*$%&|<>]"),
            "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": _repeat_words(words), "n_upper": _count(text, r"\p{Lu}+"),
        }
        return F.struct(*(v.cast("long").alias(k) for k, v in values.items()))

    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words, lambda w: let(lines, lambda x: counts(w, x)))


def counted(docs: DataFrame) -> DataFrame:
    """docs with the counts as a struct `_q`."""
    return docs.withColumn("_q", counts_of(F.col("text")))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def _bin(feature: str, q: Column) -> Column:
    top, bottom, bounds = FEATURES[feature]
    value = F.floor(1000 * q[top] / F.greatest(q[bottom], F.lit(1)))
    return sum((F.when(value > b, 1).otherwise(0) for b in bounds), F.lit(0))


def _stratum(q: Column) -> Column:
    return sum((F.when(q["n_words"] >= b, 1).otherwise(0) for b in STRATA), F.lit(0))


@dataclass(frozen=True)
class Model:
    odds: dict[str, tuple[int, ...]]
    #: None: no cutoff could be proved.
    cutoffs: tuple[int | None, ...]

    def score(self, q: Column) -> Column:
        return sum((F.element_at(F.array(*(F.lit(x) for x in self.odds[f])), _bin(f, q) + 1) for f in FEATURES), F.lit(0))

    def rejected(self, q: Column) -> Column:
        found = F.lit(False)
        for i, cutoff in enumerate(self.cutoffs):
            if cutoff is not None:
                found = F.when(_stratum(q) == i, self.score(q) > cutoff).otherwise(found)
        return found


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms; 1 where k is above the mean (the tail is then no proof)."""
    odds = F.log(F.lit(p / (1 - p)))
    step = lambda s, i: F.struct((s["t"] + F.log((n - i + 1) / i) + odds).alias("t"), (s["sum"] + F.exp(s["t"] + F.log((n - i + 1) / i) + odds)).alias("sum"))
    first = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(terms, first, step, lambda s: s["sum"]))


def fit(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, pooled: bool = False) -> Model:
    """counts: (doc_id, _q) of all documents. labels: (doc_id, quality: 1 good, 0 bad). pooled: see above, 4."""
    known = counts.join(labels.select("doc_id", "quality").filter("quality is not null"), "doc_id").withColumn("half", F.md5(F.col("doc_id").cast("string")) < "8")
    parts = [F.struct(F.lit(f).alias("feature"), _bin(f, F.col("_q")).alias("bin")) for f in FEATURES]
    seen = known.filter("half").select("quality", F.explode(F.array(*parts)).alias("x")).groupBy("x.feature", "x.bin").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"))
    got = {(r["feature"], r["bin"]): (r["bad"], r["good"]) for r in seen.collect()}  # FEATURES x bins at most
    odds = {}
    for f, (_, _, bounds) in FEATURES.items():
        cells = [got.get((f, b), (0, 0)) for b in range(len(bounds) + 1)]
        bad, good = (sum(c[i] for c in cells) for i in (0, 1))
        # one pseudo-document of each kind in each bin
        odds[f] = tuple(_hundredths((x + 1) * (good + len(cells)), (y + 1) * (bad + len(cells))) for x, y in cells)
    model = Model(odds, (None,) * (len(STRATA) + 1))
    held = known.filter("not half and quality = 1").select(_stratum(F.col("_q")).alias("stratum"), model.score(F.col("_q")).alias("score"))
    above = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("score") > c).alias(f"c{c}") for c in CUTOFFS))
    strata = len(STRATA) + 1
    if pooled:
        # the pool is the row after the strata's
        above = above.unionByName(above.groupBy(F.lit(strata).alias("stratum")).agg(*(F.sum(c).alias(c) for c in above.columns if c != "stratum")))
    tried = above.select("stratum", F.array(*(binomial_tail(F.col("n"), F.col(f"c{c}"), alpha) <= delta / (strata + pooled) for c in CUTOFFS)).alias("passed"))
    cutoffs: list[int | None] = [None] * (strata + 1)
    for r in tried.collect():  # one row for each stratum
        passed = [*r["passed"], False]
        if first_failure := passed.index(False):
            cutoffs[r["stratum"]] = CUTOFFS[first_failure - 1]
    *own, pool = cutoffs
    return Model(odds, tuple(pool if c is None else c for c in own))


def _hundredths(a: int, b: int) -> int:
    import math

    return math.floor(100 * math.log(a / b) + 0.5)


def verdict(model: Model, q: Column) -> Column:
    """A struct of q (the counts), base_failed and kept. Null or empty text fails the base rule."""
    return F.struct(q.alias("q"), base_failed(q).alias("base_failed"), (~base_failed(q) & ~model.rejected(q)).alias("kept"))


def judged(docs: DataFrame, labels: DataFrame, into: str = "_verdict") -> DataFrame:
    """docs with a struct `into`, see verdict(): q, base_failed and kept.

    Each row is judged by itself, repeated ids and null ids as well. No labels: kept is not base_failed. Other columns
    stay as they are; docs must not have one named `into` (ValueError). Strata with few labels take the pooled cutoff.
    Only labelled documents are counted for the fit, and every document once for its verdict.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {into!r} already")
    told = labels.select("doc_id", "quality").filter("quality is not null")
    model = fit(docs.select("doc_id", "text").join(told.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", counts_of(F.col("text")).alias("_q")), told, pooled=True)
    # one expression, in which the counts are a bound variable: a filter on kept computes them once
    return docs.withColumn(into, let(counts_of(F.col("text")), lambda q: verdict(model, q)))
