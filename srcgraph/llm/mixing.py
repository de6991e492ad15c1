"""Mixing sources to target weights with soft membership.

A naive Bayes classifier on hashed words, fitted on a bounded sample of labelled rows (MAX_LABELLED),
gives each document posteriors over domains. Projected-gradient least squares then fits a rate of at
least 0 for each document, so that the expected tokens of each domain (rate x tokens x posterior)
match the target weights. Errors count relative to a domain's share; in the metric that weighs a
document by its tokens this problem's largest curvature is exactly 1, so the step is 1.

DataFrame and SQL functions only. Posteriors are computed once, without a shuffle, and written to the
shared folder; an iteration is one aggregation of a few sums with map-side combining, and the rate
of a document is an expression of its posteriors, so nothing but those sums reaches the driver.

Defined cases: null and empty texts have no tokens, the classes' priors as posteriors, and the rate
that these give; very long texts are scored whole (those of the sample are bounded); of posteriors that tie the first
domain in order is the likeliest; labelled rows without a domain are left out; with no labelled row every rate is 1;
domains that no document belongs to are left out of the fit; domains that the weights do not
mention keep their share, and the weights divide the rest; repeated rows are rows of their own; an empty table gives an empty
result; other columns stay, clashing names are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored

#: Labelled rows that the classifier is fitted on, and the longest text among them.
MAX_LABELLED, MAX_TEXT_BYTES = 4000, 1 << 16
#: Hash buckets of words; words that a text's evidence counts for at most.
BUCKETS, EVIDENCE = 1 << 14, 8
MOST_ROUNDS, TOLERANCE = 40, 1e-6


def words(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\s+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    model: NaiveBayesModel | None


def fit_classifier(labelled: DataFrame) -> Classifier:
    """Fit on rows of (text, domain): MAX_LABELLED of them in hash order."""
    rows = labelled.where(F.col("domain").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= MAX_TEXT_BYTES))
    sample = stored(rows.select("text", "domain").orderBy(F.xxhash64("text", F.lit("mixing")), "text").limit(MAX_LABELLED), "labelled")
    if sample.isEmpty():
        return Classifier((), None)
    indexer = StringIndexer(inputCol="domain", outputCol="__label", stringOrderType="alphabetAsc").fit(sample)
    counted = _counts(indexer.transform(sample))
    model = NaiveBayes(featuresCol="__counts", labelCol="__label", smoothing=0.1).fit(counted)
    return Classifier(tuple(indexer.labels), model)


def _counts(df: DataFrame, column: str = "text") -> DataFrame:
    return HashingTF(inputCol="__words", outputCol="__counts", numFeatures=BUCKETS).transform(df.withColumn("__words", words(F.col(column))))


def with_posteriors(docs: DataFrame, classifier: Classifier, column: str = "text") -> DataFrame:
    """docs with n_tokens and posteriors (array, one for each domain)."""
    if classifier.model is None:
        return docs.withColumns({"n_tokens": F.size(words(F.col(column))).cast("long"), "posteriors": F.array().cast("array<double>")})
    model = classifier.model.setRawPredictionCol("__raw").setProbabilityCol("__p").setPredictionCol("__prediction")
    prior = F.array(*(F.lit(float(x)) for x in model.pi))
    scored = model.transform(_counts(docs, column))
    n = F.size("__words")
    share = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(n, F.lit(1)))
    z = F.zip_with(vector_to_array("__raw"), prior, lambda raw, p: (raw - p) * share + p)
    shifted = F.transform("__z", lambda x: F.exp(x - F.array_max("__z")))
    out = scored.withColumns({"n_tokens": n.cast("long"), "__z": z}).withColumn("__e", shifted)
    total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    done = out.withColumn("__total", total).withColumn("posteriors", F.transform("__e", lambda x: x / F.col("__total")))
    return done.drop("__words", "__counts", "__raw", "__p", "__prediction", "__z", "__e", "__total")


def targets_of(totals: list[float], domains: tuple[str, ...], weights: Mapping[str, float], tokens: float | None) -> list[float]:
    """Target tokens of each domain. Without a token budget: the least one at which no domain shrinks,
    but for those that are named with weight 0."""
    whole = sum(totals)
    named = [weights.get(d) for d in domains]
    unnamed = sum(t for t, w in zip(totals, named, strict=True) if w is None)
    given = sum(w for w in named if w is not None)
    # Unnamed domains keep their present share; the named weights divide the rest. With no unnamed
    # tokens the weights stand as they are.
    scale = (whole - unnamed) / whole / given if unnamed and given else 1.0
    shares = [w * scale if w is not None else t / whole if whole else 0.0 for t, w in zip(totals, named, strict=True)]
    budget = tokens if tokens is not None else max((t / s for t, s in zip(totals, shares, strict=True) if s > 0), default=whole)
    return [s * budget for s in shares]


def fit_rates(members: DataFrame, domains: tuple[str, ...], weights: Mapping[str, float], tokens: float | None = None) -> tuple[Column, float]:
    """The rate as an expression of the column `posteriors`, and how far the domains' totals stay from their targets:
    the largest difference relative to a domain's share before. The fit ends within TOLERANCE, or where a step no longer
    changes that, as targets may be out of reach; after MOST_ROUNDS it ends with what is left, and says so.
    members has n_tokens and posteriors."""
    rate = F.lit(1.0)
    if not domains:
        return rate, 0.0
    narrow = members.select("n_tokens", *(F.col("posteriors")[i].alias(f"p{i}") for i in range(len(domains))))
    p = [F.col(f"p{i}") for i in range(len(domains))]

    def totals(rate: Column) -> list[float]:
        row = narrow.agg(*(F.sum(rate * F.col("n_tokens") * x) for x in p)).first()
        return [float(x or 0.0) for x in row]

    shares = totals(F.lit(1.0))
    wanted = targets_of(shares, domains, weights, tokens)
    live = [i for i, s in enumerate(shares) if s > 0]
    now, steps, before = shares, [], None
    for turn in range(MOST_ROUNDS + 1):
        errors = {i: (now[i] - wanted[i]) / shares[i] for i in live}
        error = max((abs(e) for e in errors.values()), default=0.0)
        if error < TOLERANCE or (before is not None and all(abs(errors[i] - before[i]) < TOLERANCE / 100 for i in live)):
            break
        if turn == MOST_ROUNDS:
            warnings.warn(f"rates still move after {MOST_ROUNDS} rounds; totals are within {error:.2g} of their targets", stacklevel=2)
            break
        steps.append(errors)
        before, rate = errors, _stepped(rate, errors, p)
        now = totals(rate)
    listed = [F.col("posteriors")[i] for i in range(len(domains))]
    return reduce(lambda r, e: _stepped(r, e, listed), steps, F.lit(1.0)), error


def _stepped(rate: Column, errors: Mapping[int, float], p: list[Column]) -> Column:
    move = reduce(lambda a, b: a + b, (F.lit(e) * p[i] for i, e in errors.items()))
    return F.greatest(F.lit(0.0), rate - move)


def mixed(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], keys: list[str], tokens: float | None = None) -> DataFrame:
    """keys, n_tokens, posteriors, domain (the likeliest) and rate of each row, and target_error, how far the fitted
    totals stay from the targets."""
    classifier = fit_classifier(labelled)
    members = stored(with_posteriors(docs.select(*keys, "text"), classifier).select(*keys, "n_tokens", "posteriors"), "posteriors")
    rate, error = fit_rates(members, classifier.domains, weights, tokens)
    return members.withColumns({"domain": domain_of(classifier.domains), "rate": rate, "target_error": F.lit(error)})


def domain_of(domains: tuple[str, ...]) -> Column:
    if not domains:
        return F.lit(None).cast("string")
    best = F.array_position("posteriors", F.array_max("posteriors"))
    return F.element_at(F.array(*map(F.lit, domains)), best.cast("int"))


def resampled(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], tokens: float | None = None) -> DataFrame:
    """docs, each row as often as its rate says; a fraction counts by the row's own hash. Rows, tokens and
    posteriors are written once; the fit and the copies both read them, so that no text is scored twice."""
    classifier = fit_classifier(labelled)
    scored = with_posteriors(docs.withColumn("__row", F.struct(*docs.columns)), classifier).select("__row", "n_tokens", "posteriors")
    members = stored(scored, "members")
    rate = F.round(fit_rates(members.select("n_tokens", "posteriors"), classifier.domains, weights, tokens)[0], 3)
    luck = F.pmod(F.xxhash64(F.col("__row.doc_id").cast("string"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(rate + luck).cast("int")
    return members.select("__row", F.explode(F.array_repeat(F.lit(0), copies))).select("__row.*")
