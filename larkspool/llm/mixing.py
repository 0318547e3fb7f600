"""Mix documents to target shares of domain tokens, with soft membership and fitted rates.

A classifier trained on a labelled table (naive Bayes over hashed distinct words) gives every
document a posterior over domains. A document's rate is the expected number of times it
is used. With w its share of all tokens, p its posterior and r its rate, a domain
expects ``sum w r p`` tokens. The rates minimise the squared distance of these totals from the
targets by projected gradient descent from rate 1: ``r <- min(most, max(least, r - p . g))``, with
g what the totals are off, scaled by the inverse Gram matrix ``sum w p p'``. With that of all
documents the curvature is 1, so no step leads away from the nearest totals within the
bounds. The matrix of the documents that are not at a bound is tried first, as it
leads there sooner; such a step is taken back unless it comes a tenth closer.

Without a bound on the tokens to use, the rates are those nearest to 1 (by squares, weighed by
tokens) that reach the shares, whatever tokens that takes: ``min(most, max(least, 1 + (p - t) . m))``
with t the targets, and m such that ``sum w r (p - t)`` is zero, found by Newton steps on the dual.
The shares reached are compared with the targets. If one is further off than the caller
allows, for instance as MOST_RATE is in the way, that is an error, or a warning if the caller names no bound.

Every step is one aggregation over a narrow table. Only totals per domain (as many numbers
as domains) come to the driver; a rate is an expression of the posterior and the steps so
far, so no table of rates is rewritten and nothing is shuffled. DataFrame functions only.

Null and empty texts have the prior as posterior and no tokens. Labels that are null, or of
domains without a target, teach nothing; if no label is left, all domains are equally
likely. A repeated label counts each time. Rows are judged one by one; ids may repeat or be null,
other columns pass through.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import fresh, stage

#: Labelled documents that the classifier is trained on at most, and buckets that words are hashed to.
LABELLED, BUCKETS = 20_000, 4_096
#: The words of a text count as this many independent ones at most.
EVIDENCE = 40.0
#: Steps at most, and the largest distance from a target share to stop at; three steps without a tenth of progress end it too.
STEPS, CLOSE = 25, 1e-5
#: The distance of a share from its target that a warning tells.
TOLD = 1e-3
#: The most times that a document may be used.
MOST_RATE = 16.0


@dataclass(frozen=True)
class DomainModel:
    """Per domain the log of the prior and of the buckets' probabilities."""

    domains: list[str]
    prior: list[float]
    weights: list[list[float]]


def words(text: str) -> Column:
    """The words of a text: what ASCII white space separates."""
    return F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "[ \\t-\\r]+"), "")


def _buckets(own: Column) -> Column:
    return F.transform(F.array_distinct(own), lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(BUCKETS)).cast("int"))


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], seed: int = 42) -> DomainModel:
    """Train on ``docs`` (doc_id, text) and ``labelled`` (doc_id, domain)."""
    known = labelled.select("doc_id", "domain").dropna().where(F.col("domain").isin(domains))
    total = known.count()
    part = min(1.0, LABELLED / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(part * (1 << 30)))
    # About LABELLED rows of an id and a name: their size is bounded.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", _buckets(words("text")).alias("b"))
    counts = found.select("domain", F.explode_outer("b").alias("b")).groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n"))
    n_docs = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = np.ones((len(domains), BUCKETS))
    for row in counts.where("b is not null").collect():  # BUCKETS rows per domain at most
        table[domains.index(row["domain"]), row["b"]] += row["n"]
    weights = np.log(table / table.sum(axis=1, keepdims=True))
    prior = np.array([n_docs.get(d, 0) + 1.0 for d in domains])
    return DomainModel(domains, np.log(prior / prior.sum()).tolist(), weights.tolist())


def _normalised(powers: Column) -> Column:
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def with_posterior(docs: DataFrame, model: DomainModel, name: str, tokens: str, text: str = "text") -> DataFrame:
    """``docs`` with the array of posteriors and the number of words."""
    own = fresh("own_buckets", [*docs.columns, name, tokens])
    scores, powers = f"{own}_s", f"{own}_p"
    evidence = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.lit(1), F.size(own)))

    def score(k: int) -> Column:
        # Folded to one literal array when the query is planned.
        weights = F.split(F.lit(",".join(map(repr, model.weights[k]))), ",").cast("array<double>")
        total = F.aggregate(F.col(own), F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
        return F.lit(model.prior[k]) + evidence * total

    df = docs.withColumn(own, words(text))
    df = df.withColumn(tokens, F.size(own).cast("bigint")).withColumn(own, _buckets(F.col(own)))
    df = df.withColumn(scores, F.array(*(score(k) for k in range(len(model.domains)))))
    df = df.withColumn(powers, F.transform(scores, lambda s: F.exp(s - F.array_max(scores))))
    return df.withColumn(name, _normalised(F.col(powers))).drop(own, scores, powers)


@dataclass(frozen=True)
class Rates:
    """The steps that lead from rate 1 to a document's rate, and the shares on the way to those reached."""

    steps: list[list[float]]
    least: float
    budget: float
    shares: list[list[float]]

    def of(self, posterior: str) -> Column:
        if not self.steps:
            return F.lit(max(1.0, self.least))
        steps = F.array(*(F.array(*map(F.lit, step)) for step in self.steps))

        def move(rate: Column, step: Column) -> Column:
            off = sum((F.col(posterior)[k] * step[k] for k in range(len(self.steps[0]))), F.lit(0.0))
            return F.least(F.lit(MOST_RATE), F.greatest(F.lit(self.least), rate - off))

        return F.aggregate(steps, F.lit(1.0), move)

    def check(self, targets: Mapping[str, float], within: float | None = None) -> None:
        """Raise a ValueError if a share reached is more than ``within`` off its target; warn of TOLD, if None."""
        total = sum(targets.values())
        pairs = {d: (t / total, s) for (d, t), s in zip(targets.items(), self.shares[-1] if self.shares else [])}
        if all(abs(t - s) <= (TOLD if within is None else within) for t, s in pairs.values()):
            return
        text = ", ".join(f"{d} {s:.4f} of {t:.4f}" for d, (t, s) in pairs.items())
        text = f"shares reached of the targets, at rates from {self.least:g} to {MOST_RATE:g} and {self.budget:.3f} times the tokens: {text}"
        if within is not None:
            raise ValueError(text)
        warnings.warn(text, stacklevel=3)


def fit_rates(known: DataFrame, targets: Mapping[str, float], least: float = 0.0, most_budget: float | None = 1.0) -> Rates:
    """Rates for the staged table ``known`` (n_tokens, posterior), domains in the order of ``targets``.

    The budget is the number of tokens to use, as a multiple of those there are: 1, or, up to
    ``most_budget``, what it takes for no domain to shrink. It is ``fit_shares`` that has no bound (None).
    """
    if most_budget is None:
        return fit_shares(known, targets, least)
    k = len(targets)
    target = np.array(list(targets.values()), float)
    target = target / target.sum()
    p = [F.col("posterior")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(k)]

    def totals(rates: Rates) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Tokens expected per domain, Gram matrices of all and of the free documents, all tokens."""
        rate = rates.of("posterior")
        used = known.withColumn("rate", rate).withColumn("w", F.col("n_tokens").cast("double"))
        inside = (F.col("rate") > rates.least) & (F.col("rate") < MOST_RATE)
        used = used.withColumn("free", F.when(inside, F.col("w")).otherwise(F.lit(0.0)))
        row = used.agg(
            F.sum("w"),
            *(F.sum(F.col("w") * F.col("rate") * x) for x in p),
            *(F.sum(F.col(w) * p[i] * p[j]) for w in ("w", "free") for i, j in pairs),
        ).first()
        total = row[0] or 0.0
        found = np.array([x or 0.0 for x in row[1:]]) / max(total, 1.0)
        return found[:k], found[k : k + k * k].reshape(k, k), found[k + k * k :].reshape(k, k), total

    rates = Rates([], least, 1.0, [])
    base, every, free, total = totals(rates)
    if not total:
        return rates
    budget = max(1.0, min(most_budget, float(np.max(base / np.maximum(target, 1e-9)))))
    rates = Rates([], least, budget, [])
    used, stalled = base, 0

    def step(gram: np.ndarray, off: np.ndarray) -> list[float]:
        return (np.linalg.pinv(gram + 1e-9 * np.eye(k)) @ off).tolist()

    while True:
        off = used - budget * target
        distance = np.abs(off).max()
        rates.shares.append((used / max(1e-300, used.sum())).tolist())
        if distance < CLOSE or stalled == 3 or len(rates.steps) >= STEPS:
            return rates
        rates.steps.append(step(free, off))
        found = totals(rates)
        if np.abs(found[0] - budget * target).max() > 0.9 * distance:
            rates.steps[-1] = step(every, off)
            found = totals(rates)
        used, every, free, _ = found
        stalled = stalled + 1 if np.abs(used - budget * target).max() > 0.9 * distance else 0


def fit_shares(known: DataFrame, targets: Mapping[str, float], least: float = 0.0) -> Rates:
    """Rates for the staged table ``known`` that reach the target shares with as many tokens as that takes."""
    k = len(targets)
    target = np.array(list(targets.values()), float)
    target = target / target.sum()
    apart = [F.col("posterior")[i] - F.lit(float(t)) for i, t in enumerate(target)]
    w = F.col("n_tokens").cast("double")

    def seen(points: list[np.ndarray]) -> tuple[list[tuple[float, float, np.ndarray, np.ndarray, np.ndarray]], float]:
        """Per point m the dual, tokens used, gradient, Gram matrices of the free and of all documents; all tokens."""
        used, sums = known, [F.sum(w)]
        for n, m in enumerate(points):
            plain = sum((x * float(y) for x, y in zip(apart, m, strict=True)), F.lit(1.0))
            rate = F.least(F.lit(MOST_RATE), F.greatest(F.lit(least), F.col(f"plain_{n}")))
            used = used.withColumn(f"plain_{n}", plain).withColumn(f"rate_{n}", rate)
            plain, rate = F.col(f"plain_{n}"), F.col(f"rate_{n}")
            free = F.when((rate > least) & (rate < MOST_RATE), w).otherwise(F.lit(0.0))
            sums += [F.sum(w * (rate * plain - rate * rate / 2)), F.sum(w * rate), *(F.sum(w * rate * x) for x in apart)]
            sums += [F.sum(v * x * y) for v in (free, w) for x in apart for y in apart]
        row = used.agg(*sums).first()
        total = row[0] or 0.0
        found = np.array([x or 0.0 for x in row[1:]]).reshape(len(points), -1) / max(total, 1.0)
        grams = found[:, 2 + k :].reshape(len(points), 2, k, k)
        return [(f[0], f[1], f[2 : 2 + k], *g) for f, g in zip(found, grams, strict=True)], total

    at = np.zeros(k)
    (now,), total = seen([at])
    if not total:
        return Rates([], least, 1.0, [])
    shares: list[list[float]] = []
    for _ in range(2 * STEPS):
        _, budget, gradient, free, every = now
        shares.append((target + gradient / max(1e-300, budget)).tolist())
        if np.abs(gradient).max() < CLOSE * budget:
            break
        # A step with the matrix of all documents never leads away; one with that of the free ones leads there sooner.
        newton, safe = (np.linalg.pinv(g + 1e-9 * np.eye(k)) @ gradient for g in (free, every))
        points = [at - f * s for s, factors in ((newton, (1.0, 0.5, 0.1)), (safe, (1.0, 4.0))) for f in factors]
        found, _ = seen(points)
        best = min(range(len(points)), key=lambda i: (found[i][0], i))
        at, now = points[best], found[best]
    # As the posteriors of a document add up to 1, (p - t) . m is p . (m - t . m).
    return Rates([(target @ at - at).tolist()], least, float(now[1]), shares)


def copies(rate: Column, doc_id: str, seed: int = 42) -> Column:
    """How often a document is used: its rate, rounded up or down by a draw from its id."""
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def mixed_rates(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], least: float = 0.0, most_budget: float | None = 1.0, within: float | None = None
) -> DataFrame:
    """doc_id, n_tokens, posterior (in the order of ``targets``), rate and copies of every document.

    Shares that differ from the targets are an error beyond ``within``, or a warning if it is None.
    """
    model = fit_domains(docs, labelled, list(targets))
    known = with_posterior(docs.select("doc_id", "text"), model, "posterior", "n_tokens").select("doc_id", "n_tokens", "posterior")
    known = stage(known, "mixing")
    rates = fit_rates(known, targets, least, most_budget)
    rates.check(targets, within)
    return known.withColumn("rate", rates.of("posterior")).withColumn("copies", copies(F.col("rate"), "doc_id"))


def mix_documents(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], least: float = 0.0, most_budget: float | None = 1.0, within: float | None = None
) -> DataFrame:
    """``docs``, each row as often as its rate says; with ``least`` 1 every document stays.

    Shares that differ from the targets are an error beyond ``within``, or a warning if it is None.
    """
    model = fit_domains(docs, labelled, list(targets))
    known = with_posterior(docs.select("doc_id", "text"), model, "posterior", "n_tokens").select("n_tokens", "posterior")
    rates = fit_rates(stage(known, "mixing"), targets, least, most_budget)
    rates.check(targets, within)
    name, tokens = fresh("posterior", docs.columns), fresh("n_tokens", docs.columns)
    rate = fresh("rate", docs.columns)
    used = with_posterior(docs, model, name, tokens).withColumn(rate, rates.of(name))
    used = used.withColumn(tokens, copies(F.col(rate), "doc_id"))
    # Rows without copies are told by the generator: a filter on the rate would be pushed below it and compute it again.
    each = F.explode_outer(F.when(F.col(tokens) > 0, F.sequence(F.lit(1), F.col(tokens))))
    return used.withColumn(name, each).where(F.col(name).isNotNull()).select(*docs.columns)
