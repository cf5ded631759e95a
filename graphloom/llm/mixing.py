"""Soft-membership mixing: document rates whose expected domain tokens match targets, in DataFrame functions.

1. A classifier is learnt from a labelled table: for every word, by its hash, the documents of each
   domain that hold it are counted; words that some domain holds significantly more often than the
   rest (z score of Z or more, RATIO times as often), both as a share of its documents and of all
   words they hold, give every domain the log ratio of its share to that of all, as in naive Bayes.
2. Every document gets its posteriors p over the domains from the words it holds.
3. Rates r >= 0 minimise (A r - T)' W (A r - T) by projected gradient, A holding the expected tokens
   n * p of each domain, T the target totals and W the inverse of sum(n p p'). The gradient is scaled
   by the same moments of the documents whose rate is above zero, so that a step of length one is
   exact as long as no further rate is clipped; a step that does not better the squares is cut to a
   quarter. A round is one aggregation to sums over domains and pairs of domains; nothing else
   reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_sample, stored

FEATURES = 1 << 16  # words with the highest z scores that count; bounds the table of weights
PER_DOMAIN = 2_000  # labelled documents of a domain that are learnt from
Z, RATIO = 6.0, 3.0  # least z score and least ratio of shares of a word that counts
ROUNDS, HELD = 60, 6
TOLERANCE = 1e-9  # of the largest miss, as a share of all tokens

#: Token shares asked for by the registered query and the pipeline.
TARGETS = {"clean": 0.94, "toxic": 0.01, "low": 0.05}


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain: low quality, else toxic, else clean; rows without quality or toxicity have none."""
    domain = F.when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 1), "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))


def _words(text: Column | str = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _bucket(word: Column) -> Column:
    return F.xxhash64(word)


def learn(docs: DataFrame, labelled: DataFrame, per_domain: int = PER_DOMAIN) -> tuple[list[str], list[tuple[float, float]], DataFrame]:
    """Domains in alphabetical order, log priors of a text without and with significant words, and those words' weights.

    `labelled` has doc_id and domain; an id with several domains counts by the smallest. At most
    `per_domain` ids of each domain are learnt from; the priors come from all labelled documents.
    """
    told = labelled.filter(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    told = told.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r[0]: r[1] for r in told.groupBy("domain").count().collect()}
    domains = sorted(counts)
    every = sum(counts.values())
    priors = [float(np.log(counts[d] / every)) for d in domains]
    chosen = bounded_sample(told, "domain", "doc_id", per_domain)
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "domain", F.array_distinct(F.transform(_words(), _bucket)).alias("held"))
    size = {r[0]: (float(r[1]), float(r[2] or 0)) for r in held.groupBy("domain").agg(F.count(F.lit(1)), F.sum(F.size("held"))).collect()}
    counted = held.select("domain", F.explode("held").alias("bucket")).groupBy("bucket").agg(*[F.sum((F.col("domain") == d).cast("double")).alias(f"c{i}") for i, d in enumerate(domains)]) if domains else held.select(F.lit(0).alias("bucket")).limit(0)

    def shares(i: int, of: int) -> tuple[Column, Column, Column]:
        """Log ratio to all, z score and ratio to the rest of the bucket's share of domain i's documents (of 0) or held words (of 1)."""
        n = [size.get(d, (0.0, 0.0))[of] for d in domains]
        total = sum(n)
        mine, rest = F.col(f"c{i}"), sum((F.col(f"c{j}") for j in range(len(domains)) if j != i), F.lit(0.0))
        p1, p0, p = (mine + 0.5) / (n[i] + 1), (rest + 0.5) / (total - n[i] + 1), (mine + rest + 1) / (total + 2)
        return F.log(p1 / p), (p1 - p0) / F.sqrt(p * (1 - p) * (1 / (n[i] + 1) + 1 / (total - n[i] + 1))), p1 / p0

    marks, weights, scores = [], [], []
    for i in range(len(domains)):
        (_, z0, r0), (weight, z1, r1) = shares(i, 0), shares(i, 1)
        marks.append((F.least(z0, z1) >= Z) & (F.least(r0, r1) >= RATIO))
        weights.append(weight)
        scores.append(F.least(z0, z1))
    marked = F.exists(F.array(*marks).cast("array<boolean>"), lambda x: x)
    table = counted.select("bucket", F.array(*weights).cast("array<double>").alias("w"), marked.alias("marked"), F.array_max(F.array(*scores).cast("array<double>")).alias("z"))
    table = table.filter("marked").orderBy(F.desc("z"), "bucket").limit(FEATURES).select("bucket", "w")
    table = stored(table, "weights")
    any_held = held.select("doc_id", "domain", F.explode_outer("held").alias("bucket")).join(F.broadcast(table), "bucket", "left").groupBy("doc_id", "domain").agg(F.max(F.col("w").isNotNull().cast("double")).alias("some"))
    some = {r[0]: (r[1], r[2]) for r in any_held.groupBy("domain").agg(F.sum("some"), F.count(F.lit(1))).collect()}
    share = [(some.get(d, (0.0, 0))[0] + 0.5) / (some.get(d, (0.0, 0))[1] + 1) for d in domains]
    return domains, [(a + float(np.log(1 - x)), a + float(np.log(x))) for a, x in zip(priors, share, strict=True)], table


def posteriors(docs: DataFrame, domains: list[str], priors: list[tuple[float, float]], weights: DataFrame) -> DataFrame:
    """doc_id, n_tokens and p (array of the domains' posteriors) of every document.

    Rows that repeat an id are one document with the tokens of all of them; a null text has no
    tokens and no significant words, which leaves the priors.
    """
    words = docs.select("doc_id", _words().alias("_w")).select("doc_id", F.size("_w").alias("_n"), F.array_distinct(F.transform("_w", _bucket)).alias("_b"))
    each = words.select("doc_id", "_n", F.posexplode_outer("_b").alias("_at", "bucket"))
    met = each.join(F.broadcast(weights), "bucket", "left")  # at most FEATURES rows
    sums = [F.sum(F.coalesce(F.get("w", F.lit(i)), F.lit(0.0))).alias(f"s{i}") for i in range(len(domains))]
    tokens = F.sum(F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, F.col("_n")).otherwise(0)).cast("long").alias("n_tokens")
    met_any = F.max(F.col("w").isNotNull()).alias("some")
    logits = [F.col(f"s{i}") + F.when(F.col("some"), b).otherwise(a) for i, (a, b) in enumerate(priors)]
    top = F.greatest(*logits) if len(logits) > 1 else (logits[0] if logits else F.lit(0.0))
    raw = F.array(*[F.exp(x - top) for x in logits]).cast("array<double>")
    out = met.groupBy("doc_id").agg(tokens, met_any, *sums).select("doc_id", "n_tokens", raw.alias("_raw"))
    return out.select("doc_id", "n_tokens", F.transform("_raw", lambda x: x / F.aggregate("_raw", F.lit(0.0), lambda a, y: a + y)).alias("p"))


def solve(told: DataFrame, shares: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """`told` with its column rate, and the domain totals it gives; targets are `shares` of all tokens.

    Ends when the targets are met or, where they can't be, when a round betters the squares by less
    than one in ten thousand. Steps are expressions over the row; every HELD rounds the rates are written.
    """
    d = len(shares)
    p = [F.get("p", F.lit(i)) for i in range(d)]
    n = F.col("n_tokens").cast("double")
    moments = told.agg(F.sum(n), *[F.sum(n * p[i] * p[j]) for i in range(d) for j in range(i, d)]).first()
    total = float(moments[0] or 0.0)
    m = np.zeros((d, d))
    for k, (i, j) in enumerate((i, j) for i in range(d) for j in range(i, d)):
        m[i, j] = m[j, i] = float(moments[1 + k] or 0.0)
    target = total * np.array(shares) / (sum(shares) or 1.0)
    now, rate = told.withColumn("rate", F.lit(1.0)), F.col("rate")
    if not total or not d:
        return now, [0.0] * d
    weigh = np.linalg.pinv(m + 1e-12 * total * np.eye(d), hermitian=True)
    sums = lambda r: [F.sum(r * n * p[i]) for i in range(d)] + [F.sum(F.when(r > 0, n * p[i] * p[j])) for i in range(d) for j in range(i, d)]

    def look(r: Column) -> tuple[np.ndarray, np.ndarray, float]:
        """Domain totals, moments of the documents with a rate above zero, and loss."""
        row = [float(x or 0.0) for x in now.agg(*sums(r)).first()]
        live = np.zeros((d, d))
        for k, (i, j) in enumerate((i, j) for i in range(d) for j in range(i, d)):
            live[i, j] = live[j, i] = row[d + k]
        miss = np.array(row[:d]) - target
        return np.array(row[:d]), live, float(miss @ weigh @ miss)

    got, live, loss = look(rate)
    length, accepted = 1.0, 0
    for _ in range(rounds):
        miss = got - target
        if np.abs(miss).max() <= tolerance * total or length < 1e-3:
            break
        step = length * np.linalg.solve(live + 1e-6 * (np.trace(live) / d + 1e-9 * total) * np.eye(d), miss)
        trial = F.greatest(F.lit(0.0), rate - sum((p[i] * float(step[i]) for i in range(d)), F.lit(0.0)))
        new_got, new_live, new_loss = look(trial)
        if new_loss >= loss:
            length /= 4
            continue
        small = new_loss > loss * (1 - 1e-4)
        rate, got, live, loss, length, accepted = trial, new_got, new_live, new_loss, min(1.0, 2 * length), accepted + 1
        if small:
            break
        if accepted % HELD == 0:
            now, rate = stored(now.withColumn("rate", rate), "rates"), F.col("rate")
    return now.withColumn("rate", rate), got.tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, p_<domain> of every domain met in `labelled`, and rate, how often to draw the document.

    `targets` gives the shares of tokens; a domain without target has share zero, a target without
    labelled document is left out. Without labelled documents every rate is one.
    """
    domains, priors, weights = learn(docs, labelled)
    told = stored(posteriors(docs, domains, priors, weights), "posteriors")
    rated, _ = solve(told, [float(targets.get(d, 0.0)) for d in domains])
    return rated.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)], "rate")
