"""Mixing to target weights with soft membership.

A logistic regression on the words that tell domains apart, trained on the
labelled table, gives every document a posterior over domains. Each document
then gets a rate, zero or more, so that the expected tokens of the domains (rate
x tokens x posterior, summed) meet the target shares in the least-squares sense,
in the metric of the documents' Gram matrix over domains, so that a rare domain
counts as much as a frequent one. Where no documents' posteriors come as close to
one domain as the targets, they are missed.

Of the rates that do, those closest to 1 are taken (``closeness`` weighs that).

The rates start at 1 and follow the projected gradient in its lazy form: the
gradient of a document's rate is its posterior times a vector over domains, so
the sum of all gradients so far is such a vector too, and a document's rate is
what it leaves of 1, projected onto zero or more. A pass over the documents takes
these rates and sums one residual per domain and the Gram matrix of the documents
whose rate is above zero, which scales the next gradient; a step that does not
lower the dual objective is halved. Rates are never stored.

What is collected: the classifier's vocabulary, at most ``vocabulary`` words,
which of them each labelled document of the sample holds, and
some numbers per domain. The classifier is fitted on a bounded sample: about
``max_train`` labelled documents, chosen by a hash of the id. All else covers all
rows, and whole texts.

Domains: toxic, else good or poor by quality. Labels that are null or missing do
not train; several labels of a document count by their maximum. Without any
label, posteriors equal the targets and all rates are 1. A null or empty text, or
one without words, has no tokens and the posterior of its other features.
Repeated rows get equal rates. A text of any length is one row of arrays. Columns
that clash with outputs are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import materialize
from lodestone.llm.text import let

DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.94, 0.04, 0.02)
MAX_TRAIN, VOCABULARY, SLOTS = 20_000, 400, 128
#: Weight of the squared weights in the classifier's loss: grows with the labels up to RIDGE, which RIDGE_LABELS of them reach, so that few labels are not drowned by it.
RIDGE, RIDGE_LABELS = 1.0, 2000
#: Weight of the rates' squared distance from 1 beside the squared residual.
CLOSENESS = 1e-4
#: Half the G statistic that a word needs (chance of 0.004 at two degrees of freedom): without it chance and length of documents choose the words where labels are few.
MIN_GAIN = 5.5
#: Separators of words of ASCII letters, digits and all beyond ASCII; both cases are words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE_CHARS = r"[a-z\x20\x80-\x{10FFFF}]+"
MARKS = r"[^#*$%&|<>!=+@]+"


def _bin(name: str, share: Column, steps: int = 20, top: int = 9) -> Column:
    return F.concat(F.lit(name), F.least(F.lit(top), F.floor(F.coalesce(share, F.lit(0.0)) * steps)).cast("string"))


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds __words and __marks: shares of marks, capitals, digits and distinct words in steps, as words that no text holds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__words", F.array_remove(F.split(text, SEPARATORS, -1), "")).withColumn("__rest", F.regexp_replace(text, RARE_CHARS, ""))
    n = F.length(text)
    part = lambda keep: F.try_divide(F.length(F.regexp_replace("__rest", keep, "")), n)
    marks = F.array(
        _bin("#mark", part(MARKS), 50),
        _bin("#upper", part(r"[^A-Z]+"), 40),
        _bin("#digit", part(r"[^0-9]+"), 50),
        _bin("#distinct", F.try_divide(F.size(F.array_distinct("__words")), F.size("__words")), 10, 10),
    )
    return out.withColumn("__marks", marks).drop("__rest")


def _regress(x: np.ndarray, y: np.ndarray, domains: int, ridge: float, rounds: int = 80) -> np.ndarray:
    """Weights (features and a constant, by domain) of a multinomial logistic regression.

    Each round takes the Newton step of a bound on the curvature that holds for
    all weights, so the loss falls in every round and one inverse serves all.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    want, w = np.eye(domains)[y], np.zeros((x.shape[1], domains))
    step = np.linalg.inv(x.T @ x / 2 + ridge * np.eye(x.shape[1]))
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        w -= step @ (x.T @ (p / p.sum(axis=1, keepdims=True) - want) + ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int = MAX_TRAIN, vocabulary: int = VOCABULARY) -> tuple[dict[str, list[float]], list[float]] | None:
    """(weights by word, constants); None without labels. Pass another ``labels`` to hold documents out."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return None
    share = min(1.0, max_train / n)
    drawn = lambda c: F.pmod(F.xxhash64(c), F.lit(1_000_000)) < int(share * 1_000_000)
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    known = known.filter(drawn(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), domain.alias("k"))
    rows = docs.select(F.col(id_col).alias("__id"), text_col).filter(drawn(F.col("__id"))).join(known, "__id")
    rows = materialize(_measured(rows, text_col).select("k", F.array_distinct(F.concat("__marks", "__words")).alias("held")), "labelled")
    sizes = dict(rows.groupBy("k").count().collect())
    every = sum(sizes.values())
    if not every:
        return None
    tokens = rows.select("k", F.explode("held").alias("w"))
    per = tokens.groupBy("w").agg(*(F.sum((F.col("k") == k).cast("long")).alias(f"n{k}") for k in range(len(DOMAINS))))
    per = per.filter(F.greatest(*(F.col(f"n{k}") for k in range(len(DOMAINS)))) >= 3)
    seen = sum((F.col(f"n{k}") for k in range(1, len(DOMAINS))), F.col("n0"))
    gain = sum((F.when(F.col(f"n{k}") > 0, F.col(f"n{k}") * F.log((F.col(f"n{k}") / seen) / F.lit((sizes.get(k, 0) + 1) / (every + len(DOMAINS))))).otherwise(0.0) for k in range(len(DOMAINS))), F.lit(0.0))
    top = sorted(r["w"] for r in per.withColumn("gain", gain).filter(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "w").limit(vocabulary).collect())
    # of each labelled row the numbers of its words come to the driver, MAX_TRAIN x VOCABULARY at most
    chosen = F.array(*map(F.lit, top))
    numbers = F.array_sort(F.transform(F.filter("held", lambda w: w.isin(top)), lambda w: F.array_position(chosen, w).cast("int") - 1)) if top else F.array().cast("array<int>")
    got = rows.groupBy("k", numbers.alias("at")).count().collect()
    times = [r["count"] for r in got]
    x = np.zeros((len(got), len(top)))
    for i, r in enumerate(got):
        x[i, r["at"]] = 1.0
    w = _regress(np.repeat(x, times, axis=0), np.repeat([r["k"] for r in got], times), len(DOMAINS), min(RIDGE, sum(times) * RIDGE / RIDGE_LABELS))
    return {t: [float(v) for v in w[i]] for i, t in enumerate(top)}, [float(v) for v in w[-1]]


def posteriors(docs: DataFrame, model: tuple[dict[str, list[float]], list[float]] | None, targets: tuple[float, ...] = TARGETS, text_col: str = "text") -> DataFrame:
    """Adds n_tokens and posterior (array of a share per domain)."""
    out = _measured(docs, text_col).withColumn("n_tokens", F.size("__words").cast("long"))
    literal = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    if model is None:
        return out.withColumn("posterior", literal(targets)).drop("__words", "__marks")
    weights, constants = model
    words = sorted(weights)
    # a map is searched from end to end, so words are dealt to small ones by a checksum
    slots: list[list[str]] = [[] for _ in range(SLOTS)]
    for w in words:
        slots[zlib.crc32(w.encode()) % SLOTS].append(w)
    table = F.array(*(F.create_map(*(x for w in ws or [""] for x in (F.lit(w), literal(weights.get(w, constants))))) for ws in slots)) if words else None
    of = lambda w: F.element_at(F.get(table, (F.crc32(w.cast("binary")) % SLOTS).cast("int")), w)
    hits = F.concat(F.array_distinct(F.filter("__words", lambda w: w.isin(words))), F.filter("__marks", lambda w: w.isin(words)))
    score = F.aggregate(hits, literal(constants), lambda a, w: F.zip_with(a, of(w), lambda x, y: x + y)) if words else literal(constants)
    powers = lambda s: let(F.array_max(s), lambda m: F.transform(s, lambda x: F.exp(x - m)))
    share = lambda ps: let(F.aggregate(ps, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(ps, lambda x: x / t))
    return out.withColumn("posterior", let(let(score, powers), share)).drop("__words", "__marks")


def _rate(pull: np.ndarray) -> Column:
    """A row's rate: what the summed gradient leaves of 1, projected."""
    move = sum((F.get("posterior", F.lit(k)) * float(x) for k, x in enumerate(pull)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - move)


def fit(found: DataFrame, targets: tuple[float, ...], closeness: float = CLOSENESS, tolerance: float = 1e-6, passes: int = 100) -> np.ndarray:
    """The summed gradient, by domain, at the least-squares rates; ``found`` has n_tokens and posterior.

    Ends when the gradient of the dual, which is zero there, is below
    ``tolerance`` in the metric. ``passes`` bounds the passes over ``found``;
    each sums some numbers.
    """
    k = len(targets)
    size = found.agg(F.sum("n_tokens")).first()[0] or 0
    if not size:
        return np.zeros(k)
    goal = np.array(targets) / sum(targets)
    part = F.col("n_tokens") / F.lit(float(size))
    p = [F.get("posterior", F.lit(i)) for i in range(k)]

    def measure(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The residual of the domains, the Gram matrix of the rows whose rate is above zero, and the sum of squared rates."""
        rate = F.col("rate")
        on = F.when(rate > 0, part).otherwise(0.0)
        sums = [*(part * rate * x for x in p), *(on * x * y for x in p for y in p), part * rate * rate]
        got = np.array(found.withColumn("rate", _rate(pull)).agg(*(F.sum(c).alias(f"s{n}") for n, c in enumerate(sums))).first(), float)
        return got[:k] - goal, got[k:-1].reshape(k, k), float(got[-1])

    pull = np.zeros(k)
    residual, gram, squares = measure(pull)
    every = gram + 1e-9 * np.trace(gram) * np.eye(k)  # all rates are 1: the metric
    value = lambda v, s: s / 2 + float(v @ goal) + closeness / 2 * float(v @ every @ v)
    used = 1
    while used < passes:
        gradient = closeness * (every @ pull) - residual
        if float(gradient @ np.linalg.solve(every, gradient)) <= tolerance**2:
            break
        step, share = -np.linalg.solve(gram + closeness * every, gradient), 1.0
        while True:
            after = pull + share * step
            seen = measure(after)
            used += 1
            if value(after, seen[2]) <= value(pull, squares) + 1e-4 * share * float(gradient @ step) or share < 1e-4 or used >= passes:
                break
            share /= 2
        pull, (residual, gram, squares) = after, seen
    return pull


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: tuple[float, ...] = TARGETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    max_train: int = MAX_TRAIN,
) -> DataFrame:
    """``carry`` columns (all by default), n_tokens, posterior, rate, copies.

    ``copies``: the rate rounded down or up, by a hash of id and text, so that
    its expectation is the rate.
    """
    outputs = ("n_tokens", "posterior", "rate", "copies")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in outputs]
    model = train(docs, labels, id_col, text_col, max_train)
    found = posteriors(docs.withColumn("__u", F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) / F.lit(float(1 << 20))), model, targets, text_col)
    found = materialize(found.select(*carry, "__u", "n_tokens", "posterior"), "posteriors")
    out = found.withColumn("rate", _rate(fit(found, targets)))
    copies = F.floor("rate") + (F.col("__u") < F.col("rate") - F.floor("rate")).cast("int")
    return out.withColumn("copies", copies.cast("int")).select(*carry, *outputs)
