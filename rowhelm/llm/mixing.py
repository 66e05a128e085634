"""Mixing sources to target weights with soft membership. DataFrame operations only.

1. A labelled table (doc_id, domain) trains a classifier: a multinomial model of the letters that
   tell the domains apart most. Every document gets its posterior p(domain), tempered so that a long text
   isn't certain of itself. Letters are learned from at most ``max_labelled`` rows, those with the smallest hash.
2. Document i has rate r_i >= 0, and sum_i r_i * words_i * p_i(d) are the expected words of domain
   d. Rates are fitted to the targets by projected gradient steps from r = 1 (accelerated, scaled
   by the words; squared errors are weighted by the domains' shares, which makes the problem well conditioned): each step is one aggregate of D sums over all documents, and the rates are a function of
   the steps so far, so no rate is stored or moved between steps.
3. Where every document is to be kept, no rate is below 1, a domain without a target keeps its own share, and
   the mixture is as large as the most over-represented domain needs to come down to its target.

Nulls and empties: null or empty text has no words; its posterior is the domains' share and its rate
follows from that. Labels with a null id or domain teach nothing. Rows that repeat an id are separate
documents. Domains without a target get target 0 (their own share where every document is kept); targets
without a labelled domain are unreachable and left out. Without labels there is one domain '' that takes all. An empty table gives an empty
result. Extra columns are ignored by ``rates`` and kept by ``resample``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowhelm.llm.storage import bounded_sample, stored

MAX_LABELLED = 2000
LETTERS = 12
SURE_AFTER = 60.0
STEPS = 60
#: Posteriors are rounded, so that documents alike share a group in the fit.
DIGITS = 3
TOLERANCE = 1e-4
WORD = r"[^\x20\x09-\x0D]+"


def learn(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED, letters: int = LETTERS) -> tuple[list[str], list[str], list[list[float]], list[float]]:
    """(domains, letters, log-probability of each letter by domain, log-prior)."""
    known = labelled.select("doc_id", "domain").dropna()
    sample = bounded_sample(known, "doc_id", max_labelled)  # two values a row
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter("text is not null")
    counted = texts.select("domain", F.explode(F.split("text", "")).alias("c")).filter("c rlike '\\\\p{Ll}'")
    rows = counted.groupBy("domain", "c").count().collect()  # domains x letters of Unicode
    priors = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    domains = sorted(priors) or [""]
    total = {d: 0 for d in domains}
    own = {}
    for r in rows:
        own[r["domain"], r["c"]] = r["count"]
        total[r["domain"]] += r["count"]
    rate = lambda d, c: (own.get((d, c), 0) + 0.5) / (total[d] + 50)

    def worth(c):
        """Information of the letter about the domain, all domains alike."""
        mean = sum(rate(d, c) for d in domains) / len(domains)
        return sum(rate(d, c) * math.log(rate(d, c) / mean) for d in domains)

    chosen = sorted({c for _, c in own}, key=lambda c: (-worth(c), c))[:letters]
    logs = [[math.log(rate(d, c)) for c in chosen] + [math.log(max(1e-3, 1 - sum(rate(d, c) for c in chosen)))] for d in domains]
    n = sum(priors.values())
    return domains, chosen, logs, [math.log((priors.get(d, 0) + 1) / (n + len(domains))) for d in domains]


def posteriors(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """The columns, n_tokens and p: the posterior of each domain."""
    domains, letters, logs, prior = model
    text = F.coalesce("text", F.lit(""))
    counts = [(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).alias(f"_c{k}") for k, c in enumerate(letters)]
    base = docs.select(*columns, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), F.length(text).alias("_n"), *counts)
    rest = F.col("_n").cast("double")
    for k in range(len(letters)):
        rest = rest - F.col(f"_c{k}")
    base = base.withColumn(f"_c{len(letters)}", rest)
    temper = F.least(F.lit(1.0), F.lit(SURE_AFTER) / F.greatest(F.col("_n").cast("double"), F.lit(1.0)))
    score = []
    for d in range(len(domains)):
        sums = F.lit(0.0)
        for k in range(len(letters) + 1):
            sums = sums + F.col(f"_c{k}") * F.lit(logs[d][k])
        score.append(sums * temper + F.lit(prior[d]))
    base = base.select(*columns, "n_tokens", F.array(*score).alias("_s"))
    powers = F.transform("_s", lambda x: F.exp(x - F.array_max("_s")))
    base = base.select(*columns, "n_tokens", powers.alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return base.select(*columns, "n_tokens", F.transform("_e", lambda x: F.round(x / total, DIGITS)).alias("p"))


def _vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _dot(p: Column, g: Column) -> Column:
    return F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def rate_after(steps: list[tuple[list[float], float]], floor: float = 0.0) -> tuple[Column, Column]:
    """(rate, look-ahead) of a row with posterior ``p`` after the steps (gradient, momentum); no rate is below ``floor``."""
    if not steps:
        return F.lit(1.0), F.lit(1.0)
    history = F.array(*(F.struct(_vector(g).alias("g"), F.lit(m).alias("m")) for g, m in steps))

    def step(state, move):
        rate = F.greatest(F.lit(floor), state.y - _dot(F.col("p"), move.g))
        return F.struct(rate.alias("r"), (rate + move.m * (rate - state.r)).alias("y"))

    end = F.aggregate(history, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), step)
    return end.r, end.y


def fit(base: DataFrame, n_domains: int, goal: list[float], steps: int = STEPS, tolerance: float = TOLERANCE, floor: float = 0.0) -> list[tuple[list[float], float]]:
    """Steps that bring the words by domain to ``goal`` (shares of all words) for rows (n_tokens, p)."""
    groups = stored(base.groupBy("p").agg(F.sum("n_tokens").alias("n")).filter("n > 0"), "groups")  # equal posteriors have equal rates
    total = groups.agg(F.sum("n")).first()[0] or 0
    taken: list[tuple[list[float], float]] = []
    if not total:
        return taken
    t, shares = 1.0, None
    for _ in range(steps):
        rate, ahead = rate_after(taken, floor)
        now = groups.select("p", (rate * F.col("n")).alias("r"), (ahead * F.col("n")).alias("y"))
        sums = now.agg(*(F.sum(F.col("p")[d] * F.col(c)) for c in ("r", "y") for d in range(n_domains))).first()
        at = [s / total for s in sums]
        if max(abs(a - g) for a, g, s in zip(at, goal, shares or at) if s) <= tolerance * max(goal):
            break
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        shares = shares or at[:n_domains]  # at rate 1: errors count relative to a domain's share
        taken.append(([(a - g) / s if s else 0.0 for a, g, s in zip(at[n_domains:], goal, shares)], (t - 1) / after))
        t = after
    return taken


def whole_goal(base: DataFrame, domains: list[str], targets: dict[str, float], size: float) -> list[float]:
    """Goals that need no rate below 1: shares of all words, ``size`` in sum or more."""
    sums = base.agg(F.sum("n_tokens"), *(F.sum(F.col("p")[d] * F.col("n_tokens")) for d in range(len(domains)))).first()
    if not sums[0]:
        return [size / len(domains)] * len(domains)
    shares = [s / sums[0] for s in sums[1:]]
    wanted = {d: max(0.0, targets[d]) for d in domains if d in targets}
    free = sum(s for d, s in zip(domains, shares) if d not in wanted)
    whole = sum(wanted.values())
    goal = [wanted[d] / whole * max(0.0, 1 - free) if whole and d in wanted else s for d, s in zip(domains, shares)]
    # a target of 0 can't be met by repeating others; the floor keeps its documents
    size = max([size, *(s / g for s, g in zip(shares, goal) if g > 0)])
    return [size * g for g in goal]


def rates(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], size: float = 1.0, columns: list[str] | None = None, keep_all: bool = False
) -> DataFrame:
    """doc_id (or ``columns``), n_tokens, a posterior column for each domain, and the rate.

    The targets are weights; the mixture has ``size`` times the words of the documents. With ``keep_all``, no
    rate is below 1 and the mixture is larger where the targets need it.
    """
    columns = ["doc_id"] if columns is None else columns
    model = learn(docs, labelled)
    domains = model[0]
    base = stored(posteriors(docs, model, columns), "posteriors")
    wanted = [max(0.0, targets.get(d, 0.0)) for d in domains]
    whole = sum(wanted)
    goal = [size * w / whole for w in wanted] if whole else [size / len(domains)] * len(domains)
    if keep_all:
        goal = whole_goal(base, domains, targets, size)
    floor = 1.0 if keep_all else 0.0
    rate, _ = rate_after(fit(base, len(domains), goal, floor=floor), floor)
    return base.select(*columns, "n_tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)), rate.alias("rate"))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], size: float = 1.0, keep_all: bool = True) -> DataFrame:
    """The documents with their columns, each as often as its rate says; at least once with ``keep_all``.

    The whole part of the rate gives sure copies, a hash of the id and copy decides on the rest.
    """
    own = {c: f"_kept_{k}" for k, c in enumerate(docs.columns)}
    carried = docs.select("doc_id", "text", *(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in own.items()))
    rated = rates(carried, labelled, targets, size, list(own.values()), keep_all)
    chance = F.pmod(F.xxhash64(own["doc_id"], F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return rated.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*(F.col(n).alias(c) for c, n in own.items()))
