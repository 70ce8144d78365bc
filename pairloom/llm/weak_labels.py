"""Weak supervision: expectation-maximisation over rules that vote or abstain.

A vote is 1 (good), 0 (bad) or null (abstains).  The rows are first reduced to
counts of vote patterns, at most 3^m rows for m rules whatever the input, so
the loop below runs on a few numbers on the driver while all work on rows
stays in Spark."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

MAX_RULES = 8  # 3^8 = 6,561 patterns at most

#: Prior of the estimates (MAP-EM).  Rules written for different symptoms
#: seldom fire together, so agreement alone cannot tell a symptom of bad texts
#: from any other split of the corpus.  The prior says what a rule's author
#: means: a rule rarely votes bad on a good text, and sees one in four bad
#: ones.  It weighs ``STRENGTH`` times the rows on which the rule votes, so it
#: means the same at every corpus size, and a rule that votes bad on many
#: texts still loses its say.
#: So does the share of good texts before any vote.
FALSE_ALARM, RECALL, GOOD_SHARE, STRENGTH = 0.001, 0.25, 0.85, 5.0


@dataclass
class LabelModel:
    """P(good), and for each rule P(votes good | good), P(votes bad | bad),
    both among the rows on which it votes."""

    prior: float
    good: list[float]
    bad: list[float]
    rules: list[str] = field(default_factory=list)

    def log_odds(self) -> tuple[float, list[float], list[float]]:
        """Log odds of good: the constant, and what a good or bad vote adds."""
        return (math.log(self.prior / (1 - self.prior)),
                [math.log(g / (1 - b)) for g, b in zip(self.good, self.bad)],
                [math.log((1 - g) / b) for g, b in zip(self.good, self.bad)])

    def posterior(self) -> Column:
        """P(good | votes) as an expression over the rules' columns."""
        const, up, down = self.log_odds()
        z = F.lit(const)
        for name, u, d in zip(self.rules, up, down):
            z = z + F.when(F.col(name) == 1, F.lit(u)).when(F.col(name) == 0, F.lit(d)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_patterns(patterns: list[tuple[tuple, int]], rules: list[str], rounds: int = 200,
                 tolerance: float = 1e-9) -> LabelModel:
    """EM over (votes, count) patterns.  Starts from the votes themselves: a
    pattern with a bad vote is probably bad."""
    patterns = sorted(patterns, key=lambda p: tuple(-1 if v is None else v for v in p[0]))
    q = []
    for votes, _ in patterns:
        cast = [v for v in votes if v is not None]
        q.append(0.5 if not cast else 0.95 if all(cast) else 0.05)
    model = LabelModel(0.5, [0.5] * len(rules), [0.5] * len(rules), rules)
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = (sum(n * p for (_, n), p in zip(patterns, q)) + GOOD_SHARE * (STRENGTH * total + 1)) / (total + STRENGTH * total + 1)
        good, bad = [], []
        for j in range(len(rules)):
            gg = gv = bb = bv = 0.0
            for (votes, n), p in zip(patterns, q):
                if votes[j] is not None:
                    gv += n * p
                    bv += n * (1 - p)
                    gg += n * p * votes[j]
                    bb += n * (1 - p) * (1 - votes[j])
            g, b = STRENGTH * gv + 1, STRENGTH * bv + 1
            good.append((gg + g * (1 - FALSE_ALARM)) / (gv + g))
            bad.append((bb + b * RECALL) / (bv + b))
        model = LabelModel(prior, good, bad, rules)
        const, up, down = model.log_odds()
        new = []
        for votes, _ in patterns:
            z = const + sum(u if v == 1 else d for v, u, d in zip(votes, up, down) if v is not None)
            new.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        moved = max((abs(a - b) for a, b in zip(q, new)), default=0.0)
        q = new
        if moved < tolerance:
            break
    return model


def fit(votes: DataFrame, rules: list[str], rounds: int = 200) -> LabelModel:
    """Fit on all rows of ``votes``.  An empty table gives the prior."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules, got {len(rules)}")
    counted = votes.groupBy(*rules).agg(F.count(F.lit(1)).alias("n_rows_")).collect()  # at most 3^MAX_RULES rows
    return fit_patterns([(tuple(r[x] for x in rules), r["n_rows_"]) for r in counted], rules, rounds)
