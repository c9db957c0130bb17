"""Weak labels: accuracies of rules that vote or abstain, by expectation-maximisation on counts of vote patterns.

Votes are 1 (good), -1 (bad) or 0 (abstain). With m rules there are at most 3**m patterns, so the table of pattern
counts that the driver reads does not grow with the data; counts are taken over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = (-1, 0, 1)
MAX_RULES = 9             # 3**9 patterns at most
# What is believed of every rule before any row is seen, as STRENGTH rows of each class: that good rows are common and
# that a bad vote is rare on them. It settles which class is the good one and steadies rules that hardly ever vote;
# a few hundred rows outweigh it.
STRENGTH = 100
PRIOR = 0.9               # share of good rows
ALARM, FALSE_ALARM = 0.3, 0.01        # share of bad votes on bad and on good rows
PRAISE = (0.2, 0.4)       # share of good votes among the others, on bad and on good rows


@dataclass(frozen=True)
class WeakModel:
    """``prior``: share of good rows. ``tables[j][y][v]``: probability that rule j votes VOTES[v] on class y (0 bad,
    1 good). ``accuracies[j]``: probability that its vote is right when it does not abstain."""

    prior: float
    tables: tuple
    accuracies: tuple

    def log_odds(self, votes: Sequence[int]) -> float:
        x = math.log(self.prior / (1 - self.prior))
        for t, v in zip(self.tables, votes):
            x += math.log(t[1][v + 1] / t[0][v + 1])
        return x


def _belief(alarm: float, praise: float) -> tuple:
    return STRENGTH * alarm, STRENGTH * (1 - alarm) * (1 - praise), STRENGTH * (1 - alarm) * praise


def fit(patterns: Sequence[tuple[Sequence[int], float]], n_rules: int, steps: int = 200) -> WeakModel:
    """EM from "bad if any rule says so": E-step the posterior of each pattern, M-step the rules' tables and the prior
    from the rows and the belief. Without rows everything is even."""
    total = sum(c for _, c in patterns)
    if not total:
        return WeakModel(0.5, (((1 / 3,) * 3,) * 2,) * n_rules, (0.5,) * n_rules)
    post = [0.1 if any(v < 0 for v in p) else 0.95 for p, _ in patterns]
    start = _belief(ALARM, PRAISE[0]), _belief(FALSE_ALARM, PRAISE[1])
    model = None
    for _ in range(steps):
        good = sum(q * c for q, (_, c) in zip(post, patterns))
        prior = min(max((good + PRIOR * STRENGTH) / (total + STRENGTH), 1e-3), 1 - 1e-3)
        tables, acc = [], []
        for j in range(n_rules):
            cells = [list(x) for x in start]
            for q, (p, c) in zip(post, patterns):
                cells[1][p[j] + 1] += q * c
                cells[0][p[j] + 1] += (1 - q) * c
            right = cells[1][2] + cells[0][0]
            wrong = cells[1][0] + cells[0][2]
            acc.append(right / (right + wrong))
            tables.append(tuple(tuple(x / sum(row) for x in row) for row in cells))
        model = WeakModel(prior, tuple(tables), tuple(acc))
        now = [1 / (1 + math.exp(-min(max(model.log_odds(p), -500), 500))) for p, _ in patterns]
        moved = max((abs(a - b) for a, b in zip(now, post)), default=0.0)
        post = now
        if moved < 1e-9:
            break
    return model


def fit_votes(votes: DataFrame, columns: Sequence[str], steps: int = 200) -> WeakModel:
    """Fit on the vote columns of every row of ``votes``; an empty table gives an even prior and even tables."""
    if len(columns) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rows = votes.groupBy(*columns).agg(F.count("*").alias("n")).collect()     # 3**MAX_RULES rows at most
    return fit(sorted(([int(r[c]) for c in columns], int(r["n"])) for r in rows), len(columns), steps)


def posterior(model: WeakModel, columns: Sequence[str]) -> Column:
    """Probability that a row is good, from its vote columns."""
    x = F.lit(math.log(model.prior / (1 - model.prior)))
    for c, t in zip(columns, model.tables):
        ratios = [math.log(t[1][k] / t[0][k]) for k in range(3)]
        x = x + F.when(F.col(c) < 0, ratios[0]).when(F.col(c) > 0, ratios[2]).otherwise(ratios[1])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
