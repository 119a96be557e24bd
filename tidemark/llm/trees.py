"""Tree ensembles of Spark ML as plain SQL expressions, for scoring inside array functions."""

from __future__ import annotations

import re
from collections.abc import Sequence


def _tree(lines: list[str], names: Sequence[str]) -> str:
    """One tree of a model's description, as nested CASE expressions; consumes its lines."""
    line = lines.pop(0).strip()
    if m := re.match(r"Predict: (\S+)", line):
        return f"{float(m[1])!r}D"
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    low = _tree(lines, names)
    lines.pop(0)  # the Else of the same split
    return f"CASE WHEN {names[int(m[1])]} <= {float(m[2])!r}D THEN {low} ELSE {_tree(lines, names)} END"


def weighted_sum(model, names: Sequence[str]) -> str:
    """SQL for the sum of the trees' predictions times their weights; names are SQL for the features."""
    parts = []
    for tree, weight in zip(model.trees, model.treeWeights):
        lines = [x for x in tree.toDebugString.splitlines()[1:] if x.strip()]
        parts.append(f"{float(weight)!r}D * ({_tree(lines, names)})")
    return " + ".join(parts)


def boosted_probability(model, names: Sequence[str]) -> str:
    """Of a gradient-boosted classifier."""
    return f"(1D / (1D + exp(-2D * ({weighted_sum(model, names)}))))"


def forest_probability(model, names: Sequence[str]) -> str:
    """Of a forest of regression trees on labels 0 and 1: the mean of its leaves' shares."""
    return f"(({weighted_sum(model, names)}) / {float(sum(model.treeWeights))!r}D)"
