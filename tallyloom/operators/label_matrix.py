"""A label model from the overlap matrix of labeling functions, for all targets in one plan.

Votes count as 1 (for) and -1 (against). Where two functions of a target both vote, the mean product of their votes is an
entry of its overlap matrix; that and the mean of each function's votes is all the model needs: one aggregate over the votes,
with a row for each two functions of a target.

If functions err independently of each other, an entry off the diagonal is the product a_i a_j of their margins (a = twice the
accuracy less one), so the matrix, but for its diagonal, has rank one, and any three functions give a_i^2 = m_ij m_ik / m_jk;
the model takes the median of these, over all two others that don't depend on i or each other. The inverse of such a matrix
(completed by ones on the diagonal) is a diagonal less a matrix of rank one, too; two functions whose entry of the inverse
departs from that depend on each other (copies, say). They leave each other's triples, and share one vote when fused.
The share of positives comes from the means: E[vote_i] = a_i (2 p - 1).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import votes as v

LEAST, MOST = 0.05, 0.95
#: What an entry of the inverse may be off, as a share of its diagonal entries' mean.
DEPENDENT = 0.25


def overlap_matrix(votes: DataFrame) -> DataFrame:
    """target, a, b (a <= b by name), n rows where both vote, m their mean product (of a and a: the mean of its votes)."""
    g = votes.where("vote != -1").groupBy("doc_id", *v.TARGET).agg(F.sort_array(F.collect_list(F.struct("lf_name", (2 * F.col("vote") - 1).alias("vote")))).alias("v"))
    pair = lambda a, b: F.struct(a["lf_name"].alias("a"), b["lf_name"].alias("b"), F.when(a["lf_name"] == b["lf_name"], a["vote"]).otherwise(a["vote"] * b["vote"]).alias("x"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["lf_name"] >= a["lf_name"]), lambda b: pair(a, b))))
    return g.select(*v.TARGET, F.explode(pairs).alias("p")).groupBy(*v.TARGET, "p.a", "p.b").agg(F.count("*").alias("n"), (F.sum("p.x").cast("double") / F.count("*")).alias("m"))


def margins(m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """a_i of each function, from triples of functions that are apart (booleans, symmetrical); nan without any."""
    n = len(m)
    out = np.full(n, np.nan)
    for i in range(n):
        found = []
        for j, k in itertools.combinations([x for x in range(n) if x != i and apart[i, x]], 2):
            if apart[j, k] and np.isfinite(q := m[i, j] * m[i, k] / m[j, k] if m[j, k] else np.nan) and q > 0:
                found.append(min(q, 1.0))
        if found:
            out[i] = np.sqrt(np.median(found))
    return out


def dependent(m: np.ndarray) -> np.ndarray:
    """Which two functions depend on each other, by the inverse of the completed matrix; the worst pair first, as a pair that
    depends bends the margins, and with these what is seen of the others."""
    n = len(m)
    apart = ~np.eye(n, dtype=bool)
    while n > 3:
        a = np.nan_to_num(margins(m, apart), nan=0.0)
        full = np.where(np.isfinite(m), m, 0.0)
        np.fill_diagonal(full, 1.0)
        inverse = np.linalg.inv(full + 0.01 * np.eye(n))
        expected = np.linalg.inv(np.outer(a, a) + np.diag(1 - a * a) + 0.01 * np.eye(n))
        off = np.abs(inverse - expected) / np.sqrt(np.abs(np.outer(np.diag(inverse), np.diag(inverse))))
        off[~apart] = 0
        i, j = np.unravel_index(off.argmax(), off.shape)
        if off[i, j] <= DEPENDENT:
            break
        apart[i, j] = apart[j, i] = False
        if np.isnan(margins(m, apart)).any():  # a triple must be left for each function
            apart[i, j] = apart[j, i] = True
            break
    return ~apart & ~np.eye(n, dtype=bool)


PARAMETERS = "target_field string, target_value string, lf_name string, accuracy double, prior double, weight double, group_size int"


def solve(t: pd.DataFrame) -> pd.DataFrame:
    """The overlap matrix of a target -> accuracy and weight (its log odds) of each function, and the share of positives.
    Targets with fewer than three functions that vote, or with margins that can't be told, give no row."""
    names = sorted(set(t["a"]) | set(t["b"]))
    at = {x: i for i, x in enumerate(names)}
    n = len(names)
    m, means, counts = np.full((n, n), np.nan), np.zeros(n), np.zeros(n)
    for a, b, both, x in zip(t["a"], t["b"], t["n"], t["m"], strict=True):
        if a == b:
            means[at[a]], counts[at[a]] = x, both
        else:
            m[at[a], at[b]] = m[at[b], at[a]] = x
    columns = [c.split()[0] for c in PARAMETERS.split(", ")]
    if n < 3:
        return pd.DataFrame(columns=columns)
    tied = dependent(m)
    a = margins(m, ~tied & ~np.eye(n, dtype=bool))
    if np.isnan(a).all():
        return pd.DataFrame(columns=columns)
    accuracy = np.clip((1 + np.nan_to_num(a, nan=0.0)) / 2, LEAST, MOST)
    told = 2 * accuracy - 1
    positives = (counts * told) @ means / max((counts * told) @ told, 1e-12)
    prior = float(np.clip((1 + positives) / 2, 0.01, 0.99))
    group, size = np.arange(n), np.ones(n, int)
    for i, j in zip(*np.nonzero(tied), strict=True):
        group[group == group[j]] = group[i]
    size = np.array([(group == g).sum() for g in group])
    row = t.iloc[0]
    return pd.DataFrame({"target_field": row["target_field"], "target_value": row["target_value"], "lf_name": names, "accuracy": accuracy, "prior": prior, "weight": np.log(accuracy / (1 - accuracy)) / size, "group_size": size})[columns]


def parameters(votes: DataFrame) -> DataFrame:
    """Accuracies of all functions of all targets: a task holds one target's matrix."""
    return overlap_matrix(votes).groupBy(*v.TARGET).applyInPandas(solve, PARAMETERS)


def fuse(votes: DataFrame) -> DataFrame:
    """Probabilities of all targets by their models; by majority where a target has no model."""
    p = parameters(votes).select(*v.TARGET, "lf_name", "weight", F.log(F.col("prior") / (1 - F.col("prior"))).alias("start"))
    side = F.when(F.col("vote") == 1, 1).when(F.col("vote") == 0, -1).otherwise(0)
    z = votes.join(p, [*v.TARGET, "lf_name"]).groupBy("doc_id", *v.TARGET).agg((F.sum(side * F.col("weight")) + F.max("start")).alias("z"))
    cast = votes.groupBy("doc_id", *v.TARGET).agg(F.count_if(F.col("vote") != -1).alias("cast"))
    t = v.majority(votes).join(cast, ["doc_id", *v.TARGET]).join(z, ["doc_id", *v.TARGET], "left")
    p = F.when(F.col("z").isNull(), F.col("probability")).when(F.col("cast") == 0, 0.5).otherwise(1 / (1 + F.exp(-F.col("z"))))
    status = F.when(F.col("z").isNull(), F.col("fit_status")).otherwise("success_model")
    return t.withColumns({"probability": p, "fit_status": status}).drop("z", "cast")
