"""Connected components by repeated contraction, as DataFrame plans over tables in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


#: So many edges are finished by one task.
FEW = 1 << 20


def smallest(batches):
    """All edges (a, b), a bounded number of them -> each node and the smallest of its component."""
    ends = [(batch["a"], batch["b"]) for batch in batches]
    if not ends:
        return
    nodes = pa.chunked_array([x for pair in ends for x in pair]).combine_chunks()
    lengths = [len(a) for a, _ in ends]
    names = pc.unique(nodes)
    names = names.take(pc.sort_indices(names))
    codes = pc.index_in(nodes, names).to_numpy()
    parts = np.split(codes, np.cumsum([n for n in lengths for _ in range(2)])[:-1])
    a, b = np.concatenate(parts[::2]), np.concatenate(parts[1::2])
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    yield pa.record_batch([names, names.take(pa.array(label))], ["node", "to"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b) -> (node, label): nodes with the same label are connected; nodes without an edge aren't listed.

    In each round every node moves to its smallest neighbour, if that is smaller, and the edges follow. Node ids should be
    hashes, so that long chains shrink by a constant factor. No node's neighbours are gathered in one place. Once `few` edges
    are left, one task finishes them.
    """
    e = cut(edges.where("a != b").distinct(), "edges")
    steps: list[DataFrame] = []
    while left := e.count():
        if left <= few:
            kind = e.schema["a"].dataType.simpleString()
            steps.append(cut(e.coalesce(1).mapInArrow(smallest, f"node {kind}, to {kind}"), "step"))
            break
        old = e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "step")
        steps.append(step)
        e = e.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        before, e = old, cut(e.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        discard(before)
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = steps[0].select("node", F.col("to").alias("label"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = cut(out, "components")
    discard(e, *steps)
    return out
