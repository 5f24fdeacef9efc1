"""Connected components of a link table by hooking and pointer jumping.

Each round every node hooks to its smallest smaller neighbour (one aggregate with map-side
combination, so a hub is no burden), chains of hooks are flattened by joining the hook table
with itself, and links are rewritten to the roots found. Nodes that hooked leave the graph,
so at least half of the rest goes each round. All state is written tables; nothing is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.llm.common import write_table


def _links(df: DataFrame) -> DataFrame:
    return (df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .filter("u < v").distinct())


def _flatten(hooks: DataFrame) -> DataFrame:
    """Follow hooks (node, root) until every root is one that did not hook."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = write_table(hooks.join(up, "root", "left").select(
            "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "hooks")
        hooks = jumped.select("node", "root")
        if not jumped.filter("moved").limit(1).count():
            return hooks


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (u, v) that isn't itself the smallest node
    of its component; ``root`` is that smallest node."""
    links, labels = write_table(_links(links), "links"), None
    while links.limit(1).count():
        hooks = _flatten(write_table(links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")), "hooks"))
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            old = labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            labels = write_table(old.unionByName(hooks), "labels")
        a = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        links = write_table(_links(links.join(a, "u", "left").join(b, "v", "left").select(
            F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))), "links")
    if labels is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' components under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new
