"""Connected components of a link table, without collecting it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.llm.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, label for every node of the links; label is the smallest node that it reaches.

    Alternates two star steps until nothing changes: every node hands its larger
    neighbours to its smallest neighbour, then its smaller ones.  Minima are
    pre-aggregated and joined back, so a node of very many links is never gathered.
    """
    edges = cut(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).filter("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").filter("u <> v").distinct()
        edges = cut(small)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"links still changed after {rounds} rounds")
    label = edges.groupBy("v").agg(F.min("u").alias("label")).withColumnRenamed("v", "node")
    return cut(label.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()).groupBy("node").agg(F.min("label").alias("label")))


def merged(label: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The labels of ``components`` after further links: components are joined by their labels, nodes aren't gone through again."""
    new = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    named = lambda df, c: df.join(label.select(F.col("node").alias(f"n_{c}"), F.col("label").alias(f"l_{c}")), F.col(c) == F.col(f"n_{c}"), "left").withColumn(f"l_{c}", F.coalesce(f"l_{c}", c))
    ends = cut(named(named(new, "a"), "b").select("l_a", "l_b"))
    top = components(ends, "l_a", "l_b").select(F.col("node").alias("l"), F.col("label").alias("top"))
    nodes = label.unionByName(ends.select(F.explode(F.array("l_a", "l_b")).alias("node")).select("node", F.col("node").alias("label"))).distinct()
    return cut(nodes.join(top, nodes["label"] == top["l"], "left").select("node", F.coalesce("top", "label").alias("label")).distinct())


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the links a, b as join the same labels: fewer than there are labels."""
    names, place = np.unique(label, return_inverse=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    _, first = np.unique(place[a].astype(np.int64) * len(names) + place[b], return_index=True)
    keep, apart = [], len(names)
    for i, x, y in zip(first.tolist(), place[a[first]].tolist(), place[b[first]].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            keep.append(i)
            apart -= 1
            if apart == 1:
                break
    return a[keep], b[keep]
