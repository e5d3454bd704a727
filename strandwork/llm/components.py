"""Connected components of an edge table, as DataFrame steps (alternating large-star and small-star).

Labels never reach the driver: only the number of changed edges does. Every round is written to the shared folder,
so that the plan stays short and a lost executor costs one round at most; the round before is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._common import Scratch


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, root`` for every node that has an edge; ``root`` is the smallest node of its component.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct()
    keep = Scratch(edges.sparkSession)
    e = keep(e, "edges")
    print_of = None
    while True:
        # large-star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: every smaller neighbour of a node, and the node, are tied to its smallest neighbour
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        before, e = e, keep(small.where("a <> b").distinct(), "edges")
        keep.drop(before)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == print_of:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        print_of = state
