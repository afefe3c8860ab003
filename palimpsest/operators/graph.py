"""Relations between rows: neighbours, predecessors and associative expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.config import Expand
from palimpsest.functions.vector import best_first
from palimpsest.operators.versions import latest
from palimpsest.sources.scratch import saved


#: Up to so many given rows are broadcast.
MANY_IDS = 4096


def current_edges(log: DataFrame) -> DataFrame:
    """The newest state of each edge (from, to, kind) that isn't removed."""
    return latest(log, ("from_id", "to_id", "kind")).where(~F.col("removed")).drop("removed", "seqno")


def _of_kinds(edges: DataFrame, kinds: Sequence[int]) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds)) if kinds else edges


def neighbors(edges: DataFrame, from_ids: Sequence[int] | DataFrame, alive: DataFrame, kinds: Sequence[int] = (), reverse: bool = False) -> DataFrame:
    """Edges out of the given rows (into them with `reverse`) whose two ends are in `alive`.

    from_ids are ids, or a frame with a column rowid; `alive` has a column rowid.
    """
    near, far = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    found = _of_kinds(edges, kinds)
    ids = alive.select("rowid")
    # Which given rows are alive is asked of these, so edges meet their near end once and never by a key that very many share.
    if isinstance(from_ids, DataFrame):
        starts = from_ids.select("rowid").distinct().join(ids, "rowid", "left_semi")
        few = starts.limit(MANY_IDS + 1).collect()
        if len(few) <= MANY_IDS:
            starts = starts.sparkSession.createDataFrame([(r.rowid,) for r in few], "rowid bigint").coalesce(1)
            found = found.join(F.broadcast(starts.withColumnRenamed("rowid", near)), near, "left_semi")
        else:
            found = found.join(starts.withColumnRenamed("rowid", near), near, "left_semi")
    else:
        found = found.where(F.col(near).isin(*from_ids)).join(ids.where(F.col("rowid").isin(*from_ids)).withColumnRenamed("rowid", near), near, "left_semi")
    found = found.join(ids.withColumnRenamed("rowid", far), far, "left_semi")
    return found.select("from_id", "to_id", "kind", "weight", "metadata")


def predecessors(edges: DataFrame, to_ids: Sequence[int] | DataFrame, alive: DataFrame, kinds: Sequence[int] = ()) -> DataFrame:
    return neighbors(edges, to_ids, alive, kinds, reverse=True)


def expand(seeds: DataFrame, edges: DataFrame, targets: DataFrame, options: Expand, higher_is_better: bool = True) -> DataFrame:
    """Seeds (rowid, score) and what they reach: (rowid, score, via).

    A neighbour's score is score * weight * decay; a row keeps the best score of
    all paths of up to `hops` edges, and `via` (null for a seed that no path
    improved) is the last edge of that path. Only rows in `targets`, which the
    caller has filtered, are reached. New rows are admitted best first while
    there are fewer than `max_nodes` in all, so every hop joins a bounded
    frontier with the edges.
    """
    edge_type = "struct<from_id:bigint,to_id:bigint,kind:smallint,weight:float>"
    usable = _of_kinds(edges, options.kinds).select("from_id", "to_id", "kind", "weight")
    targets = targets.select("rowid")
    best = seeds.groupBy("rowid").agg(F.max("score").alias("score")).withColumn("via", F.lit(None).cast(edge_type))
    best = best.withColumn("fresh", F.lit(True))
    for hop in range(min(options.hops, Expand.MAX_HOPS)):
        if hop:
            # At most `max_nodes` rows; else each hop would compute the ones before it twice.
            best = saved(best, "hop")
        frontier = best.where("fresh").select(F.col("rowid").alias("from_id"), F.col("score").alias("from_score"))
        reached = usable.join(F.broadcast(frontier) if hop else frontier, "from_id").select(
            F.col("to_id").alias("rowid"),
            (F.col("from_score") * F.col("weight").cast("double") * options.decay).alias("score"),
            F.struct("from_id", "to_id", "kind", "weight").alias("via"),
        )
        reached = reached.groupBy("rowid").agg(
            F.max(F.struct("score", (-F.col("via.from_id")).alias("_tie"), "via")).alias("b")
        ).select("rowid", F.col("b.score").alias("new_score"), F.col("b.via").alias("new_via"))
        # Only what is reached is looked up among the targets.
        reached = reached.join(targets, "rowid", "left_semi")
        both = best.join(reached, "rowid", "full")
        improved = F.coalesce(F.col("new_score") > F.col("score"), F.col("new_score").isNotNull() & F.col("score").isNull())
        merged = both.select(
            "rowid",
            F.when(improved, F.col("new_score")).otherwise(F.col("score")).alias("score"),
            F.when(improved, F.col("new_via")).otherwise(F.col("via")).alias("via"),
            improved.alias("fresh"),
            F.col("score").isNull().alias("is_new"),
        )
        # Known rows first, then new ones by score: the limit admits just what fits.
        merged = merged.orderBy(F.col("is_new").asc(), F.col("score").desc(), F.col("rowid").asc())
        best = merged.limit(options.max_nodes).drop("is_new")
    return best.drop("fresh")


def edge_weight(weight: Column) -> Column:
    return F.least(F.greatest(weight.cast("double"), F.lit(0.0)), F.lit(1.0)).cast("float")
