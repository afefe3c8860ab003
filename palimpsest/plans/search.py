"""The retrieval pipeline: a fluent builder that ends in one DataFrame.

filter -> vector and keyword channels -> fusion -> expansion -> composite score
-> near-duplicate removal -> diversity -> top_k -> rerank hook.

The channels' limits bound everything after them: the later steps see at most
twice top_k rows, or max_nodes after an expansion.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F

from palimpsest.config import Expand, Scoring, notify
from palimpsest.errors import Closed, ConfigError, DimensionMismatch, NonFinite, Unsupported
from palimpsest.functions.vector import best_first
from palimpsest.operators import ann, bm25, fusion, graph, knn, scoring
from palimpsest.operators.ann import CellIndex
from palimpsest.plans.compile import compile_filter
from palimpsest.plans.expr import Expr
from palimpsest.plans.parser import as_expr

if TYPE_CHECKING:
    from palimpsest.sources.view import View

BODY = ("key", "created_at", "expires_at", "importance", "confidence", "valid_from", "valid_to", "text", "metadata", "provenance")
_VIA = "struct<from_id:bigint,to_id:bigint,kind:smallint,weight:float>"


class Search:
    """Builds one search over a namespace of a view; `execute` gives the hits in rank order."""

    def __init__(self, view: View, ns: str) -> None:
        self.view, self.ns = view, ns
        self._vector: list[float] | None = None
        self._text: str | None = None
        self._filter: Expr | None = None
        self._top_k, self._ef = 10, None
        self._fusion: tuple[str, float] | None = None
        self._expand: Expand | None = None
        self._scoring: Scoring | None = None
        self._near: float | None = None
        self._lambda: float | None = None
        self._rerank: Callable[[DataFrame], DataFrame] | None = None
        self._index: tuple[CellIndex, int | None] | None = None
        self._exact = False
        self._query_id: int | None = None
        self._code_order = False

    def vector(self, query: Sequence[float]) -> Search:
        self._vector = [float(x) for x in query]
        return self

    def text(self, query: str) -> Search:
        self._text = query
        return self

    def where(self, condition: Expr | str) -> Search:
        found = as_expr(condition, self.view.now)
        self._filter = found if self._filter is None else self._filter & found
        return self

    def top_k(self, k: int) -> Search:
        self._top_k = k
        return self

    def ef(self, ef: int) -> Search:
        """Effort of an approximate search: filters that leave fewer candidates are scanned."""
        self._ef = ef
        return self

    def rrf(self, k: int = fusion.RRF_K) -> Search:
        self._fusion = ("rrf", k)
        return self

    def weighted(self, alpha: float) -> Search:
        self._fusion = ("weighted", alpha)
        return self

    def expand(self, options: Expand | None = None, **settings) -> Search:
        self._expand = options or Expand(**settings)
        return self

    def score(self, options: Scoring | None = None, **settings) -> Search:
        self._scoring = options or Scoring(**settings)
        return self

    def dedup_by_id(self) -> Search:
        """Hits never repeat a row in this engine, so this is the default too."""
        return self

    def dedup_near(self, threshold: float) -> Search:
        self._near = threshold
        return self

    def mmr(self, weight: float) -> Search:
        self._lambda = weight
        return self

    def rerank(self, hook: Callable[[DataFrame], DataFrame]) -> Search:
        self._rerank = hook
        return self

    def using(self, index: CellIndex, probes: int | None = None) -> Search:
        """Approximate vector channel by this index: of the rows that it knows only the probed cells are scored."""
        self._index = (index, probes)
        return self

    def exact(self) -> Search:
        """No index, even if the store has one."""
        self._exact = True
        return self

    def as_of(self, at_ms: int) -> Search:
        self.view = self.view.as_of(at_ms)
        return self

    def query_id(self, number: int) -> Search:
        """Numbers the query; the default is the next number of this process."""
        self._query_id = number
        return self

    def in_code_order(self) -> Search:
        """Without a composite score, rows that an expansion adds come after all others.

        The default is to sort by score whatever its source.
        """
        self._code_order = True
        return self

    def _check(self) -> None:
        config = self.view.config
        if self.view.closed:
            raise Closed("the store is closed")
        if self._vector is None and self._text is None:
            raise ConfigError("a search needs a vector or a text")
        if self._vector is not None:
            if len(self._vector) != config.dimension:
                raise DimensionMismatch(f"{len(self._vector)} components; the store has {config.dimension}")
            if not all(map(math.isfinite, self._vector)):
                raise NonFinite("the query vector")
        config.limits.check_top_k(self._top_k)
        if self._ef is not None:
            config.limits.check_ef(self._ef)
        if self._fusion is not None and (self._vector is None or self._text is None):
            raise Unsupported("fusion needs both channels")
        if self._fusion and self._fusion[0] == "weighted" and not 0.0 <= self._fusion[1] <= 1.0:
            raise ConfigError("alpha must be between 0 and 1")
        if self._near is not None and not 0.0 <= self._near <= 1.0:
            raise ConfigError("the threshold must be between 0 and 1")
        if self._lambda is not None and not math.isfinite(self._lambda):
            raise NonFinite("lambda")

    def _channels(self, everything: DataFrame) -> tuple[DataFrame, bool]:
        """Fused (rowid, score), and whether higher is better."""
        metric = self.view.config.metric
        condition = None if self._filter is None else compile_filter(self._filter)
        both = self._vector is not None and self._text is not None
        budget = 2 * self._top_k if both else self._top_k
        near = words = None
        if self._vector is not None:
            chosen = self._dispatch(everything, condition)
            if chosen is not None:
                near = knn.top_k(self._indexed(everything, condition, *chosen), self._vector, budget, metric)
            else:
                near = knn.top_k(everything, self._vector, budget, metric, condition)
        if self._text is not None:
            words = bm25.search(everything, self._text, budget, self.view.config.stopwords, condition)
        if not both:
            return (near, metric.higher_is_better) if words is None else (words, True)
        kind, value = self._fusion or ("rrf", fusion.RRF_K)
        if kind == "rrf":
            return fusion.reciprocal_rank([(near, metric.higher_is_better), (words, True)], self._top_k, int(value)), True
        return fusion.weighted(near, words, value, self._top_k, not metric.higher_is_better), True

    def _dispatch(self, everything: DataFrame, condition) -> tuple[CellIndex, int] | None:
        """The index and number of cells to probe, or None for an exact scan.

        An index is used where it holds more rows than are cheap to scan, for the
        present state only; a filter's candidates are counted to choose the probes.
        """
        options, asked = self.view.config.index, None
        if self._index is not None:
            index, asked = self._index
        elif self._exact or self.view.at_ms is not None:
            return None
        else:
            index = self.view.index(self.ns)
            if index is None or not ann.wants_index(index.size, options):
                return None
        if asked is not None:
            return index, asked
        if condition is None:
            return index, index.probes
        counts = everything.agg(F.count_if(condition), F.count(F.lit(1))).first()
        probes = ann.probes_for(index, counts[0], counts[1], max(self._ef or 0, self._top_k))
        return None if probes is None else (index, probes)

    def _indexed(self, everything: DataFrame, condition, index: CellIndex, probes: int) -> DataFrame:
        """The probed rows that are still the newest, and all rows that changed or came since the index was built."""
        live = everything if condition is None else everything.where(condition)
        known = live.where(F.col("seqno") < index.seqno).select("rowid", "seqno")
        rows = index.probed(self._vector, probes).select("rowid", "seqno", "vector").join(known, ["rowid", "seqno"], "left_semi")
        tail = live.where(F.col("seqno") >= index.seqno).select("rowid", "seqno", "vector")
        return rows.unionByName(tail)

    def execute(self) -> DataFrame:
        """The hits: (rowid, query_id, score, record columns, via, breakdown), best first.

        With `count_hits`, the hits are computed at once, and counted at the
        store's next flush.
        """
        number = next(self.view.log.queries) if self._query_id is None else self._query_id
        observer = self.view.config.observer
        try:
            hits = self._hits(number)
            if self.view.config.count_hits and self.view.at_ms is None:
                # Bounded by top_k; the order of a kept frame stays.
                hits = hits.persist()
                self.view.log.hits.extend(r.rowid for r in hits.select("rowid").collect())
        except Exception as error:
            notify(observer, "error", {"during": "query", "query_id": number, "error": str(error)})
            raise
        notify(observer, "query", {"query_id": number, "ns": self.ns, "top_k": self._top_k})
        return hits

    def _hits(self, number: int) -> DataFrame:
        self._check()
        uses_access = self._scoring is not None or (self._filter is not None and self._filter.uses_access)
        everything = self.view.rows(self.ns, with_access=uses_access)
        found, higher = self._channels(everything)
        candidates = everything if self._filter is None else everything.where(compile_filter(self._filter))
        if self._expand is not None:
            grown = graph.expand(found, self.view.edges(), candidates, self._expand)
            if self._code_order and self._scoring is None:
                own = found.select("rowid", F.col("score").alias("_own"))
                grown = grown.join(own, "rowid", "left").orderBy(
                    F.col("_own").isNull().asc(), F.col("_own").desc() if higher else F.col("_own").asc(), "rowid"
                ).limit(self._top_k).drop("_own")
            found = grown
        else:
            found = found.withColumn("via", F.lit(None).cast(_VIA))
        # Bounded by the channels' limits or max_nodes, whatever the table's size.
        hits = candidates.join(F.broadcast(found), "rowid").withColumn("query_id", F.lit(number).cast("bigint"))
        if self._scoring is not None:
            hits = scoring.composite(hits, self._scoring, self.view.now, higher)
            higher = True
        else:
            hits = hits.withColumn("breakdown", scoring.plain_breakdown(F.col("score")))
        hits = hits.select("rowid", "query_id", "score", "vector", *BODY, "via", "breakdown")
        if self._near is not None:
            hits = scoring.drop_near(hits, self._near, higher).drop("rank")
        if self._lambda is not None:
            hits = scoring.mmr(hits, self._lambda, self._top_k, higher)
            hits = hits.orderBy("rank")
        else:
            hits = hits.orderBy(*best_first(higher, F.col("score"), F.col("rowid"))).limit(self._top_k)
        hits = hits.drop("vector", "rank")
        if self._rerank is not None:
            hits = self._rerank(hits)
        return hits
