"""Reading a state of a store: pinned, lazy and without side effects."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F

from palimpsest.config import StoreConfig
from palimpsest.operators import ann, graph, stats, versions
from palimpsest.plans.compile import compile_filter
from palimpsest.plans.expr import Expr
from palimpsest.plans.parser import as_expr
from palimpsest.plans.search import Search
from palimpsest.sources.commits import CommitLog


def normal_path(path: str) -> str:
    """A namespace path without empty segments."""
    return "/".join(part for part in path.split("/") if part)


class View:
    """One committed state, read at one time.

    `now` decides expiry; with `at_ms` the state is that of the past, and expiry
    is judged by then. Relations and access counts are always the present ones.
    """

    def __init__(self, log: CommitLog, record: dict, config: StoreConfig, now: int, at_ms: int | None = None) -> None:
        self.log, self.record, self.config = log, record, config
        self.at_ms, self._now, self.closed = at_ms, now, False

    @property
    def now(self) -> int:
        return self._now if self.at_ms is None else self.at_ms

    def as_of(self, at_ms: int) -> View:
        return View(self.log, self.record, self.config, self._now, at_ms)

    def versions(self) -> DataFrame:
        found = self.log.table(self.record, "versions")
        if self.record["tables"].get("closures"):
            found = versions.with_closures(found, self.log.table(self.record, "closures"))
        return found

    def newest(self, ns: str | None = None) -> DataFrame:
        """Newest version of each row, tombstones and expired ones too; namespace first, as rows never move."""
        found = self.versions()
        if ns is not None:
            found = found.where(F.col("ns") == normal_path(ns))
        return versions.latest(found) if self.at_ms is None else versions.as_of(found, self.at_ms)

    def rows(self, ns: str | None = None, with_access: bool = False) -> DataFrame:
        """Live rows."""
        found = self.newest(ns).where(versions.live(self.now))
        return versions.with_access(found, self.log.table(self.record, "access")) if with_access else found

    def edges(self) -> DataFrame:
        return graph.current_edges(self.log.table(self.record, "edges"))

    def index(self, ns: str) -> ann.CellIndex | None:
        """The stored index of a namespace, if one was built."""
        entry = self.record.get("indexes", {}).get(normal_path(ns))
        if entry is None:
            return None
        if entry["folder"] not in self.log.indexes:
            folder, spark = f"{self.log.root}/{entry['folder']}", self.log.spark
            # As many centres as `cells` or `train_rows` allow.
            rows = spark.read.schema("cell int, centre array<double>").parquet(f"{folder}/centres").collect()
            centres = np.array([r.centre for r in sorted(rows)], np.float64)
            self.log.indexes[entry["folder"]] = ann.load(spark, f"{folder}/rows", centres, self.config.metric, entry["probes"], entry["size"], entry["seqno"])
        return self.log.indexes[entry["folder"]]

    def namespaces(self) -> DataFrame:
        """(path) of all registered namespaces."""
        return versions.latest(self.log.table(self.record, "namespaces"), ("path",)).where(~F.col("dropped")).select("path")

    def list_namespaces(self) -> list[str]:
        """Registered paths in order; see `namespaces` for very many."""
        return [r.path for r in self.namespaces().orderBy("path").collect()]

    def namespace(self, path: str) -> NamespaceView:
        return NamespaceView(self, path)

    def get_by_rowid(self, rowid: int) -> Row | None:
        return self.rows().where(F.col("rowid") == rowid).drop("deleted").first()

    def get_vector(self, rowid: int) -> list[float] | None:
        row = self.rows().where(F.col("rowid") == rowid).select("vector").first()
        return None if row is None else list(row.vector)

    def get_many_by_rowid(self, ids: Sequence[int]) -> list[Row | None]:
        """In the order of the request, None for what isn't there."""
        found = {r.rowid: r for r in self.rows().where(F.col("rowid").isin(*map(int, ids))).drop("deleted").collect()}
        return [found.get(i) for i in ids]

    def namespace_stats(self) -> DataFrame:
        return stats.namespace_stats(self.rows())

    def stats(self) -> DataFrame:
        return stats.global_stats(self.versions(), self.edges(), self.now, self.config.dimension)

    def dead_ratio(self) -> DataFrame:
        return stats.dead_ratio(self.versions(), self.now, F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))

    def snapshot_stats(self) -> DataFrame:
        return stats.snapshot_stats(self.versions(), self.now)

    def check(self) -> DataFrame:
        """(problem, n) of the rules that the tables break; empty if all is well."""
        return stats.problems(self.versions(), self.edges(), self.namespaces(), self.now)


class NamespaceView:
    """Reads of one namespace."""

    def __init__(self, view: View, path: str) -> None:
        self._fixed, self.path = view, normal_path(path)

    @property
    def view(self) -> View:
        return self._fixed

    def _where(self, condition: Expr | str | None, include_deleted: bool = False) -> DataFrame:
        view = self.view
        expr = as_expr(condition, view.now)
        rows = view.newest(self.path)
        if not include_deleted:
            rows = rows.where(versions.live(view.now))
        if expr is not None and expr.uses_access:
            rows = versions.with_access(rows, view.log.table(view.record, "access"))
        return rows if expr is None else rows.where(compile_filter(expr))

    def rows(self) -> DataFrame:
        """Live rows in no order."""
        return self.view.rows(self.path)

    def owners(self) -> DataFrame:
        """(key, owner, owned): the row that has or last had each key, and whether it is live."""
        view = self.view
        live = versions.live(view.now).alias("live")
        known = view.newest(self.path).where("key IS NOT NULL").select("key", "rowid", "seqno", live)
        best = known.groupBy("key").agg(F.max(F.struct("live", "seqno", "rowid")).alias("o"))
        return best.select("key", F.col("o.rowid").alias("owner"), F.col("o.live").alias("owned"))

    def iter(self, condition: Expr | str | None = None, include_deleted: bool = False) -> DataFrame:
        """Matching rows by rowid; with `include_deleted` tombstones and expired rows too."""
        return self._where(condition, include_deleted).orderBy("rowid")

    def count(self, condition: Expr | str | None = None) -> int:
        return self._where(condition).count()

    def get(self, key: str) -> Row | None:
        return self._where(None).where(F.col("key") == key).drop("deleted").first()

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def get_many(self, keys: Sequence[str]) -> list[Row | None]:
        """In the order of the request, None for what isn't there."""
        found = {r.key: r for r in self._where(None).where(F.col("key").isin(*keys)).drop("deleted").collect()}
        return [found.get(k) for k in keys]

    def get_many_df(self, requests: DataFrame) -> DataFrame:
        """For each of `requests` (pos, key) its row or nulls, by pos; any number of them."""
        return requests.join(self._where(None), "key", "left").orderBy("pos")

    def neighbors(self, from_id: int, kinds: Sequence[int] = ()) -> DataFrame:
        """Edges out of a row; ends that expired still count, tombstones don't."""
        alive = self.view.newest().where(~F.col("deleted"))
        return graph.neighbors(self.view.edges(), [from_id], alive, kinds)

    def predecessors(self, to_id: int, kinds: Sequence[int] = ()) -> DataFrame:
        alive = self.view.newest().where(~F.col("deleted"))
        return graph.predecessors(self.view.edges(), [to_id], alive, kinds)

    def search(self) -> Search:
        return Search(self.view, self.path)
