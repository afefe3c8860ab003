"""The store: an append-only, bi-temporal record table with namespaces and relations.

Every write appends Parquet folders and ends in one commit record; nothing is
changed in place. One writer at a time; readers keep the state they opened.
Bulk writes are DataFrame jobs. Writes of single records are small jobs too,
meant for maintenance and tests rather than for loading.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from palimpsest.config import Compaction, Consolidation, Dedup, InsertMode, Metric, RelationKind, Retention, StoreConfig, notify
from palimpsest.errors import (
    Closed, ConfigError, DimensionMismatch, DuplicateKey, KeyMismatch, LimitExceeded, MetaTooDeep, MetricMismatch, NonFinite,
    NotFound, ReadOnly, TooLarge,
)
from palimpsest.functions.scalar import clamp01, json_depth
from palimpsest.functions.vector import is_finite
from palimpsest.operators import ann, scoring, similarity, versions
from palimpsest.operators.graph import edge_weight
from palimpsest.operators.spread import join_large_keys
from palimpsest.plans.compile import compile_filter
from palimpsest.plans.expr import Expr
from palimpsest.plans.parser import as_expr
from palimpsest.schema import RECORD, TABLES, VERSIONS, columns, types
from palimpsest.sources.commits import CommitLog
from palimpsest.sources.scratch import numbered, saved, shared_path
from palimpsest.sources.view import NamespaceView, View, normal_path

#: `feedback`: what being used adds to importance, and being corrected takes from confidence.
USED_BOOST, CORRECTED_PENALTY = 0.02, 0.1
#: Deduplicating writes go record by record, so many at a time on the driver.
BLOCK_RECORDS = 4096
#: Stored matches that are fetched for each record at once; further ones are asked for as needed.
KNOWN_MATCHES = 8
#: What a block has written goes to the store in parts of about so many bytes, as merged records may grow without bound.
PART_BYTES = 16 << 20
#: Beyond so many stored rows for each new one, records are only matched block by block.
STORED_SHARE = 16

INSERTED, MERGED, DUPLICATE = "inserted", "merged", "duplicate"
OUTCOME = "ord bigint, status string, rowid bigint, score double"


@dataclass(frozen=True)
class Outcome:
    """What a write did with one record; for a duplicate, the row it repeats and their similarity."""

    status: str
    rowid: int
    score: float | None = None


@dataclass
class Report:
    scanned: int = 0
    changed: int = 0
    ids: list[int] = field(default_factory=list)


class _Write:
    """Collects the folders of one commit."""

    def __init__(self, store: MemoryStore) -> None:
        self.store, self.log = store, store.log
        self.record = {**store.record, "tables": {k: list(v) for k, v in store.record["tables"].items()}}
        self.now = max(store.config.clock(), self.record["now"])
        self.record["now"] = self.now

    def take(self, what: str, n: int) -> int:
        """The first of n new ids or sequence numbers."""
        first = self.record[what]
        self.record[what] = first + n
        return first

    def append(self, table: str, frame: DataFrame) -> None:
        self.record["tables"].setdefault(table, []).append(self.log.write(table, frame))

    def append_rows(self, table: str, rows: list[dict]) -> None:
        names = columns(TABLES[table])
        data = [tuple(r.get(c) for c in names) for r in rows]
        self.append(table, self.log.spark.createDataFrame(data, TABLES[table]).coalesce(1))

    def register(self, path: str) -> None:
        """Makes a namespace known; its depth and characters are checked here."""
        parts = path.split("/")
        limits = self.store.config.limits
        if len(parts) > limits.ns_depth:
            raise LimitExceeded("namespace path too deep")
        if re.search(r"[\x00-\x1f\x7f]", path):
            raise ConfigError("control character in a namespace path")
        if self.view().namespaces().where(F.col("path") == path).isEmpty():
            self.append_rows("namespaces", [{"path": path, "seqno": self.take("next_seqno", 1), "dropped": False}])

    def view(self) -> View:
        """The state as it will be: with what this write has appended so far."""
        return View(self.log, self.record, self.store.config, self.now)

    def commit(self, event: str, **details) -> None:
        try:
            self.store.record = self.log.commit(self.record)
        except Exception as error:
            self.store.tell("error", {"during": event, "error": str(error)})
            raise
        self.store.tell(event, details)


class MemoryStore:
    """A store under one root folder."""

    def __init__(self, log: CommitLog, record: dict, config: StoreConfig) -> None:
        self.log, self.record, self.config, self.closed = log, record, config, False

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: StoreConfig) -> MemoryStore:
        """Opens a store, or makes one where there is none."""
        log = CommitLog(spark, root, config.compression)
        record = log.newest()
        if record is None:
            if config.read_only:
                raise NotFound(f"no store at {root}")
            record = log.commit({
                "commit": 0, "now": 0, "next_rowid": 1, "next_seqno": 1, "dimension": config.dimension,
                "metric": config.metric.value, "stopwords": config.stopwords, "kinds": dict(RelationKind.NAMES), "tables": {}, "streams": {},
            })
        if record["dimension"] != config.dimension:
            raise DimensionMismatch(f"the store has {record['dimension']} components")
        if record["metric"] != config.metric.value:
            raise MetricMismatch(f"the store compares by {Metric(record['metric']).value}")
        return cls(log, record, replace(config, stopwords=record["stopwords"]))

    def tell(self, event: str, details: dict) -> None:
        notify(self.config.observer, event, details)

    def writing(self) -> _Write:
        if self.closed:
            raise Closed("the store is closed")
        if self.config.read_only:
            raise ReadOnly("the store was opened for reading")
        return _Write(self)

    def view(self, at_ms: int | None = None) -> View:
        view = View(self.log, self.record, self.config, max(self.config.clock(), self.record["now"]), at_ms)
        view.closed = self.closed
        return view

    snapshot = view

    def as_of(self, at_ms: int) -> View:
        return self.view(at_ms)

    def namespace(self, path: str) -> Namespace:
        return Namespace(self, path)

    def list_namespaces(self) -> list[str]:
        return self.view().list_namespaces()

    def reload(self) -> bool:
        """Moves on to the newest commit; tells whether there was one."""
        newest = self.log.newest()
        moved = newest["commit"] != self.record["commit"]
        self.record = newest
        return moved

    def flush(self) -> None:
        """Counts the hits of searches since the last flush; every write is durable when it returns."""
        if self.closed:
            raise Closed("the store is closed")
        hits, self.log.hits = self.log.hits, []
        if hits and not self.config.read_only:
            write = self.writing()
            write.append_rows("access", [{"rowid": i, "at_ms": write.now, "delta": n} for i, n in sorted(Counter(hits).items())])
            write.commit("write", hits=len(hits))
        self.tell("flush", {"hits": len(hits)})

    def close(self) -> None:
        if not self.closed and self.log.hits:
            self.flush()
        self.closed = True

    def stats(self) -> DataFrame:
        return self.view().stats()

    def check(self) -> DataFrame:
        return self.view().check()

    def backup_to(self, target: str) -> dict[str, int]:
        return self.log.copy_to(self.record, target)

    def relation_kind(self, name: str) -> int:
        """The number of a relation kind; a new name gets the next free one."""
        known = self.record["kinds"]
        if name in known:
            return known[name]
        if not name or len(name.encode()) > self.config.limits.name_bytes:
            raise TooLarge("relation kind name")
        if re.search(r"[\x00-\x1f\x7f]", name):
            raise ConfigError("control character in a relation kind name")
        write = self.writing()
        number = max(RelationKind.FIRST_CUSTOM, max(known.values()) + 1)
        write.record["kinds"] = {**known, name: number}
        write.commit("write", kind=name)
        return number

    def drop_namespace(self, path: str) -> int:
        """Tombstones all rows of a path and its descendants ("" is everything) and forgets the paths."""
        path, write = normal_path(path), self.writing()
        inside = F.lit(True) if not path else (F.col("ns") == path) | F.startswith("ns", F.lit(path + "/"))
        n = _bury(write, self.view().rows().where(inside))
        gone = [p for p in self.list_namespaces() if not path or p == path or p.startswith(path + "/")]
        if gone:
            first = write.take("next_seqno", len(gone))
            write.append_rows("namespaces", [{"path": p, "seqno": first + i, "dropped": True} for i, p in enumerate(gone)])
        write.commit("write", dropped=n)
        return n

    def compact(self, policy: Compaction | None = None, force: bool = False) -> Report:
        """Rewrites the versions that are still wanted, and the newest edges and access totals.

        Runs when there are `tier_count` folders or the dead share is beyond
        `dead_ratio`, or by force. A row's whole chain is always in scope.
        """
        policy = policy or self.config.compaction
        view, write = self.view(), self.writing()
        folders = len(self.record["tables"].get("versions", []))
        all_rows = view.versions()
        total = all_rows.count()
        report = Report(scanned=total)
        if not total:
            return report
        kept = versions.survivors(all_rows, write.now, policy.history_horizon_ms)
        if not force and folders < policy.tier_count:
            dead = total - versions.latest(all_rows).where(versions.live(write.now)).count()
            if dead <= policy.dead_ratio * total:
                return report
        tasks = max(1, -(-total // policy.segment_rows))
        write.record["tables"]["versions"] = []
        write.append("versions", kept.repartitionByRange(tasks, "ns", "rowid").sortWithinPartitions("ns", "rowid", "seqno"))
        write.record["tables"].pop("closures", None)
        if self.record["tables"].get("edges"):
            edges = versions.latest(self.log.table(self.record, "edges"), ("from_id", "to_id", "kind")).where(~F.col("removed"))
            write.record["tables"]["edges"] = []
            write.append("edges", edges)
        if self.record["tables"].get("access"):
            totals = versions.access_totals(self.log.table(self.record, "access"))
            write.record["tables"]["access"] = []
            write.append("access", totals.select("rowid", F.col("last_access").alias("at_ms"), F.col("access_count").alias("delta")))
        write.commit("compaction")
        report.changed = total - self.view().versions().count()
        return report

    def vacuum(self) -> int:
        """Deletes data folders that the newest commit doesn't list; older snapshots can no longer be read."""
        names = self.log.unlisted(self.record)
        for name in names:
            self.log.remove(name)
        return len(names)

    def maintenance_tick(self) -> dict[str, Report]:
        """What a background job does now and then: forget by policy, then compact."""
        done = {}
        if self.config.retention is not None:
            for path in self.list_namespaces():
                done[f"retain {path}"] = self.namespace(path).retain(self.config.retention)
        done["compact"] = self.compact()
        return done

    def build_index(self, ns: str) -> ann.CellIndex:
        """Builds and stores an approximate index of a namespace's live rows; searches use it from then on.

        Rows that change or come later are searched exactly beside it, so an index
        is never stale, only less useful, until it is built again.
        """
        ns, write = normal_path(ns), self.writing()
        name = f"data/indexes/{uuid.uuid4().hex}"
        folder, seqno = f"{self.log.root}/{name}", write.record["next_seqno"]
        index = ann.build(self.view().rows(ns).select("rowid", "seqno", "vector"), self.config.index, self.config.metric, f"{folder}/rows", seqno)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(index.centres)]
        self.log.spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
        entry = {"folder": name, "seqno": seqno, "size": index.size, "probes": index.probes}
        write.record["indexes"] = {**write.record.get("indexes", {}), ns: entry}
        write.commit("write", index=ns)
        return index

    def drop_index(self, ns: str) -> bool:
        """Forgets a namespace's index; its files go at the next vacuum."""
        known = self.record.get("indexes", {})
        if normal_path(ns) not in known:
            return False
        write = self.writing()
        write.record["indexes"] = {k: v for k, v in known.items() if k != normal_path(ns)}
        write.commit("write", index=ns)
        return True


def _bury(write: _Write, rows: DataFrame) -> int:
    """Appends a tombstone for each of the given newest versions."""
    found, n = numbered(rows.select(*columns(VERSIONS)), "tombstones")
    if n:
        first = write.take("next_seqno", n)
        write.append("versions", found.withColumn("seqno", F.col("ord") + first).withColumn("deleted", F.lit(True)).withColumn("tx_ms", F.lit(write.now)))
    return n


def _plain(record: dict) -> dict:
    """A record with all fields and their Python types; ints may stand for floats."""
    out = {c: record.get(c) for c in columns(RECORD)}
    out["vector"] = [float(x) for x in out["vector"]]
    for name in ("importance", "confidence"):
        out[name] = None if out[name] is None else float(out[name])
    return out


class _Match(NamedTuple):
    """A row that a record repeats, and how closely; an equal text goes before any vector."""

    rowid: int
    score: float
    by_text: bool = False


class _Pending:
    """Records of a block as they stand, in the order in which their rows came up."""

    def __init__(self, most: int, dimension: int) -> None:
        self.units, self.alive = np.zeros((most, dimension)), np.zeros(most, bool)
        self.rows: list[tuple[int, dict] | None] = []
        self.place: dict[int, int] = {}
        self.texts: dict[str, set[int]] = {}

    @staticmethod
    def _unit(values: Sequence[float]) -> np.ndarray:
        v = np.asarray(values, np.float64)
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def record(self, rowid: int) -> dict | None:
        at = self.place.get(rowid)
        return None if at is None else self.rows[at][1]

    def drop(self, rowid: int) -> dict | None:
        at = self.place.pop(rowid, None)
        if at is None:
            return None
        old = self.rows[at][1]
        self.rows[at] = None
        self.texts.get(old.get("text"), set()).discard(at)
        self.alive[at] = False
        return old

    def put(self, rowid: int, record: dict) -> None:
        """Sets a row's record; a row that is there already keeps its place."""
        at = self.place.get(rowid)
        if at is None:
            at = self.place[rowid] = len(self.rows)
            self.rows.append(None)
        else:
            self.texts.get(self.rows[at][1].get("text"), set()).discard(at)
        self.rows[at] = (rowid, record)
        self.units[at], self.alive[at] = self._unit(record["vector"]), True
        if record.get("text") is not None:
            self.texts.setdefault(record["text"], set()).add(at)

    def best(self, record: dict, threshold: float) -> _Match | None:
        """The earliest row of equal text, else the one of the closest vector, the earliest of equals."""
        n = len(self.rows)
        if not self.place:
            return None
        if record["text"] is not None and (equal := self.texts.get(record["text"])):
            return _Match(self.rows[min(equal)][0], 1.0, True)
        similar = np.where(self.alive[:n], np.minimum(self.units[:n] @ self._unit(record["vector"]), 1.0), -np.inf)
        at = int(np.argmax(similar))
        return _Match(self.rows[at][0], float(similar[at])) if similar[at] >= threshold else None


def _checked_number(name: str, value: float | None) -> None:
    if value is not None and not math.isfinite(value):
        raise NonFinite(name)


class Namespace(NamespaceView):
    """Reads and writes of one namespace; reads always see the newest commit."""

    def __init__(self, store: MemoryStore, path: str) -> None:
        super().__init__(None, path)
        self.store = store

    @property
    def view(self) -> View:
        return self.store.view()

    # ---- inserting -------------------------------------------------------

    def insert(self, record: dict) -> Outcome:
        outcome = self.insert_batch([record])[0]
        if outcome.status == DUPLICATE and self.store.config.dedup is not Dedup.REJECT and outcome.score == 0.0:
            raise DuplicateKey(str(record.get("key")))
        return outcome

    def insert_batch(self, records: Sequence[dict]) -> list[Outcome]:
        """Inserts in order, all or nothing, at one time."""
        if not records:
            return []
        names = columns(RECORD)
        for r in records:
            if unknown := set(r) - set(names):
                raise ConfigError(f"unknown fields {sorted(unknown)}")
        rows = [tuple(_plain(r).values()) for r in records]
        frame = self.store.log.spark.createDataFrame(rows, RECORD).coalesce(1)
        return self._outcomes(self.insert_df(frame))

    def insert_df(self, frame: DataFrame, stream: tuple[str, int] | None = None) -> DataFrame:
        """Inserts any number of rows in their order; returns (ord, status, rowid, score).

        Later rows of a key are newer versions of earlier ones. `stream` names a
        source and its batch: a batch that was committed before is skipped, in
        every mode.
        """
        write = self.store.writing()
        if stream is not None:
            if write.record["streams"].get(stream[0], -1) >= stream[1]:
                return self.store.log.spark.createDataFrame([], OUTCOME)
            write.record["streams"] = {**write.record["streams"], stream[0]: stream[1]}
        rows, n = numbered(self._shaped(frame), "insert")
        self._validate(rows)
        if not n:
            if stream is not None:
                write.commit("write", inserted=0)
            return self.store.log.spark.createDataFrame([], OUTCOME)
        write.register(self.path)
        if self.store.config.dedup in (Dedup.OFF, Dedup.KEEP_BOTH):
            return self._append(write, rows, n)
        return self._deduplicated(write, rows, n)

    @staticmethod
    def _outcomes(placed: DataFrame) -> list[Outcome]:
        return [Outcome(r.status, r.rowid, r.score) for r in placed.orderBy("ord").collect()]

    def _shaped(self, frame: DataFrame) -> DataFrame:
        """All record columns, missing ones null."""
        have = {c.lower() for c in frame.columns}
        return frame.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in types(RECORD).items()))

    def _validate(self, rows: DataFrame) -> None:
        """Raises for the first kind of rule that any row breaks; one pass over the rows."""
        config, limits = self.store.config, self.store.config.limits
        finite = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
        size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
        rules: list[tuple[Column, type[Exception], str]] = [
            (F.coalesce(F.size("vector") != config.dimension, F.lit(True)), DimensionMismatch, f"the store has {config.dimension} components"),
            (~is_finite(F.col("vector")), NonFinite, "vector"),
            (finite(F.col("importance")) | finite(F.col("confidence")), NonFinite, "importance or confidence"),
            (size("key") > limits.key_bytes, TooLarge, "key"),
            (size("text") > limits.text_bytes, TooLarge, "text"),
            (size("metadata") > limits.meta_bytes, TooLarge, "metadata"),
            (F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull(), ConfigError, "metadata is not JSON"),
            (json_depth(F.col("metadata")) > limits.meta_depth, MetaTooDeep, "metadata"),
        ]
        counts = rows.agg(*(F.count_if(rule).alias(f"r{i}") for i, (rule, _, _) in enumerate(rules))).first()
        for n, (_, kind, message) in zip(counts, rules):
            if n:
                raise kind(f"{message} ({n} rows)")

    def _versions(self, rows: DataFrame, write: _Write, deleted: Column | None = None) -> DataFrame:
        """Version columns for shaped records that have rowid and seqno."""
        now = F.lit(write.now)
        return rows.select(
            "rowid", F.lit(self.path).alias("ns"), "seqno", now.alias("tx_ms"), (F.lit(False) if deleted is None else deleted).alias("deleted"), "key", "vector", "text",
            "metadata", now.alias("created_at"), (now + F.col("ttl_ms")).alias("expires_at"),
            clamp01(F.coalesce("importance", F.lit(0.5).cast("float"))).alias("importance"),
            clamp01(F.coalesce("confidence", F.lit(1.0).cast("float"))).alias("confidence"),
            F.coalesce("valid_from", now).alias("valid_from"), "valid_to", "provenance",
        )

    def _append(self, write: _Write, rows: DataFrame, n: int) -> DataFrame:
        # The first row of each key; rows without a key each stand alone, and never meet in a group.
        heads = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("ord").alias("head"))
        placed = rows.join(heads, "key", "left").join(NamespaceView(write.view(), self.path).owners(), "key", "left")
        head = F.coalesce("head", "ord")
        first_id, first_seq = write.take("next_rowid", n), write.take("next_seqno", n)
        reject = self.store.config.insert_mode is InsertMode.REJECT_DUPLICATE
        taken = (F.coalesce("owned", F.lit(False)) | (head != F.col("ord"))) if reject else F.lit(False)
        placed = placed.withColumn("rowid", F.coalesce("owner", head + first_id)).withColumn("seqno", F.col("ord") + first_seq)
        placed = placed.withColumn("status", F.when(taken, DUPLICATE).otherwise(INSERTED))
        write.append("versions", self._versions(placed.where(F.col("status") == INSERTED), write))
        write.commit("write", inserted=n)
        return placed.select("ord", "status", "rowid", F.when(F.col("status") == DUPLICATE, 0.0).alias("score"))

    def _deduplicated(self, write: _Write, rows: DataFrame, n: int) -> DataFrame:
        """Inserts in which each record sees what the ones before it left, in one commit.

        The rule is sequential, but most records of a large write depend on no other
        one; these are settled in one plan, see `_settle_alone`. The others go through the
        driver, `BLOCK_RECORDS` of them at a time: a block is matched against the store
        and all blocks before it in one job, and settled among itself in memory.
        Outcomes are written block by block.
        """
        spark, folder = rows.sparkSession, shared_path(rows.sparkSession, "outcomes")
        ordered, inserted, left = rows.withColumn("origin", F.col("ord")), 0, n
        if n > BLOCK_RECORDS:
            ordered, inserted = self._settle_alone(write, saved(rows, "ordered"), n, folder)
            ordered, left = numbered(ordered.withColumnRenamed("ord", "origin").orderBy("origin"), "dependent")
        for start in range(0, left, BLOCK_RECORDS):
            block = ordered.where(F.col("ord").between(start, start + BLOCK_RECORDS - 1))
            outcomes, made = self._settle(write, block, start)
            inserted += made
            spark.createDataFrame(outcomes, OUTCOME).coalesce(1).write.mode("append").parquet(folder)
        write.commit("write", inserted=inserted)
        return spark.read.schema(OUTCOME).parquet(folder)

    def _settle_alone(self, write: _Write, rows: DataFrame, n: int, folder: str) -> tuple[DataFrame, int]:
        """Settles the records whose outcome needs no order: the others, and how many versions were written.

        A record depends on others if a vector of the write or the store is similar to
        its own, if its key comes again or is owned, if a stored row has its text, or if
        a record of its text depends on others. What is left matches by text alone: the
        first record of a text goes in and the others repeat it. Where duplicates
        aren't refused, all records of a repeated text depend on each other.
        """
        config, space = self.store.config, NamespaceView(write.view(), self.path)
        stored = space.rows()
        if stored.count() > STORED_SHARE * n:
            return rows, 0
        digest = F.sha2("text", 256).alias("digest")
        # A little below the threshold, since sums differ in their last bits.
        both = rows.select(F.col("ord").alias("rowid"), "vector").unionByName(stored.select((-F.col("rowid") - 1).alias("rowid"), "vector"))
        links = similarity.threshold_links(both, config.dedup_threshold - 1e-9)
        bound = links.select(F.explode(F.array("a", "b")).alias("ord")).where("ord >= 0")
        keyed = rows.where("key IS NOT NULL").select("ord", "key")
        known_keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key").union(space.owners().select("key")).distinct()
        bound = bound.union(keyed.join(known_keys, "key", "left_semi").select("ord")).distinct().withColumn("bound", F.lit(True))
        marked = rows.select("ord", digest).join(bound, "ord", "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
        marked = saved(marked, "marked")
        classes = marked.where("digest IS NOT NULL").groupBy("digest").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"), F.max("bound").alias("any"))
        texts = stored.where("text IS NOT NULL").select(digest).distinct().withColumn("stored", F.lit(True))
        repeated = F.lit(False) if config.dedup is Dedup.REJECT else F.col("n") > 1
        any_bound = (F.col("any") | F.col("stored").isNotNull() | repeated).alias("dependent")
        classes = saved(classes.join(texts, "digest", "left").select("digest", "first", "n", any_bound), "texts")
        with_text = join_large_keys(marked.where("digest IS NOT NULL"), classes, ["digest"], "n", n, F.col("ord"))
        without = marked.where("digest IS NULL").select("ord", F.col("ord").alias("first"), F.col("bound").alias("dependent"))
        settled = saved(with_text.select("ord", "first", "dependent").unionByName(without), "settled")
        first_id, first_seq = write.take("next_rowid", n), write.take("next_seqno", n)
        new = F.col("ord") == F.col("first")
        settled.where("NOT dependent").select(
            "ord", F.when(new, INSERTED).otherwise(DUPLICATE).alias("status"), (F.col("first") + first_id).alias("rowid"), F.when(~new, 1.0).alias("score"),
        ).write.mode("append").parquet(folder)
        alone = settled.where(~F.col("dependent") & new).select("ord")
        placed = rows.join(alone, "ord", "left_semi").withColumn("rowid", F.col("ord") + first_id).withColumn("seqno", F.col("ord") + first_seq)
        made = alone.count()
        if made:
            write.append("versions", self._versions(placed, write))
        return rows.join(settled.where("dependent").select("ord"), "ord", "left_semi"), made

    def _settle(self, write: _Write, block: DataFrame, start: int) -> tuple[list[tuple], int]:
        """Outcomes (ord, status, rowid, score) of one block of records, and how many versions it wrote."""
        config, space = self.store.config, NamespaceView(write.view(), self.path)
        records = [r.asDict() for r in block.orderBy("ord").collect()]
        origins = [r.pop("origin") for r in records]
        for r in records:
            r.pop("ord")
        owners = {r.key: r.owner for r in space.owners().join(block.select("key").distinct(), "key").collect()}
        stored = self._stored_matches(space, block)
        wanted = sorted({m.rowid for found in stored.values() for m in found})
        known = {r.rowid: r.asDict() for r in self._by_rowid(space, wanted)}
        pending, replaced, out_rows, outcomes = _Pending(len(records), config.dimension), set(), [], []
        made = held = 0

        def place(record: dict, rowid: int, deleted: bool = False) -> None:
            nonlocal held
            out_rows.append({**record, "rowid": rowid, "seqno": write.take("next_seqno", 1), "_deleted": deleted})
            held += len(record["text"] or "") + len(record["metadata"] or "") + 32 * config.dimension
            if held > PART_BYTES:
                flush()

        def flush() -> None:
            nonlocal made, held
            if out_rows:
                names = columns(RECORD)
                data = [tuple(r[c] for c in names) + (r["rowid"], r["seqno"], r["_deleted"]) for r in out_rows]
                frame = self.store.log.spark.createDataFrame(data, RECORD + ", rowid BIGINT, seqno BIGINT, gone BOOLEAN").coalesce(1)
                write.append("versions", self._versions(frame, write, F.col("gone")))
            made, held = made + len(out_rows), 0
            out_rows.clear()

        def best_stored(i: int) -> _Match | None:
            """The best match among stored rows that this block hasn't changed; of the others its own state counts."""
            first = stored.get(start + i, [])
            found = [m for m in first if m.rowid not in replaced and m.rowid not in pending.place]
            if not found and len(first) == KNOWN_MATCHES:
                # This block has changed all matches that are known; ask for the next ones.
                changed = sorted(replaced | set(pending.place))
                found = self._stored_matches(space, block.where(F.col("ord") == start + i), changed).get(start + i, [])
                known.update((r.rowid, r.asDict()) for r in self._by_rowid(space, [m.rowid for m in found if m.rowid not in known]))
            return found[0] if found else None

        for i, record in enumerate(records):
            match = best_stored(i)
            other = pending.best(record, config.dedup_threshold)
            if other is not None and (match is None or (other.by_text, other.score) > (match.by_text, match.score)):
                match = other
            target = owners.get(record["key"]) if record["key"] is not None else None
            if match and config.dedup is Dedup.REJECT:
                outcomes.append((origins[i], DUPLICATE, match.rowid, match.score))
                continue
            merged = None
            if match and config.dedup is Dedup.MERGE:
                merged = config.merge(pending.record(match.rowid) or known[match.rowid], record)
            if merged is not None:
                whole = _plain(merged)
                place(whole, match.rowid)
                pending.put(match.rowid, whole)
                outcomes.append((origins[i], MERGED, match.rowid, match.score))
                continue
            if match and config.dedup is Dedup.REPLACE:
                old = pending.drop(match.rowid) or known[match.rowid]
                place({c: old.get(c) for c in columns(RECORD)}, match.rowid, deleted=True)
                replaced.add(match.rowid)
                target = None  # a replacement is always a new row
            rowid = write.take("next_rowid", 1) if target is None else target
            if record["key"] is not None:
                owners[record["key"]] = rowid
            place(record, rowid)
            pending.put(rowid, record)
            outcomes.append((origins[i], INSERTED, rowid, None))
        flush()
        return outcomes, made

    def _stored_matches(self, space: NamespaceView, block: DataFrame, without: Sequence[int] = ()) -> dict[int, list[_Match]]:
        """For each row (ord, text, vector) the live rows that it repeats, best first: equal text, then the closest vectors."""
        stored = space.rows()
        if without:
            stored = stored.where(~F.col("rowid").isin(*without))
        close = similarity.nearest_above(block.select("ord", "vector"), stored, self.store.config.dedup_threshold, KNOWN_MATCHES)
        found: dict[int, list[_Match]] = {}
        for r in close.orderBy("ord", "rank").collect():
            found.setdefault(r.ord, []).append(_Match(r.rowid, min(float(r.score), 1.0)))
        # Texts meet by a wide digest; of a text that very many rows have, few are fetched.
        digest = F.sha2("text", 256).alias("digest")
        same = block.where("text IS NOT NULL").select("ord", digest).join(stored.where("text IS NOT NULL").select(digest, "rowid"), "digest")
        first = F.row_number().over(Window.partitionBy("ord").orderBy("rowid"))
        equal: dict[int, list[_Match]] = {}
        for r in same.withColumn("place", first).where(F.col("place") <= KNOWN_MATCHES).orderBy("ord", "rowid").collect():
            equal.setdefault(r.ord, []).append(_Match(r.rowid, 1.0, True))
        for ord_, matches in equal.items():
            known = {m.rowid for m in matches}
            found[ord_] = (matches + [m for m in found.get(ord_, []) if m.rowid not in known])[:KNOWN_MATCHES]
        return found

    @staticmethod
    def _by_rowid(space: NamespaceView, ids: Sequence[int]) -> list[Row]:
        """The live rows of at most a block's matches."""
        if not ids:
            return []
        spark = space.view.log.spark
        wanted = spark.createDataFrame([(i,) for i in ids], "rowid bigint")
        # Which versions these are is found without their texts, of which a long history has very many.
        newest = [r.seqno for r in space.rows().join(F.broadcast(wanted), "rowid").select("seqno").collect()]
        if not newest:
            return []
        found = space.view.versions().where(F.col("seqno").between(min(newest), max(newest)))
        return found.join(F.broadcast(spark.createDataFrame([(i,) for i in newest], "seqno bigint")), "seqno", "left_semi").drop("deleted").collect()

    # ---- single rows -----------------------------------------------------

    def _row(self, key: str | None, rowid: int | None, live: bool = False) -> Row | None:
        """The newest version by key (of this namespace) or by rowid (of any), unless it is a tombstone."""
        view = self.view
        rows = view.newest(self.path if rowid is None else None).where(~F.col("deleted"))
        if live:
            rows = rows.where(versions.live(view.now))
        rows = rows.where(F.col("key") == key if rowid is None else F.col("rowid") == rowid)
        return rows.orderBy(F.col("seqno").desc()).first()

    def update(self, key: str | None = None, patch: dict | None = None, rowid: int | None = None) -> bool:
        """Appends a version with the patch's fields; a field set to None is cleared. False if there is no such row.

        `ttl_ms` counts from now. An expired row can be updated, a deleted one can't.
        """
        patch = dict(patch or {})
        if unknown := set(patch) - set(columns(RECORD)):
            raise ConfigError(f"unknown fields {sorted(unknown)}")
        write, row = self.store.writing(), self._row(key, rowid)
        if row is None:
            return False
        for name in ("importance", "confidence"):
            _checked_number(name, patch.get(name))
        new = row.asDict()
        new_key = patch.get("key", row.key)
        if new_key is not None and new_key != row.key:
            owner = self.view.rows(row.ns).where(F.col("key") == new_key).first()
            if owner is not None and owner.rowid != row.rowid:
                raise DuplicateKey(new_key)
        if "ttl_ms" in patch:
            ttl = patch.pop("ttl_ms")
            new["expires_at"] = None if ttl is None else write.now + ttl
        defaults = {"importance": 0.5, "confidence": 1.0, "valid_from": write.now}
        new |= {k: defaults.get(k) if v is None else v for k, v in patch.items()}
        self._append_version(write, new)
        return True

    def _append_version(self, write: _Write, row: dict, **details) -> None:
        frame = self.store.log.spark.createDataFrame([tuple(_plain(row).values())], RECORD)
        self._validate(frame)
        row = {**row, "seqno": write.take("next_seqno", 1), "tx_ms": write.now, "vector": [float(x) for x in row["vector"]]}
        for name in ("importance", "confidence"):
            row[name] = min(1.0, max(0.0, float(row[name])))
        write.append_rows("versions", [row])
        write.commit("write", **details)

    def delete(self, key: str | None = None, rowid: int | None = None) -> bool:
        """Appends a tombstone; False if there is no such row or it has one already."""
        write, row = self.store.writing(), self._row(key, rowid)
        if row is None:
            return False
        write.append_rows("versions", [row.asDict() | {"seqno": write.take("next_seqno", 1), "tx_ms": write.now, "deleted": True}])
        write.commit("write", deleted=1)
        return True

    def supersede(self, key: str, record: dict) -> int:
        """Replaces a belief: a whole new version, and the old one's valid_to closed where the new one starts."""
        if record.get("key", key) != key:
            raise KeyMismatch(str(record.get("key")))
        write, row = self.store.writing(), self._row(key, None)
        if row is None:
            raise NotFound(key)
        frame = self.store.log.spark.createDataFrame([tuple(_plain({**record, "key": key}).values())], RECORD)
        self._validate(frame)
        seqno = write.take("next_seqno", 1)
        new = self._versions(frame.withColumn("rowid", F.lit(row.rowid)).withColumn("seqno", F.lit(seqno)), write)
        write.append("versions", new)
        start = record.get("valid_from") if record.get("valid_from") is not None else write.now
        write.append_rows("closures", [{"rowid": row.rowid, "seqno": row.seqno, "valid_to": start}])
        write.commit("write", superseded=row.rowid)
        return row.rowid

    def touch(self, key: str | None = None, boost: float | None = None, rowid: int | None = None) -> bool:
        """Counts an access of a live row; a boost also appends a version with more importance."""
        _checked_number("boost", boost)
        write, row = self.store.writing(), self._row(key, rowid, live=True)
        if row is None:
            return False
        self._touched(write, row, boost)
        write.commit("write", touched=row.rowid)
        return True

    def _touched(self, write: _Write, row: Row, boost: float | None) -> None:
        write.append_rows("access", [{"rowid": row.rowid, "at_ms": write.now, "delta": 1}])
        if boost is not None:
            self._changed(write, row, importance=min(1.0, max(0.0, row.importance + boost)))

    @staticmethod
    def _changed(write: _Write, row: Row, **fields) -> None:
        write.append_rows("versions", [row.asDict() | fields | {"seqno": write.take("next_seqno", 1), "tx_ms": write.now}])

    def record_hits(self, hits: DataFrame) -> None:
        """Counts one access for each hit; searches themselves never write."""
        write = self.store.writing()
        write.append("access", hits.groupBy("rowid").agg(F.count(F.lit(1)).alias("delta")).withColumn("at_ms", F.lit(write.now)))
        write.commit("write", hits=True)

    def feedback(self, rowid: int, query_id: int, corrected_by: int | None = None, used: bool = False) -> bool:
        """Used, ignored (neither) or corrected by another row; once for each (row, query)."""
        write, row = self.store.writing(), self._row(None, rowid, live=True)
        if row is None:
            return False
        seen = self.store.log.table(self.store.record, "feedback").where((F.col("rowid") == rowid) & (F.col("query_id") == query_id))
        if seen.first() is not None:
            return False
        write.append_rows("feedback", [{"rowid": rowid, "query_id": query_id}])
        if used:
            self._touched(write, row, USED_BOOST)
        if corrected_by is not None:
            self._changed(write, row, confidence=max(0.0, row.confidence - CORRECTED_PENALTY))
            write.append_rows("edges", [self._edge(write, corrected_by, rowid, RelationKind.CONTRADICTS, 1.0, None)])
        write.commit("write", feedback=rowid)
        return True

    # ---- relations -------------------------------------------------------

    @staticmethod
    def _edge(write: _Write, from_id: int, to_id: int, kind: int, weight: float, metadata: str | None, removed: bool = False) -> dict:
        return {
            "from_id": from_id, "to_id": to_id, "kind": kind, "weight": min(1.0, max(0.0, float(weight))), "metadata": metadata,
            "seqno": write.take("next_seqno", 1), "removed": removed,
        }

    def relate(self, from_id: int, to_id: int, kind: int = RelationKind.RELATED, weight: float = 1.0, metadata: str | None = None) -> None:
        """Sets an edge; the rows need not exist."""
        _checked_number("weight", weight)
        write = self.store.writing()
        write.append_rows("edges", [self._edge(write, from_id, to_id, kind, weight, metadata)])
        write.commit("write", edge=(from_id, to_id, kind))

    def relate_df(self, edges: DataFrame) -> int:
        """Sets many edges (from_id, to_id, kind, weight, metadata); of one key the last row holds."""
        write = self.store.writing()
        if edges.where(F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf"))).limit(1).count():
            raise NonFinite("weight")
        rows, n = numbered(edges.select("from_id", "to_id", "kind", edge_weight(F.col("weight")).alias("weight"), "metadata"), "edges")
        if n:
            first = write.take("next_seqno", n)
            write.append("edges", rows.withColumn("seqno", F.col("ord") + first).withColumn("removed", F.lit(False)))
            write.commit("write", edges=n)
        return n

    def unrelate(self, from_id: int, to_id: int, kind: int) -> bool:
        same = (F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("kind") == kind)
        if self.view.edges().where(same).first() is None:
            return False
        write = self.store.writing()
        write.append_rows("edges", [self._edge(write, from_id, to_id, kind, 0.0, None, removed=True)])
        write.commit("write", edge=(from_id, to_id, kind))
        return True

    # ---- jobs ------------------------------------------------------------

    def forget(self, condition: Expr | str) -> int:
        """Tombstones all live rows that match."""
        write = self.store.writing()
        n = _bury(write, self._where(condition))
        if n:
            write.commit("write", deleted=n)
        return n

    def retain(self, policy: Retention | None = None) -> Report:
        """Tombstones live rows whose retention score is below the policy's, but for protected ones."""
        policy, write = policy or Retention(), self.store.writing()
        view = self.view
        rows = view.rows(self.path, with_access=True)
        protected = F.lit(False)
        if policy.protect is not None:
            protected = F.coalesce(compile_filter(as_expr(policy.protect, write.now)), F.lit(False))
        score = scoring.retention(rows, policy, write.now)
        marked = rows.withColumn("_gone", ~protected & (score < policy.min_importance))
        report = Report(scanned=rows.count())
        report.changed = _bury(write, marked.where("_gone"))
        report.ids = [r.rowid for r in marked.where("_gone").select("rowid").orderBy("rowid").limit(100).collect()]
        if report.changed:
            write.commit("write", deleted=report.changed)
        return report

    def consolidate(self, policy: Consolidation | None = None) -> Report:
        """Sums up clusters of similar rows in new records that point at their sources.

        Clusters are taken in the order of their smallest rowid. A cluster is cut
        to its `max_cluster` most important members before it is gathered, so
        a summary never sees more.
        """
        policy, write = policy or Consolidation(), self.store.writing()
        view = self.view
        rows = self._where(policy.filter)
        labels = similarity.clusters(rows, policy.threshold)
        members = rows.select(*columns(VERSIONS)).join(labels, "rowid")
        by_rank = Window.partitionBy("cluster").orderBy(F.col("importance").desc(), F.col("seqno").asc())
        members = members.withColumn("place", F.row_number().over(by_rank))
        sizes = labels.groupBy("cluster").agg((F.count(F.lit(1)) > policy.max_cluster).alias("cut"))
        members = members.where(F.col("place") <= policy.max_cluster).join(sizes, "cluster")
        done = view.edges().where(F.col("kind") == RelationKind.DERIVED_FROM).select(F.col("to_id").alias("rowid")).distinct()
        skipped = members.join(done, "rowid", "left_semi").select("cluster").distinct()
        members = members.join(skipped, "cluster", "left_anti")
        chosen, summarizer = columns(RECORD), policy.summarizer

        def summed(group):
            import pandas as pd

            truncated = bool(group["cut"].iloc[0])
            ordered = group.sort_values("place" if truncated else "seqno")
            made = summarizer([r._asdict() for r in ordered.itertuples(index=False)]) if summarizer else None
            if made is None:
                # Of equally important members the last one counts.
                best = ordered[ordered["importance"] == ordered["importance"].max()].iloc[-1]
                texts = list(dict.fromkeys(t for t in ordered["text"] if t is not None))
                made = {
                    "vector": best["vector"], "importance": best["importance"], "text": "; ".join(texts) if texts else None,
                    "confidence": float(ordered["confidence"].mean()),
                }
            row = {c: made.get(c) for c in chosen} | {"cluster": int(group["cluster"].iloc[0]), "sources": ordered["rowid"].tolist()}
            return pd.DataFrame([row])

        summaries = members.groupBy("cluster").applyInPandas(summed, RECORD + ", cluster BIGINT, sources ARRAY<BIGINT>")
        made, n = numbered(summaries.orderBy("cluster"), "summaries")
        report = Report(scanned=rows.count(), changed=n)
        if not n:
            return report
        target = normal_path(policy.target) if policy.target is not None else self.path
        write.register(target)
        first_id, first_seq = write.take("next_rowid", n), write.take("next_seqno", n)
        placed = made.withColumn("rowid", F.col("ord") + first_id).withColumn("seqno", F.col("ord") + first_seq)
        write.append("versions", self._versions(placed, write).withColumn("ns", F.lit(target)))
        links, m = numbered(placed.select(F.col("rowid").alias("from_id"), F.explode("sources").alias("to_id")), "links")
        first_seq = write.take("next_seqno", m)
        write.append("edges", links.select(
            "from_id", "to_id", F.lit(RelationKind.DERIVED_FROM).alias("kind"), F.lit(1.0).alias("weight"), F.lit(None).alias("metadata"),
            (F.col("ord") + first_seq).alias("seqno"), F.lit(False).alias("removed"),
        ))
        if not policy.keep_sources:
            _bury(write, rows.join(links.select(F.col("to_id").alias("rowid")), "rowid", "left_semi"))
        write.commit("write", consolidated=n)
        report.ids = [first_id + i for i in range(n)]
        return report
