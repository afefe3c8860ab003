"""Settings as frozen dataclasses; each checks itself when made."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from palimpsest.errors import ConfigError, LimitExceeded

DAY_MS = 86_400_000


class Metric(Enum):
    """How vectors are compared. `l2` is the squared distance: smaller is better."""

    COSINE = "cosine"
    DOT = "dot"
    L2 = "l2"

    @property
    def higher_is_better(self) -> bool:
        return self is not Metric.L2


class InsertMode(Enum):
    UPSERT = "upsert"
    REJECT_DUPLICATE = "reject_duplicate"


class Dedup(Enum):
    """What a write does with a record whose text or vector is already there."""

    OFF = "off"
    REJECT = "reject"
    REPLACE = "replace"
    KEEP_BOTH = "keep_both"
    MERGE = "merge"


class TimeAxis(Enum):
    VALID_TIME = "valid_time"
    TRANSACTION_TIME = "transaction_time"


class RelationKind:
    """Built-in relation kinds; a store's own kinds start at FIRST_CUSTOM."""

    DERIVED_FROM = 0
    SUPPORTS = 1
    CONTRADICTS = 2
    RELATED = 3
    FIRST_CUSTOM = 16
    NAMES = {"derived_from": 0, "supports": 1, "contradicts": 2, "related": 3}


def _need(ok: bool, message: str, kind: type[Exception] = ConfigError) -> None:
    if not ok:
        raise kind(message)


def _unit(name: str, value: float) -> None:
    _need(math.isfinite(value) and 0.0 <= value <= 1.0, f"{name} must be between 0 and 1")


@dataclass(frozen=True)
class Limits:
    key_bytes: int = 1024
    text_bytes: int = 1 << 20
    meta_bytes: int = 64 << 10
    meta_depth: int = 32
    ns_depth: int = 32
    top_k_max: int = 4096
    ef_max: int = 4096
    name_bytes: int = 128

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            _need(value >= 1, f"{name} must be positive")

    def check_top_k(self, top_k: int) -> None:
        _need(1 <= top_k <= self.top_k_max, f"top_k must be from 1 to {self.top_k_max}", LimitExceeded)

    def check_ef(self, ef: int) -> None:
        _need(1 <= ef <= self.ef_max, f"ef must be from 1 to {self.ef_max}", LimitExceeded)


@dataclass(frozen=True)
class Scoring:
    """Weights and shapes of the composite score."""

    w_sim: float = 1.0
    w_recency: float = 0.0
    w_importance: float = 0.0
    w_access: float = 0.0
    w_confidence: float = 0.0
    half_life_ms: int = 14 * DAY_MS
    c_norm: int = 100
    floor: float = 0.0
    time_axis: TimeAxis = TimeAxis.VALID_TIME
    #: Accepted for compatibility: neither exact search nor cells have a routing to bias,
    #: and it never changes scores.
    bias_routing: bool = False

    def __post_init__(self) -> None:
        for name in ("w_sim", "w_recency", "w_importance", "w_access", "w_confidence", "floor"):
            _need(math.isfinite(getattr(self, name)), f"{name} must be finite")
        _need(self.half_life_ms >= 0, "half_life_ms must not be negative")
        _need(self.c_norm >= 0, "c_norm must not be negative")


@dataclass(frozen=True)
class Expand:
    """Associative expansion over relations."""

    hops: int = 1
    decay: float = 0.5
    kinds: tuple[int, ...] = ()
    max_nodes: int = 4096

    MAX_HOPS = 3

    def __post_init__(self) -> None:
        _need(self.hops >= 0, "hops must not be negative")
        _need(math.isfinite(self.decay), "decay must be finite")
        _need(self.max_nodes >= 1, "max_nodes must be positive")


@dataclass(frozen=True)
class Retention:
    """Forgets what scores below `min_importance`; `protect` is a filter that exempts."""

    min_importance: float = 0.2
    half_life_ms: int = 14 * DAY_MS
    access_weight: float = 0.05
    protect: object | None = None

    def __post_init__(self) -> None:
        _need(math.isfinite(self.min_importance), "min_importance must be finite")
        _need(math.isfinite(self.access_weight), "access_weight must be finite")
        _need(self.half_life_ms >= 0, "half_life_ms must not be negative")


@dataclass(frozen=True)
class Consolidation:
    threshold: float = 0.9
    max_cluster: int = 32
    keep_sources: bool = True
    target: str | None = None
    filter: object | None = None
    #: list of member rows -> record dict, or None for the default summary.
    summarizer: Callable | None = None

    def __post_init__(self) -> None:
        _unit("threshold", self.threshold)
        _need(self.max_cluster >= 1, "max_cluster must be positive")


@dataclass(frozen=True)
class Compaction:
    tier_ratio: int = 4
    tier_count: int = 4
    dead_ratio: float = 0.25
    segment_rows: int = 1_000_000
    #: Older versions than this are dropped; None keeps all.
    history_horizon_ms: int | None = None

    def __post_init__(self) -> None:
        _need(self.tier_ratio >= 2 and self.tier_count >= 2, "tier_ratio and tier_count must be at least 2")
        _unit("dead_ratio", self.dead_ratio)
        _need(self.segment_rows >= 1, "segment_rows must be positive")
        _need(self.history_horizon_ms is None or self.history_horizon_ms >= 0, "history_horizon_ms must not be negative")


@dataclass(frozen=True)
class IndexOptions:
    """The optional approximate index: an inverted file of k-means cells."""

    brute_force_max_rows: int = 2048
    cells: int | None = None
    probes: int = 8
    train_rows: int = 20_000
    seed: int = 42
    rescore_oversample: int = 4
    #: An index probes as many cells as reach this recall on so many sampled queries.
    recall_floor: float = 0.98
    sample_queries: int = 16

    def __post_init__(self) -> None:
        _need(self.brute_force_max_rows >= 0, "brute_force_max_rows must not be negative")
        _need(self.cells is None or self.cells >= 1, "cells must be positive")
        _need(self.probes >= 1 and self.train_rows >= 1, "probes and train_rows must be positive")
        _need(self.rescore_oversample >= 1, "rescore_oversample must be positive")
        _need(self.sample_queries >= 1, "sample_queries must be positive")
        _unit("recall_floor", self.recall_floor)


def notify(observer: Callable[[str, dict], None] | None, event: str, details: dict) -> None:
    """Tells an observer of an event: query, write, flush, compaction or error."""
    if observer is not None:
        try:
            observer(event, details)
        except Exception:  # noqa: BLE001  an observer must not break what it watches
            pass


def wall_clock_ms() -> int:
    return int(time.time() * 1000)


@dataclass(frozen=True)
class StoreConfig:
    dimension: int
    metric: Metric = Metric.COSINE
    stopwords: bool = True
    insert_mode: InsertMode = InsertMode.UPSERT
    dedup: Dedup = Dedup.OFF
    dedup_threshold: float = 0.95
    #: (existing row, new record) -> merged record dict, or None to keep both.
    merge: Callable | None = None
    limits: Limits = field(default_factory=Limits)
    compaction: Compaction = field(default_factory=Compaction)
    index: IndexOptions = field(default_factory=IndexOptions)
    retention: Retention | None = None
    read_only: bool = False
    #: Codec of the data files: zstd, snappy, lz4, gzip or none; None is the session's.
    compression: str | None = None
    #: Whether searches of the present state count as accesses of their hits, at the next flush.
    count_hits: bool = False
    #: Milliseconds since 1970; plans never read the clock themselves.
    clock: Callable[[], int] = wall_clock_ms
    #: Called with (event, details); its exceptions are dropped.
    observer: Callable[[str, dict], None] | None = None

    def __post_init__(self) -> None:
        _need(1 <= self.dimension <= 65536, "dimension must be from 1 to 65536")
        _unit("dedup_threshold", self.dedup_threshold)
        _need(self.compression in (None, "none", "uncompressed", "snappy", "gzip", "lz4", "zstd"), "unknown compression")
        _need(self.dedup is not Dedup.MERGE or self.merge is not None, "Dedup.MERGE needs a merge function")
