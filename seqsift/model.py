"""What a query is made of."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

#: Slack on every radius.
TOLERANCE = 1e-6

VECTORS = T.StructType([
    T.StructField("track_id", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType())),
    T.StructField("power", T.DoubleType()), T.StructField("t_start", T.DoubleType()), T.StructField("t_end", T.DoubleType()),
])
RESULTS = T.StructType([T.StructField("qkey", T.StringType()), T.StructField("ikey", T.StringType()), T.StructField("qpos", T.IntegerType()), T.StructField("ipos", T.IntegerType()), T.StructField("dist", T.DoubleType())])


class SeqSiftError(Exception):
    """A request that can't be served."""


class DuplicateKeyError(SeqSiftError):
    """A track with this key is there already."""


class Distance(Enum):
    DOT = 1
    NORMED = 2  # 2 - 2 cos, from 0 to 4
    EUCLIDEAN = 3  # squared
    KL = 4  # symmetric unless asked otherwise

    @property
    def larger_is_better(self) -> bool:
        return self is Distance.DOT


class Accumulation(Enum):
    DB = 1  # the best points of all
    PER_TRACK = 2  # the best points of each track, of the tracks with the best means
    ONE_TO_ONE = 3  # the best point for each query position


@dataclass(frozen=True)
class QueryId:
    """Which part of the query is sought: ``length`` vectors from ``start``, or from every position if ``exhaustive``."""

    length: int = 1
    start: int = 0
    exhaustive: bool = False
    allow_false_positives: bool = False

    def __post_init__(self):
        if self.length < 1 or self.start < 0:
            raise SeqSiftError("a sequence has at least one vector and starts at 0 or later")


@dataclass(frozen=True)
class Params:
    distance: Distance = Distance.NORMED
    accumulation: Accumulation = Accumulation.PER_TRACK
    npoints: int = 10
    ntracks: int = 10
    kl_asymmetric: bool = False

    def __post_init__(self):
        if self.accumulation is not Accumulation.ONE_TO_ONE and self.npoints < 1:
            raise SeqSiftError("npoints is at least 1")
        if self.accumulation is Accumulation.PER_TRACK and self.ntracks < 1:
            raise SeqSiftError("ntracks is at least 1")


@dataclass(frozen=True)
class Refine:
    """Conditions that all have to hold. A hop of 0 counts as 1."""

    include_keys: tuple[str, ...] | None = None
    exclude_keys: tuple[str, ...] | None = None
    radius: float | None = None
    absolute_threshold: float | None = None
    relative_threshold: float | None = None
    duration_ratio: float | None = None
    qhop: int = 1
    ihop: int = 1

    @property
    def needs_power(self) -> bool:
        return self.absolute_threshold is not None or self.relative_threshold is not None


@dataclass(frozen=True)
class QuerySpec:
    qid: QueryId = field(default_factory=QueryId)
    params: Params = field(default_factory=Params)
    refine: Refine = field(default_factory=Refine)
