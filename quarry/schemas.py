"""Table schemas, options with their defaults, and filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_s, _i, _b = T.StringType(), T.IntegerType(), T.BooleanType()
CHUNKS = T.StructType(
    [T.StructField(n, _s) for n in ("Id", "FilePath", "NamespaceName", "ClassName", "MemberName", "MemberType", "Content", "Signature", "Documentation")]
    + [T.StructField("StartLine", _i), T.StructField("EndLine", _i), T.StructField("Embedding", T.ArrayType(T.FloatType())), T.StructField("IndexedAt", T.TimestampType()), T.StructField("ContentHash", _s)]
    + [T.StructField(n, _b) for n in ("IsController", "IsService", "IsMiddleware")]
    + [T.StructField("HttpMethods", _s), T.StructField("RouteTemplate", _s), T.StructField("CallsTo", T.ArrayType(_s)), T.StructField("ChunkIndex", _i), T.StructField("TotalChunks", _i), T.StructField("ParentChunkId", _s)]
)
POSTINGS = T.StructType([T.StructField("ChunkId", _s), T.StructField("Term", _s), T.StructField("Weight", T.DoubleType())])
EDGES = T.StructType([T.StructField("SourceChunkId", _s), T.StructField("TargetChunkId", _s), T.StructField("CallType", _s), T.StructField("LineNumber", _i)])
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class HybridOptions:
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3


@dataclass(frozen=True)
class ThresholdOptions:
    enabled: bool = True
    floor: float = 0.30
    ceiling: float = 0.85
    percentile: float = 70.0


@dataclass(frozen=True)
class RankerOptions:
    name_boost: float = 1.3
    controller_boost: float = 1.1
    service_boost: float = 1.1
    middleware_boost: float = 1.1
    documented_boost: float = 1.05
    short_penalty: float = 0.9
    short_lines: int = 10


@dataclass(frozen=True)
class ChunkingOptions:
    max_lines: int = 50
    overlap_lines: int = 10

    def __post_init__(self):
        if not 0 <= self.overlap_lines < self.max_lines:
            raise ValueError("overlap_lines must be at least 0 and less than max_lines")


@dataclass(frozen=True)
class SearchOptions:
    minimum_similarity: float = 0.55
    top_k: int = 20
    display_count: int = 5
    weak_match_threshold: float = 0.30
    use_keyword: bool = True
    prefilter: bool = False
    hybrid: HybridOptions = field(default_factory=HybridOptions)
    threshold: ThresholdOptions = field(default_factory=ThresholdOptions)
    ranker: RankerOptions = field(default_factory=RankerOptions)


@dataclass(frozen=True)
class SearchFilter:
    """All set fields must hold. Blank texts hold for every row."""

    namespace: str | None = None
    class_name: str | None = None
    http_method: str | None = None
    file_pattern: str | None = None
    chunk_type: str | None = None
    is_controller: bool | None = None
    is_service: bool | None = None
    is_middleware: bool | None = None

    @property
    def empty(self) -> bool:
        return all(v is None for v in vars(self).values())
