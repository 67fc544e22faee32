"""Options of an index and of a query, validated when made."""

from __future__ import annotations

from dataclasses import dataclass

METHODS = ("conjunctive", "disjunctive")
SCORINGS = ("TFIDF", "BM25", "BM11", "BM15")
CODECS = ("no", "unary", "gamma")
SEARCHES = ("ternary", "skipping")


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}; got {value!r}")


@dataclass(frozen=True)
class IndexConfig:
    """What the stored terms depend on; changing any of it needs a new build."""

    name: str = "main"
    stem: bool = False
    keep_stop: bool = True
    codec: str = "no"
    parts: int | None = None

    def __post_init__(self):
        _one_of(self.codec, CODECS, "codec")


@dataclass(frozen=True)
class QueryConfig:
    """What may change from query to query. `search` names an access path and never changes results."""

    method: str = "disjunctive"
    scoring: str = "BM25"
    k: int = 10
    search: str = "ternary"
    k1: float = 1.2
    b: float = 0.75
    textbook_bm15: bool = False

    def __post_init__(self):
        _one_of(self.method, METHODS, "method")
        _one_of(self.scoring, SCORINGS, "scoring")
        _one_of(self.search, SEARCHES, "search")
        if self.k < 1:
            raise ValueError("k must be at least 1")

    def run_name(self, index: str) -> str:
        return f"{index} {self.scoring} {self.k} {self.method} {self.search}"


def rebuild_needed(old: IndexConfig, new: IndexConfig) -> bool:
    """Whether stored terms or lists would differ; query options never need a build."""
    return (old.stem, old.keep_stop, old.codec) != (new.stem, new.keep_stop, new.codec)


#: What the command line takes where nothing is said: rows to read, and options of an index.
DEFAULT_ROWS = 500
DEFAULT_INDEX = IndexConfig(stem=True)
