"""Settings as frozen dataclasses, with an optional YAML file laid over the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from . import fixed_values as fv


@dataclass(frozen=True)
class Ranking:
    rrf_k: int = 60
    pool: int = 30
    rerank_blend: float = 0.75
    prior_customer_path: float = 0.12
    prior_customer_store: float = 0.06
    prior_symbol_in_path: float = 0.10
    rerank_enabled: bool = True
    rerank_models: tuple[str, ...] = ()
    # "concat": ranks run on over base then customer; "per_store": each store starts at 1; "global": by score.
    rank_scope: str = "concat"
    # "chunk": every chunk of a path votes; "path": the best chunk of a path votes once per channel.
    rrf_vote: str = "chunk"
    symbol_prior_casefold: bool = False


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class Retrieval:
    chunk_size: int = 1200
    chunk_overlap: int = 200
    k_dense: int = 20
    k_bm25: int = 20
    k_exact: int = 20
    k_final: int = 12
    # Without a number: all keywords, whole files, whole contents.
    max_keywords: int | None = None
    exact_content_chars: int | None = None
    rerank_content_chars: int | None = None
    max_file_chars: int = 14_000
    embed_model: str = "hashing-64"
    embed_dim: int = 64
    embed_batch: int = 64
    scopes: dict = field(default_factory=lambda: dict(fv.SCOPE_PRESETS))
    default_scope: str = "automotive"
    index_roots: tuple[str, ...] = fv.FLAT_ROOTS
    customer_path_parts: tuple[str, ...] = fv.CUSTOMER_PATH_PARTS
    stores_root: str | None = None
    default_customer: str | None = "base"


@dataclass(frozen=True)
class Loop:
    max_tool_steps: int = 8
    max_specialists: int | None = None
    max_debate_rounds: int = 3
    patch_max_tries: int = 2
    patch_context_chars: int = 24_000


@dataclass(frozen=True)
class Limits:
    """Upper bounds on what may be sent to every task at once; larger tables are shuffled, larger batches of queries go in blocks."""

    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 << 20
    queries_per_slice: int = 1024
    weights_per_block: int = 200_000


@dataclass(frozen=True)
class Settings:
    ranking: Ranking = Ranking()
    bm25: Bm25 = Bm25()
    retrieval: Retrieval = field(default_factory=Retrieval)
    loop: Loop = Loop()
    limits: Limits = Limits()

    def scope_roots(self, scope: str | None = None) -> tuple[str, ...]:
        """Roots of a scope preset; an unknown scope falls back to the flat list."""
        name = scope or self.retrieval.default_scope
        return tuple(self.retrieval.scopes.get(name) or self.retrieval.index_roots or (".",))


def _overlay(section, values: dict):
    known = {f.name: f for f in fields(section)}
    changes = {}
    for key, value in (values or {}).items():
        if key in known:
            changes[key] = tuple(value) if isinstance(value, list) else value
    return replace(section, **changes)


def load_settings(path: str | Path | None = None) -> Settings:
    """Defaults, with the sections found in a YAML file laid over them."""
    settings = Settings()
    if path is None or not Path(path).exists():
        return settings
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    parts = {
        f.name: _overlay(getattr(settings, f.name), data.get(f.name))
        for f in fields(settings)
        if isinstance(data.get(f.name), dict)
    }
    return replace(settings, **parts)
