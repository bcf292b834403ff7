"""Run settings. One frozen value is passed to the plans; nothing is global."""

from __future__ import annotations

from dataclasses import asdict, dataclass

MODES = ("original", "embedding")
METRICS = ("cosine", "ip", "l2")

# Class ids and their display names.
CLASS_NAMES = {0: "goodware", 1: "malware"}


@dataclass(frozen=True)
class RunConfig:
    # data
    target_column: str | None = None  # None = last column
    seed: int = 42
    train_limit: int | None = None
    test_limit: int | None = None
    balance_train: bool = False
    balance_test: bool = False
    # features and retrieval
    top_k_features: int | None = None
    feature_order: str = "file"  # or "score": order kept when nothing is cut
    k: int = 3
    mode: str = "original"
    standardize: bool = False
    # rows as text
    embedding_model: str = "hashing"
    embedding_dim: int = 64
    top_features_per_row: int = 128
    features_per_chunk: int = 8
    # prompts
    max_prompt_tokens: int = 2048
    max_new_tokens: int = 10
    max_examples: int = 5
    max_features: int = 20
    min_features: int = 3
    prompt_variants: int = 3
    min_consistent_votes: int = 2
    always_override: bool = False
    # cache
    cache_version: int = 1

    def check(self) -> "RunConfig":
        if self.k <= 0:
            raise ValueError("k must be greater than zero")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.feature_order not in ("file", "score"):
            raise ValueError("feature_order must be 'file' or 'score'")
        if self.top_k_features is not None and self.top_k_features <= 0:
            raise ValueError("top_k_features must be greater than zero")
        if self.top_features_per_row <= 0 or self.features_per_chunk <= 0:
            raise ValueError("text settings must be greater than zero")
        if self.min_features <= 0 or self.max_features < self.min_features:
            raise ValueError("need 0 < min_features <= max_features")
        return self

    def as_dict(self) -> dict:
        return asdict(self)
