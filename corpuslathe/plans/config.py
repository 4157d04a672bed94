"""Settings, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, field

SAMPLE_TYPES = ("CodeQA", "Documentation", "CodeCompletion", "ToolCalling", "MultiTurn", "BugDetection", "RepoContext")
FORMATS = ("OpenAI", "ChatML", "Llama4", "Mistral", "ShareGPT", "Alpaca")


@dataclass(frozen=True)
class Quality:
    min_tokens: int = 50
    max_tokens: int = 8192
    max_avg_line_length: int = 200
    min_alphanumeric: float = 0.4
    min_line_count: int = 3
    dedup_threshold: float = 0.85
    encoding: str = "byte_bpe_50k.tiktoken"
    skip_generated: bool = False
    skip_boilerplate: bool = False
    max_line_count: int | None = None

    def __post_init__(self):
        if self.max_line_count is not None and self.max_line_count < self.min_line_count:
            raise ValueError("max_line_count is under min_line_count")
        if self.min_tokens > self.max_tokens:
            raise ValueError("min_tokens is over max_tokens")


@dataclass(frozen=True)
class Ignore:
    """``user_patterns`` are globs of names, added to the fixed ones."""

    use_gitignore: bool = True
    user_patterns: tuple[str, ...] = ()
    skip_sensitive: bool = True
    max_file_bytes: int = 1_000_000

    def __post_init__(self):
        if self.max_file_bytes <= 0:
            raise ValueError("max_file_bytes must be positive")


@dataclass(frozen=True)
class Config:
    ignore: Ignore = field(default_factory=Ignore)
    quality: Quality = field(default_factory=Quality)
    enabled_types: tuple[str, ...] = SAMPLE_TYPES[:5]
    formats: tuple[str, ...] = ("OpenAI", "ChatML")
    token_budget: int = 8192
    include_manifest: bool = True
    #: (sample type, registered table function) of generators from outside the package.
    added_generators: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.token_budget <= 0:
            raise ValueError("token_budget must be positive")
        if wrong := (set(self.enabled_types) - set(SAMPLE_TYPES)) | (set(self.formats) - set(FORMATS)):
            raise ValueError(f"unknown: {sorted(wrong)}")
