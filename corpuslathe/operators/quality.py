"""Filters on samples and on source files, as columns with the reason of rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import sample_token_count
from ..plans.config import Quality

# What marks generated files and lock files.
GENERATED_PATH = r"generated|autogen|\.gen\.|(\.pb\.go|\.pb\.rs|\.d\.ts|\.min\.js|\.min\.css|\.bundle\.js)$"
GENERATED_HEADER = "auto-generated|autogenerated|automatically generated|do not edit|do not modify|generated by|generated from|this file is generated|code generated by|@generated|machine generated|this is a generated file"
LOCK_PATH = r"lock\.|\.lock$|^bun\.lockb$"


def is_generated(path: Column, content: Column) -> Column:
    header = F.lower(F.array_join(F.slice(T.lines(content), 1, 20), "\n"))
    low = F.lower(path)
    return low.rlike(GENERATED_PATH) | header.rlike(GENERATED_HEADER) | low.rlike(LOCK_PATH) | (low == "package-lock.json") | (low == "pnpm-lock.yaml")


def is_boilerplate(source: Column) -> Column:
    n = T.line_count(source)
    comments = F.size(F.filter(T.lines(source), lambda x: x.rlike(r"^\s*(//|#|/\*|\*)")))
    return (n == 0) | ((n <= 3) & F.lower(source).rlike(r"get|set|return self\.")) | ((n > 5) & (comments / n > 0.7))


def sources_passed(files: DataFrame, config: Quality) -> DataFrame:
    """Files (path, content, line_count) that samples may be made of. Generated files,
    boilerplate and long files go if the settings say so; files without text stay."""
    kept = files
    if config.skip_generated:
        kept = kept.where(~F.coalesce(is_generated(F.col("path"), F.col("content")), F.lit(False)))
    if config.skip_boilerplate:
        kept = kept.where(~F.coalesce(is_boilerplate(F.col("content")), F.lit(False)))
    if config.max_line_count is not None:
        kept = kept.where(F.col("line_count") <= config.max_line_count)
    return kept


def turn_reason(turn: Column, config: Quality) -> Column:
    """Why an assistant turn is rejected, or null."""
    content = turn["content"]
    return F.when(
        turn["role"] == "assistant",
        F.when(T.average_line_bytes(content) > config.max_avg_line_length, "long lines").when(
            ~content.contains("```") & (T.alphanumeric_share(content) < config.min_alphanumeric), "few letters"
        ),
    )


def cheap_reason(conversation: Column, config: Quality) -> Column:
    """The first reason that needs no token count, in the filters' order; null passes."""
    blank = F.exists(conversation, lambda t: T.is_blank(t["content"]) & t["tool_calls"].isNull())
    by_turn = F.get(F.filter(F.transform(conversation, lambda t: turn_reason(t, config)), lambda r: r.isNotNull()), F.lit(0))

    def short(turn: Column) -> Column:
        return (turn["role"] == "user") & T.fenced_line_count(turn["content"]).between(1, config.min_line_count - 1)

    return F.when(blank, "empty turn").otherwise(F.coalesce(by_turn, F.when(F.exists(conversation, short), "short code")))


def with_reasons(samples: DataFrame, config: Quality | None = None) -> DataFrame:
    """``samples`` with tokens and reject_reason. The token bounds come first in the
    order of reasons."""
    config = config or Quality()
    counted = samples.withColumn("tokens", sample_token_count(F.col("conversation"), config.encoding))
    bounds = F.when(F.col("tokens") < config.min_tokens, "few tokens").when(F.col("tokens") > config.max_tokens, "many tokens")
    return counted.withColumn("reject_reason", F.coalesce(bounds, cheap_reason(F.col("conversation"), config)))


def passed(samples: DataFrame, config: Quality | None = None) -> DataFrame:
    """Samples without a reason; the cheap filters run before tokens are counted."""
    config = config or Quality()
    fine = samples.where(cheap_reason(F.col("conversation"), config).isNull())
    return fine.where(sample_token_count(F.col("conversation"), config.encoding).between(config.min_tokens, config.max_tokens))
