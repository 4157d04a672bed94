"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

1. Candidates of three kinds in every text, as spans in code points, with the
   hash of the credential's value.
2. Values are counted over the corpus by distinct repositories and owners, without
   the full stops that end a sentence. One that many owners hold, or two in many
   repositories, is a copied example ("widespread"); one of few owners that looks
   random is "live", in however many repositories of its owner; the rest is "weak".
3. Bare tokens elsewhere whose value is a live credential are added as spans.

Only hashes leave the text's row; grouped counts pre-aggregate before shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, written

# The patterns of the kinds, in the order that breaks ties.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BARE = r"[A-Za-z0-9+/_.=-]{16,}"
KINDS = ["assign", "access", "hex", "bare"]
LEAST = {"assign": 6, "access": 20, "hex": 24, "bare": 16}
#: Spans of short runs are dropped anyway, and a run is matched whole, so the least length may stand in the pattern.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "bare": BARE}
MASK = "[SECRET]"
#: A value is widespread with so many owners, or with two owners and so many repositories.
WIDESPREAD_OWNERS, WIDESPREAD_REPOS = 3, 6
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|your|dummy|xxxx|1234567|abcdef01|(.)\1{5}"

SPAN = "struct<start:int,kind:int,end:int,value:int,hash:string,random:boolean>"


def _hits(text: Column, kind: str) -> Column:
    """Array of SPAN for one kind; value is where the credential starts."""
    pattern, least, k = F.lit(PATTERNS[kind]), LEAST[kind], KINDS.index(kind)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else whole
    bare = kind == "bare"
    found = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), whole.alias("whole"), values.alias("value"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        value = F.regexp_replace(x["value"], r"\.+$", "")
        span = F.struct(
            start.alias("start"), F.lit(k).alias("kind"), (start + F.length(value) if bare else end).alias("end"), (end - F.length(x["value"])).alias("value"),
            F.sha2(value, 256).alias("hash"), looks_random(value).alias("random"),
        ).cast(SPAN)
        kept = x["whole"].isNotNull() & (F.length(value if bare else x["value"]) >= least)
        return F.struct(
            F.coalesce(end, start).alias("at"), F.when(kept, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    spans = F.aggregate(found, zero, step, lambda state: state["spans"])
    return F.when(text.rlike(PATTERNS[kind]), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def looks_random(value: Column) -> Column:
    """At least 16 characters, letters and digits, many different ones, no placeholder."""
    letters = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (letters >= 9) & ~value.rlike(PLACEHOLDER)


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str | Column | None, owner_col: str | Column | None) -> DataFrame:
    """A row for each row: row, doc_id, repo, owner, text_hash, base and bare spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    where = lambda c: (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast("string")
    base = spread(docs).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), where(repo_col).alias("repo"), where(owner_col).alias("owner"), text.alias("text")
    ).withColumn("base", F.array_sort(F.concat(*(_hits(F.col("text"), k) for k in KINDS[:3]))))
    apart = F.filter(
        _hits(F.col("text"), "bare"), lambda b: b["random"] & ~F.exists("base", lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    )
    return base.select("row", "doc_id", "repo", "owner", F.xxhash64("text").alias("text_hash"), "base", apart.alias("bare"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_hits, n_repos, n_owners, verdict) for the values of base spans."""
    each = found.where(F.size("base") > 0).select("repo", "owner", F.explode("base").alias("s")).select("repo", "owner", "s.hash", "s.random")
    return (
        each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"), F.first("random").alias("random"))
        .groupBy("hash").agg(F.sum("n").alias("n_hits"), F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"), F.first("random").alias("random"))
        .withColumn("verdict", F.when((F.col("n_owners") >= WIDESPREAD_OWNERS) | (F.col("n_owners") == 2) & (F.col("n_repos") >= WIDESPREAD_REPOS), "widespread").when(F.col("random"), "live").otherwise("weak"))
        .drop("random")
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | Column | None = "source", owner_col: str | Column | None = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, spans (by start, then kind:
    struct of start, kind, end, value, hash, random, verdict, n_repos, n_owners).

    Null texts are empty and have no spans. Rows are told apart by position, so
    repeated ids and rows each keep their own spans; a null id stays null. A null
    repository or owner counts as none, so a value known only there is not
    widespread. Other columns are not read. An empty table gives no rows.
    """
    found = written(candidates(docs, id_col, text_col, repo_col, owner_col))
    counts = written(ownership(found))
    each = found.where(F.size("base") + F.size("bare") > 0).select("row", F.explode(F.concat("base", "bare")).alias("s"))
    told = (
        # counts are a written table, so Spark splits a widely copied value's rows
        each.join(counts, each.s["hash"] == counts["hash"], "left")
        .where((F.col("s.kind") < 3) | (F.col("verdict") == "live"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "s.value", "s.hash", "s.random", "verdict", "n_repos", "n_owners"))).alias("spans"))
    )
    none = F.array().cast(told.schema["spans"].dataType)
    return found.join(told, "row", "left").select("doc_id", "text_hash", F.coalesce("spans", none).alias("spans"))


def spans_string(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_widespread."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    def count(of: str, value) -> Column:
        return F.size(F.filter("spans", lambda s: s[of] == F.lit(value))).cast("long")

    return found.select(
        "doc_id",
        *(count("kind", k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(spans_string(base), 256).alias("base_sha256"),
        spans_string(F.col("spans")).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "widespread").alias("n_widespread"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | Column | None = "source", owner_col: str | Column | None = "source") -> DataFrame:
    """``docs`` with live credentials replaced by ``MASK`` and, where the table has
    it, n_chars counted anew. Every row stays; rows without a live credential are
    unchanged, and they are not shuffled unless they hold a candidate."""
    live = secret_spans(docs, id_col, text_col, repo_col, owner_col).select(
        "doc_id", "text_hash", F.filter("spans", lambda s: s["verdict"] == "live").alias("_live")
    ).where(F.size("_live") > 0).dropDuplicates(["doc_id", "text_hash"]).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    text = F.col(text_col)
    may = F.coalesce(text.rlike("|".join(PATTERNS[k] for k in KINDS)), F.lit(False))
    some = docs.where(may)

    def step(state: Column, s: Column) -> Column:
        start = F.greatest(s["value"], state["at"])
        gone = s["end"] <= state["at"]
        return F.struct(
            F.greatest(s["end"], state["at"]).alias("at"),
            F.when(gone, state["out"]).otherwise(F.concat(state["out"], F.substr(text, state["at"] + 1, start - state["at"]), F.lit(MASK))).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("_live", zero, step, lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1)))
    some = some.join(live, F.col(id_col).eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_hash")), "left").withColumn(
        text_col, F.when(F.col("_live").isNotNull(), masked).otherwise(text)
    )
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.when(F.col("_live").isNotNull(), F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return docs.where(~may).unionByName(some.select(*docs.columns))
