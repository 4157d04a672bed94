"""Temperature mixing of sources, in DataFrame functions only.

1. Tokens by source (a grouped sum), then shares p.
2. Weights are p ** alpha, normalised. alpha is bisected: entropy falls and the
   most repeated source is read less often as alpha rises from 0 to 1, so the
   wanted alpha is the least that keeps the entropy target from above, or the
   repetition limit, whichever is larger. The catalogue of sources is one row
   here, its size that of the sources' list, not of the corpus.
3. A source's stream is its documents epoch after epoch, each epoch in a new
   permutation by a hash of id and text, so rows that tie are equal; the last epoch
   ends where the source's budget does.
4. Blocks of the mixture take from every stream in turn so many tokens as its
   weight says. Running sums over a stream are made in ``PARTS`` parts by the
   permutation's leading digits and joined by the parts' totals, so that a source
   with a third of all rows is spread like any other.
5. Rows are placed by their ids and hashes. What else a caller wants of them, texts
   above all, joins the places at the end, by file and row number; so a text is
   shuffled once. Tables that aren't Parquet files are written first for that.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TURNS = 60
PARTS = 4096
BLOCK_TOKENS = 1 << 18
#: The entropy target lies so far on the way from the natural entropy to the greatest one.
FLATTEN = 0.5
MOST_REPEATS = 3.0


def tokens_of(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; null text has none."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def _total(x: Column, of) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + of(v))


def weights(
    sources: DataFrame, entropy_share: float | None = None, most_repeats: float | None = MOST_REPEATS, keep_all: bool = False, flatten: float | None = FLATTEN
) -> DataFrame:
    """(source, tokens, alpha, weight, target) from (source, tokens).

    Entropy is to reach ``entropy_share`` of its maximum, the natural one if that
    is higher; without it, ``flatten`` of the way from the natural entropy to the
    maximum. With neither, only the repetition limit counts. The budget is the corpus's tokens; with ``keep_all`` it is the least
    that reads every source at least once. Sources without tokens get no weight.
    """
    row = sources.where("tokens > 0").agg(
        F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("all"), F.sum("tokens").cast("double").alias("total"), F.max("tokens").cast("double").alias("most")
    ).where("total is not null")

    def power(alpha: Column):
        return lambda s: F.pow(s["tokens"] / F.col("total"), alpha)

    def entropy(alpha: Column) -> Column:
        z = _total(F.col("all"), power(alpha))
        return F.log(z) - alpha * _total(F.col("all"), lambda s: power(alpha)(s) * F.log(s["tokens"] / F.col("total"))) / z

    def repeats(alpha: Column) -> Column:
        """How often the most repeated source, the smallest, is read."""
        least = F.element_at(F.array_sort(F.transform("all", lambda s: s["tokens"])), 1)
        if keep_all:
            return F.pow(F.col("most") / least, 1 - alpha)
        z = _total(F.col("all"), power(alpha))
        return F.pow(least / F.col("total"), alpha) / z * F.col("total") / least

    def bisected(good) -> Column:
        """The least alpha in [0, 1] for which good(alpha) holds; it holds at 1."""
        def step(state: Column, _: Column) -> Column:
            mid = (state["lo"] + state["hi"]) / 2
            fine = good(mid)
            return F.struct(F.when(fine, state["lo"]).otherwise(mid).alias("lo"), F.when(fine, mid).otherwise(state["hi"]).alias("hi"))

        zero = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), zero, step, lambda s: s["hi"])

    most, natural, limits = F.log(F.size("all").cast("double")), entropy(F.lit(1.0)), []
    if entropy_share is not None:
        limits.append(bisected(lambda a: entropy(a) <= F.greatest(F.lit(entropy_share) * most, natural + 1e-12)))
    elif flatten is not None:
        limits.append(bisected(lambda a: entropy(a) <= natural + F.lit(flatten) * F.greatest(most - natural, F.lit(0.0)) + 1e-12))
    if most_repeats is not None:
        limits.append(bisected(lambda a: repeats(a) <= max(most_repeats, 1.0)))
    alpha = F.greatest(*limits) if len(limits) > 1 else limits[0] if limits else F.lit(1.0)
    # nine digits, upwards: the same on every machine, and within the limits
    row = row.withColumn("alpha", F.least(F.ceil(alpha * 1e9) / 1e9, F.lit(1.0))).withColumn("z", _total(F.col("all"), power(F.col("alpha"))))
    budget = F.col("z") * F.pow("total", "alpha") * F.pow("most", 1 - F.col("alpha")) if keep_all else F.col("total")
    each = row.select("alpha", "z", "total", budget.alias("budget"), F.explode("all").alias("s"))
    weight = F.pow(F.col("s.tokens") / F.col("total"), F.col("alpha")) / F.col("z")
    return each.select("s.source", "s.tokens", "alpha", weight.alias("weight"), (weight * F.col("budget")).alias("target"))


def block_plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", most_repeats: float = MOST_REPEATS, blocks: int = 512, least: int = 1 << 20, most: int = 1 << 26) -> tuple[int, int]:
    """(tokens of a block, number of blocks) of a mixture that keeps all documents: about
    ``blocks`` blocks of ``least`` to ``most`` tokens, so that each can be a file."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source")
    totals = docs.select(key, tokens_of(F.col(text_col).cast("string")).alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    budget = weights(totals, None, most_repeats, True).agg(F.sum("target")).first()[0] or 0.0
    size = min(max(int(budget) // blocks, least), most)
    return size, int(budget // size) + 1


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with _mix_file and _mix_index, which tell its rows apart in every reading."""
    place = F.xxhash64("_metadata.file_path").alias("_mix_file"), F.col("_metadata.row_index").alias("_mix_index")
    if docs.inputFiles():
        try:
            return docs.select("*", *place)
        except AnalysisException:  # not as it was read, or no Parquet
            pass
    return written(docs).select("*", *place)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy_share: float | None = None, most_repeats: float | None = MOST_REPEATS,
    keep_all: bool = False, block_tokens: int = BLOCK_TOKENS, seed: int = 1, carry: list[str] | None = None, flatten: float | None = FLATTEN,
) -> DataFrame:
    """A row for each document and epoch in which it is read: doc_id, source,
    tokens, epoch, block, position; or the columns named in ``carry`` with epoch,
    block and position.

    A null source is a source of its own. Null and empty texts have no tokens; they
    are read once, in epoch 0, if their source has a target, and not at all in a
    source without tokens unless ``keep_all``, which deals its rows to all blocks.
    Repeated rows are rows of their own. The result is the same in any partitioning;
    of rows that differ in carried columns alone, either may come first. An empty
    table gives no rows. No other column is read, except those carried.
    """
    text = F.col(text_col).cast("string")
    docs = _numbered(docs) if carry else docs
    own = [F.col("_mix_file"), F.col("_mix_index")] if carry else []
    name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    rows = docs.select(
        *own, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("key"),
        tokens_of(text).alias("tokens"), name.alias("name"),
    )
    totals = rows.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    plan = weights(totals.withColumnRenamed("key", "source"), entropy_share, most_repeats, keep_all, flatten).select(
        F.col("source").alias("key"), F.col("tokens").alias("total"), "target", "weight"
    )
    # a source's whole epochs; rounding must not open or lose one
    plan = plan.withColumn("whole", F.floor(F.col("target") / F.col("total") + 1e-6).cast("int"))
    last = F.when(F.col("target") - F.col("whole") * F.col("total") >= 1, F.col("whole")).otherwise(F.col("whole") - 1)
    plan = plan.withColumn("last", F.greatest(last, F.lit(0)))
    read = rows.join(plan, "key", "left" if keep_all else "inner")
    if keep_all:  # a source without tokens knows the number of blocks from the others
        read = read.crossJoin(F.broadcast(plan.agg(F.floor(F.coalesce(F.sum("target"), F.lit(0.0)) / block_tokens).alias("last_block"))))
    last = F.when(F.col("tokens") > 0, F.coalesce("last", F.lit(0))).otherwise(0)
    read = read.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", "name"))
    read = read.withColumn("order", order).withColumn("part", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    stream = ["key", "epoch", "part"]
    parts = read.groupBy(*stream).agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("key", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*stream, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy(*stream).orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    placed = read.withColumn("end", F.sum("tokens").over(own)).join(parts, stream)
    end = F.col("epoch") * F.coalesce("total", F.lit(0)) + F.col("before") + F.col("end")
    placed = placed.withColumn("at", end).where("total is null or epoch < whole or tokens = 0 or at <= target")
    share = F.greatest(F.coalesce("weight", F.lit(1.0)) * block_tokens, F.lit(1.0))
    block = F.floor((F.col("at") - F.col("tokens")) / share)
    if keep_all:
        anywhere = F.pmod(F.xxhash64("order"), F.col("last_block") + 1)
        block = F.when(F.col("weight").isNull(), anywhere).otherwise(F.least(block, F.col("last_block")))
    placed = placed.withColumn("block", block.cast("long"))
    position = F.row_number().over(Window.partitionBy("block").orderBy("order", "epoch", "key")) - 1
    placed = placed.withColumn("position", position.cast("long"))
    if carry:
        places = placed.select("_mix_file", "_mix_index", "epoch", "block", "position").withColumnsRenamed({c: f"_{c}" for c in ("epoch", "block", "position")})
        # the places, without texts, are the side that a task holds
        met = docs.select(*carry, "_mix_file", "_mix_index").join(places.hint("shuffle_hash"), ["_mix_file", "_mix_index"])
        return met.select(*carry, F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_position").alias("position"))
    return placed.select("doc_id", "source", "tokens", "epoch", "block", "position")
