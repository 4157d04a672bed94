"""Sample generators from outside the package, as table functions.

    plugins.register(spark, "my_samples", my_generator)
    spark.sql("SELECT * FROM my_samples(TABLE(symbols) PARTITION BY path ORDER BY sym_pos)")

A generator gets the symbols of one file, rows in their order, and gives tuples of
``SAMPLE``. Spark deals files to tasks and hands over one file at a time, so a generator
holds no more than that. ``Config.added_generators`` names those that a run is to use.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .generators import Tables, _samples, turn

#: What a generator gives: of which pattern (1 or more characters; a symbol's samples are in
#: their order), about which symbol, the three turns, tokens and tier.
SAMPLE = "pattern string, sym_pos int, system string, question string, answer string, tokens long, tier string"
COLUMNS = "path, file_pos, language, sym_pos, name, kind, visibility, parent, parameters, return_type, signature, doc_comment, source_text, start_line, end_line, n_lines, fence"


def register(spark: SparkSession, name: str, generator: Callable[[list[Row]], Iterable[tuple]]) -> None:
    """Makes a generator a table function of that name. Its rows come with the file's
    path, file_pos, language, and the symbol's name and kind."""

    class OfFile:
        def __init__(self):
            self.rows = []

        def eval(self, symbol: Row):
            self.rows.append(symbol)

        def terminate(self):
            at = {r.sym_pos: r for r in self.rows}
            place: dict[int, int] = {}
            for pattern, sym_pos, *rest in generator(self.rows):
                r = at[sym_pos]
                place[sym_pos] = place.get(sym_pos, -1) + 1
                yield (r.path, r.file_pos, r.language, r.name, r.kind, place[sym_pos], pattern, sym_pos, *rest)

    returns = f"path string, file_pos long, language string, name string, kind string, place int, {SAMPLE}"
    spark.udtf.register(name, F.udtf(OfFile, returnType=returns))


def generated_by(ctx: Tables, name: str, sample_type: str, rank: int) -> DataFrame:
    """Samples of a registered table function over a project's symbols."""
    spark, view = ctx.files.sparkSession, f"symbols_{uuid.uuid4().hex}"
    ctx.symbols.selectExpr(*COLUMNS.split(", ")).createOrReplaceTempView(view)
    rows = spark.sql(f"SELECT * FROM {name}(TABLE({view}) PARTITION BY path ORDER BY sym_pos)")
    turns = [turn("system", F.col("system")), turn("user", F.col("question")), turn("assistant", F.col("answer"))]
    return _samples(rows, ctx, rank, sample_type, F.col("pattern"), turns, F.col("tokens"), F.col("tier"), at=(F.col("file_pos"), F.col("sym_pos") * 4 + F.col("place")))
