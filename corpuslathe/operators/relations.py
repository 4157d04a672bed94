"""Joins between files: who mentions whose names, who stands beside whom.

Mentions are substring matches, as a name inside another counts too. The distinct
names are few against the texts: they are written in parts of bounded size, and a task
reads the part it needs and scans its texts with an Aho-Corasick automaton, in Arrow
batches. Names pass neither through the driver nor a broadcast. All further joins are
equi-joins on names and paths.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.files import store
from ..functions.tables import written

#: Names in one automaton, which a task builds.
NAMES_AT_ONCE = 200_000


def mentions(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (path, name): texts (path, text) that contain names (name).

    Null and empty names and texts match nothing. Where there are several parts of
    names, texts are dealt to the tasks of each part.
    """
    wanted = names.where("name is not null and name <> ''").select("name").distinct()
    parts = max(1, -(-wanted.count() // NAMES_AT_ONCE))
    kind = texts.schema["path"].dataType.simpleString()
    folder = written(wanted.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")), "part").inputFiles()
    at = folder[0].rpartition("/part=")[0] if folder else None

    def automaton(part: int):
        import ahocorasick
        from pyarrow import dataset, fs

        machine = ahocorasick.Automaton()
        if at is not None:
            files, path = store(at)
            if files.get_file_info(f"{path}/part={part}").type == fs.FileType.Directory:
                for batch in dataset.dataset(f"{path}/part={part}", filesystem=files, format="parquet").to_batches(columns=["name"]):
                    for n in batch.column(0).to_pylist():
                        machine.add_word(n, n)
        machine.make_automaton()
        return machine

    def run(batches):
        machine, of = None, None
        for batch in batches:
            rows, found = [], []
            for i, (t, part) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if part != of:
                    machine, of = automaton(part), part
                hits = sorted({n for _, n in machine.iter(t)}) if t and len(machine) else []
                rows += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["path", "name"])

    own = texts.select("path", "text")
    if parts == 1:
        own = own.withColumn("part", F.lit(0))
    else:
        tasks = max(parts, own.rdd.getNumPartitions())
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        own = own.repartition(tasks, "part", F.pmod(F.xxhash64("path"), F.lit(-(-tasks // parts)))).sortWithinPartitions("part")
    return own.mapInArrow(run, f"path {kind}, name string").distinct()


def searched_texts(analyses: DataFrame) -> DataFrame:
    """(path, text): sources of all symbols and all imports of a file, apart."""
    parts = F.concat(F.transform("symbols", lambda s: s["source_text"]), F.transform("imports", lambda i: i["source"]))
    return analyses.select("path", F.array_join(parts, "\u0000").alias("text"))


def referencing_files(symbols: DataFrame, hits: DataFrame, files: DataFrame, k: int = 3) -> DataFrame:
    """(path, sym_pos, referencing): for each symbol the first k other files, in file
    order, that mention its name."""
    order = files.select(F.col("path").alias("other"), F.col("file_pos").alias("other_pos"))
    per_name = hits.select("name", F.col("path").alias("other")).join(order, "other")
    # of a name, no symbol needs more than the first k + 1 files: its own may be one
    first = per_name.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("other_pos"))).where(F.col("n") <= k + 1)
    joined = symbols.select("path", "sym_pos", "name").join(first, "name").where("path <> other")
    ranked = joined.withColumn("n", F.row_number().over(Window.partitionBy("path", "sym_pos").orderBy("other_pos"))).where(F.col("n") <= k)
    return ranked.groupBy("path", "sym_pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("other_pos", "other"))), lambda x: x["other"]).alias("referencing"))


def siblings(files: DataFrame, k: int = 10) -> DataFrame:
    """(dir, siblings): the first k files of each directory in file order."""
    own = files.withColumn("dir", T.parent_dir(F.col("path")))
    ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("file_pos"))).where(F.col("n") <= k)
    return ranked.groupBy("dir").agg(F.transform(F.sort_array(F.collect_list(F.struct("file_pos", "path"))), lambda x: x["path"]).alias("siblings"))


def related_pairs(analyses: DataFrame, symbols: DataFrame, imports: DataFrame, hits: DataFrame) -> DataFrame:
    """(a, a_pos, b, b_pos), a before b, of files of which one imports the other's
    stem or mentions a name that the other defines."""
    files = analyses.select("path", "file_pos")
    defined = symbols.select(F.col("path").alias("x"), "name").distinct().join(hits.select(F.col("path").alias("y"), "name"), "name").select("x", "y")
    stems = files.select(F.col("path").alias("x"), T.stem(F.col("path")).alias("name")).where("name <> ''")
    sources = imports.groupBy("path").agg(F.array_join(F.collect_list("source"), "\u0000").alias("text"))
    by_import = stems.join(mentions(stems, sources).select(F.col("path").alias("y"), "name"), "name").select("x", "y")
    left, right = files.toDF("x", "x_pos"), files.toDF("y", "y_pos")
    both = defined.union(by_import).distinct().join(left, "x").join(right, "y").where("x_pos <> y_pos")
    swap = F.col("x_pos") < F.col("y_pos")
    pick = lambda p, q: F.when(swap, F.col(p)).otherwise(F.col(q))
    return both.select(pick("x", "y").alias("a"), pick("x_pos", "y_pos").alias("a_pos"), pick("y", "x").alias("b"), pick("y_pos", "x_pos").alias("b_pos")).distinct()


def names_mentioned(symbols: DataFrame, texts: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """(x, y, names): the first k symbol names of file x that the symbols' sources of
    file y mention, in the order of x's symbols."""
    found = symbols.select(F.col("path").alias("x"), "sym_pos", "name").join(hits.select(F.col("path").alias("y"), "name"), "name").where("x <> y")
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("x", "y").orderBy("sym_pos"))).where(F.col("n") <= k)
    return ranked.groupBy("x", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("sym_pos", "name"))), lambda s: s["name"]).alias("names"))
