"""Each stage of the pipeline against brute force on what it gets."""

from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslathe.llm import mixing, packing, secrets, toxicity

from .test_operators import base_spans, groups, sets_of


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory, sf):
    sf_dir = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(90_000, None, "en", "src0", 0), (90_001, "", "en", None, 0), (90_002, "same words here " * 9, "en", "src1", 144), (90_002, "same words here " * 9, "en", "src1", 144), (None, "a text without an id", "en", "src1", 20)]
    odd = spark.createDataFrame(odd, docs.schema)
    docs = docs.unionByName(odd)
    out, base = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(str(base / name))
        out.append(spark.read.parquet(str(base / name)))
    return out


def test_columns(stages):
    assert [x[0] for x in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_toxic(spark, sf, stages):
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    model = toxicity.fit(stages[0], labels.where(~toxicity.held_out()))
    scored = {(r.doc_id, r.predicted) for r in toxicity.score(stages[0], model).collect()}
    assert Counter(r.doc_id for r in stages[1].collect()) == Counter(r.doc_id for r in stages[0].collect() if (r.doc_id, 0) in scored)
    clean = stages[0].join(labels.where("toxic = 0"), "doc_id").count()
    assert stages[1].join(labels.where("toxic = 0"), "doc_id").count() >= 0.99 * clean


def test_near(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    s = sets_of(rows)
    where = {}
    for i, x in enumerate(s):
        for h in x:
            where.setdefault(h, []).append(i)
    pairs = Counter((a, b) for v in where.values() for k, a in enumerate(v) for b in v[k + 1 :])
    links = [p for p, n in pairs.items() if 100 * n >= 75 * (len(s[p[0]]) + len(s[p[1]]) - n)]
    least = {}
    g = groups(len(rows), links)
    for (i, _), c in zip(rows, g, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = {least.get(c, i) for (i, _), c in zip(rows, g, strict=True)}
    got = Counter(r.doc_id for r in stages[2].collect())
    assert set(got) == want and max(got.values()) == 1


def test_near_rows_by_id_and_text(spark, sf):
    """Repeated ids with other texts, and rows without id."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, d), (3, d), (None, a), (None, b + " more"), (None, e), (None, e), (None, e + " more"), (None, "short"), (None, None), (None, None), (None, ""), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], spark.read.parquet(f"{sf}/documents.parquet").schema)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    of_e = [k for k in got if k[1] in (e, e + " more")]
    assert len(of_e) == 1 and of_e[0][0] is None
    assert got == Counter([(1, a), (2, b), (3, c), (3, d), *of_e, (None, "short"), (None, None), (None, ""), (4, None), (4, "")])


def test_secrets(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    live = secrets.secret_spans(stages[2], repo_col=F.concat_ws("/", "source", "lang"), owner_col="source").select("doc_id", F.filter("spans", lambda s: s["verdict"] == "live").alias("s")).collect()
    for r in live:
        text, out, at = before[r.doc_id].text, "", 0
        for s in r.s:
            if s.end > at:
                out += text[at : max(at, s.value)] + secrets.MASK
                at = s.end
        assert after[r.doc_id].text == (out + text[at:] if r.s else text)
        if r.s:
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text) and len(base_spans(after[r.doc_id].text)) < len(base_spans(text)) or "bare" in str(r.s)


def test_mixed_and_packed(stages):
    one, mixed = Counter(r.doc_id for r in stages[3].collect()), Counter(r.doc_id for r in stages[4].collect())
    assert set(one) == set(mixed) and max(mixed.values()) <= 2
    packed = stages[5]
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == mixed
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n > 2048 or n <> end").count() == 0
    total = packed.agg(F.sum("length")).first()[0]
    assert full.count() <= -(-total // 2048) + 1


def test_sequences_follow_blocks(spark, sf, tmp_path, monkeypatch):
    """A block of the mixture is a file, in order; no sequence holds pieces of two blocks,
    and the sequences' numbers rise with the blocks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.row_number().over(Window.orderBy("doc_id")).cast("long"))
    plan = mixing.block_plan(docs, most_repeats=corpus_pipeline.MOST_REPEATS, least=1 << 14)
    monkeypatch.setattr(mixing, "block_plan", lambda *a, **b: plan)
    corpus_pipeline.mixed(spark, docs, sf).write.parquet(str(tmp_path / "mixed"))
    table = spark.read.parquet(str(tmp_path / "mixed"))
    placed = mixing.mix(docs, keep_all=True, most_repeats=corpus_pipeline.MOST_REPEATS, block_tokens=plan[0]).orderBy("block", "position").collect()
    got = table.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in placed] and len({r.block for r in placed}) == len({r.file_name for r in got}) > 3
    monkeypatch.setattr(packing, "BLOCK_ROWS", 16)  # several chunks a block
    rows = corpus_pipeline.packed(spark, table, sf).orderBy("sequence_id").collect()
    blocks = {}
    for r in placed:
        blocks.setdefault(r.doc_id, set()).add(r.block)
    of, where = {}, {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append(blocks[r.doc_id])
    for n, held in of.items():
        where[n] = set.intersection(*held)  # a document read twice is in two blocks
        assert where[n]
    lowest = 0
    for n in sorted(where):
        assert max(where[n]) >= lowest
        lowest = max(lowest, min(where[n]))
    assert Counter((r.doc_id, r.piece) for r in rows if r.piece == 0) == Counter((r.doc_id, 0) for r in placed)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, None), (None, None)]])
def test_empty_and_null_texts(spark, sf, tmp_path, rows):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted((r.doc_id is None, r.doc_id, r.length) for r in docs.collect()) == sorted((i is None, i, 1) for i, _ in rows)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and "sequence_id" in got.columns
