"""Runs: kept analyses, counts on the way, leases, generators from outside."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from corpuslathe.functions import files as shared
from corpuslathe.operators import statistics, symbols
from corpuslathe.operators.analyses import Store
from corpuslathe.plans import generators, lease, pipeline, plugins, runlog
from corpuslathe.plans.config import Config
from corpuslathe.plans.session import Session
from corpuslathe.sources import scan
from corpuslathe.streaming import progress

from .test_project import JAVA, PY, RS, TS


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, text in {"a/x.py": PY, "a/copy.py": PY, "b/lib.rs": RS, "b/box.ts": TS, "Main.java": JAVA, "README.md": "# T\n\nA tree. It is small.\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def rows(df):
    return sorted(map(repr, df.collect()))


def test_analyses_are_kept(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    scanned = lambda: scan.project_files(spark, str(tree))
    assert rows(store.analysed(scanned())) == rows(symbols.analysed(scanned())) and store.parsed == 4
    assert rows(store.analysed(scanned())) == rows(symbols.analysed(scanned())) and store.parsed == 0
    (tree / "b/lib.rs").write_text(RS + "\npub fn more() -> i32 {\n    let a = 1;\n    a\n}\n")
    again = Store(spark, str(tmp_path / "store"))
    assert rows(again.analysed(scanned())) == rows(symbols.analysed(scanned())) and again.parsed == 1
    assert again.pointer()[0] == 2 and store.kept().count() == 5
    # what a failed run left does not count; another version starts anew
    (tmp_path / "store/part-lost").mkdir()
    assert store.kept().count() == 5
    newer = Store(spark, str(tmp_path / "store"), version=symbols.VERSION + 1)
    assert newer.kept() is None and rows(newer.analysed(scanned())) == rows(symbols.analysed(scanned())) and newer.parsed == 4
    assert Store(spark, str(tmp_path / "s2")).analysed(scanned().where("path = 'README.md'")).count() == 0


def test_two_sessions_add_at_once(spark, tree, tmp_path, monkeypatch):
    one, two = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    found = symbols.parsed(symbols.sources(scan.project_files(spark, str(tree))).dropDuplicates(["content_hash", "language"]))
    real, seen = Store.pointer, []

    def slow(self):
        told = real(self)
        if self is one and not seen:  # the other one comes between reading and making
            seen.append(1)
            two.add(found)
        return told

    monkeypatch.setattr(Store, "pointer", slow)
    one.add(found)
    at, folders = one.pointer()
    assert at == 2 and len(folders) == 2 and one.kept().count() == 8
    files = scan.project_files(spark, str(tree))
    assert rows(one.analysed(files)) == rows(symbols.analysed(files)) and one.parsed == 0
    one.compact()
    assert len(one.pointer()[1]) == 1 and one.kept().count() == 4 and rows(two.analysed(files)) == rows(symbols.analysed(files))


def test_counts_and_events_of_a_run(spark, tree, tmp_path):
    log = runlog.RunLog(str(tmp_path / "log"), "r1")
    ctx = pipeline.project_tables(spark, str(tree), "demo", str(tmp_path / "w"), log=log)
    got = pipeline.run(ctx, str(tmp_path / "w"), Config(enabled_types=("CodeQA", "Documentation")), log)
    assert got.counters == statistics.quality_counters(got.judged, got.kept).first().asDict() and got.counters["passed"] > 0 and got.counters["duplicates_removed"] > 0
    told = runlog.events(spark, log.path).orderBy("seq").collect()
    assert [r.seq for r in told] == list(range(len(told))) and {r.run for r in told} == {"r1"}
    done = [r.phase for r in told if r.event == "completed"]
    assert done == ["scanning", "analyzing", "generating", "qualityFiltering"] and all(r.ms >= 0 for r in told if r.event == "completed")
    phases = {r.phase: r for r in progress.completed_phases(runlog.events(spark, log.path)).collect()}
    assert all(phases[p].started and phases[p].completed and phases[p].percent == 100 for p in ("scanning", "generating", "qualityFiltering"))
    assert log.counts["files"] == {"n": ctx.files.count(), "size_bytes": sum(r.size_bytes for r in ctx.files.collect())}


def slow(symbols_of_file):
    time.sleep(60)
    return iter(())


def test_runs_of_two_sessions(spark, tree, tmp_path):
    a, b = (Session(spark, str(tmp_path / "work"), lease_lives_s=6.0) for _ in range(2))
    assert a.status == {"state": "idle"} and not b.cancel()
    key = a.scan(str(tree)).id
    assert b.scan(str(tree)).id == key
    plugins.register(spark, "slow_samples", slow)
    a.update_config(added_generators=(("Slow", "slow_samples"),))
    raised = []

    def running():
        try:
            a.run(key)
        except Exception as e:
            raised.append(e)

    t = threading.Thread(target=running)
    t.start()
    end = time.time() + 60
    while b.status["state"] != "running" and time.time() < end:
        time.sleep(0.2)
    assert b.status["state"] == "running" and b.status["project"] == key
    with pytest.raises(lease.Busy):
        b.run(key)
    time.sleep(8)  # longer than a lease lives: it was renewed
    assert b.status["state"] == "running"
    began = time.time()
    assert b.cancel()
    t.join(45)
    assert not t.is_alive() and time.time() - began < 40 and isinstance(raised[0], lease.Cancelled)
    assert a.status["state"] == b.status["state"] == "cancelled" and a.log().where("event = 'cancelled'").count() == 1
    assert not list((tmp_path / "work").glob("*.lease")) and not list((tmp_path / "work").glob("cancel-*"))
    # a dead lease is taken over, and the next run is whole
    shared.put(f"{b.work}/run.lease", {"run": "gone", "project": key, "renewed": time.time() - 60, "lives_s": 6.0})
    b.update_config(enabled_types=("Documentation",))
    result = b.run(key)
    assert b.status["state"] == "complete" and b.status["counters"] == result.counters
    assert [r.phase for r in a.log().where(F.col("run") == b.status["run"]).where("event = 'completed'").orderBy("seq").collect()] == ["generating", "qualityFiltering", "exporting"]
    with pytest.raises(Exception, match="no sample type"):
        b.update_config(enabled_types=())
        b.run(key)
    assert b.status["state"] == "error"


def test_leases_one_at_a_time(spark, tmp_path):
    """Of many that try at once, on a free and on a dead lease, one gets it."""
    for dead in (False, True):
        folder = str(tmp_path / f"w{dead}")
        if dead:
            shared.put(f"{folder}/run.lease", {"run": "gone", "project": "p", "renewed": 0.0, "lives_s": 1.0})
        got, start = [], threading.Barrier(8)

        def take():
            held = lease.Lease(spark, folder, "p")
            start.wait()
            try:
                held.take()
                got.append(held.run)
            except lease.Busy:
                pass

        threads = [threading.Thread(target=take) for _ in range(8)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(got) == 1 and lease.holder(folder)["run"] == got[0]


def explained(project, purpose, fences, calls):
    """The explanations and usages of ``generators.code_qa`` as a generator of its own."""

    def of_file(found):
        for s in found:
            if s.kind not in ("function", "method", "class", "struct", "trait", "interface", "enum") or s.n_lines < 4:
                continue
            fence, callable_ = fences.get(s.language, ""), s.kind in ("function", "method")
            asked = f"What does the `{s.name}` {s.kind} in `{s.path}` do?" if callable_ else f"What is the purpose of the `{s.name}` enum in `{s.path}`?" if s.kind == "enum" else f"Explain the `{s.name}` {s.kind} defined in `{s.path}`."
            doc = s.doc_comment.rstrip(".") + "." if s.doc_comment is not None else None
            if callable_:
                answer = f"The `{s.name}` {s.kind}" + (f" on `{s.parent}`" if s.parent else "") + f" in `{s.path}` " + (doc or purpose(s.name) + ".")
            elif s.kind in ("class", "struct"):
                answer = f"`{s.name}` is a {s.kind} defined in `{s.path}`. {doc or ''}"
            elif s.kind == "enum":
                answer = f"`{s.name}` is an enum in `{s.path}` that represents a set of distinct variants. {doc or ''}"
            else:
                answer = f"`{s.name}` is a {s.kind} that defines a contract in `{s.path}`. {doc or ''}"
            if s.parameters:
                each = ", ".join(f"`{p.name}`" + (f" ({p.type_annotation})" if p.type_annotation is not None else "") for p in s.parameters)
                answer += f"\n\nIt takes {len(s.parameters)} parameter(s): {each}."
            answer += f" It returns `{s.return_type}`." if s.return_type is not None else ""
            tokens, tier = len(s.source_text.encode()) // 4, "Simple" if s.n_lines < 10 else "Moderate" if s.n_lines < 40 else "Complex"
            about = "Project description: A demo. "
            yield "explain1", s.sym_pos, f"You are an expert {s.language} developer working on the {project} project. {about}Explain code clearly and concisely.", f"{asked}\n\n```{fence}\n{s.source_text}\n```", answer, tokens, tier
            if s.n_lines > 15 and s.kind in ("function", "method", "class", "struct"):
                names = ", ".join(p.name for p in s.parameters if s.kind == "function" or p.name not in ("self", "&self", "&mut self"))
                function, make, method = calls.get(s.language, calls["Rust"])
                made = lambda name: make.replace("{}", name, 1)
                fill = lambda text: text.replace("{}", "\0", 1).replace("{}", names, 1).replace("\0", s.name)
                use = fill(function) if s.kind == "function" else made(s.name) if s.kind != "method" else made(s.parent) + fill(method) if s.parent is not None else ""
                asked = f"How would you use the `{s.name}` {s.kind} from `{s.path}`? Show a practical example.\n\n```{fence}\n{s.signature if s.signature is not None else s.source_text}\n```"
                yield "usage2", s.sym_pos, f"You are an expert {s.language} developer. Provide clear, practical code examples.", asked, f"Here's how you might use `{s.name}` from `{s.path}`:\n\n```{fence}\n{use}```", tokens, tier

    return of_file


def test_generator_from_outside(spark, tree, tmp_path):
    """A table function gives the rows of code_qa, alone in SQL and as part of a run."""
    from corpuslathe.functions import text as T

    ctx = pipeline.project_tables(spark, str(tree), "demo", str(tmp_path / "w"), "A demo")
    said = {r.name: r.said for r in ctx.symbols.select("name", T.purpose_of_name(F.col("name")).alias("said")).distinct().collect()}
    plugins.register(spark, "explained", explained("demo", said.__getitem__, T.FENCES, generators.CALLS))
    got, want = plugins.generated_by(ctx, "explained", "CodeQA", 0), generators.code_qa(ctx)
    assert rows(got.select(*generators.COLUMNS)) == rows(want.select(*generators.COLUMNS)) and want.count() > 8
    ctx.symbols.createOrReplaceTempView("syms")
    n = spark.sql(f"SELECT count(*) AS n FROM explained(TABLE(SELECT {plugins.COLUMNS} FROM syms) PARTITION BY path ORDER BY sym_pos)").first().n
    assert n == want.count()
    run = pipeline.run(ctx, str(tmp_path / "w"), Config(enabled_types=("Documentation",), added_generators=(("Own", "explained"),)))
    assert {r.sample_type for r in run.samples.select("sample_type").distinct().collect()} == {"Documentation", "Own"}
    assert run.samples.count() == run.samples.select("ord").distinct().count() == run.samples.select("sample_key").distinct().count()
