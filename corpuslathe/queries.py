"""Registered queries of the engine over the given tables, and their SQL.

Documents stand for files (lang as language, source as project), conversations for
samples; benchmark items for names to look for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.tables import spread, written
from .functions.tokens import content_hash, sample_text
from .operators import dedup, quality, relations, statistics, symbols
from .plans.config import Quality
from .plans import generators
from .plans.generators import METADATA, TOOL, TURN
from .sinks.formats import formatted
from .sources import scan
from .streaming import progress

FLAGSHIP = "project_language_totals"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the columns of a file table."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("file_pos"), F.col("source").alias("project"), F.col("lang").alias("language"),
        F.octet_length(text).cast("long").alias("size_bytes"), T.line_count(text).alias("line_count"), text.alias("content"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the columns of a sample table, in the order of conv_id."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    none = F.lit(None)
    turns = F.transform("t", lambda t: F.struct(t["role"].alias("role"), F.coalesce(t["text"], F.lit("")).alias("content"), none.alias("tool_calls"), none.alias("tool_call_id"), none.alias("name")).cast(TURN))
    tokens = F.aggregate("t", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(T.quarter_bytes(t["text"]), F.lit(0).cast("long")))
    tier = F.when(F.size("t") <= 3, "Simple").when(F.size("t") <= 5, "Moderate").otherwise("Complex")
    meta = F.struct(none.alias("language"), none.alias("symbol_name"), none.alias("symbol_kind"), tokens.alias("estimated_tokens"), tier.alias("complexity_tier")).cast(METADATA)
    return rows.select(
        F.sha2(F.col("conv_id").cast("string"), 256).alias("sample_key"), F.col("conv_id").alias("ord"), F.lit("conversations").alias("source_project"), F.array().cast("array<string>").alias("source_files"),
        F.lit("MultiTurn").alias("sample_type"), turns.alias("conversation"), none.cast(f"array<{TOOL}>").alias("tools"), meta.alias("metadata"),
    )


LINES_SQL = "CASE WHEN {0} = '' THEN 0 ELSE length({0}) - length(replace({0}, chr(10), '')) + CASE WHEN ends_with({0}, chr(10)) THEN 0 ELSE 1 END END"
TEXT_LINES = LINES_SQL.format("text")
SPACE = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@query(
    f"""SELECT source AS project, lang AS language, count(*) AS file_count, sum({TEXT_LINES})::BIGINT AS total_lines, sum(strlen(text))::BIGINT AS total_bytes
    FROM documents WHERE lang IS NOT NULL GROUP BY ALL"""
)
def project_language_totals(spark, sf_dir):
    """Files, lines and bytes by project and language."""
    own = files(spark, sf_dir).where("language is not null").groupBy("project", "language")
    return own.agg(F.count("*").alias("file_count"), F.sum("line_count").alias("total_lines"), F.sum("size_bytes").alias("total_bytes"))


@query(
    f"""SELECT lang AS language, count(*) AS file_count, sum({TEXT_LINES})::BIGINT AS total_lines, sum(strlen(text))::BIGINT AS total_bytes, grouping(lang) = 1 AS is_total
    FROM documents GROUP BY ROLLUP (lang) HAVING grouping(lang) = 1 OR lang IS NOT NULL"""
)
def language_totals(spark, sf_dir):
    """R1 and R2 in one pass."""
    return statistics.language_totals(files(spark, sf_dir))


@query(
    f"""SELECT doc_id, {TEXT_LINES} AS n_lines, strlen(text) // 4 AS quarter,
    (strlen(text) * 10 // 35 + len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '')) * 13 // 10) // 2 AS estimated FROM documents"""
)
def text_measures(spark, sf_dir):
    """Lines and token estimates of each text."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(text).alias("n_lines"), T.quarter_bytes(text).alias("quarter"), T.estimated_tokens(text).alias("estimated"))


@query()
def content_hashes(spark, sf_dir):
    """XXH3 of the content, and the first document with it."""
    own = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    first = own.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return own.join(first, "content_hash")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc FROM documents")
def first_with_content(spark, sf_dir):
    """Each document and the first with the same content."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return own.join(own.groupBy("h").agg(F.min("doc_id").alias("first_doc")), "h").select("doc_id", "first_doc")


HEADER_SQL = "lower(array_to_string(string_split(text, chr(10))[1:20], chr(10)))"


@query(f"SELECT doc_id, regexp_matches({HEADER_SQL}, '{quality.GENERATED_HEADER}') AS generated FROM documents")
def generated_headers(spark, sf_dir):
    """whether the first 20 lines say that a file is generated."""
    return table(spark, sf_dir, "documents").select("doc_id", quality.is_generated(F.lit("x.txt"), F.col("text")).alias("generated"))


NAMES = ["a.pb.go", "autogen_b.rs", "c.gen.ts", "d.min.js", "yarn.lock", "package-lock.json", "e.rs", "pnpm-lock.yaml", "bun.lockb", "f.d.ts", "block.rs"]
NAME_SQL = "['" + "','".join(NAMES) + "'][doc_id % 11 + 1]"


@query(
    f"""WITH d AS (SELECT doc_id, lower(source || '/' || {NAME_SQL}) AS p, {HEADER_SQL} AS h FROM documents)
    SELECT doc_id, p AS path, contains(p, 'generated') OR contains(p, 'autogen') OR contains(p, '.gen.') OR list_any_value(list_filter(['.pb.go', '.pb.rs', '.d.ts', '.min.js', '.min.css', '.bundle.js'], lambda x: ends_with(p, x))) IS NOT NULL
      OR regexp_matches(h, '{quality.GENERATED_HEADER}') OR contains(p, 'lock.') OR ends_with(p, '.lock') OR p IN ('bun.lockb', 'package-lock.json', 'pnpm-lock.yaml') AS generated FROM d"""
)
def generated_paths(spark, sf_dir):
    """generated files and lock files by path and header."""
    path = F.lower(F.concat("source", F.lit("/"), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 11 + 1).cast("int"))))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), quality.is_generated(path, F.col("text")).alias("generated"))


@query(
    """WITH l AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS a FROM documents),
    c AS (SELECT doc_id, text, len(a) AS n, len(list_filter(a, lambda x: regexp_matches(x, '^\\s*(//|#|/\\*|\\*)'))) AS k FROM l)
    SELECT doc_id, text = '' OR (n <= 3 AND regexp_matches(lower(text), 'get|set|return self\\.')) OR (n > 5 AND k / n > 0.7) AS boilerplate FROM c"""
)
def boilerplate(spark, sf_dir):
    """F8: short accessors and texts that are mostly comments."""
    return table(spark, sf_dir, "documents").select("doc_id", quality.is_boilerplate(F.col("text")).alias("boilerplate"))


TURNS_SQL = "SELECT conv_id, list(struct_pack(role := role, content := coalesce(text, '')) ORDER BY turn, role, text) AS c FROM conversations GROUP BY conv_id"


@query(
    f"""WITH s AS ({TURNS_SQL}), j AS (SELECT conv_id,
      len(list_filter(c, lambda t: regexp_replace(t.content, '{SPACE}', '', 'g') = '')) > 0 AS blank,
      list_filter(list_transform(c, lambda t: CASE WHEN t.role = 'assistant' THEN CASE WHEN strlen(t.content) // nullif({LINES_SQL.format("t.content")}, 0) > 200 THEN 'long lines'
        WHEN NOT contains(t.content, '```') AND length(regexp_replace(t.content, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length(t.content), 1) < 0.4 THEN 'few letters' END END), lambda r: r IS NOT NULL)[1] AS r FROM s)
    SELECT conv_id, CASE WHEN blank THEN 'empty turn' ELSE r END AS reason FROM j"""
)
def sample_reasons(spark, sf_dir):
    """F10 to F14 without token counts: the first reason to reject a sample."""
    return samples(spark, sf_dir).select(F.col("ord").alias("conv_id"), quality.cheap_reason(F.col("conversation"), Quality()).alias("reason"))


@query()
def judged_samples(spark, sf_dir):
    """Tokens of each sample and the first reason to reject it."""
    return quality.with_reasons(samples(spark, sf_dir)).select(F.col("ord").alias("conv_id"), "tokens", "reject_reason")


@query()
def deduplicated_documents(spark, sf_dir):
    """Documents that the keep-first rule keeps."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    return dedup.deduplicated(docs, F.col("text")).select(F.col("ord").alias("doc_id"))


@query()
def minhash_links(spark, sf_dir):
    """Linked pairs of documents and their estimated similarity."""
    signed = written(dedup.signatures(table(spark, sf_dir, "documents"), "doc_id"))
    stored = signed.select(F.col("ord").alias("i"), "signature")
    return dedup.links(written(dedup.heads(signed)), stored=stored)


def _json(x: str) -> str:
    return f"to_json({x})::VARCHAR"


ROLE_SQL = "CASE t.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' WHEN 'system' THEN 'system' ELSE 'observation' END"
IPY_SQL = "CASE WHEN t.role IN ('system', 'user', 'assistant') THEN t.role ELSE 'ipython' END"


@query(f"""WITH s AS ({TURNS_SQL}) SELECT conv_id, '{{"messages":[' || array_to_string(list_transform(c, lambda t: '{{"content":' || {_json("t.content")} || ',"role":"' || t.role || '"}}'), ',') || ']}}' AS line FROM s""")
def format_openai(spark, sf_dir):
    """W1."""
    return formatted(samples(spark, sf_dir), "OpenAI", with_tools=False).select(F.col("ord").alias("conv_id"), "line")


@query(f"""WITH s AS ({TURNS_SQL}) SELECT conv_id, '{{"text":' || to_json(array_to_string(list_transform(c, lambda t: '<|im_start|>' || t.role || chr(10) || t.content || '<|im_end|>' || chr(10)), ''))::VARCHAR || '}}' AS line FROM s""")
def format_chatml(spark, sf_dir):
    """W2."""
    return formatted(samples(spark, sf_dir), "ChatML", with_tools=False).select(F.col("ord").alias("conv_id"), "line")


@query(f"""WITH s AS ({TURNS_SQL}) SELECT conv_id, '{{"text":' || to_json('<|begin_of_text|>' || array_to_string(list_transform(c, lambda t: '<|start_header_id|>' || {IPY_SQL} || '<|end_header_id|>' || chr(10) || chr(10) || t.content || '<|eot_id|>' || chr(10)), ''))::VARCHAR || '}}' AS line FROM s""")
def format_llama(spark, sf_dir):
    """W3."""
    return formatted(samples(spark, sf_dir), "Llama4", with_tools=False).select(F.col("ord").alias("conv_id"), "line")


@query(f"""WITH s AS ({TURNS_SQL}), f AS (SELECT *, list_filter(c, lambda t: t.role = 'system')[1].content AS sys, list_position(list_transform(c, lambda t: t.role), 'user') AS u FROM s)
    SELECT conv_id, '{{"text":' || to_json('<s>' || array_to_string(list_transform(c, lambda t, i: CASE t.role WHEN 'system' THEN '' WHEN 'user' THEN '[INST] ' || CASE WHEN i = u AND sys IS NOT NULL THEN sys || chr(10) || chr(10) ELSE '' END || t.content || ' [/INST]'
      WHEN 'assistant' THEN t.content || '</s>' ELSE '[TOOL_RESULTS] {{"id": "unknown", "content": ' || to_json(t.content)::VARCHAR || '}}[/TOOL_RESULTS]' END), ''))::VARCHAR || '}}' AS line FROM f""")
def format_mistral(spark, sf_dir):
    """W4."""
    return formatted(samples(spark, sf_dir), "Mistral", with_tools=False).select(F.col("ord").alias("conv_id"), "line")


@query(f"""WITH s AS ({TURNS_SQL}) SELECT conv_id, '{{"conversations":[' || array_to_string(list_transform(c, lambda t: '{{"from":"' || {ROLE_SQL} || '","value":' || to_json(t.content)::VARCHAR || '}}'), ',') || ']}}' AS line FROM s""")
def format_sharegpt(spark, sf_dir):
    """W5."""
    return formatted(samples(spark, sf_dir), "ShareGPT", with_tools=False).select(F.col("ord").alias("conv_id"), "line")


@query(f"""WITH s AS ({TURNS_SQL}), p AS (SELECT conv_id, coalesce(list_filter(c, lambda t: t.role = 'system')[-1].content, '') AS sys, coalesce(list_filter(c, lambda t: t.role = 'assistant')[-1].content, '') AS a,
      array_to_string(list_transform(list_filter(c, lambda t: t.role = 'user'), lambda t: t.content), chr(10) || chr(10)) AS u FROM s)
    SELECT conv_id, '{{"input":' || to_json(CASE WHEN sys = '' THEN '' ELSE u END)::VARCHAR || ',"instruction":' || to_json(CASE WHEN sys = '' THEN u ELSE sys END)::VARCHAR || ',"output":' || to_json(a)::VARCHAR || '}}' AS line FROM p""")
def format_alpaca(spark, sf_dir):
    """W6."""
    return formatted(samples(spark, sf_dir), "Alpaca", with_tools=False).select(F.col("ord").alias("conv_id"), "line")


@query(f"""WITH s AS ({TURNS_SQL}) SELECT conv_id, '{{"middle":' || to_json(coalesce(list_filter(c, lambda t: t.role = 'assistant')[1].content, ''))::VARCHAR || ',"prefix":' || to_json(coalesce(list_filter(c, lambda t: t.role = 'user')[1].content, ''))::VARCHAR || ',"suffix":""}}' AS line FROM s""")
def format_fill_in(spark, sf_dir):
    """W7 on samples without a marker: prefix, middle and an empty suffix."""
    own = samples(spark, sf_dir).withColumn("sample_type", F.lit("CodeCompletion"))
    return formatted(own, "OpenAI", with_tools=False).select(F.col("ord").alias("conv_id"), "line")


@query(
    """WITH s AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1), t AS (SELECT CASE WHEN k <= 3 THEN 'Simple' WHEN k <= 5 THEN 'Moderate' ELSE 'Complex' END AS tier FROM s)
    SELECT 'complexity' AS dimension, tier AS key, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'type', 'MultiTurn', count(*) FROM t HAVING count(*) > 0 UNION ALL SELECT 'language', 'Unknown', count(*) FROM t HAVING count(*) > 0"""
)
def sample_counts(spark, sf_dir):
    """Samples by type, language and complexity."""
    return statistics.counts(samples(spark, sf_dir))


@query(
    """WITH s AS (SELECT conv_id, sum(coalesce(strlen(text) // 4, 0))::BIGINT AS v FROM conversations GROUP BY 1), a AS (SELECT list(v ORDER BY v) AS l FROM s)
    SELECT len(l)::BIGINT AS n, list_sum(l)::BIGINT AS sum, l[1] AS min, l[-1] AS max, (list_sum(l) // len(l))::BIGINT AS mean, l[len(l) // 2 + 1] AS median,
    l[floor((len(l) - 1) * 0.9)::BIGINT + 1] AS p90, l[floor((len(l) - 1) * 0.99)::BIGINT + 1] AS p99 FROM a"""
)
def token_statistics(spark, sf_dir):
    """Order statistics of the samples' token estimates."""
    return statistics.order_statistics(samples(spark, sf_dir).select(F.col("metadata.estimated_tokens").alias("v")), "v")


@query(
    """WITH h AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text))
    SELECT item_id, n::INT AS n, doc_id FROM h WHERE n <= 3"""
)
def first_mentions(spark, sf_dir):
    """The first three documents that contain each benchmark text."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("name"))
    hits = relations.mentions(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))
    ranked = items.join(hits, "name").withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("path")))
    return ranked.where("n <= 3").select("item_id", "n", F.col("path").alias("doc_id"))


@query(
    """WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*)/[^/]*$', 1) AS dir FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY page_id) AS n FROM p)
    SELECT dir, array_to_string(list(page_id ORDER BY page_id), ',') AS siblings FROM r WHERE n <= 10 GROUP BY dir"""
)
def page_siblings(spark, sf_dir):
    """The first ten pages of each folder."""
    path = F.regexp_replace("url", "[?#].*$", "")
    # a file's name is its page's number, as paths repeat
    own = table(spark, sf_dir, "pages").select(F.concat(T.parent_dir(path), F.lit("/"), "page_id").alias("path"), F.col("page_id").alias("file_pos"))
    return relations.siblings(own).select("dir", F.array_join(F.transform("siblings", lambda x: F.regexp_extract(x, "([^/]*)$", 1)), ",").alias("siblings"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def not_yet_labelled(spark, sf_dir):
    """Documents without a label."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, source, quality FROM documents d JOIN labels USING (doc_id)")
def labelled_documents(spark, sf_dir):
    """Labels with their documents' sources."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT conv_id, text FROM conversations WHERE turn = 0 ORDER BY conv_id LIMIT 20 OFFSET 10")
def preview_page(spark, sf_dir):
    """A page of first turns."""
    return table(spark, sf_dir, "conversations").where("turn = 0").orderBy("conv_id").offset(10).limit(20).select("conv_id", "text")


@query("SELECT user_id, event_type, count(*) AS n, max(struct_pack(ts := ts, event_id := event_id, value := value)).ts AS ts, max(struct_pack(ts := ts, event_id := event_id, value := value)).event_id AS event_id, max(struct_pack(ts := ts, event_id := event_id, value := value)).value AS value FROM events GROUP BY ALL")
def latest_events(spark, sf_dir):
    """The last event of each kind and user."""
    return progress.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    """Events by hour and kind, the batch form of the stream."""
    return progress.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("total", F.round("total", 6))


@query("SELECT doc_id, lower(regexp_replace(source || ' ' || lang || '!', '[^\\p{L}\\p{N}-]', '_', 'g')) AS safe, replace(replace(replace(replace(text, '\"', '\\\"'), chr(10), ' '), chr(13), ''), ':', ' -') AS escaped FROM documents")
def names_and_yaml(spark, sf_dir):
    """K2, K5: file-safe names, and each text escaped for YAML."""
    name = F.concat("source", F.lit(" "), "lang", F.lit("!"))
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_name(name).alias("safe"), T.yaml_escaped(F.col("text")).alias("escaped"))


@query("SELECT doc_id, replace(replace(replace(replace(text, '\"', '\\\"'), chr(10), ' '), chr(13), ''), ':', ' -') AS escaped FROM documents")
def yaml_texts(spark, sf_dir):
    """K5: each whole text escaped for YAML."""
    return table(spark, sf_dir, "documents").select("doc_id", T.yaml_escaped(F.col("text")).alias("escaped"))


@query("SELECT source, count(*) AS n, CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K' WHEN count(*) < 1000000 THEN '100K<n<1M' ELSE '1M<n<10M' END AS bucket FROM documents GROUP BY 1")
def size_buckets(spark, sf_dir):
    """K6: size category of each source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("bucket", T.size_bucket(F.col("n")))


@query()
def descriptions(spark, sf_dir):
    """The first sentences of each text read as Markdown."""
    return scan.description(spread(table(spark, sf_dir, "documents")), "text").select("doc_id", "description")


@query(
    f"""WITH c AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '^((?:[^.!?]*[.!?]){{3}})', 1), ''), text) AS cut FROM documents),
    h AS (SELECT *, strlen(left(cut, length(cut) - 1)) >= 500 AS long, left(cut, list_filter(range(125, 501), lambda k: strlen(left(cut, k)) >= 500)[1]) AS head FROM c)
    SELECT doc_id, regexp_replace(CASE WHEN long THEN CASE WHEN contains(head, ' ') THEN regexp_extract(head, '(?s)^(.*) ', 1) ELSE head END || '...' ELSE cut END, '^{SPACE}+|{SPACE}+$', '', 'g') AS said FROM h"""
)
def first_sentences(spark, sf_dir):
    """The first three sentences of each text, cut at a blank after 500 bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated_sentences(F.col("text")).alias("said"))


def tool_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample with a tool call for each document."""
    id_ = F.concat(F.lit("call_"), "doc_id")
    arguments = F.to_json(F.struct(F.col("n_chars").alias("limit"), F.col("lang").alias("pattern"), (F.col("doc_id") % 2 == 0).alias("whole")))
    call = F.struct(id_.alias("id"), F.lit("search_code").alias("function_name"), arguments.alias("arguments"))
    said = [("system", F.concat(F.lit("Source "), "source"), None, None), ("user", F.concat(F.lit("Find "), "lang", F.lit("?")), None, None), ("assistant", F.lit("Searching."), F.array(call), None), ("tool", F.col("text"), None, id_), ("assistant", F.concat(F.lit("In "), "source"), None, None)]
    none = F.lit(None)
    turns = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content"), (none if k is None else k).alias("tool_calls"), (none if i is None else i).alias("tool_call_id"), none.alias("name")).cast(TURN) for r, c, k, i in said))
    tool = F.struct(F.lit("search_code").alias("name"), F.lit('Search "code".').alias("description"), F.lit('{"type":"object","properties":{},"required":[]}').alias("parameters"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("ToolCalling").alias("sample_type"), turns.alias("conversation"), F.array(tool).cast(f"array<{TOOL}>").alias("tools"))


_ARGS = """'{"limit":' || n_chars || ',"pattern":"' || lang || '","whole":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || '}'"""
_TOOL = """'{"description":"Search \\"code\\".","name":"search_code","parameters":{"properties":{},"required":[],"type":"object"}}'"""
_FUNCTION = f"""'{{"function":' || {_TOOL} || ',"type":"function"}}'"""
_CALL_ID = "'call_' || doc_id"
TOOL_LINES = {
    "OpenAI": f"""'{{"messages":[{{"content":"Source ' || source || '","role":"system"}},{{"content":"Find ' || lang || '?","role":"user"}},{{"content":"Searching.","role":"assistant","tool_calls":[{{"function":{{"arguments":' || {_json(_ARGS)}
      || ',"name":"search_code"}},"id":"' || {_CALL_ID} || '","type":"function"}}]}},{{"content":' || {_json("text")} || ',"role":"tool","tool_call_id":"' || {_CALL_ID} || '"}},{{"content":"In ' || source || '","role":"assistant"}}],"tools":[' || {_FUNCTION} || ']}}'""",
    "ChatML": f"""'{{"text":' || to_json('<|im_start|>system' || chr(10) || 'Source ' || source || chr(10) || chr(10) || '<tools>' || chr(10) || {_FUNCTION} || chr(10) || '</tools><|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Find ' || lang || '?<|im_end|>' || chr(10)
      || '<|im_start|>assistant' || chr(10) || 'Searching.' || chr(10) || '<tool_call>' || chr(10) || '{{' || chr(10) || '  "arguments": {{' || chr(10) || '    "limit": ' || n_chars || ',' || chr(10) || '    "pattern": "' || lang || '",' || chr(10) || '    "whole": ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END
      || chr(10) || '  }},' || chr(10) || '  "name": "search_code"' || chr(10) || '}}' || chr(10) || '</tool_call><|im_end|>' || chr(10) || '<|im_start|>tool' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || 'In ' || source || '<|im_end|>' || chr(10))::VARCHAR || '}}'""",
    "Llama4": f"""'{{"text":' || to_json('<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'Source ' || source || chr(10) || chr(10) || 'You have access to the following tools:' || chr(10) || chr(10) || {_TOOL} || chr(10) || '<|eot_id|>' || chr(10)
      || '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || 'Find ' || lang || '?<|eot_id|>' || chr(10) || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || 'Searching.' || chr(10) || '[search_code(limit=' || n_chars || ', pattern=' || chr(39) || lang || chr(39) || ', whole=' || CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END || ')]<|eot_id|>' || chr(10)
      || '<|start_header_id|>ipython<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>' || chr(10) || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || 'In ' || source || '<|eot_id|>' || chr(10))::VARCHAR || '}}'""",
    "Mistral": f"""'{{"text":' || to_json('<s>[INST] Source ' || source || chr(10) || chr(10) || 'Available tools:' || chr(10) || {_FUNCTION} || chr(10) || chr(10) || chr(10) || 'Find ' || lang || '? [/INST]Searching.' || chr(10) || '[TOOL_CALLS] [{{"arguments":' || {_ARGS} || ',"id":"' || {_CALL_ID}
      || '","name":"search_code"}}]</s>[TOOL_RESULTS] {{"id": "' || {_CALL_ID} || '", "content": ' || {_json("text")} || '}}[/TOOL_RESULTS]In ' || source || '</s>')::VARCHAR || '}}'""",
    "ShareGPT": f"""'{{"conversations":[{{"from":"system","value":"Source ' || source || '"}},{{"from":"human","value":"Find ' || lang || '?"}},{{"from":"gpt","value":' || to_json('Searching.' || chr(10) || chr(10) || '[Called search_code: ' || {_ARGS} || ']')::VARCHAR
      || '}},{{"from":"observation","value":' || {_json("text")} || '}},{{"from":"gpt","value":"In ' || source || '"}}]}}'""",
    "Alpaca": """'{"input":' || to_json('Find ' || lang || '?' || chr(10) || chr(10) || '[Tool result: ' || text || ']')::VARCHAR || ',"instruction":"Source ' || source || '","output":"In ' || source || '"}'""",
}


def _register_tools(style: str) -> None:
    def run(spark, sf_dir):
        return formatted(tool_samples(spark, sf_dir), style).select("doc_id", "line")

    run.__name__, run.__doc__ = f"format_{style.lower()}_tools", "W1 to W6 with tools, calls and results."
    query(f"SELECT doc_id, {TOOL_LINES[style]} AS line FROM documents")(run)


for _style in TOOL_LINES:
    _register_tools(_style)


_MARKED = "WITH p AS (SELECT doc_id, source AS a, text || chr(10) AS z, lang || chr(10) AS m FROM documents)"


@query(
    f"""{_MARKED} SELECT doc_id, 'OpenAI' AS style, '{{"completion":' || {_json("m")} || ',"prompt":' || to_json('<|fim_prefix|>' || a || '<|fim_suffix|>' || z || '<|fim_middle|>')::VARCHAR || '}}' AS line FROM p
    UNION ALL SELECT doc_id, 'ChatML', '{{"text":' || to_json('<fim_prefix>' || a || '<fim_suffix>' || z || '<fim_middle>' || m)::VARCHAR || '}}' FROM p
    UNION ALL SELECT doc_id, 'Llama4', '{{"text":' || to_json('<PRE> ' || a || ' <SUF>' || z || ' <MID> ' || m)::VARCHAR || '}}' FROM p
    UNION ALL SELECT doc_id, 'Mistral', '{{"middle":' || {_json("m")} || ',"prefix":' || {_json("a")} || ',"suffix":' || {_json("z")} || '}}' FROM p"""
)
def format_fill_in_marked(spark, sf_dir):
    """Texts in fences with a marker, in four formats."""
    none = F.lit(None)
    said = [("user", F.concat(F.lit("Fill:\n```py\n"), "source", F.lit("<FILL>"), "text", F.lit("\n```"))), ("assistant", F.concat(F.lit("```py\n"), "lang", F.lit("\n```")))]
    turns = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content"), none.alias("tool_calls"), none.alias("tool_call_id"), none.alias("name")).cast(TURN) for r, c in said))
    own = table(spark, sf_dir, "documents").select("doc_id", F.lit("CodeCompletion").alias("sample_type"), turns.alias("conversation"), none.cast(f"array<{TOOL}>").alias("tools"))
    parts = [formatted(own, style, with_tools=False).select("doc_id", F.lit(style).alias("style"), "line") for style in ("OpenAI", "ChatML", "Llama4", "Mistral")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def project(spark: SparkSession, sf_dir: str) -> generators.Tables:
    """Documents as files that define one symbol each: a word of a text is a line."""
    language = F.element_at(F.create_map(*(F.lit(x) for x in ("en", "Rust", "de", "Python", "fr", "TypeScript", "es", "Go"))), F.col("lang"))
    kind = F.element_at(F.array(*map(F.lit, ("function", "method", "class"))), (F.col("doc_id") % 3 + 1).cast("int"))
    given = lambda name, kind: F.struct(F.lit(name).alias("name"), F.lit(kind).cast("string").alias("type_annotation"), F.lit(False).alias("is_optional"))
    parameters = F.when(kind == "method", F.array(given("self", None), given("key", "int"))).when(kind == "function", F.array(given("item", None))).otherwise(F.array().cast("array<struct<name:string,type_annotation:string,is_optional:boolean>>"))
    code = F.replace("text", F.lit(" "), F.lit("\n"))
    when = lambda n, value: F.when(F.col("doc_id") % n == 0, value)
    fields = {
        "name": F.concat(F.lit("get_item_"), "doc_id"), "kind": kind, "start_line": F.lit(1), "end_line": T.line_count(code), "start_col": F.lit(0), "byte_start": F.lit(0), "byte_end": F.octet_length(code), "source_text": code,
        "doc_comment": when(2, F.concat(F.lit("About "), "source", F.lit("."))), "parameters": parameters, "return_type": when(5, F.lit("int")), "signature": F.lit(None).cast("string"), "body_text": F.when(F.instr(code, "\n") > 0, F.substr(code, F.instr(code, "\n") + 1)), "parent": F.when(kind == "method", "Box"),
    }
    text = table(spark, sf_dir, "documents").where("text is not null")
    base = text.select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("doc_id").alias("file_pos"), language.alias("language"), F.array(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("symbols"), code.alias("content"))
    analyses = base.select("path", "file_pos", "language", "symbols", F.array().cast("array<struct<source:string,is_wildcard:boolean>>").alias("imports"))
    return generators.Tables("demo", "A demo", base.select("path", "file_pos", "language", "content"), analyses)


def _said(samples: DataFrame) -> DataFrame:
    """Document, last question and answer, estimate and tier of samples."""
    c = F.col("conversation")
    doc = F.regexp_extract(F.col("source_files")[0], "([^/]*)$", 1).cast("long")
    return samples.select(doc.alias("doc_id"), c[1]["content"].alias("asked"), F.element_at(c, -1)["content"].alias("answered"), F.col("metadata.estimated_tokens").alias("tokens"), F.col("metadata.complexity_tier").alias("tier"))


SYMBOLS_SQL = f"""s AS (SELECT *, {LINES_SQL.format("code")} AS n, 'get_item_' || doc_id AS name, source || '/' || doc_id AS path, strlen(code) // 4 AS quarter, ['function', 'method', 'class'][doc_id % 3 + 1] AS kind,
      CASE lang WHEN 'en' THEN 'Rust' WHEN 'de' THEN 'Python' WHEN 'fr' THEN 'TypeScript' WHEN 'es' THEN 'Go' END AS language, CASE lang WHEN 'en' THEN 'rust' WHEN 'de' THEN 'python' WHEN 'fr' THEN 'typescript' WHEN 'es' THEN 'go' ELSE '' END AS fence,
      CASE WHEN doc_id % 2 = 0 THEN 'About ' || source || '.' END AS doc, CASE WHEN doc_id % 5 = 0 THEN 'int' END AS returns, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_params
    FROM (SELECT *, replace(text, ' ', chr(10)) AS code FROM documents WHERE text IS NOT NULL))"""
_CODE = "'```' || fence || chr(10) || code || chr(10) || '```'"


@query(
    f"""WITH {SYMBOLS_SQL} SELECT doc_id, 'Can you review this ' || kind || ' `' || name || '`?' || chr(10) || chr(10) || {_CODE} AS asked, quarter + 400 AS tokens, CASE WHEN n > 30 THEN 'Complex' ELSE 'Moderate' END AS tier,
    CASE WHEN doc IS NULL THEN CASE language
      WHEN 'Rust' THEN 'Here''s a documentation template:' || chr(10) || chr(10) || '```rust' || chr(10) || '/// TODO: Describe what `' || name || '` does.' || chr(10) || '///' || chr(10) || '/// # Arguments' || chr(10) || '///' || chr(10)
        || '/// * `' || CASE kind WHEN 'method' THEN 'key' ELSE 'item' END || '` - TODO: describe this parameter' || chr(10) || '///' || chr(10) || '/// # Returns' || chr(10) || '///' || chr(10) || '/// TODO: Describe the return value.' || chr(10) || '```'
      WHEN 'Python' THEN 'Here''s a docstring template:' || chr(10) || chr(10) || '```python' || chr(10) || 'def ' || name || '(...):' || chr(10) || '\"\"\"TODO: Describe what ' || name || ' does.' || chr(10) || chr(10) || 'Args:' || chr(10) || 'TODO: Document parameters' || chr(10) || chr(10) || 'Returns:' || chr(10) || 'TODO: Document return value' || chr(10) || '\"\"\"' || chr(10) || '```'
      ELSE 'Here''s a documentation template:' || chr(10) || chr(10) || '```' || chr(10) || '/**' || chr(10) || '* TODO: Describe what ' || name || ' does.' || chr(10) || '*' || chr(10) || '* @param ... - TODO: Document parameters' || chr(10) || '* @returns TODO: Document return value' || chr(10) || '*/' || chr(10) || '```' END
    WHEN n > 30 THEN 'Here''s how I''d approach refactoring `' || name || '`:' || chr(10) || chr(10) || '1. Identify the distinct responsibilities in the function' || chr(10) || '2. Extract each into a well-named helper function' || chr(10) || '3. The main function becomes an orchestrator that calls the helpers' || chr(10) || chr(10) || 'This makes each piece independently testable and easier to understand.'
    ELSE 'For `' || name || '`, consider these edge cases:' || chr(10) || chr(10) || '1. What happens with empty or null inputs?' || chr(10) || '2. Are there boundary conditions for numeric parameters?' || chr(10) || '3. Could concurrent access cause issues?' || chr(10) || chr(10) || 'Adding input validation and clear error handling for these cases would make the code more robust.' END AS answered
    FROM s WHERE n >= 10 AND kind <> 'class'"""
)
def generator_reviews(spark, sf_dir):
    """Reviews of two rounds; the second answer."""
    return _said(generators.multi_turn(project(spark, sf_dir)))


@query(
    f"""WITH {SYMBOLS_SQL}, q AS (SELECT *, CASE WHEN kind = 'class' THEN 'Explain the `' || name || '` class defined in `' || path || '`.' ELSE 'What does the `' || name || '` ' || kind || ' in `' || path || '` do?' END AS question FROM s WHERE n >= 4)
    SELECT doc_id, question || chr(10) || chr(10) || {_CODE} AS asked, quarter AS tokens, CASE WHEN n < 10 THEN 'Simple' WHEN n < 40 THEN 'Moderate' ELSE 'Complex' END AS tier,
      CASE WHEN kind = 'class' THEN '`' || name || '` is a class defined in `' || path || '`. ' || coalesce(doc, '')
        ELSE 'The `' || name || '` ' || kind || CASE kind WHEN 'method' THEN ' on `Box`' ELSE '' END || ' in `' || path || '` ' || coalesce(doc, 'retrieves item ' || doc_id || '.') END
      || CASE kind WHEN 'method' THEN chr(10) || chr(10) || 'It takes 2 parameter(s): `self`, `key` (int).' WHEN 'function' THEN chr(10) || chr(10) || 'It takes 1 parameter(s): `item`.' ELSE '' END || coalesce(' It returns `' || returns || '`.', '') AS answered FROM q"""
)
def generator_explanations(spark, sf_dir):
    """Explanations of symbols."""
    return _said(generators.explanations(project(spark, sf_dir)))


@query(
    f"""WITH {SYMBOLS_SQL}, u AS (SELECT *, CASE kind WHEN 'function' THEN 'item' WHEN 'method' THEN 'key' END AS names FROM s WHERE n > 15)
    SELECT doc_id, 'How would you use the `' || name || '` ' || kind || ' from `' || path || '`? Show a practical example.' || chr(10) || chr(10) || {_CODE} AS asked, quarter AS tokens, CASE WHEN n < 40 THEN 'Moderate' ELSE 'Complex' END AS tier,
      'Here''s how you might use `' || name || '` from `' || path || '`:' || chr(10) || chr(10) || '```' || fence || chr(10) || CASE kind
        WHEN 'function' THEN CASE language WHEN 'Python' THEN 'result = ' || name || '(item)' WHEN 'TypeScript' THEN 'const result = ' || name || '(item);' WHEN 'Go' THEN 'result := ' || name || '(item)' ELSE 'let result = ' || name || '(item);' END
        ELSE CASE language WHEN 'Python' THEN 'instance = ' || c || '()' WHEN 'TypeScript' THEN 'const instance = new ' || c || '();' WHEN 'Go' THEN 'instance := ' || c || '{{}}' ELSE 'let instance = ' || c || '::new();' END
          || CASE kind WHEN 'method' THEN chr(10) || 'instance.' || name || '(key)' || CASE WHEN language IN ('Python', 'Go') THEN '' ELSE ';' END ELSE '' END END || chr(10) || '```' AS answered
    FROM (SELECT *, CASE kind WHEN 'method' THEN 'Box' ELSE name END AS c FROM u)"""
)
def generator_usage(spark, sf_dir):
    """Usage examples in the syntax of the language."""
    return _said(generators.usages(project(spark, sf_dir)))


_DOC_SQL = """CASE language
      WHEN 'Rust' THEN '/// ' || said || chr(10) || CASE kind WHEN 'method' THEN '///' || chr(10) || '/// # Arguments' || chr(10) || '///' || chr(10) || '/// * `key` - int parameter' || chr(10) WHEN 'function' THEN '///' || chr(10) || '/// # Arguments' || chr(10) || '///' || chr(10) || '/// * `item` - unspecified type parameter' || chr(10) ELSE '' END
        || coalesce('///' || chr(10) || '/// # Returns' || chr(10) || '///' || chr(10) || '/// ' || returns || chr(10), '')
      WHEN 'Python' THEN '    \"\"\"' || said || chr(10) || chr(10) || CASE kind WHEN 'method' THEN '    Args:' || chr(10) || '        self (Any): Description.' || chr(10) || '        key (int): Description.' || chr(10) WHEN 'function' THEN '    Args:' || chr(10) || '        item (Any): Description.' || chr(10) ELSE '' END
        || coalesce(chr(10) || '    Returns:' || chr(10) || '        ' || returns || chr(10), '') || '    \"\"\"'
      WHEN 'TypeScript' THEN '/**' || chr(10) || ' * ' || said || chr(10) || CASE kind WHEN 'method' THEN ' * @param {*} self - Description' || chr(10) || ' * @param {int} key - Description' || chr(10) WHEN 'function' THEN ' * @param {*} item - Description' || chr(10) ELSE '' END || coalesce(' * @returns {' || returns || '}' || chr(10), '') || ' */'
      WHEN 'Go' THEN '// ' || name || ' ' || said ELSE '// ' || said END"""


@query(
    f"""WITH {SYMBOLS_SQL}, d AS (SELECT *, coalesce(doc, '`' || name || '` ' || CASE kind WHEN 'class' THEN 'represents a data structure' ELSE 'performs an operation' END) AS said FROM s WHERE n >= 3)
    SELECT doc_id, 'Write documentation for the following ' || kind || ' in `' || path || '`:' || chr(10) || chr(10) || {_CODE} AS asked, quarter AS tokens, CASE WHEN n > 30 THEN 'Complex' ELSE 'Moderate' END AS tier, {_DOC_SQL} AS answered FROM d WHERE doc IS NULL
    UNION ALL SELECT doc_id, 'Improve the documentation for this ' || kind || ' in `' || path || '`.' || chr(10) || chr(10) || 'Current documentation:' || chr(10) || doc || chr(10) || chr(10) || 'Code:' || chr(10) || {_CODE}, quarter, 'Moderate',
      'Here''s improved documentation for `' || name || '`:' || chr(10) || chr(10) || {_DOC_SQL} FROM d WHERE doc IS NOT NULL AND n > 10"""
)
def generator_documentation(spark, sf_dir):
    """Documentation written and improved."""
    return _said(generators.documentation(project(spark, sf_dir)))


@query(
    f"""WITH {SYMBOLS_SQL}, e AS (SELECT *, CASE kind WHEN 'method' THEN '- `self`: unspecified' || chr(10) || '- `key`: int' || chr(10) ELSE '- `item`: unspecified' || chr(10) END AS listed FROM s WHERE n >= 5 AND kind <> 'class')
    SELECT doc_id, 'Can you explain what the `' || name || '` ' || kind || ' does in this project?' AS asked, quarter + 200 AS tokens, CASE WHEN n > 30 THEN 'Complex' ELSE 'Moderate' END AS tier,
      'The `' || name || '` ' || kind || CASE WHEN doc IS NULL THEN ' is defined in `' || path || '`.' ELSE ' in `' || path || '` ' || doc || '.' END || chr(10) || chr(10) || '**Parameters:**' || chr(10) || listed || chr(10) || coalesce('**Returns:** `' || returns || '`' || chr(10), '') AS answered FROM e"""
)
def generator_reading(spark, sf_dir):
    """A file is read and a symbol explained."""
    return _said(generators.reading(project(spark, sf_dir)))


_RULES = {
    "unwrap": "language = 'Rust' AND contains(code, '.unwrap()')", "unsafe": "language = 'Rust' AND (contains(code, 'unsafe {') OR contains(code, 'unsafe{'))", "clone": "language = 'Rust' AND len(string_split(code, '.clone()')) > 3",
    "any": "language = 'TypeScript' AND contains(code, ': any')", "loose": "language = 'TypeScript' AND contains(code, '== ') AND NOT contains(code, '=== ')", "console": "language = 'TypeScript' AND contains(code, 'console.log')",
    "broad": "language = 'Python' AND (contains(code, 'except:') OR contains(code, 'except Exception:'))", "eval": "language = 'Python' AND (contains(code, 'eval(') OR contains(code, 'exec('))", "ignored": "language = 'Go' AND (contains(code, '_ = err') OR contains(code, '_ =err'))",
    "todo": "regexp_matches(code, 'TODO|FIXME|HACK')", "handling": "n_params > 0 AND NOT regexp_matches(code, 'Error|error|Result|try|catch|except') AND n > 15",
}


@query(
    f"""WITH {SYMBOLS_SQL}, i AS (SELECT *, list_filter([{", ".join("CASE WHEN " + r + " THEN '" + generators.ISSUES[k].replace("'", "''") + "' END" for k, r in _RULES.items())}], lambda x: x IS NOT NULL) AS issues FROM s WHERE n >= 8 AND kind <> 'class')
    SELECT doc_id, 'Review this ' || kind || ' for potential issues:' || chr(10) || chr(10) || {_CODE} AS asked, quarter + 200 AS tokens, 'Moderate' AS tier,
      'I found ' || len(issues) || ' potential issue(s) in `' || name || '`:' || chr(10) || chr(10) || array_to_string(list_transform(issues, lambda x, k: k || '. ' || x || chr(10) || chr(10)), '') AS answered FROM i WHERE len(issues) > 0"""
)
def generator_issues(spark, sf_dir):
    """What simple rules find."""
    return _said(generators.bug_detection(project(spark, sf_dir)))


_BODY_LINES_SQL = LINES_SQL.format("body")


@query(
    f"""WITH {SYMBOLS_SQL}, b AS (SELECT *, substr(code, strpos(code, chr(10)) + 1) AS body, left(code, strpos(code, chr(10))) AS prefix FROM s WHERE kind <> 'class' AND strpos(code, chr(10)) > 0),
    n AS (SELECT *, {_BODY_LINES_SQL} AS k FROM b)
    SELECT doc_id, 'Complete the function body for the following code. The `<FILL>` marker shows where the code should be inserted.' || chr(10) || chr(10) || '```' || fence || chr(10) || prefix || '<FILL>' || chr(10) || '```' AS asked,
      '```' || fence || chr(10) || body || chr(10) || '```' AS answered, (strlen(prefix) + strlen(body)) // 4 AS tokens, CASE WHEN k > 20 THEN 'Complex' WHEN k > 8 THEN 'Moderate' ELSE 'Simple' END AS tier FROM n WHERE k >= 3"""
)
def generator_completion(spark, sf_dir):
    """Bodies to fill in; a text's first word is what stands before its body."""
    return _said(generators.code_completion(project(spark, sf_dir)))


@query(
    """WITH d AS (SELECT source AS dir, doc_id, source || '/' || doc_id AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL),
    s AS (SELECT dir, min(doc_id) AS doc_id, count(*) AS k, array_to_string(list('- `' || path || '`' ORDER BY doc_id), chr(10)) AS listed FROM d WHERE n <= 10 GROUP BY dir HAVING count(*) >= 2)
    SELECT doc_id, 'What files are in the `' || dir || '` directory?' AS asked, 'The `' || dir || '` directory contains ' || k || ' file(s):' || chr(10) || chr(10) || listed AS answered, 250 AS tokens, 'Simple' AS tier FROM s"""
)
def generator_exploring(spark, sf_dir):
    """What each directory holds."""
    return _said(generators.exploring(project(spark, sf_dir)))


@query(
    f"""WITH {SYMBOLS_SQL}, t AS (SELECT count(*) AS n FROM s), k AS (SELECT string_agg('- `' || path || '` (' || language || ') — defines: ' || name || chr(10), '' ORDER BY doc_id) AS files FROM (SELECT * FROM s ORDER BY doc_id LIMIT 8))
    SELECT 'Give me an overview of the demo project.' AS asked, '**demo** — A demo' || chr(10) || chr(10) || 'The project contains ' || n || ' source file(s) with ' || n || ' symbol(s).' || chr(10) || chr(10) || '**Key files:**' || chr(10) || files AS answered, 300 AS tokens, 'Moderate' AS tier, n AS n_files FROM t, k WHERE n >= 3"""
)
def generator_overview(spark, sf_dir):
    """The overview of the project, and of how many files it tells."""
    own = generators.overview(project(spark, sf_dir))
    return own.select(
        F.col("conversation")[1]["content"].alias("asked"), F.element_at("conversation", -1)["content"].alias("answered"), F.col("metadata.estimated_tokens").alias("tokens"), F.col("metadata.complexity_tier").alias("tier"), F.size("source_files").alias("n_files")
    )


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_slice(string_split(coalesce(text, ''), ' '), 1, doc_id % 6) AS w FROM documents),
    c AS (SELECT *, array_to_string(w, chr(10)) AS code FROM d),
    j AS (SELECT doc_id, text, {LINES_SQL.format("code")} AS k, regexp_replace(text, '{SPACE}', '', 'g') = '' AS blank,
      CASE WHEN strlen(text) // nullif({TEXT_LINES}, 0) > 200 THEN 'long lines' WHEN NOT contains(text, '```') AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length(text), 1) < 0.4 THEN 'few letters' END AS r FROM c)
    SELECT doc_id, CASE WHEN blank THEN 'empty turn' ELSE coalesce(r, CASE WHEN k BETWEEN 1 AND 2 THEN 'short code' END) END AS reason FROM j"""
)
def fenced_samples(spark, sf_dir):
    """Questions with so many words of a text as code, a word a line, answered
    by the text; the first reason to reject each."""
    text = F.coalesce("text", F.lit(""))
    k = (F.col("doc_id") % 6).cast("int")
    code = F.array_join(F.slice(F.split(text, " "), F.lit(1), k), "\n")
    turns = F.array(generators.turn("user", F.concat(F.lit("See:\n```\n"), code, F.lit("\n```\n"))), generators.turn("assistant", text))
    return table(spark, sf_dir, "documents").select("doc_id", quality.cheap_reason(turns, Quality()).alias("reason"))



_PASSED = "list_filter(c, lambda t: t.role = 'assistant' AND (strlen(t.content) // nullif({0}, 0) > 200 OR NOT contains(t.content, '```') AND length(regexp_replace(t.content, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length(t.content), 1) < 0.4))".replace("{0}", LINES_SQL.format("t.content")).replace("{{", "{").replace("}}", "}")


@query(
    f"""WITH s AS ({TURNS_SQL}), j AS (SELECT conv_id, array_to_string(list_transform(c, lambda t: t.content), chr(10)) AS said, len({_PASSED}) = 0 AND len(list_filter(c, lambda t: regexp_replace(t.content, '{SPACE}', '', 'g') = '')) = 0 AS fine FROM s)
    SELECT count(*) AS total_input, count(*) FILTER (NOT fine) AS filtered, count(*) FILTER (fine) AS pre_dedup_count, count(DISTINCT said) FILTER (fine) AS passed, count(*) FILTER (fine) - count(DISTINCT said) FILTER (fine) AS duplicates_removed FROM j"""
)
def quality_counts(spark, sf_dir):
    """Counters of a run without token bounds that drops equal samples."""
    judged = samples(spark, sf_dir).withColumn("reject_reason", quality.cheap_reason(F.col("conversation"), Quality()))
    kept = judged.where("reject_reason is null").select(sample_text(F.col("conversation")).alias("said")).distinct()
    return statistics.quality_counters(judged, kept)


_PAIRS = """hit AS (SELECT DISTINCT b.item_id AS x, d.doc_id AS y FROM benchmark b JOIN documents o ON o.doc_id = b.item_id JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '' AND d.doc_id <> b.item_id)"""


def _passages(spark: SparkSession, sf_dir: str):
    """Benchmark texts as the symbols of the document with their number, and who holds them."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    files = docs.select(F.col("doc_id").alias("path"), F.col("doc_id").alias("file_pos"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path"), F.col("text").alias("name"), F.lit(0).alias("sym_pos")).join(files.select("path"), "path", "left_semi")
    return files, items, relations.mentions(items.select("name"), docs.select(F.col("doc_id").alias("path"), "text"))


@query(f"WITH {_PAIRS} SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM hit")
def related_documents(spark, sf_dir):
    """Pairs of documents of which one holds the passage of the other."""
    files, items, hits = _passages(spark, sf_dir)
    imports = spark.createDataFrame([], "path long, source string")
    return relations.related_pairs(files, items, imports, hits).select("a", "b")


@query(f"WITH {_PAIRS} SELECT x, y, 1 AS n FROM hit")
def passages_mentioned(spark, sf_dir):
    """Which passages of a document another one holds."""
    _, items, hits = _passages(spark, sf_dir)
    return relations.names_mentioned(items, table(spark, sf_dir, "documents"), hits).select("x", "y", F.size("names").alias("n"))


@query("SELECT CASE lang WHEN 'en' THEN 'Rust' WHEN 'de' THEN 'Python' WHEN 'fr' THEN 'TypeScript' WHEN 'es' THEN 'Go' END AS language, count(*) AS n_files, sum(1)::BIGINT AS n_symbols, count(DISTINCT source || '/' || doc_id) AS n_names FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def symbol_totals(spark, sf_dir):
    """Files and symbols by language."""
    ctx = project(spark, sf_dir)
    own = symbols.symbol_table(ctx.analyses).join(ctx.files.select("path", "language"), "path")
    return own.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("n_symbols").alias("n_symbols"), F.countDistinct("path").alias("n_names"))
