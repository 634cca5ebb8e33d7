"""Tables of the evidence model derived from the driver's tables.

Each function takes (spark, sf_dir).  ``SQL`` holds the same derivations for the
SQL side of the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evigrid import params as P
from evigrid.session import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("q", F.lit(True))
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        F.coalesce("text", F.lit("")).alias("content"), F.coalesce("q", F.lit(False)).alias("is_quarantined"), (F.col("doc_id") % 97 == 0).alias("deleted"),
    )


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", P.WHITE)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") % 3).alias("grp"), F.array_join(F.slice(words, 1, 12), " ").alias("question"), F.col("text").alias("anchor"))


def scope(questions: DataFrame) -> DataFrame:
    """qid and the one project it is bound to, null for all."""
    return questions.select("qid", F.when(F.col("qid") % 4 == 0, F.concat(F.lit("src"), (F.col("qid") % 20).cast("string"))).alias("scope"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as blocks: every seventh line a heading, an empty heading where doc_id % 13 = 0 and pos = 7."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    heading = F.col("pos") % 7 == 0
    return lines.select(
        "document_id", "pos", F.when(heading, "heading").otherwise("text").alias("kind"), F.when(heading, 1 + F.col("pos") % 3).alias("level"),
        F.when((F.col("document_id") % 13 == 0) & (F.col("pos") == 7), "").otherwise(F.col("line")).alias("text"), (1 + F.floor(F.col("pos") / 20)).cast("int").alias("page"),
    )


def doc_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.when(F.col("doc_id") % 101 == 0, 0).otherwise((1 + F.floor(F.col("n_chars") / 1800)) * F.when(F.col("doc_id") % 50 == 0, 10).otherwise(1))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"), F.col("text").alias("content"), "n_chars", pages.cast("long").alias("page_count"))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("figure_id"), (k % 200).alias("document_id"), F.when(k % 9 != 0, F.concat(F.lit("Figure "), F.col("p_size").cast("string"), F.lit(": "), F.col("p_name"))).alias("caption"),
        (F.col("p_size") * 12).cast("long").alias("width"), (100 + k % 300).cast("long").alias("height"), (F.col("p_retailprice") * 8).cast("double").alias("bytes"),
        (k % 4 != 0).alias("has_image"), F.element_at(F.array(F.lit("pending"), F.lit("done"), F.lit("failed")), (k % 3 + 1).cast("int")).alias("vlm_status"),
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("figure_id")
    return figures(spark, sf_dir).where("vlm_status = 'pending'").select(
        "figure_id", F.when(k % 11 == 0, "failed").otherwise("done").alias("status"), F.when(k % 11 != 0, F.concat(F.lit("summary "), k.cast("string"))).alias("summary"),
        (k % 500).alias("prompt_tokens"), (k % 90).alias("completion_tokens"), (k % 6 == 0).alias("from_cache"),
    )


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("long").alias("row"), F.lit(1).alias("row_span"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), 2).otherwise(1).alias("col_span"),
        ((F.col("l_linenumber") == 1) | ((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 5 == 0))).alias("is_header"),
    )


def table_text(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """A pipe table of the lines of each order; orders with key % 5 = 3 have short rows, with 4 no separator row.

    of: (table_id), distinct; only the lines of these tables are gathered.
    """
    k = F.col("l_orderkey")
    row = F.concat(F.lit("| part "), F.col("l_partkey").cast("string"), F.when(k % 5 != 3, F.concat(F.lit(" | "), F.col("l_linenumber").cast("string"))).otherwise(F.lit("")), F.lit(" |"))
    lines = table(spark, sf_dir, "lineitem")
    lines = lines if of is None else lines.join(of, k.cast("long") == of["table_id"], "left_semi")
    rows = lines.groupBy(k.cast("long").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), row.alias("r")))).alias("x"))
    head = F.concat(F.lit("| name | key |\n"), F.when(F.col("table_id") % 5 != 4, F.lit("| --- | ---: |\n")).otherwise(F.lit("")))
    return rows.select("table_id", F.when(F.col("table_id") % 2 == 0, "caption").alias("caption"), F.concat(head, F.array_join(F.transform("x", lambda e: e["r"]), "\n")).alias("markdown"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    known = F.element_at(F.array(F.lit("deepseek-chat"), F.lit("gpt-4o-mini"), F.lit("other-model")), (c % 3 + 1).cast("int"))
    tokens = F.when(c % 10 != 0, F.floor(F.length(F.coalesce("text", F.lit(""))) / 4))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", (c % 20).alias("project_id"), "turn", "role", F.when(F.col("role") == "assistant", F.concat(F.coalesce("text", F.lit("")), F.lit(" [C1]"))).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
        known.alias("model"), tokens.alias("prompt_tokens"), tokens.alias("completion_tokens"), (c % 23 == 0).alias("deleted"),
        F.when(c % 29 == 0, "error").otherwise("stop").alias("finish_reason"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client"), "ts", F.round(F.col("value") / 100, 6).alias("cost"))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    status = F.when(e == "signup", "queued").when(e == "view", "processing").when(e == "click", "text_ready").when(e == "purchase", "full_ready").when(e == "error", "failed").otherwise("rejected")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), seq.cast("long").alias("seq"), status.alias("status"), "ts")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index side of reconciliation: rows lost, changed, of another model, and of no document."""
    d, i = docs(spark, sf_dir), F.col("document_id")
    known = d.where(i % 31 != 0).select(i.alias("point_id"), "project_id", F.when(i % 37 == 0, F.lit("changed")).otherwise(F.sha2("content", 256)).alias("content_hash"), F.when(i % 41 == 0, "old-model").otherwise(P.EMBEDDING_MODEL).alias("embedding_model"))
    extra = spark.range(1, 6).select((-F.col("id")).alias("point_id"), F.concat(F.lit("src"), F.col("id").cast("string")).alias("project_id"), F.lit("x").alias("content_hash"), F.lit(P.EMBEDDING_MODEL).alias("embedding_model"))
    return known.unionByName(extra)


SQL = {
    "docs": "SELECT doc_id AS document_id, source AS project_id, 'doc-' || CAST(doc_id AS VARCHAR) AS title, coalesce(text, '') AS content, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_quarantined, doc_id % 97 = 0 AS deleted FROM documents",
    "golden": "SELECT item_id AS qid, item_id % 3 AS grp, array_to_string(list_slice(string_split_regex(text, '[ \\t\\r\\n]+'), 1, 12), ' ') AS question, text AS anchor FROM benchmark",
    "scope": "SELECT qid, CASE WHEN qid % 4 = 0 THEN 'src' || CAST(qid % 20 AS VARCHAR) END AS scope FROM golden",
    "blocks": """SELECT document_id, CAST(i - 1 AS BIGINT) AS pos, CASE WHEN (i - 1) % 7 = 0 THEN 'heading' ELSE 'text' END AS kind, CASE WHEN (i - 1) % 7 = 0 THEN 1 + (i - 1) % 3 END AS level,
        CASE WHEN document_id % 13 = 0 AND i - 1 = 7 THEN '' ELSE lines[i] END AS text, 1 + (i - 1) // 20 AS page
        FROM (SELECT document_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id AS document_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))""",
    "doc_upload": "SELECT doc_id AS document_id, source AS project_id, text AS content, n_chars, CASE WHEN doc_id % 101 = 0 THEN 0 ELSE (1 + n_chars // 1800) * CASE WHEN doc_id % 50 = 0 THEN 10 ELSE 1 END END AS page_count FROM documents",
    "figures": """SELECT p_partkey AS figure_id, p_partkey % 200 AS document_id, CASE WHEN p_partkey % 9 <> 0 THEN 'Figure ' || CAST(p_size AS VARCHAR) || ': ' || p_name END AS caption, p_size * 12 AS width, 100 + p_partkey % 300 AS height,
        CAST(p_retailprice * 8 AS DOUBLE) AS bytes, p_partkey % 4 <> 0 AS has_image, CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' ELSE 'failed' END AS vlm_status FROM part""",
    "captions": "SELECT figure_id, CASE WHEN figure_id % 11 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN figure_id % 11 <> 0 THEN 'summary ' || CAST(figure_id AS VARCHAR) END AS summary, figure_id % 500 AS prompt_tokens, figure_id % 90 AS completion_tokens, figure_id % 6 = 0 AS from_cache FROM figures WHERE vlm_status = 'pending'",
    "table_cells": "SELECT l_orderkey AS table_id, l_linenumber AS row, 1 AS row_span, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 2 ELSE 1 END AS col_span, l_linenumber = 1 OR (l_linenumber = 2 AND l_orderkey % 5 = 0) AS is_header FROM lineitem",
    "table_text": """SELECT CAST(l_orderkey AS BIGINT) AS table_id, CASE WHEN l_orderkey % 2 = 0 THEN 'caption' END AS caption,
        '| name | key |' || chr(10) || CASE WHEN l_orderkey % 5 <> 4 THEN '| --- | ---: |' || chr(10) ELSE '' END || string_agg('| part ' || CAST(l_partkey AS VARCHAR) || CASE WHEN l_orderkey % 5 <> 3 THEN ' | ' || CAST(l_linenumber AS VARCHAR) ELSE '' END || ' |', chr(10) ORDER BY l_linenumber, l_partkey) AS markdown FROM lineitem GROUP BY l_orderkey""",
    "messages": """SELECT conv_id, conv_id % 20 AS project_id, turn, role, CASE WHEN role = 'assistant' THEN coalesce(text, '') || ' [C1]' ELSE coalesce(text, '') END AS text,
        CASE conv_id % 3 WHEN 0 THEN 'deepseek-chat' WHEN 1 THEN 'gpt-4o-mini' ELSE 'other-model' END AS model, CASE WHEN conv_id % 10 <> 0 THEN length(coalesce(text, '')) // 4 END AS prompt_tokens,
        CASE WHEN conv_id % 10 <> 0 THEN length(coalesce(text, '')) // 4 END AS completion_tokens, conv_id % 23 = 0 AS deleted,
        CASE WHEN conv_id % 29 = 0 THEN 'error' ELSE 'stop' END AS finish_reason FROM conversations""",
    "requests": "SELECT event_id, user_id AS client, ts, round(value / 100, 6) AS cost FROM events",
    "status_log": "SELECT user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'text_ready' WHEN 'purchase' THEN 'full_ready' WHEN 'error' THEN 'failed' ELSE 'rejected' END AS status, ts FROM events",
    "points": f"""SELECT document_id AS point_id, project_id, CASE WHEN document_id % 37 = 0 THEN 'changed' ELSE sha256(content) END AS content_hash, CASE WHEN document_id % 41 = 0 THEN 'old-model' ELSE '{P.EMBEDDING_MODEL}' END AS embedding_model FROM docs WHERE document_id % 31 <> 0
        UNION ALL SELECT -i, 'src' || CAST(i AS VARCHAR), 'x', '{P.EMBEDDING_MODEL}' FROM range(1, 6) t(i)""",
}
_NEEDS = {"scope": ("golden",), "captions": ("figures",), "points": ("docs",)}


def with_sql(names: str, body: str, **more: str) -> str:
    """A statement over derived tables: ``names`` are those it reads, ``more`` its own steps in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, ()):
            add(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    steps = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH {', '.join(steps)} {body}" if steps else body
