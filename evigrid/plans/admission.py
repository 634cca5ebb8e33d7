"""Sources, sinks and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrid import params as P
from evigrid.functions import text as T
from evigrid.plans import query
from evigrid.session import table
from evigrid.sources import fixtures as X
from evigrid.sources.fixtures import with_sql


@query(with_sql("docs", "SELECT document_id, project_id, title FROM docs WHERE NOT deleted ORDER BY document_id DESC"))
def list_documents(spark, sf_dir, project: str | None = None):
    """Live documents, newest first, of one project where it is given."""
    d = X.docs(spark, sf_dir)
    d = d if project is None else d.where(F.col("project_id") == project)
    return d.where("not deleted").select("document_id", "project_id", "title").orderBy(F.desc("document_id"))


@query(with_sql("figures", "SELECT figure_id, width, height, bytes FROM figures WHERE width >= 150 AND height >= 150 AND greatest(width, height) / greatest(1, least(width, height)) <= 8 AND bytes >= 5120"))
def junk_figure_filter(spark, sf_dir):
    long, short = F.greatest("width", "height"), F.greatest(F.lit(1), F.least("width", "height"))
    return X.figures(spark, sf_dir).where((F.col("width") >= P.FIGURE_MIN_PX) & (F.col("height") >= P.FIGURE_MIN_PX) & (long / short <= P.FIGURE_MAX_ASPECT) & (F.col("bytes") >= P.FIGURE_MIN_BYTES)).select("figure_id", "width", "height", "bytes")


def replace_by(existing, incoming, key):
    """Rows of the incoming keys give way to the incoming rows; a second run changes nothing."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


_IN = "SELECT document_id, 'new ' || content AS content FROM docs WHERE document_id % 10 = 3 UNION ALL SELECT -document_id - 1, content FROM docs WHERE document_id % 50 = 0"


@query(with_sql("docs", "SELECT document_id, content FROM docs WHERE document_id NOT IN (SELECT document_id FROM inc) UNION ALL SELECT * FROM inc", inc=_IN))
def replace_by_document(spark, sf_dir):
    d = X.docs(spark, sf_dir)
    inc = d.where("document_id % 10 = 3").select("document_id", F.concat(F.lit("new "), "content").alias("content")).unionByName(d.where("document_id % 50 = 0").select((-F.col("document_id") - 1).alias("document_id"), "content"))
    return replace_by(d.select("document_id", "content"), inc, "document_id")


@query(with_sql("docs points", "SELECT point_id, content_hash FROM points WHERE point_id % 5 <> 0 UNION ALL SELECT point_id, 'upserted' FROM points WHERE point_id % 5 = 0 UNION ALL SELECT 1000000000 + document_id, 'added' FROM docs WHERE document_id % 100 = 0"))
def upsert_points(spark, sf_dir):
    p = X.points(spark, sf_dir).select("point_id", "content_hash")
    new = p.where("point_id % 5 = 0").select("point_id", F.lit("upserted").alias("content_hash")).unionByName(X.docs(spark, sf_dir).where("document_id % 100 = 0").select((F.col("document_id") + 1_000_000_000).alias("point_id"), F.lit("added").alias("content_hash")))
    return replace_by(p, new, "point_id")


def _edges(spark, sf_dir):
    """chunk -> figure links: chunk key = document of the chunk, by part."""
    return X.figures(spark, sf_dir).select((F.col("figure_id") % 150).alias("chunk_document"), "figure_id", F.col("document_id").alias("figure_document"))


_GONE = "SELECT document_id FROM docs WHERE deleted"


@query(with_sql("docs figures points", "SELECT 'edges' AS kind, count(*) AS n FROM e WHERE a NOT IN (SELECT * FROM gone) AND b NOT IN (SELECT * FROM gone) UNION ALL SELECT 'figures', count(*) FROM figures WHERE document_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'chunks', count(*) FROM docs WHERE NOT deleted UNION ALL SELECT 'tables', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone) UNION ALL SELECT 'points', count(*) FROM points WHERE point_id NOT IN (SELECT * FROM gone)", gone=_GONE, e="SELECT figure_id % 150 AS a, figure_id, document_id AS b FROM figures"))
def cascade_delete_document(spark, sf_dir):
    """Points go first, then edges by chunk or by figure (two anti joins), then chunks, figures and tables."""
    d = X.docs(spark, sf_dir)
    gone = d.where("deleted").select("document_id")
    edges = _edges(spark, sf_dir).join(gone.withColumnRenamed("document_id", "chunk_document"), "chunk_document", "left_anti").join(gone.withColumnRenamed("document_id", "figure_document"), "figure_document", "left_anti")
    figs, chunks = X.figures(spark, sf_dir).join(gone, "document_id", "left_anti"), d.join(gone, "document_id", "left_anti")
    points = X.points(spark, sf_dir).join(gone.withColumnRenamed("document_id", "point_id"), "point_id", "left_anti")
    tables = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id")).distinct().join(gone, "document_id", "left_anti")
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(edges, "edges").unionByName(n(figs, "figures")).unionByName(n(chunks, "chunks")).unionByName(n(tables, "tables")).unionByName(n(points, "points"))


@query(with_sql("docs", "SELECT document_id, project_id FROM docs WHERE project_id NOT IN ('src1', 'src7')"))
def cascade_delete_project(spark, sf_dir):
    d = X.docs(spark, sf_dir)
    gone = spark.createDataFrame([("src1",), ("src7",)], "project_id string")
    return d.join(F.broadcast(gone), "project_id", "left_anti").select("document_id", "project_id")  # the stated projects, two rows


_LOG = "attempt int, usage struct<k:bigint>, failed_step string, step_timings_ms struct<parse:bigint,embed:bigint>, config_snapshot struct<model:string>"


@query(f"""SELECT document_id, CAST(coalesce(sum(k), 0) AS BIGINT) AS used, count(*) AS attempts, count(step) AS failed, arg_max(step, event_id) FILTER (step IS NOT NULL) AS last_failed_step,
    CAST(sum(event_id % 500) AS BIGINT) AS parse_ms, CAST(coalesce(sum(k * 10), 0) AS BIGINT) AS embed_ms, '{P.EMBEDDING_MODEL}' AS model
    FROM (SELECT user_id AS document_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'parse' WHEN 1 THEN 'chunk' ELSE 'embed' END END AS step FROM events) GROUP BY document_id""")
def ingestion_job_log(spark, sf_dir):
    """One JSON record an attempt (usage, failed step, timings, settings), read back and summed by document."""
    k, step = F.get_json_object("props", "$.k").cast("long"), F.element_at(F.array(F.lit("parse"), F.lit("chunk"), F.lit("embed")), (F.col("event_id") % 3 + 1).cast("int"))
    record = F.struct(
        F.lit(1).alias("attempt"), F.struct(k.alias("k")).alias("usage"), F.when(F.col("event_type") == "error", step).alias("failed_step"),
        F.struct((F.col("event_id") % 500).alias("parse"), (k * 10).alias("embed")).alias("step_timings_ms"), F.struct(F.lit(P.EMBEDDING_MODEL).alias("model")).alias("config_snapshot"),
    )
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), "event_id", F.to_json(record).alias("record"))
    r = log.select("document_id", "event_id", F.from_json("record", _LOG).alias("r")).select("document_id", "event_id", "r.*")
    failed = F.when(F.col("failed_step").isNotNull(), F.col("event_id"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return r.groupBy("document_id").agg(
        total("usage.k").alias("used"), F.count(F.lit(1)).alias("attempts"), F.count("failed_step").alias("failed"), F.max_by("failed_step", failed).alias("last_failed_step"),
        total("step_timings_ms.parse").alias("parse_ms"), total("step_timings_ms.embed").alias("embed_ms"), F.max("config_snapshot.model").alias("model"),
    )


@query(with_sql("docs points", "SELECT project_id, point_id AS document_id, count(*) AS n FROM points GROUP BY ALL"))
def count_by_document(spark, sf_dir):
    return X.points(spark, sf_dir).groupBy("project_id", F.col("point_id").alias("document_id")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("figures", "SELECT coalesce(f.document_id, t.document_id) AS document_id, coalesce(figures, 0) AS figures, coalesce(tables, 0) AS tables FROM (SELECT document_id, count(*) AS figures FROM figures WHERE has_image GROUP BY 1) f FULL JOIN (SELECT l_orderkey % 300 AS document_id, count(DISTINCT l_orderkey) AS tables FROM lineitem GROUP BY 1) t ON f.document_id = t.document_id"))
def corpus_media_counts(spark, sf_dir):
    f = X.figures(spark, sf_dir).where("has_image").groupBy("document_id").agg(F.count(F.lit(1)).alias("figures"))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().groupBy((F.col("l_orderkey") % 300).alias("document_id")).agg(F.count(F.lit(1)).alias("tables"))
    return f.join(t, "document_id", "full").select("document_id", F.coalesce("figures", F.lit(0)).alias("figures"), F.coalesce("tables", F.lit(0)).alias("tables"))


@query(with_sql("docs", "SELECT document_id, sha256(content) AS content_hash FROM docs"))
def content_hash(spark, sf_dir):
    return X.docs(spark, sf_dir).select("document_id", F.sha2("content", 256).alias("content_hash"))


@query(with_sql("docs", "SELECT document_id, row_number() OVER w = 1 AS accepted, CASE WHEN row_number() OVER w > 1 THEN first_value(document_id) OVER w END AS existing_document_id FROM docs WHERE NOT deleted WINDOW w AS (PARTITION BY project_id, sha256(content) ORDER BY document_id)"))
def dedup_upload(spark, sf_dir):
    """The first live document of a project and hash wins; a partial minimum comes before the exchange."""
    d = X.docs(spark, sf_dir).where("not deleted").select("document_id", "project_id", F.sha2("content", 256).alias("h"))
    first = d.groupBy("project_id", "h").agg(F.min("document_id").alias("f"))
    return d.join(first, ["project_id", "h"]).select("document_id", (F.col("document_id") == F.col("f")).alias("accepted"), F.when(F.col("document_id") != F.col("f"), F.col("f")).alias("existing_document_id"))


@query(with_sql("doc_upload", "SELECT document_id, CASE WHEN coalesce(content, '') = '' THEN 'empty' WHEN page_count > 80 THEN 'too_large' ELSE 'accept' END AS verdict FROM doc_upload"))
def upload_gate(spark, sf_dir):
    return X.doc_upload(spark, sf_dir).select("document_id", F.when(F.coalesce("content", F.lit("")) == "", "empty").when(F.col("page_count") > P.MAX_PAGES, "too_large").otherwise("accept").alias("verdict"))


@query(with_sql("doc_upload", "SELECT document_id, CASE WHEN page_count = 0 THEN 'PDF_CORRUPT' WHEN length(regexp_replace(regexp_replace(coalesce(content, ''), '^[ \\t\\r\\n]+', ''), '[ \\t\\r\\n]+$', '')) / page_count < 200 THEN 'PDF_NO_TEXT_LAYER' ELSE 'pass' END AS verdict FROM doc_upload"))
def text_yield_gate(spark, sf_dir):
    chars = F.length(T.trim(F.coalesce("content", F.lit(""))))
    return X.doc_upload(spark, sf_dir).select("document_id", F.when(F.col("page_count") == 0, "PDF_CORRUPT").when(chars / F.col("page_count") < P.MIN_CHARS_PER_PAGE, "PDF_NO_TEXT_LAYER").otherwise("pass").alias("verdict"))


_CODES = "CASE event_id % 6 WHEN 0 THEN 'PDF_CORRUPT' WHEN 1 THEN 'DOC_TOO_LARGE' WHEN 2 THEN 'EMBEDDING_FAILED' WHEN 3 THEN 'CANCELLED' WHEN 4 THEN 'STORAGE_FAILED' END"


@query(f"SELECT event_id, coalesce(code, 'INGEST_FAILED') AS error_code, CASE WHEN code IN ('PDF_CORRUPT', 'DOC_TOO_LARGE') THEN 'rejected' WHEN code = 'CANCELLED' THEN 'queued' ELSE 'failed' END AS status, coalesce(code NOT IN ('PDF_CORRUPT', 'DOC_TOO_LARGE'), true) AS retry FROM (SELECT event_id, {_CODES} AS code FROM events)")
def ingest_outcome(spark, sf_dir):
    """Error codes looked up in a table of as many rows as there are codes."""
    rows = [(c, "rejected", False) for c in P.REJECTING] + [(c, "failed", True) for c in P.FAILING] + [("CANCELLED", "queued", True)]
    known = F.broadcast(spark.createDataFrame(rows, "code string, status string, retry boolean"))
    return table(spark, sf_dir, "events").select("event_id", F.expr(_CODES).alias("code")).join(known, "code", "left").select("event_id", F.coalesce("code", F.lit("INGEST_FAILED")).alias("error_code"), F.coalesce("status", F.lit("failed")).alias("status"), F.coalesce("retry", F.lit(True)).alias("retry"))


@query(with_sql("blocks docs", "SELECT document_id, round(coalesce(sum(length(b.text)) FILTER (kind = 'text'), 0) / greatest(1, max(length(content))), 6) AS coverage, coalesce(sum(length(b.text)) FILTER (kind = 'text'), 0) / greatest(1, max(length(content))) >= 0.6 AS pass, bool_or(kind = 'heading' AND b.text <> '') AS has_heading FROM blocks b JOIN docs USING (document_id) GROUP BY document_id"))
def parse_coverage(spark, sf_dir):
    b = X.blocks(spark, sf_dir).groupBy("document_id").agg(F.coalesce(F.sum(F.when(F.col("kind") == "text", F.length("text"))), F.lit(0)).alias("n"), F.bool_or((F.col("kind") == "heading") & (F.col("text") != "")).alias("has_heading"))
    share = F.col("n") / F.greatest(F.lit(1), F.length("content"))
    return b.join(X.docs(spark, sf_dir).select("document_id", "content"), "document_id").select("document_id", F.round(share, 6).alias("coverage"), (share >= 0.6).alias("pass"), "has_heading")


@query(with_sql("docs", "SELECT document_id, normalized FROM (SELECT document_id, lower(trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'))) AS normalized FROM docs)"))
def normalize_text(spark, sf_dir):
    return X.docs(spark, sf_dir).select("document_id", T.normalize(F.col("content")).alias("normalized"))
