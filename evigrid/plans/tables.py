"""Tables and figures of documents, captions and chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evigrid import params as P
from evigrid.operators import structure as S
from evigrid.plans import query
from evigrid.sources import fixtures as X
from evigrid.sources.fixtures import with_sql


@query(with_sql("table_cells", "SELECT table_id, CASE WHEN max(greatest(row_span, col_span)) > 1 OR count(DISTINCT row) FILTER (is_header) >= 2 THEN 'spanned' ELSE 'flat' END AS kind FROM table_cells GROUP BY table_id"))
def table_structure_kind(spark, sf_dir):
    spans = F.max(F.greatest("row_span", "col_span")) > 1
    heads = F.count_distinct(F.when(F.col("is_header"), F.col("row"))) >= 2
    return X.table_cells(spark, sf_dir).groupBy("table_id").agg(F.when(spans | heads, "spanned").otherwise("flat").alias("kind"))


@query(with_sql("table_text", "SELECT table_id, nullif(trim(concat_ws(chr(10), caption, markdown)), '') AS surface FROM table_text"))
def table_surface(spark, sf_dir):
    return X.table_text(spark, sf_dir).select("table_id", F.nullif(F.trim(F.concat_ws("\n", "caption", "markdown")), F.lit("")).alias("surface"))


@query(with_sql("figures", "SELECT figure_id, CASE WHEN caption IS NULL THEN 'Figure' ELSE regexp_extract(caption, '^Figure [0-9]+[a-z]?') END AS label FROM figures"))
def figure_label(spark, sf_dir):
    found = F.regexp_replace(F.regexp_extract(F.trim(F.coalesce("caption", F.lit(""))), r"(?i)^(fig(?:ure)?\.? ?\d+[a-z]?)", 1), r"(?i)^fig\.? ", "Figure ")
    return X.figures(spark, sf_dir).select("figure_id", F.when(found != "", found).otherwise("Figure").alias("label"))


def _split(x: str) -> str:
    return f"list_transform(string_split(regexp_replace(regexp_replace(trim({x}), '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c))"


_PIPE = dict(
    l="SELECT table_id, list_filter(list_transform(string_split(markdown, chr(10)), lambda x: trim(x)), lambda x: contains(x, '|')) AS ls FROM table_text",
    p=f"SELECT table_id, {_split('ls[1]')} AS headers, {_split('ls[2]')} AS sep, list_transform(ls[3:], lambda x: {_split('x')}) AS body FROM l WHERE len(ls) >= 2",
    t="SELECT table_id, headers, list_transform(sep, lambda c: CASE WHEN c LIKE ':%:' THEN 'center' WHEN c LIKE '%:' THEN 'right' WHEN c LIKE ':%' THEN 'left' END) AS align, list_transform(body, lambda r: list_transform(range(1, len(headers) + 1), lambda i: coalesce(r[i], ''))) AS rows FROM p WHERE len(list_filter(sep, lambda c: NOT regexp_full_match(c, ':?-+:?'))) = 0",
)


@query(with_sql("table_text", "SELECT table_id, array_to_string(headers, '~') AS headers, array_to_string(list_transform(align, lambda a: coalesce(a, '-')), '~') AS align, array_to_string(list_transform(rows, lambda r: array_to_string(r, '~')), '^') AS rows FROM t", **_PIPE))
def parse_pipe_tables(spark, sf_dir):
    t = S.parse_pipe_tables(X.table_text(spark, sf_dir))
    return t.select("table_id", F.array_join("headers", "~").alias("headers"), F.array_join(F.transform("align", lambda a: F.coalesce(a, F.lit("-"))), "~").alias("align"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), "^").alias("rows"))


@query(with_sql("table_text", "SELECT table_id, CAST(i - 1 AS INTEGER) AS col, coalesce(align[i], CASE WHEN len(list_filter(rows, lambda r: r[i] <> '')) > 0 AND len(list_filter(rows, lambda r: r[i] <> '' AND NOT regexp_matches(r[i], '^[-+]?[$]?[0-9][0-9,]*(\\.[0-9]+)?%?$'))) = 0 THEN 'right' ELSE 'left' END) AS align FROM (SELECT *, unnest(range(1, len(headers) + 1)) AS i FROM t)", **_PIPE))
def column_alignment(spark, sf_dir):
    return S.column_alignment(S.parse_pipe_tables(X.table_text(spark, sf_dir)))


@query(with_sql("docs figures table_text", """SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY branch, pos) - 1 AS chunk_index, chunk_type, content FROM (
    SELECT document_id, 0 AS branch, 0 AS pos, 'text' AS chunk_type, content FROM docs WHERE content <> ''
    UNION ALL SELECT table_id, 1, table_id, 'table_child', coalesce(caption || chr(10), '') || markdown FROM table_text
    UNION ALL SELECT document_id, 2, figure_id, 'figure', coalesce(caption, 'Figure') FROM figures)"""))
def build_chunk_rows(spark, sf_dir):
    """One index sequence a document over three branches: text, tables, figures."""
    text = X.docs(spark, sf_dir).where("content <> ''").select("document_id", F.lit(0).alias("branch"), F.lit(0).cast("long").alias("pos"), F.lit("text").alias("chunk_type"), "content")
    tabs = X.table_text(spark, sf_dir).select(F.col("table_id").alias("document_id"), F.lit(1).alias("branch"), F.col("table_id").alias("pos"), F.lit("table_child").alias("chunk_type"), F.concat_ws("\n", "caption", "markdown").alias("content"))
    figs = X.figures(spark, sf_dir).select("document_id", F.lit(2).alias("branch"), F.col("figure_id").alias("pos"), F.lit("figure").alias("chunk_type"), F.coalesce("caption", F.lit("Figure")).alias("content"))
    order = Window.partitionBy("document_id").orderBy("branch", "pos")
    return text.unionByName(tabs).unionByName(figs).select("document_id", (F.row_number().over(order) - 1).cast("long").alias("chunk_index"), "chunk_type", "content")


@query(with_sql("figures", "SELECT f.figure_id, c.h IS NOT NULL AS cached FROM figures f LEFT JOIN (SELECT DISTINCT sha256('image ' || CAST(width AS VARCHAR)) AS h FROM figures WHERE vlm_status = 'done') c ON sha256('image ' || CAST(f.width AS VARCHAR)) = c.h WHERE f.has_image AND f.vlm_status = 'pending'"))
def caption_candidates(spark, sf_dir):
    """Pending figures with an image; an image that was captioned before is a cache hit by its hash."""
    f = X.figures(spark, sf_dir).withColumn("h", F.sha2(F.concat(F.lit("image "), F.col("width").cast("string")), 256))
    done = f.where("vlm_status = 'done'").select("h").distinct().withColumn("c", F.lit(True))
    return f.where("has_image and vlm_status = 'pending'").join(done, "h", "left").select("figure_id", F.coalesce("c", F.lit(False)).alias("cached"))


@query(with_sql("captions", "SELECT count(*) AS total, count(*) FILTER (status = 'done') AS captioned, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (from_cache) AS cached, CAST(sum(prompt_tokens) FILTER (NOT from_cache) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) FILTER (NOT from_cache) AS BIGINT) AS completion_tokens, round(sum(prompt_tokens) FILTER (NOT from_cache) / 1e6::DOUBLE * 0.15::DOUBLE + sum(completion_tokens) FILTER (NOT from_cache) / 1e6::DOUBLE * 0.6::DOUBLE, 9) AS cost_usd FROM captions"))
def caption_tally(spark, sf_dir):
    paid = lambda c: F.sum(F.when(~F.col("from_cache"), F.col(c)))
    t = X.captions(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("captioned"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("from_cache").alias("cached"), paid("prompt_tokens").alias("prompt_tokens"), paid("completion_tokens").alias("completion_tokens"))
    a, b = P.CAPTION_USD_PER_MILLION
    return t.withColumn("cost_usd", F.round(F.col("prompt_tokens") / 1e6 * a + F.col("completion_tokens") / 1e6 * b, 9))


_RES = dict(
    old="SELECT document_id, figure_id, row_number() OVER (PARTITION BY document_id ORDER BY figure_id) - 1 AS chunk_index, coalesce(caption, 'Figure') AS base FROM figures WHERE figure_id % 5 <> 0",
    top="SELECT document_id, max(chunk_index) AS m FROM old GROUP BY document_id",
    s="SELECT f.figure_id, f.document_id, coalesce(f.caption, 'Figure') || chr(10) || chr(10) || c.summary AS content FROM figures f JOIN captions c USING (figure_id) WHERE c.status = 'done'",
    u="SELECT s.figure_id, s.document_id, o.chunk_index, false AS added, s.content FROM s JOIN old o USING (figure_id) UNION ALL SELECT s.figure_id, s.document_id, coalesce(m, -1) + row_number() OVER (PARTITION BY s.document_id ORDER BY s.figure_id), true, s.content FROM s LEFT JOIN top USING (document_id) WHERE s.figure_id NOT IN (SELECT figure_id FROM old)",
)


def _resurfaced(spark, sf_dir):
    """Figure chunks anew with their summaries; a figure without a chunk gets the next index of its document."""
    f = X.figures(spark, sf_dir)
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("figure_id"))
    old = f.where("figure_id % 5 <> 0").select("figure_id", "document_id", (index - 1).cast("long").alias("chunk_index"))
    top = old.groupBy("document_id").agg(F.max("chunk_index").alias("m"))
    s = X.captions(spark, sf_dir).where("status = 'done'").join(f, "figure_id").select("figure_id", "document_id", F.concat(F.coalesce("caption", F.lit("Figure")), F.lit("\n\n"), "summary").alias("content"))
    kept = s.join(old.select("figure_id", "chunk_index"), "figure_id").withColumn("added", F.lit(False))
    new = s.join(old, "figure_id", "left_anti").join(top, "document_id", "left").withColumn("chunk_index", F.coalesce("m", F.lit(-1)) + index).withColumn("added", F.lit(True)).drop("m")
    return kept.unionByName(new)


@query(with_sql("figures captions", "SELECT figure_id, document_id, chunk_index, added, sha256(content) AS content_hash FROM u", **_RES))
def resurface_figure_chunks(spark, sf_dir):
    return _resurfaced(spark, sf_dir).select("figure_id", "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "added", F.sha2("content", 256).alias("content_hash"))


@query(with_sql("docs figures captions", "SELECT d.document_id, CASE WHEN NOT d.deleted AND d.document_id % 3 <> 0 THEN 1 + coalesce(n, 0) ELSE 1 END AS chunk_count FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n FROM u WHERE added GROUP BY 1) USING (document_id)", **_RES))
def final_chunk_count(spark, sf_dir):
    n = _resurfaced(spark, sf_dir).where("added").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    ready = ~F.col("deleted") & (F.col("document_id") % 3 != 0)
    return X.docs(spark, sf_dir).join(n, "document_id", "left").select("document_id", F.when(ready, 1 + F.coalesce("n", F.lit(0))).otherwise(1).cast("long").alias("chunk_count"))


@query(with_sql("figures", "SELECT document_id, chunk_figure, figure_id, max(confidence) AS confidence FROM (SELECT a.document_id, a.figure_id AS chunk_figure, b.figure_id, 0.9::DOUBLE AS confidence FROM figures a JOIN figures b ON a.document_id = b.document_id AND regexp_extract(a.caption, 'Figure ([0-9]+)', 1) = regexp_extract(b.caption, 'Figure ([0-9]+)', 1) AND regexp_extract(a.caption, 'Figure ([0-9]+)', 1) <> '' UNION ALL SELECT document_id, figure_id, figure_id, 1.0 FROM figures) GROUP BY ALL"))
def chunk_figure_links(spark, sf_dir):
    return caption_links(X.figures(spark, sf_dir))


def caption_links(figures: DataFrame) -> DataFrame:
    """Links by the number that a caption names, and each figure to its own; the highest confidence stays.

    Pairs stream out of one join and are never gathered again: a pair that shares several numbers is made at the least of them.
    """
    no = F.regexp_extract("caption", r"Figure (\d+)", 1)
    f = figures.groupBy("document_id", "figure_id").agg(F.collect_set(F.when(no != "", no)).alias("nos"))
    named = f.select("document_id", F.explode("nos").alias("no"), "figure_id", "nos")
    met = named.withColumnRenamed("figure_id", "chunk_figure").withColumnRenamed("nos", "own").join(named, ["document_id", "no"])
    other = met.where((F.col("chunk_figure") != F.col("figure_id")) & (F.array_min(F.array_intersect("own", "nos")) == F.col("no")))
    pairs = other.select("document_id", "chunk_figure", "figure_id", F.lit(0.9).alias("confidence"))
    return pairs.unionByName(f.select("document_id", F.col("figure_id").alias("chunk_figure"), "figure_id", F.lit(1.0).alias("confidence")))
