"""Document structure and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrid.functions import text as T
from evigrid.operators import chunking as C, structure as S
from evigrid.plans import query
from evigrid.plans.chunk_sql import chunk_sql, stack_sql
from evigrid.session import table
from evigrid.sources import fixtures as X
from evigrid.sources.fixtures import with_sql

_BODY = "coalesce(html, '')"
for _t in S.DROPPED:
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_t}\\b.*?</{_t}\\s*>', '', 'g')"
_TEXT = f"regexp_replace(regexp_replace(piece, '{S.ENDING}', ''), '<[^>]*>', '', 'g')"
for _n, _s in S.ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_n}', '{_s.replace(chr(39), chr(39) * 2)}')"
_HTML = dict(
    b=f"SELECT page_id, {_BODY} AS body FROM pages",
    z=f"SELECT page_id, regexp_extract_all(body, '{S.OPENING}') AS tags, string_split_regex(body, '{S.OPENING}') AS pieces FROM b",
    e="SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, lower(regexp_extract(tags[i], '<([A-Za-z0-9]+)', 1)) AS tag, pieces[i + 1] AS piece FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM z)",
)


@query(with_sql("", f"SELECT page_id, pos, CASE WHEN tag LIKE 'h%' THEN 'heading' ELSE 'text' END AS kind, CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS level, trim(regexp_replace({_TEXT}, '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM e", **_HTML))
def extract_blocks(spark, sf_dir):
    return S.extract_blocks(table(spark, sf_dir, "pages"))


_STACK = dict(
    r="SELECT *, " + ", ".join(f"max(CASE WHEN level = {v} THEN pos END) OVER w AS p{v}" for v in (1, 2, 3)) + " FROM blocks WINDOW w AS (PARTITION BY document_id ORDER BY pos)",
    s="SELECT r.document_id, r.pos, r.kind, r.text, r.page, r.level, [" + ", ".join(f"CASE WHEN r.p{v} > greatest(-1{''.join(f', coalesce(r.p{u}, -1)' for u in range(1, v))}) THEN b{v}.text END" for v in (1, 2, 3)) + "] AS st FROM r " + " ".join(f"LEFT JOIN blocks b{v} ON b{v}.document_id = r.document_id AND b{v}.pos = r.p{v}" for v in (1, 2, 3)),
)


@query(with_sql("blocks", "SELECT document_id, pos, nullif(array_to_string(list_filter(st, lambda x: x IS NOT NULL AND x <> ''), ' > '), '') AS section_path FROM s", **_STACK))
def heading_stack(spark, sf_dir):
    return S.heading_stack(X.blocks(spark, sf_dir)).select("document_id", "pos", "section_path")


@query(with_sql("blocks", "SELECT document_id, pos, text FROM blocks WHERE kind = 'text' AND trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) <> ''"))
def body_filter(spark, sf_dir):
    return S.body_filter(X.blocks(spark, sf_dir)).select("document_id", "pos", "text")


@query(with_sql("docs", "SELECT document_id, greatest(1, length(content) // 4) AS tokens FROM docs"))
def count_tokens(spark, sf_dir):
    return X.docs(spark, sf_dir).select("document_id", T.count_tokens(F.col("content")).alias("tokens"))


_OUT = "chunk_index, sha256(content) AS content_hash, section_path, page_start, page_end, forced, tokens FROM chunks"
_PACKED = {"blocks": X.SQL["blocks"], **stack_sql("blocks", "document_id", 3)}
_ONE = {"docs": X.SQL["docs"], "one": "SELECT document_id, 0 AS pos, 'text' AS kind, CAST(NULL AS INTEGER) AS level, content AS text, 1 AS page FROM docs", **stack_sql("one", "document_id", 1)}
_PAGES = {**_HTML, "pb": f"SELECT page_id, pos, CASE WHEN tag LIKE 'h%' THEN 'heading' ELSE 'text' END AS kind, CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS level, trim(regexp_replace({_TEXT}, '[ \\t\\r\\n]+', ' ', 'g')) AS text, 1 AS page FROM e", **stack_sql("pb", "page_id", 6)}


@query(chunk_sql(_PACKED, f"SELECT doc AS document_id, {_OUT}"))
def pack_chunks(spark, sf_dir):
    """Packing, forced splits and merging of tiny chunks over the line blocks of all documents."""
    return C.chunk_documents(X.blocks(spark, sf_dir)).drop("content")


@query(chunk_sql(_ONE, f"SELECT doc AS document_id, {_OUT}"))
def force_split(spark, sf_dir):
    """Whole documents as one block each, so that long ones are split."""
    one = X.docs(spark, sf_dir).select("document_id", F.lit(0).alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("content").alias("text"), F.lit(1).alias("page"))
    return C.chunk_documents(one).drop("content")


@query(chunk_sql(_PAGES, f"SELECT doc AS page_id, {_OUT}"))
def merge_tiny(spark, sf_dir):
    """Chunks of HTML pages, where short paragraphs join the chunk before them."""
    return C.chunk_documents(S.extract_blocks(table(spark, sf_dir, "pages")).withColumn("page", F.lit(1)), "page_id").drop("content")


@query(with_sql("docs", "SELECT document_id, '[Paper]' || CASE WHEN project_id IS NOT NULL AND project_id <> '' THEN '[' || project_id || ']' ELSE '' END || chr(10) || content AS embed_text FROM docs"))
def embed_text(spark, sf_dir):
    return X.docs(spark, sf_dir).select("document_id", T.embed_text(F.col("content"), F.col("project_id")).alias("embed_text"))


_STATS = """, n AS (SELECT doc, count(*) AS chunks, round(avg(tokens), 6) AS mean_tokens FROM chunks GROUP BY doc),
    f AS (SELECT document_id, count(*) AS figures FROM figures GROUP BY document_id), t AS (SELECT table_id % 200 AS document_id, count(*) AS tables FROM table_text GROUP BY ALL)
    SELECT d.document_id, coalesce(chunks, 0) AS chunks, coalesce(figures, 0) AS figures, coalesce(tables, 0) AS tables, coalesce(mean_tokens, 0) AS mean_tokens,
        d.document_id IN (SELECT point_id FROM points) AS is_embedded FROM docs d LEFT JOIN n ON n.doc = d.document_id LEFT JOIN f USING (document_id) LEFT JOIN t USING (document_id)"""


@query(chunk_sql({"docs": X.SQL["docs"], "figures": X.SQL["figures"], "table_text": X.SQL["table_text"], "points": X.SQL["points"], **_PACKED}, _STATS))
def chunk_stats(spark, sf_dir):
    """Chunk, figure and table counts and mean tokens of each document; embedded where the index has the id."""
    c = C.chunk_documents(X.blocks(spark, sf_dir)).select("document_id", "tokens")
    f = X.figures(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("figures"))
    t = X.table_text(spark, sf_dir).groupBy((F.col("table_id") % 200).alias("document_id")).agg(F.count(F.lit(1)).alias("tables"))
    n = c.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("tokens"), 6).alias("mean_tokens"))
    indexed = X.points(spark, sf_dir).select(F.col("point_id").alias("document_id"), F.lit(True).alias("is_embedded"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    rows = X.docs(spark, sf_dir).select("document_id")
    for part in (n, f, t, indexed):
        rows = rows.join(part, "document_id", "left")
    return rows.select("document_id", zero("chunks"), zero("figures"), zero("tables"), F.coalesce("mean_tokens", F.lit(0.0)).alias("mean_tokens"), F.coalesce("is_embedded", F.lit(False)).alias("is_embedded"))
