"""Links of chunks and figures by mention, caption and page; the vector cache; approximate neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid import params as P
from evigrid.functions import text as T
from evigrid.operators.neighbours import ProjectionIndex, recall
from evigrid.operators.vector_cache import VectorCache, hashed_terms
from evigrid.operators.vectors import exact_topk
from evigrid.plans import query
from evigrid.plans.chunk_index import PLACES, chunk_points
from evigrid.plans.chunk_sql import chunk_sql, stack_sql
from evigrid.session import shared_dir, stored, table
from evigrid.sources import fixtures as X
from evigrid.sources.fixtures import with_sql

#: Pages of a bin of the range join: a chunk has one row for each bin that its pages touch.
PAGE_BIN = 8
CONFIDENCE = {"explicit_ref": 0.9, "caption": 1.0, "same_page": 0.4}


def link_groups(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """(link_type, document_id, place, kind, member, confidence): chunks and figures that share a group are linked.

    Groups are a figure number named in a document (by chunk texts and captions), a page of it, or a figure
    with the chunks of its own caption.  A group lists its members once, so a number that is named often is not
    squared; only groups with both kinds of members are kept.

    chunks: document_id, point_id, content, page_start, page_end; figures: document_id, figure_id, caption, page.
    """
    number = r"(?i)\bfig(?:ure|\.)?\s*(\d+)"
    named = chunks.select("document_id", F.col("point_id").alias("member"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(number), F.lit(1)))).alias("no"))
    mention = named.select(F.lit("explicit_ref").alias("link_type"), "document_id", F.col("no").cast("long").alias("place"), F.lit("chunk").alias("kind"), "member")
    shown = figures.where(F.regexp_extract("caption", number, 1) != "").select(F.lit("explicit_ref").alias("link_type"), "document_id", F.regexp_extract("caption", number, 1).cast("long").alias("place"), F.lit("figure").alias("kind"), F.col("figure_id").alias("member"))
    # pages with figures, met by the chunks that span them: bins bring both together, then the range is tested
    pages = figures.select("document_id", F.col("page").cast("long").alias("page")).distinct().withColumn("bin", F.floor(F.col("page") / PAGE_BIN))
    spans = chunks.select("document_id", F.col("point_id").alias("member"), "page_start", "page_end", F.explode(F.sequence(F.floor(F.col("page_start") / PAGE_BIN), F.floor(F.col("page_end") / PAGE_BIN))).alias("bin"))
    on_page = spans.join(pages, ["document_id", "bin"]).where("page between page_start and page_end").select(F.lit("same_page").alias("link_type"), "document_id", F.col("page").alias("place"), F.lit("chunk").alias("kind"), "member")
    of_page = figures.select(F.lit("same_page").alias("link_type"), "document_id", F.col("page").cast("long").alias("place"), F.lit("figure").alias("kind"), F.col("figure_id").alias("member"))
    held = figures.where("caption is not null").select("document_id", F.col("figure_id").cast("long").alias("place"), "figure_id", T.normalize(F.col("caption")).alias("c"))
    # a caption is a chunk's text where it stands on a line of its own
    lines = chunks.select("document_id", F.col("point_id").alias("member"), F.explode(F.split("content", "\n")).alias("line")).select("document_id", "member", T.normalize(F.col("line")).alias("c")).distinct()
    stands = lines.join(held, ["document_id", "c"])
    own = stands.select(F.lit("caption").alias("link_type"), "document_id", "place", F.lit("chunk").alias("kind"), "member")
    whose = stands.select(F.lit("caption").alias("link_type"), "document_id", "place", F.lit("figure").alias("kind"), F.col("figure_id").cast("long").alias("member")).distinct()
    rows = mention.unionByName(shown).unionByName(on_page).unionByName(of_page).unionByName(own).unionByName(whose)
    both = rows.groupBy("link_type", "document_id", "place").agg(F.count_if(F.col("kind") == "chunk").alias("x"), F.count_if(F.col("kind") == "figure").alias("y")).where("x > 0 and y > 0").drop("x", "y")
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return rows.join(both, ["link_type", "document_id", "place"], "left_semi").withColumn("confidence", sure[F.col("link_type")])


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.figures(spark, sf_dir).select("document_id", "figure_id", "caption", (1 + F.col("figure_id") % 3).alias("page"))


_NO = "(?i)\\bfig(?:ure|\\.)?\\s*(\\d+)"
_NORM = "lower(trim(regexp_replace({0}, '[ \\t\\r\\n]+', ' ', 'g')))"
_LINKS = f""", cp AS (SELECT doc AS document_id, doc * {PLACES} + chunk_index AS point_id, page_start, page_end, content || CASE WHEN chunk_index % 2 = 0 THEN chr(10) || 'see Fig. ' || CAST(doc % 50 + 1 AS VARCHAR) ELSE chr(10) || 'Figure ' || CAST(doc % 50 + 1 AS VARCHAR) || ': ' || (SELECT min(p_name) FROM part WHERE p_partkey % 200 = doc) END AS content FROM chunks WHERE doc < 200),
    fg AS (SELECT document_id, figure_id, caption, 1 + figure_id % 3 AS page FROM figures),
    stands AS (SELECT DISTINCT c.document_id, c.point_id, f.figure_id FROM (SELECT document_id, point_id, {_NORM.format('line')} AS line FROM (SELECT document_id, point_id, unnest(string_split(content, chr(10))) AS line FROM cp)) c JOIN fg f ON f.document_id = c.document_id AND {_NORM.format('f.caption')} = c.line),
    rows_ AS (SELECT DISTINCT 'explicit_ref' AS link_type, document_id, CAST(no AS BIGINT) AS place, 'chunk' AS kind, point_id AS member FROM (SELECT document_id, point_id, unnest(regexp_extract_all(content, '{_NO}', 1)) AS no FROM cp)
        UNION ALL SELECT 'explicit_ref', document_id, CAST(regexp_extract(caption, '{_NO}', 1) AS BIGINT), 'figure', figure_id FROM fg WHERE regexp_extract(caption, '{_NO}', 1) <> ''
        UNION ALL SELECT DISTINCT 'same_page', c.document_id, page, 'chunk', point_id FROM cp c JOIN fg f ON f.document_id = c.document_id AND f.page BETWEEN page_start AND page_end
        UNION ALL SELECT 'same_page', document_id, page, 'figure', figure_id FROM fg
        UNION ALL SELECT 'caption', document_id, figure_id, 'chunk', point_id FROM stands UNION ALL SELECT DISTINCT 'caption', document_id, figure_id, 'figure', figure_id FROM stands)
    SELECT r.*, CASE link_type WHEN 'caption' THEN 1.0::DOUBLE WHEN 'explicit_ref' THEN 0.9 ELSE 0.4 END AS confidence FROM rows_ r SEMI JOIN (SELECT link_type, document_id, place FROM rows_ GROUP BY ALL HAVING count(DISTINCT kind) = 2) b USING (link_type, document_id, place)"""


@query(chunk_sql({"docs": X.SQL["docs"], "figures": X.SQL["figures"], "blocks": X.SQL["blocks"], **stack_sql("blocks", "document_id", 3)}, _LINKS))
def figure_links(spark, sf_dir):
    """Link groups of the documents that have figures, their chunks with a mention or a caption line added."""
    name = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 200).alias("document_id")).agg(F.min("p_name").alias("name"))
    no = (F.col("document_id") % 50 + 1).cast("string")
    line = F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("\nsee Fig. "), no)).otherwise(F.concat(F.lit("\nFigure "), no, F.lit(": "), "name"))
    chunks = chunk_points(spark, sf_dir, X.blocks(spark, sf_dir).where("document_id < 200")).join(name, "document_id", "left").withColumn("content", F.concat("content", line))
    return link_groups(chunks.where("content is not null"), _figures(spark, sf_dir))


@query(with_sql("docs", """SELECT 1 AS run, count(*) AS texts, count(DISTINCT content) AS keys, count(DISTINCT content) AS embedded FROM docs WHERE document_id % 3 = 0
    UNION ALL SELECT 2, count(*), count(DISTINCT content), count(DISTINCT content) FILTER (content NOT IN (SELECT content FROM docs WHERE document_id % 3 = 0)) FROM docs
    UNION ALL SELECT 3, count(*), count(DISTINCT content), 0 FROM docs"""))
def vector_cache(spark, sf_dir):
    """A third of the texts, then all, then all again: each distinct missing text is embedded once, the last run embeds none."""
    cache, out = VectorCache(spark, f"{shared_dir(spark)}/cache", hashed_terms), None
    docs = X.docs(spark, sf_dir).select("document_id", F.col("content").alias("text"))
    for run, texts in ((1, docs.where("document_id % 3 = 0")), (2, docs), (3, docs)):
        found = cache.vectors(texts, "document_id", "text")
        row = found.agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("cache_key").alias("keys"), F.countDistinct(F.when(~F.col("hit"), F.col("cache_key"))).alias("embedded")).select(F.lit(run).alias("run"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def vector_ann(spark, sf_dir):
    """Approximate neighbours of every row with an id divisible by 100 among all rows, with each question's recall against the exact form."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding")
    asked = rows.where("point_id % 100 = 0").withColumnRenamed("point_id", "qid")
    index = ProjectionIndex(rows)
    found = stored(index.topk(asked, P.PREFETCH_DENSE))
    return found.join(recall(found, exact_topk(asked, rows, P.PREFETCH_DENSE)), "qid")
