"""Evidence, citations and their evaluation, over the retrieved benchmark questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evigrid import params as P
from evigrid.functions import text as T
from evigrid.functions.fuzzy import best_match
from evigrid.operators import retrieval as R
from evigrid.plans import query
from evigrid.plans.retrieval import _HITS, Run, recalls
from evigrid.session import stored
from evigrid.sources import fixtures as X
from evigrid.sources.fixtures import with_sql

#: The stand-in answers abstain under this cosine, so that both kinds occur.
ANSWER_GATE = 0.15
_MK = P.MARKER.replace("\\s", "[ \\t]").replace("\\d", "[0-9]")
_TRIM = "regexp_replace(regexp_replace({0}, '^[ \\t\\r\\n]+', ''), '[ \\t\\r\\n]+$', '')"
_S1 = "regexp_extract(content, '^[^.]*[.]')"
STEPS = dict(
    _HITS,
    a0=f"SELECT g.qid, max({_S1}) FILTER (rank = 0) AS s1, max({_S1}) FILTER (rank = 1) AS s2 FROM golden g LEFT JOIN kept USING (qid) GROUP BY g.qid",
    answers=f"SELECT qid, CASE WHEN hydrated_count = 0 OR max_cosine < {ANSWER_GATE} THEN '{P.ABSTAIN}' ELSE coalesce(s1 || ' [C1]', '') || coalesce(' ' || s2 || ' [C2, F1]', '') || CASE WHEN qid % 7 = 0 THEN ' [C99]' ELSE '' END END AS text FROM a0 JOIN sig USING (qid)",
    anc="SELECT qid, 'C' || CAST(rank + 1 AS VARCHAR) AS marker, point_id, rank, title, project_id, content FROM kept",
    m0=f"SELECT qid, g, list_transform(string_split(groups[g], ','), lambda x: trim(x)) AS ms FROM (SELECT qid, groups, unnest(range(1, len(groups) + 1)) AS g FROM (SELECT qid, regexp_extract_all(text, '{_MK}', 1) AS groups FROM answers))",
    m1="SELECT qid, g, i, ms[i] AS marker FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m0)",
    used="SELECT qid, marker, row_number() OVER (PARTITION BY qid ORDER BY min(g * 1000 + i)) AS place FROM m1 GROUP BY qid, marker",
    valid="SELECT u.qid, u.marker, a.marker IS NOT NULL AS ok FROM used u LEFT JOIN anc a ON a.qid = u.qid AND a.marker = u.marker WHERE u.marker LIKE 'C%'",
)


def sql(body: str, **more: str) -> str:
    return with_sql("docs golden scope", body, **STEPS, **more)


class Answered:
    """Kept evidence, anchors and stand-in answers of one folder of tables; the evidence is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.run = Run(spark, sf_dir)
        self.questions = self.run.questions
        self.dense = stored(self.run.dense())
        self.fused = stored(R.rrf_fuse(self.dense, self.run.sparse()))
        self.kept = stored(R.guardrails(R.join_back(R.doc_quota(R.fused_cut(self.fused), self.run.points), self.run.points), self.run.scope))
        self._answers = None

    def anchors(self) -> DataFrame:
        return self.kept.select("qid", F.concat(F.lit("C"), (F.col("rank") + 1).cast("string")).alias("marker"), "point_id", "rank", "title", "project_id", "content")

    def answers(self) -> DataFrame:
        if self._answers is None:
            first = F.regexp_extract("content", r"^[^.]*[.]", 0)
            s = self.kept.groupBy("qid").agg(F.max(F.when(F.col("rank") == 0, first)).alias("s1"), F.max(F.when(F.col("rank") == 1, first)).alias("s2"))
            gate = (F.col("hydrated_count") == 0) | (F.col("max_cosine") < ANSWER_GATE)
            told = F.concat(F.coalesce(F.concat("s1", F.lit(" [C1]")), F.lit("")), F.coalesce(F.concat(F.lit(" "), "s2", F.lit(" [C2, F1]")), F.lit("")), F.when(F.col("qid") % 7 == 0, " [C99]").otherwise(""))
            signals = R.signals(self.questions, self.dense, self.fused, self.kept)
            self._answers = stored(signals.join(s, "qid", "left").select("qid", F.when(gate, P.ABSTAIN).otherwise(told).alias("text")))
        return self._answers

    def used(self) -> DataFrame:
        return self.answers().select("qid", F.posexplode(T.markers(F.col("text"))).alias("p", "marker")).select("qid", "marker", (F.col("p") + 1).cast("long").alias("place"))

    def validity(self) -> DataFrame:
        known = self.anchors().select("qid", "marker").withColumn("k", F.lit(True))
        return self.used().where("marker like 'C%'").join(known, ["qid", "marker"], "left").select("qid", "marker", F.coalesce("k", F.lit(False)).alias("ok"))


@query(sql("SELECT qid, marker, point_id FROM anc"))
def anchors(spark, sf_dir):
    return Answered(spark, sf_dir).anchors().select("qid", "marker", "point_id")


_QUOTE = "CASE WHEN length(t) <= 360 THEN t ELSE regexp_replace(CASE WHEN contains(left(t, 360), ' ') AND 360 - instr(reverse(left(t, 360)), ' ') > 180 THEN left(t, CAST(360 - instr(reverse(left(t, 360)), ' ') AS BIGINT)) ELSE left(t, 360) END, '[ \\t\\r\\n]+$', '') END"


@query(with_sql("docs", f"SELECT document_id, {_QUOTE} AS quote FROM t", t=f"SELECT document_id, {_TRIM.format('content')} AS t FROM docs"))
def quote(spark, sf_dir):
    return X.docs(spark, sf_dir).select("document_id", T.quote(F.col("content")).alias("quote"))


@query(sql(f"SELECT qid, 'cit-' || marker AS id, {_QUOTE} AS quote, title, 0 AS page, 'pending' AS status FROM (SELECT *, {_TRIM.format('content')} AS t FROM anc)"))
def pending_citations(spark, sf_dir):
    a = Answered(spark, sf_dir).anchors()
    return a.select("qid", F.concat(F.lit("cit-"), "marker").alias("id"), T.quote(F.col("content")).alias("quote"), "title", F.lit(0).alias("page"), F.lit("pending").alias("status"))


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(sql("SELECT qid, string_agg(d, chr(10) ORDER BY first) AS block FROM (SELECT qid, point_id, min(rank) AS first, '<document title=\"' || any_value(title) || '\">' || chr(10) || string_agg('<chunk id=\"' || marker || '\">' || " + _ESC.format(_TRIM.format("content")) + " || '</chunk>', chr(10) ORDER BY rank) || chr(10) || '</document>' AS d FROM anc GROUP BY qid, point_id) GROUP BY qid"))
def context_block(spark, sf_dir):
    """Chunks grouped by document in order of first appearance; at most the context's few rows per question."""
    chunk = F.concat(F.lit('<chunk id="'), "marker", F.lit('">'), T.escape(T.trim(F.col("content"))), F.lit("</chunk>"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n")
    d = Answered(spark, sf_dir).anchors().groupBy("qid", "point_id", "title").agg(F.min("rank").alias("first"), join(F.struct("rank", chunk.alias("t"))).alias("body"))
    whole = F.concat(F.lit('<document title="'), "title", F.lit('">\n'), "body", F.lit("\n</document>"))
    return d.groupBy("qid").agg(join(F.struct("first", whole.alias("t"))).alias("block"))


_MEDIA = dict(
    fig="SELECT qid, figure_id, coalesce(caption, 'Figure') AS label, row_number() OVER (PARTITION BY qid ORDER BY min(rank), figure_id) AS n FROM kept JOIN figures f ON f.document_id = kept.point_id WHERE has_image GROUP BY qid, figure_id, caption",
    tab="SELECT qid, table_id, coalesce(caption, 'Table') AS label, markdown, row_number() OVER (PARTITION BY qid ORDER BY rank, table_id) AS n FROM kept JOIN table_text t ON t.table_id = kept.point_id",
    media="SELECT qid, 'figure' AS kind, CAST(figure_id AS BIGINT) AS id, 'F' || CAST(n AS VARCHAR) AS marker, label, '' AS body, n FROM fig WHERE n <= 4 UNION ALL SELECT qid, 'table', table_id, 'T' || CAST(n AS VARCHAR), label, chr(10) || markdown, n FROM tab",
)
_FROM = "docs golden scope figures table_text"


def _media(spark, sf_dir, kept: DataFrame | None = None) -> DataFrame:
    """Figures (with an image, at most four) and tables of kept documents, each numbered by first appearance."""
    k = (Run(spark, sf_dir).kept() if kept is None else kept).select("qid", F.col("point_id").alias("document_id"), "rank")
    k = stored(k)
    f = k.join(X.figures(spark, sf_dir).where("has_image"), "document_id").groupBy("qid", F.col("figure_id").cast("long").alias("id")).agg(F.min("rank").alias("rank"), F.first("caption").alias("caption"))
    t = k.join(X.table_text(spark, sf_dir, k.select(F.col("document_id").alias("table_id")).distinct()).withColumn("document_id", F.col("table_id")), "document_id")
    n = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id")).cast("long")
    of = lambda df, kind, body: df.withColumn("n", n).select(
        "qid", F.lit(kind).alias("kind"), "id", F.concat(F.lit(kind[0].upper()), F.col("n").cast("string")).alias("marker"), F.coalesce("caption", F.lit(kind.capitalize())).alias("label"), body.alias("body"), "n"
    )
    return of(f, "figure", F.lit("")).where(F.col("n") <= P.MAX_FIGURES).unionByName(of(t.withColumnRenamed("table_id", "id"), "table", F.concat(F.lit("\n"), "markdown")))


@query(with_sql(_FROM, "SELECT qid, kind, id, marker, label FROM media", **STEPS, **_MEDIA))
def hydrate_media(spark, sf_dir):
    return _media(spark, sf_dir).drop("n", "body")


@query(with_sql(_FROM, "SELECT qid, string_agg('<' || kind || 's>' || chr(10) || lines || chr(10) || '</' || kind || 's>', chr(10) ORDER BY kind) AS block FROM (SELECT qid, kind, string_agg('<' || kind || ' id=\"' || marker || '\">' || " + _ESC.format("label || body") + " || '</' || kind || '>', chr(10) ORDER BY n) AS lines FROM media GROUP BY qid, kind) GROUP BY qid", **STEPS, **_MEDIA))
def media_block(spark, sf_dir):
    """Figures, then tables with their rows, as one block a question."""
    line = F.concat(F.lit("<"), "kind", F.lit(' id="'), "marker", F.lit('">'), T.escape(F.concat("label", "body")), F.lit("</"), "kind", F.lit(">"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n")
    parts = _media(spark, sf_dir).groupBy("qid", "kind").agg(join(F.struct("n", line.alias("t"))).alias("lines"))
    whole = F.concat(F.lit("<"), "kind", F.lit("s>\n"), "lines", F.lit("\n</"), "kind", F.lit("s>"))
    return parts.groupBy("qid").agg(join(F.struct("kind", whole.alias("t"))).alias("block"))


@query(with_sql(_FROM, "SELECT m.qid, kind, id, CASE WHEN u.marker IS NOT NULL THEN 'cited' ELSE 'candidate' END AS display FROM media m LEFT JOIN used u ON u.qid = m.qid AND u.marker = m.marker", **STEPS, **_MEDIA))
def promote_media(spark, sf_dir):
    a = Answered(spark, sf_dir)
    u = a.used().select("qid", "marker", F.lit("cited").alias("c"))
    return _media(spark, sf_dir, a.kept).join(u, ["qid", "marker"], "left").select("qid", "kind", "id", F.coalesce("c", F.lit("candidate")).alias("display"))


@query(sql("SELECT qid, marker, place FROM used"))
def used_markers(spark, sf_dir):
    return Answered(spark, sf_dir).used()


@query(sql("SELECT qid, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM valid GROUP BY qid"))
def citation_validity(spark, sf_dir):
    return Answered(spark, sf_dir).validity().groupBy("qid").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


_TRI = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2]))"


@query(sql("SELECT qid, marker, CASE WHEN len(tw) > 0 AND 100 * len(list_intersect(tw, tc)) >= 60 * len(tw) THEN 'grounded' ELSE 'weak' END AS status FROM (SELECT qid, marker, " + _TRI.format("ww") + " AS tw, " + _TRI.format("cw") + " AS tc FROM w)",
    cites=f"SELECT u.qid, u.marker, text, regexp_extract_all(text, '\\[[^\\]]*\\b' || u.marker || '\\b[^\\]]*\\]')[1] AS grp FROM used u JOIN answers USING (qid) WHERE u.marker LIKE 'C%'",
    w="SELECT c.qid, c.marker, regexp_extract_all(lower(right(left(text, CAST(instr(text, grp) - 1 AS BIGINT)), 240)), '[\\p{L}\\p{N}]+') AS ww, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS cw FROM cites c JOIN anc ON anc.qid = c.qid AND anc.marker = c.marker"))
def grounding(spark, sf_dir):
    """Share of the word trigrams before a citation that its chunk holds; joined on the cited anchor."""
    rows = _cited(Answered(spark, sf_dir))
    return rows.select("qid", "marker", _trigram_status(rows).alias("status"))


def _cited(a: Answered) -> DataFrame:
    """qid, marker, window (up to 240 characters before the first group that cites the marker), content of the cited chunk."""
    group = F.regexp_substr("text", F.concat(F.lit(r"\[[^\]]*\b"), "marker", F.lit(r"\b[^\]]*\]")))
    before = F.expr("substring(text, 1, instr(text, grp) - 1)")
    at = a.used().where("marker like 'C%'").join(a.answers(), "qid").withColumn("grp", group).withColumn("window", before)
    return at.withColumn("window", F.substring("window", F.greatest(F.lit(1), F.length("window") - 239), F.lit(240))).join(a.anchors().select("qid", "marker", "content"), ["qid", "marker"])


def _trigram_status(rows: DataFrame):
    tw, tc = T.trigrams(F.col("window")), T.trigrams(F.col("content"))
    return F.when((F.size(tw) > 0) & (100 * F.size(F.array_intersect(tw, tc)) >= 60 * F.size(tw)), "grounded").otherwise("weak")


@query()
def grounding_exact(spark, sf_dir):
    """Both forms for each cited pair: the best partial match (grounded from 60) beside the trigram form, and whether they agree."""
    rows = _cited(Answered(spark, sf_dir))
    score = best_match("window", "content")
    both = rows.select("qid", "marker", F.round(score, 6).alias("score"), _trigram_status(rows).alias("trigram_status"))
    exact = F.when(F.col("score") >= P.GROUNDED_FROM, "grounded").otherwise("weak")
    return both.withColumn("status", exact).withColumn("agree", F.col("status") == F.col("trigram_status"))


@query(sql("SELECT qid, marker, row_number() OVER (PARTITION BY qid ORDER BY place) AS number FROM used WHERE marker LIKE 'C%'"))
def display_numbers(spark, sf_dir):
    return Answered(spark, sf_dir).used().where("marker like 'C%'").withColumn("number", F.row_number().over(Window.partitionBy("qid").orderBy("place")).cast("long")).drop("place")


@query(sql("SELECT u.qid, row_number() OVER (PARTITION BY u.qid ORDER BY place) AS number, title FROM used u JOIN anc a ON a.qid = u.qid AND a.marker = u.marker"))
def source_list(spark, sf_dir):
    a = Answered(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("qid").orderBy("place")).cast("long")
    return a.used().join(a.anchors().select("qid", "marker", "title"), ["qid", "marker"]).select("qid", n.alias("number"), "title")


@query(with_sql("docs points", "SELECT p.point_id, p.content_hash IS DISTINCT FROM sha256(d.content) AS source_changed FROM points p JOIN docs d ON d.document_id = p.point_id"))
def source_drift(spark, sf_dir):
    d = X.docs(spark, sf_dir).select(F.col("document_id").alias("point_id"), F.sha2("content", 256).alias("h"))
    return X.points(spark, sf_dir).join(d, "point_id").select("point_id", (~F.col("content_hash").eqNullSafe(F.col("h"))).alias("source_changed"))


@query(sql(f"SELECT qid, marker, coalesce(q <> '' AND contains(content, q), false) AS verbatim FROM (SELECT a.qid, a.marker, a.content, {_QUOTE} AS q FROM (SELECT *, {_TRIM.format('content')} AS t FROM anc) a)"))
def quote_verbatim(spark, sf_dir):
    """An emitted quote against the texts of its own document: an equi-join first, then containment."""
    return _verbatim(Answered(spark, sf_dir), sf_dir)


def _verbatim(a: Answered, sf_dir) -> DataFrame:
    emitted = a.anchors().select("qid", "marker", F.col("point_id").alias("document_id"), T.quote(F.col("content")).alias("q"))
    texts = X.docs(a.kept.sparkSession, sf_dir).select("document_id", "content")
    return emitted.join(texts, "document_id").groupBy("qid", "marker").agg(F.bool_or((F.col("q") != "") & F.contains("content", "q")).alias("verbatim"))


@query(with_sql(
    _FROM, "SELECT left(marker, 1) = 'C' AS text_kind, count(*) AS used, count(*) FILTER (a.k IS NOT NULL) AS valid FROM used u LEFT JOIN emitted a ON a.qid = u.qid AND a.k = u.marker GROUP BY 1",
    **STEPS, **_MEDIA, emitted="SELECT qid, marker AS k FROM anc UNION ALL SELECT qid, marker FROM media",
))
def id_validity(spark, sf_dir):
    """Used markers of both kinds against those emitted: anchors of chunks, figures and tables."""
    a = Answered(spark, sf_dir)
    known = a.anchors().select("qid", "marker").unionByName(_media(spark, sf_dir, a.kept).select("qid", "marker")).withColumn("k", F.lit(1))
    return a.used().join(known, ["qid", "marker"], "left").groupBy(F.col("marker").startswith("C").alias("text_kind")).agg(F.count(F.lit(1)).alias("used"), F.count("k").alias("valid"))


_ABS = f"SELECT a.qid, e.grp, e.expect, contains(text, left('{P.ABSTAIN}', 40)) AND NOT regexp_matches(text, '{_MK}') AS abstained FROM answers a JOIN expect e USING (qid)"


def _abstained(a: Answered, spark, sf_dir) -> DataFrame:
    said = F.contains("text", F.lit(P.ABSTAIN[:40])) & (F.size(T.markers(F.col("text"))) == 0)
    return a.answers().withColumn("abstained", said).join(recalls(spark, sf_dir, a.kept).select("qid", "grp", "expect", "hit"), "qid")


@query(sql("SELECT qid, abstained, abstained = (expect = 'abstain') AS correct FROM ab", ab=_ABS))
def abstain_correct(spark, sf_dir):
    return _abstained(Answered(spark, sf_dir), spark, sf_dir).select("qid", "abstained", (F.col("abstained") == (F.col("expect") == "abstain")).alias("correct"))


_REPORT = dict(
    ab=_ABS,
    per="SELECT ab.qid, ab.grp, (expect = 'answer')::INT AS n_rec, (expect = 'answer' AND hit)::INT AS hits, (abstained = (expect = 'abstain'))::INT AS abst, coalesce(v.used, 0) AS n_id, coalesce(v.ok, 0) AS ids FROM ab JOIN (SELECT qid, hit FROM rec) r USING (qid) LEFT JOIN (SELECT qid, count(*) AS used, count(*) FILTER (ok) AS ok FROM valid GROUP BY qid) v USING (qid)",
    rep="SELECT grp, round(coalesce(sum(hits)::DOUBLE / nullif(sum(n_rec), 0), 1.0), 6) AS recall, round(coalesce(sum(ids)::DOUBLE / nullif(sum(n_id), 0), 1.0), 6) AS id_validity, round(coalesce(sum(abst)::DOUBLE / nullif(count(*), 0), 1.0), 6) AS abstain FROM per GROUP BY GROUPING SETS ((grp), ())",
)


def _report(a: Answered, spark, sf_dir) -> DataFrame:
    v = a.validity().groupBy("qid").agg(F.count(F.lit(1)).alias("used"), F.count_if("ok").alias("ok"))
    rows = _abstained(a, spark, sf_dir).join(v, "qid", "left")
    share = lambda n, d: F.round(F.coalesce(F.try_divide(F.sum(n), F.sum(d)), F.lit(1.0)), 6)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    ans = F.col("expect") == "answer"
    return stored(rows).groupingSets([["grp"], []], "grp").agg(
        share(one(ans & F.col("hit")), one(ans)).alias("recall"), share(F.coalesce("ok", F.lit(0)).cast("double"), F.coalesce("used", F.lit(0)).cast("double")).alias("id_validity"),
        share(one(F.col("abstained") == (F.col("expect") == "abstain")), F.lit(1.0)).alias("abstain"),
    )


@query(sql("SELECT * FROM rep", **_REPORT))
def eval_report(spark, sf_dir):
    return _report(Answered(spark, sf_dir), spark, sf_dir)


@query(sql("SELECT gate, value, value >= least AS pass FROM (SELECT 'recall' AS gate, recall AS value, 0.9::DOUBLE AS least FROM rep WHERE grp IS NULL UNION ALL SELECT 'id_validity', id_validity, 1.0 FROM rep WHERE grp IS NULL UNION ALL SELECT 'quote', coalesce(avg((contains(content, q))::INT), 1.0), 1.0 FROM (SELECT content, " + _QUOTE + f" AS q FROM (SELECT *, {_TRIM.format('content')} AS t FROM anc)) UNION ALL SELECT 'abstain', abstain, 0.9 FROM rep WHERE grp IS NULL)", **_REPORT))
def hard_gates(spark, sf_dir):
    a = Answered(spark, sf_dir)  # one run of the retrieval serves all four gates
    total = _report(a, spark, sf_dir).where("grp is null").select(F.expr("stack(3, 'recall', recall, 'id_validity', id_validity, 'abstain', abstain) as (gate, value)"))
    q = _verbatim(a, sf_dir).agg(F.coalesce(F.avg(F.col("verbatim").cast("double")), F.lit(1.0)).alias("value")).select(F.lit("quote").alias("gate"), "value")
    least = spark.createDataFrame(list(P.EVAL_GATES), "gate string, least double")
    return total.unionByName(q).join(F.broadcast(least), "gate").select("gate", "value", (F.col("value") >= F.col("least")).alias("pass"))
