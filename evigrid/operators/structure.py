"""Document structure: blocks of HTML pages, heading paths, pipe tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evigrid import params as P

#: Elements whose contents are no text, tags that open a block, tags that end one.
DROPPED = ("script", "style", "nav", "footer")
OPENING = r"(?i)<(?:h[1-6]|p|li)(?:\s[^>]*)?>"
ENDING = r"(?is)</(?:h[1-6]|p|li|ul|ol|div|article|section|table|body|html)\s*>.*$"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
LEVELS = 6


def extract_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, level, text): headings, paragraphs and list items in order, tags and entities resolved."""
    body = F.coalesce(F.col(html), F.lit(""))
    for tag in DROPPED:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    pieces, tags = F.split(body, OPENING, -1), F.regexp_extract_all(body, F.lit(OPENING), F.lit(0))
    text = F.regexp_replace(F.regexp_replace("piece", ENDING, ""), "<[^>]*>", "")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    zipped = F.arrays_zip(tags.alias("tag"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("piece"))
    rows = pages.select(key, F.posexplode(zipped).alias("pos", "x")).select(key, "pos", F.lower(F.regexp_extract("x.tag", r"(?i)<([a-z0-9]+)", 1)).alias("tag"), F.col("x.piece").alias("piece"))
    heading = F.col("tag").startswith("h")
    return rows.select(key, "pos", F.when(heading, "heading").otherwise("text").alias("kind"), F.when(heading, F.substring("tag", 2, 1).cast("int")).alias("level"), F.trim(F.regexp_replace(text, P.WHITE, " ")).alias("text"))


def heading_stack(blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds ``section_path`` and ``path_key`` (the first two entries): running maxima instead of a stack.

    The last heading of level L is on the stack where it comes after the last
    headings of all higher levels.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks
    for lv in range(1, LEVELS + 1):
        out = out.withColumn(f"_h{lv}", F.max(F.when(F.col("level") == lv, F.struct("pos", "text"))).over(w))
    on = []
    for lv in range(1, LEVELS + 1):
        above = [F.coalesce(F.col(f"_h{u}.pos"), F.lit(-1)) for u in range(1, lv)]
        top = F.lit(-1) if not above else above[0] if len(above) == 1 else F.greatest(*above)
        on.append(F.when(F.col(f"_h{lv}.pos") > top, F.col(f"_h{lv}.text")))
    stack = F.filter(F.array(*on), lambda x: x.isNotNull())
    path = F.array_join(F.filter(stack, lambda x: x != ""), " > ")
    return out.withColumn("section_path", F.when(path != "", path)).withColumn("path_key", F.slice(stack, 1, 2)).drop(*(f"_h{lv}" for lv in range(1, LEVELS + 1)))


def body_filter(blocks: DataFrame) -> DataFrame:
    """Blocks that become text: no headings, nothing empty."""
    return blocks.where((F.col("kind") == "text") & (F.trim(F.regexp_replace("text", P.WHITE, " ")) != ""))


def _cells(line: Column) -> Column:
    """Cells of a row; an escaped bar is part of its cell."""
    hidden = F.replace(F.trim(line), F.lit("\\|"), F.lit("\x01"))
    bare = F.regexp_replace(F.regexp_replace(hidden, r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|", -1), lambda c: F.trim(F.replace(c, F.lit("\x01"), F.lit("|"))))


def parse_pipe_tables(tables: DataFrame, key: str = "table_id", text: str = "markdown") -> DataFrame:
    """(key, headers, align, rows) of texts with a separator row; rows are cut or filled to the header's width."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("|")))
    t = tables.select(key, F.transform(lines, _cells).alias("_r")).where("size(_r) >= 2").select(key, F.col("_r")[0].alias("headers"), F.col("_r")[1].alias("_sep"), F.expr("slice(_r, 3, size(_r))").alias("_body"))
    t = t.where(F.forall("_sep", lambda c: F.regexp_like(c, F.lit("^:?-+:?$"))))
    side = lambda c: F.when(F.startswith(c, F.lit(":")) & F.endswith(c, F.lit(":")), "center").when(F.endswith(c, F.lit(":")), "right").when(F.startswith(c, F.lit(":")), "left")
    width = F.size("headers")
    row = lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(r, i), F.lit("")))
    return t.select(key, "headers", F.transform("_sep", side).alias("align"), F.transform("_body", row).alias("rows"))


#: Fixed value: the pattern of a cell that reads as a number.
NUMERIC = r"^[-+]?[$€£]?\s*\d[\d,]*(\.\d+)?\s*%?$"


def column_alignment(parsed: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, col, align): the explicit side, else right where all filled cells are numbers, else left."""
    cols = parsed.select(key, F.posexplode("headers").alias("col", "header"), "align", "rows")
    cell = cols.select(key, "col", F.get("align", F.col("col")).alias("given"), F.explode_outer("rows").alias("r")).withColumn("v", F.get("r", F.col("col")))
    filled = F.coalesce(F.col("v"), F.lit("")) != ""
    number = F.bool_and(F.when(filled, F.col("v").rlike(NUMERIC)))
    return cell.groupBy(key, "col", "given").agg(number.alias("n")).select(key, "col", F.coalesce("given", F.when(F.coalesce("n", F.lit(False)), "right").otherwise("left")).alias("align"))
