"""Column functions on texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evigrid import params as P


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where a lambda would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(c: Column) -> Column:
    """White space runs to one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), P.WHITE, " ")))


def trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^[ \t\r\n]+", ""), r"[ \t\r\n]+$", "")


def count_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(P.TERM), F.lit(0))


def quote(c: Column) -> Column:
    """Trimmed; over 360 characters cut there, and at the last blank if that lies past 180."""
    t = trim(c)
    cut = F.substring(t, 1, P.QUOTE_CHARS)
    back = F.length(cut) - F.locate(" ", F.reverse(cut))  # zero-based place of the last blank
    at_blank = (F.locate(" ", F.reverse(cut)) > 0) & (back > P.QUOTE_LEAST)
    return F.when(F.length(t) <= P.QUOTE_CHARS, t).otherwise(F.regexp_replace(F.when(at_blank, F.substring(cut, F.lit(1), back)).otherwise(cut), r"[ \t\r\n]+$", ""))


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def embed_text(content: Column, path: Column) -> Column:
    return F.concat(F.lit("[Paper]"), F.when(path.isNotNull() & (path != ""), F.concat(F.lit("["), path, F.lit("]"))).otherwise(""), F.lit("\n"), content)


def markers(c: Column) -> Column:
    """Distinct cited tokens in order of first use."""
    groups = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(P.MARKER), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x)))))


def trigrams(c: Column) -> Column:
    """Distinct runs of three words, joined by blanks."""
    none = F.array().cast("array<string>")
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return let(terms(c), lambda w: F.when(F.size(w) < 3, none).otherwise(runs(w)))
