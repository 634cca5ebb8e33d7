"""The packing rules as SQL folds: recursion over pieces, over cuts of long pieces, and over packed groups."""

from __future__ import annotations

from evigrid import params as P

_TRIM = "regexp_replace({0}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"
#: First place past ``frm`` whose words from ``start`` no longer fit; null where all fit.  ends[k + 1] is the length of the first k words.
_CUT = f"frm - 1 + nullif(list_position(list_transform(list_slice(ends, frm + 2, len(ends)), lambda v: v - ends[start + 1] > {P.CHUNK_TARGET * 4}), true), 0)"


def stack_sql(blocks: str, key: str, levels: int) -> dict[str, str]:
    """Steps that give ``pieces`` (doc, i, text, path, mk, page) of a block table, by the headings before each block."""
    above = [", ".join(f"coalesce(p{u}.pos, -1)" for u in range(1, v)) for v in range(1, levels + 1)]
    title = [f"CASE WHEN p{v}.pos > {f'greatest(-1, {above[v - 1]})' if above[v - 1] else '-1'} THEN p{v}.text END" for v in range(1, levels + 1)]
    last = ", ".join(f"max(CASE WHEN level = {v} THEN {{'pos': pos, 'text': text}} END) OVER w AS p{v}" for v in range(1, levels + 1))
    return {
        "heads": f"SELECT *, {last} FROM {blocks} WINDOW w AS (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING)",
        "stacked": f"SELECT {key} AS doc, pos, kind, text, page, list_filter([{', '.join(title)}], lambda x: x IS NOT NULL) AS st FROM heads",
        "pieces": f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i, text, nullif(array_to_string(list_filter(st, lambda x: x <> ''), ' > '), '') AS path, array_to_string(list_slice(st, 1, 2), chr(31)) AS mk, page, greatest(1, length(text) // 4) AS n FROM stacked WHERE kind = 'text' AND {_TRIM.format('text')} <> ''",
    }


#: From ``pieces`` to ``chunks`` (doc, chunk_index, content, section_path, page_start, page_end, forced, tokens).
FOLDS = {
    "lw": f"SELECT doc, i, path, page, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT *, string_split_regex({_TRIM.format('text')}, '[ \\t\\r\\n]+') AS ws FROM pieces WHERE n > {P.CHUNK_MAX})",
    "le": "SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc, i ORDER BY k) AS e FROM lw",
    "long": "SELECT doc, i, path, page, list_prepend(0, list(e ORDER BY k)) AS ends, list(w ORDER BY k) AS ws FROM le GROUP BY ALL",
    "cuts": f"""SELECT *, {_CUT} AS cut FROM (SELECT doc, i, path, page, ends, ws, 0 AS seg, CAST(0 AS BIGINT) AS start, CAST(1 AS BIGINT) AS frm FROM long)
        UNION ALL SELECT *, {_CUT} FROM (SELECT doc, i, path, page, ends, ws, seg + 1 AS seg,
            coalesce(start - 1 + nullif(list_position(list_transform(list_slice(ends, start + 1, cut), lambda v: ends[cut + 1] - v <= {P.CHUNK_OVERLAP * 4}), true), 0), cut) AS start, cut + 1 AS frm FROM cuts WHERE cut IS NOT NULL)""",
    "segs": "SELECT doc, i, seg, path, page, array_to_string(list_slice(ws, start + 1, coalesce(cut, len(ws))), ' ') AS text FROM cuts",
    "nseg": "SELECT doc, i, count(*) AS c FROM segs GROUP BY ALL",
    "numbered": "SELECT p.*, coalesce(c, 0) AS c FROM pieces p LEFT JOIN nseg USING (doc, i)",
    "packed": f"""SELECT doc, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS grp, '' AS mk, CAST(NULL AS BIGINT) AS tok FROM (SELECT DISTINCT doc FROM pieces)
        UNION ALL SELECT p.doc, p.i,
            CASE WHEN p.n > {P.CHUNK_MAX} THEN f.grp + p.c WHEN f.tok IS NULL OR f.mk <> p.mk OR f.tok + p.n > {P.CHUNK_MAX} THEN f.grp + 1 ELSE f.grp END, p.mk,
            CASE WHEN p.n > {P.CHUNK_MAX} THEN NULL ELSE (SELECT CASE WHEN t < {P.CHUNK_TARGET} THEN t END FROM (SELECT CASE WHEN f.tok IS NULL OR f.mk <> p.mk OR f.tok + p.n > {P.CHUNK_MAX} THEN p.n ELSE f.tok + p.n END AS t)) END
        FROM packed f JOIN numbered p ON p.doc = f.doc AND p.i = f.i + 1""",
    "grouped": f"""SELECT p.doc, grp, {_TRIM.format("string_agg(text, chr(10) || chr(10) ORDER BY p.i)")} AS text, arg_min(coalesce(path, chr(0)), p.i) AS path, false AS forced, min(page) AS lo, max(page) AS hi
        FROM packed f JOIN pieces p ON p.doc = f.doc AND p.i = f.i WHERE p.n <= {P.CHUNK_MAX} GROUP BY p.doc, grp
        UNION ALL SELECT s.doc, f.grp - c + seg + 1, {_TRIM.format("s.text")}, coalesce(s.path, chr(0)), seg > 0, s.page, s.page FROM segs s JOIN packed f ON f.doc = s.doc AND f.i = s.i JOIN nseg c ON c.doc = s.doc AND c.i = s.i""",
    "joined": f"""SELECT doc, grp, grp AS head, path, length(text) AS len FROM grouped WHERE grp = 1
        UNION ALL SELECT g.doc, g.grp, CASE WHEN stays THEN j.head ELSE g.grp END, CASE WHEN stays THEN j.path ELSE g.path END, CASE WHEN stays THEN j.len + 2 + length(g.text) ELSE length(g.text) END
        FROM (SELECT j.*, NOT g.forced AND g.path = j.path AND greatest(1, length(g.text) // 4) < {P.CHUNK_MIN_MERGE} AND greatest(1, j.len // 4) + greatest(1, length(g.text) // 4) <= {P.CHUNK_MAX} AS stays
              FROM joined j JOIN grouped g ON g.doc = j.doc AND g.grp = j.grp + 1) j JOIN grouped g ON g.doc = j.doc AND g.grp = j.grp + 1""",
    "whole": f"SELECT g.doc, head, {_TRIM.format('string_agg(text, chr(10) || chr(10) ORDER BY g.grp)')} AS content, nullif(arg_min(g.path, g.grp), chr(0)) AS section_path, min(lo) AS page_start, max(hi) AS page_end, arg_min(forced, g.grp) AS forced FROM joined j JOIN grouped g ON g.doc = j.doc AND g.grp = j.grp GROUP BY g.doc, head",
    "chunks": "SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY head) - 1 AS chunk_index, content, section_path, page_start, page_end, forced, greatest(1, length(content) // 4) AS tokens FROM whole",
}


def chunk_sql(sources: dict[str, str], body: str) -> str:
    """A statement over the chunks of ``sources``, which end in ``pieces``."""
    steps = {**sources, **FOLDS}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({s})" for n, s in steps.items()) + " " + body
