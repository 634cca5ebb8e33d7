"""Rules of single operators on small inputs."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evigrid import params as P
from evigrid.functions import text as T
from evigrid.operators import chunking as C, eventlog as E, structure as S


PIECE = st.tuples(st.lists(st.integers(1, 40).map(lambda n: "w" * n), min_size=1, max_size=60).map(" ".join), st.sampled_from([None, "a", "a > b", "c"]), st.integers(1, 4), st.sampled_from([1, 1, 8]))


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECE, max_size=14))
def test_properties_of_packing(drawn):
    """What any packing must keep: all words in order, the limits, one section a chunk, pages of its pieces, no neighbour left small."""
    pieces = [(" ".join([t] * k), path, path, page) for t, path, page, k in drawn]
    chunks = C.pack(pieces)
    words = [w for t, *_ in pieces for w in t.split()]
    at = 0
    for c in chunks:
        own = c["content"].split()
        if c["forced"]:  # begins with words already seen, at most the overlap of them
            back = next(k for k in range(len(own) + 1) if words[at : at + len(own) - k] == own[k:] and own[:k] == words[at - k : at])
            assert sum(len(w) + 1 for w in own[:back]) <= P.CHUNK_OVERLAP * 4
            own = own[back:]
        assert words[at : at + len(own)] == own
        at += len(own)
        assert c["tokens"] <= P.CHUNK_MAX + 1 and c["page_start"] <= c["page_end"]
    assert at == len(words) and [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
    for x, y in zip(chunks, chunks[1:]):
        small = not y["forced"] and y["tokens"] < P.CHUNK_MIN_MERGE and x["section_path"] == y["section_path"]
        assert not small or x["tokens"] + y["tokens"] > P.CHUNK_MAX


def test_packing_by_hand():
    t = lambda n: (("x" * 9 + " ") * n)[: n * 4 - 1] + "x"  # noqa: E731  n tokens of text
    of = lambda pieces: [(c["tokens"], c["section_path"], c["forced"]) for c in C.pack(pieces)]
    assert of([]) == []
    assert of([(t(400), "a", "a", 1), (t(400), "a", "a", 1), (t(200), "a", "a", 2), (t(400), "a", "a", 2)]) == [(1001, "a", False), (400, "a", False)]  # closes past the target
    assert of([(t(800), "a", "a", 1), (t(500), "a", "a", 1)]) == [(800, "a", False), (500, "a", False)]  # would pass the maximum
    assert of([(t(300), "a", "a", 1), (t(300), "b", "b", 1)]) == [(300, "a", False), (300, "b", False)]  # another section
    assert of([(t(950), "a", "a", 1), (t(50), "a", "a", 1)]) == [(1000, "a", False)]  # a tiny one joins its section
    assert of([(t(950), "a", "a", 1), (t(50), "b", "b", 1)]) == [(950, "a", False), (50, "b", False)]
    assert of([(t(1180), "a", "a", 1), (t(50), "a", "a", 1)]) == [(1180, "a", False), (50, "a", False)]  # not over the maximum
    split = C.pack([(t(2000), "a", "a", 3)])
    assert [c["forced"] for c in split] == [False, True, True] and all(c["page_start"] == 3 for c in split)


def test_chunks_of_documents(spark):
    rows = [(1, 0, "heading", 1, "Title", 1), (1, 1, "text", None, "body " * 30, 1), (1, 2, "heading", 2, "", 1), (1, 3, "text", None, "more", 2), (2, 0, "text", None, "   ", 1)]
    b = spark.createDataFrame(rows, "document_id long, pos int, kind string, level int, text string, page int")
    got = C.chunk_documents(b).collect()
    assert [(r.document_id, r.section_path, r.page_start, r.page_end) for r in got] == [(1, "Title", 1, 2)] or len(got) == 2
    assert all(r.document_id == 1 for r in got)


def test_quote_and_markers(spark):
    long = "word " * 100
    r = spark.createDataFrame([(long, "a [C1, F2] b [C1] [C12] arr[1] [1,2]")], "t string, m string").select(T.quote(F.col("t")).alias("q"), T.markers(F.col("m")).alias("m")).first()
    assert len(r.q) <= 360 and r.q.endswith("word") and long.startswith(r.q)
    assert r.m == ["C1", "F2", "C12"]


def test_pipe_tables(spark):
    md = "| a | b |\n| :-- | --: |\n| x \\| y | 1 |\n| z |\n"
    t = spark.createDataFrame([(1, md), (2, "no table"), (3, "| a |\n| b |")], "table_id long, markdown string")
    rows = S.parse_pipe_tables(t).collect()
    assert [r.table_id for r in rows] == [1] and rows[0].rows == [["x | y", "1"], ["z", ""]] and rows[0].align == ["left", "right"]


def test_windows_and_costs(spark):
    r = spark.sql("select 1L event_id, 'a' client, timestamp_ntz'2024-01-01 00:00:01' ts, 4.99D cost union all select 2, 'a', timestamp_ntz'2024-01-01 00:00:05', 0.02 union all select 3, 'b', timestamp_ntz'2024-01-01 00:00:06', 1.0")
    w = {x.event_id: (x.allowed, x.retry_after) for x in E.fixed_window(r, 1, 600).collect()}
    assert w == {1: (True, None), 2: (False, 596), 3: (True, None)}
    assert {x.event_id: x.admitted for x in E.cost_admission(r, 5.0).collect()} == {1: True, 2: True, 3: False}
    m = spark.createDataFrame([("deepseek-chat", 1000, 1000), ("x", 1000, 0), ("x", None, None)], "model string, prompt_tokens long, completion_tokens long")
    assert sorted(round(x.cost, 6) for x in E.estimate_cost(m).collect()) == [0.00027, 0.00137, P.FLAT_COST_USD]


def test_failed_answers_cost_nothing(spark):
    m = spark.createDataFrame([("x", None, None, "error"), ("x", None, None, None)], "model string, prompt_tokens long, completion_tokens long, finish_reason string")
    assert sorted(x.cost for x in E.estimate_cost(m).collect()) == [0.0, P.FLAT_COST_USD]


def test_markers_without_emission(spark):
    rows = [("a", 0, "start", None, None), ("a", 1, "citation", "cit-C1", "x"), ("a", 2, "text-delta", None, "w [C"), ("a", 3, "text-delta", None, "1, C2]"), ("b", 0, "text-delta", None, "w [C1]"), ("c", 0, "citation", "cit-C1", "x"), ("c", 1, "text-delta", None, "w [C1]"), ("d", 0, "start", None, None)]
    e = spark.createDataFrame(rows, "stream_id string, seq long, type string, id string, payload string")
    assert {r.stream_id: r.used_emitted for r in E.contract_checks(e).collect()} == {"a": False, "b": False, "c": True, "d": True}


def test_questions_as_json_lines(spark, tmp_path):
    from evigrid.sources.questions import read_golden

    (tmp_path / "q.jsonl").write_text('{"id": "q1", "group": "g", "question": "what?", "expect": "answer", "gold_text_anchor": "a"}\n\n{"id": "q2", "group": "g", "question": "who?", "expect": "abstain"}\n')
    assert [(r.qid, r.expect, r.anchor) for r in read_golden(spark, str(tmp_path / "q.jsonl")).orderBy("qid").collect()] == [("q1", "answer", "a"), ("q2", "abstain", None)]


def test_library_without_training_operators():
    import evigrid.registry as r

    assert len(r.QUERIES) > 80 and not any(n.startswith("op") and n[2:3].isdigit() for n in r.QUERIES)


def test_chunks_come_before_a_document_ends(spark):
    """A document of any length costs one open chunk: the first comes while pieces still arrive; and blocks are dealt once."""
    from itertools import count, islice

    endless = ((f"line {i} " * 40, "a", "a", 1) for i in count())
    assert [c["chunk_index"] for c in islice(C.chunked(endless), 3)] == [0, 1, 2]
    b = spark.createDataFrame([(1, 0, "text", None, "body", 1)], "document_id long, pos int, kind string, level int, text string, page int")
    plan = C.chunk_documents(b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FlatMapGroupsInPandas" not in plan


def test_caption_links_of_repeated_figures(spark):
    from evigrid.plans.tables import caption_links

    rows = [(1, 10, "Figure 3: a"), (1, 10, "Figure 4: b"), (1, 11, "Figure 3"), (1, 11, "see Figure 4"), (1, 12, None), (1, 13, "none"), (2, 14, "Figure 3"), (1, 15, "Figure 4")]
    links = caption_links(spark.createDataFrame(rows, "document_id long, figure_id long, caption string"))
    alike = [(1, a, b) for a in (10, 11, 15) for b in (10, 11, 15) if a != b]
    assert sorted(map(tuple, links.collect())) == sorted([(*x, 0.9) for x in alike] + [(d, i, i, 1.0) for d, i in {(d, i) for d, i, _ in rows}])
    # pairs are not gathered behind the join that makes them
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_chunks_keep_their_documents_columns(spark):
    rows = [(1, "p", None, 0, "text", None, "one " * 900, 1), (1, "p", None, 1, "text", None, "two " * 900, 1), (2, None, True, 0, "text", None, "body", 1)]
    b = spark.createDataFrame(rows, "document_id long, project string, flag boolean, pos int, kind string, level int, text string, page int")
    got = {(r.document_id, r.project, r.flag) for r in C.chunk_documents(b, keep=("project", "flag")).collect()}
    assert got == {(1, "p", None), (2, None, True)} and C.chunk_documents(b, keep=("project", "flag")).count() > 2
