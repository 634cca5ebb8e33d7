"""The registered queries of the training-data operators, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid.session import shared_dir, ship, stored, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import token_file

    path = f"{shared_dir(spark)}/tokens"
    token_file.write(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=0)
    return token_file.read_digests(spark, path).withColumnRenamed("key", "doc_id")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import kneser_ney

    return kneser_ney.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), machine).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import pii

    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import warc

    path = f"{shared_dir(spark)}/warc"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.page_rows(warc.captures(warc.read(spark, path, blocks=False)))


#: What a shard may hold, in bytes of text.
SHARD_BYTES = 512 << 10


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import sharding

    docs, path = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards"
    sharding.write(docs, path, SHARD_BYTES)
    return sharding.read(spark, path, docs).withColumnRenamed("key", "doc_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import quality_rules

    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import near_dup

    return near_dup.groups(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import bpe

    ship(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import alignment

    both = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    ids = stored(alignment.encode(table(spark, sf_dir, "documents"), *both))
    return alignment.align(ids, alignment.pair_counts(ids, *both), *both).withColumnRenamed("key", "doc_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import collocation

    return collocation.mine(table(spark, sf_dir, "documents"))


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigrid.llm import set_join

    return set_join.groups(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _similar(words: int, share: int, columns: str) -> str:
    """Components of documents whose sets of word shingles are alike, all pairs that share a shingle counted."""
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) END AS sh FROM d),
        u AS (SELECT doc_id, unnest(sh) AS x FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= {share} * (len(x.sh) + len(y.sh) - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m AS component_id{columns} FROM s JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) q ON q.a = doc_id"""


_WORDS = f"regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
QUERIES = {f.__name__: f for f in (op1_token_file, op2_kneser_ney, op3_toxicity, op4_warc, op5_quality_rules, op6_near_dup, op7_bpe_automaton, op8_pii, op9_sharding, op10_decontaminate, op11_token_alignment, op12_collocations, op13_set_join)}
ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
        d AS (SELECT page_id, strlen(b) AS payload_bytes, sha1(b) AS h FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last FROM d)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < last THEN last END AS refers_to
        FROM g""",
    "op9_sharding": f"""
        WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
                          CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
        e AS (SELECT *, CAST(d AS INTEGER) AS depth, h >> CAST(60 - d AS INTEGER) AS bucket FROM r, range(0, 61) t(d)),
        s AS (SELECT *, sum(bytes) OVER (PARTITION BY depth, bucket) AS shard_bytes FROM e),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM s WHERE shard_bytes <= {SHARD_BYTES})
        SELECT doc_id, bytes, depth, bucket, CAST(0 AS BIGINT) AS page, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM f WHERE k = 1""",
    "op6_near_dup": _similar(5, 75, ", m = doc_id AS kept"),
    "op13_set_join": _similar(4, 85, ""),
    "op10_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} FROM documents), b AS (SELECT item_id, {_WORDS} FROM benchmark),
        x AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + 9], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        y AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM x))),
        h AS (SELECT DISTINCT doc_id, item_id, i, k FROM y JOIN x USING (k, phrase)),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_FOLDED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, len(x) AS k, array_to_string(x, ' ') AS phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i:i])) AS x FROM w
              UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) FROM w UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) FROM w) GROUP BY ALL),
        t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS x FROM g WHERE k > 1 AND f >= 10),
        cut AS (SELECT *, array_to_string(x[1:j], ' ') AS pl, array_to_string(x[j + 1:], ' ') AS pr FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
        s AS (SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
              FROM cut JOIN g l ON l.lang = cut.lang AND l.phrase = pl JOIN g r ON r.lang = cut.lang AND r.phrase = pr),
        low AS (SELECT lang, phrase, a, arg_min({{'l': l, 'r': r, 'score': score}}, score * 10 + j) AS b FROM s GROUP BY ALL),
        held AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
        o AS (SELECT low.lang, low.phrase, a, b.l AS l, b.r AS r, b.score AS score, row_number() OVER (PARTITION BY low.lang ORDER BY b.score DESC, a DESC, low.phrase) AS rank
              FROM low LEFT JOIN held ON held.lang = low.lang AND held.phrase = low.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000""",
}
