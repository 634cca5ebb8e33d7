"""Quality by the perplexity of an interpolated modified Kneser-Ney model (operator 2).

The model runs over UTF-8 bytes, ``ORDER`` of them in a key, so a key is an exact
integer, its context is the key without the last byte and its suffix the key
without the first.  It is trained on the texts that labels call good.

Training counts keys of the highest order in each task, sums them by key, and
works down by joins that are dealt by key: continuation counts (types per
suffix), counts of counts for the three discounts of an order, sums per context,
and from the lowest order up ``p = (c - d(c)) / sum + gamma(context) * p(suffix)``.

Scoring takes the longest known key at each byte and the gammas of the longer
contexts passed over.  While the tables have at most ``TABLE_ROWS`` rows (checked
by a count) every task holds them as sorted arrays; larger ones stay dealt out:
the distinct keys of all documents meet the tables in joins, then the keys of each
document meet their values.  Both ways use the same numbers in double precision,
rounded alike, so a document scores the same whichever way is taken.

Trusted texts are found by a join on ids.  A bitmap of their hashes, of ``FILTER_BITS`` bits
whatever their number, goes to every task first and leaves most other texts out of
the exchange.

A fifth of the trusted documents (by a hash of the key) stays out of training and
sets the limits, since texts that were trained on look too easy: ``verdicts`` keeps
a document whose perplexity is at most the ``QUANTILE`` of that fifth in its language.
The quantile is exact over perplexities in thousandths, so runs agree on it.

Results for odd input: null and empty texts have no perplexity and are not kept; a
null language is one of its own; a language with fewer than ``LEAST`` documents in that
fifth uses the quantile over all languages; without any trusted text all bytes are
equally likely and all other texts stay; repeated rows are scored each, and train
each; a repeated label counts once, and a document is trusted if any of its labels
says so; very long texts count whole; columns of other names are ignored by ``verdicts``
and carried by ``score``, which replaces columns named like its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evigrid.session import ship, stored

ORDER, TABLE_ROWS, QUANTILE, LEAST = 5, 4_000_000, 0.99, 20
BUFFER, FILTER_BITS, DIGITS = 4 << 20, 1 << 26, 6


def keys(text: str | None) -> np.ndarray:
    """The key that ends at each byte; the text is preceded by zero bytes."""
    data = np.frombuffer(b"\0" * (ORDER - 1) + (text or "").encode(), np.uint8).astype(np.int64)
    n = len(data) - ORDER + 1
    out = np.zeros(n, np.int64)
    for i in range(ORDER):
        out = (out << 8) | data[i : i + n]
    return out


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, c) of the highest order over all texts, summed in each task before the exchange."""
    ship(docs.sparkSession)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(keys(t.as_py()))
                size += len(held[-1])
                if size >= BUFFER:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    def out(held):
        k, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["key", "c"])

    return docs.select(text).mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _discounts(types: DataFrame) -> list[float]:
    """D1, D2, D3+ of an order from its counts of counts."""
    r = types.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5))).first()
    n = [0, *(r[f"n{i}"] for i in range(1, 5))]
    if not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in (1, 2, 3)]
    return [min(max(x, 0.05), 0.95 * i) for i, x in zip((1, 2, 3), d)]


def train(trusted: DataFrame, text: str = "text") -> DataFrame:
    """The model: (ord, key, logp) of known keys and (ord, key, loggamma) of known contexts."""
    orders = {ORDER: stored(counts(trusted, text))}
    for k in range(ORDER - 1, 0, -1):  # a shorter key counts the longer types it ends
        orders[k] = stored(orders[k + 1].groupBy(F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).agg(F.count(F.lit(1)).alias("c")))
    below, parts = None, []
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(orders[k])
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = orders[k].select("key", "c", F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("suffix"))
        ctx = stored(rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(off).alias("off")).select("ctx", "total", (F.col("off") / F.col("total")).alias("gamma")))
        rows = rows.join(ctx, "ctx")
        rows = rows.withColumn("lower", F.lit(1 / 256)) if below is None else rows.join(below.select(F.col("key").alias("suffix"), F.col("p").alias("lower")), "suffix")
        below = stored(rows.select("key", ((F.col("c") - off) / F.col("total") + F.col("gamma") * F.col("lower")).alias("p")))
        parts += [below.select(F.lit(k).alias("ord"), "key", F.log("p").alias("logp"), F.lit(None).cast("double").alias("loggamma")), ctx.select(F.lit(k).alias("ord"), F.col("ctx").alias("key"), F.lit(None).cast("double").alias("logp"), F.log("gamma").alias("loggamma"))]
    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    return stored(model)


def _lookup(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Values of the keys, NaN where unknown."""
    known, values = table
    if not len(known):
        return np.full(len(wanted), np.nan)
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return np.where(known[at] == wanted, values[at], np.nan)


def _logp(tables: dict, k: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(len(k)), np.arange(len(k))
    for order in range(ORDER, 0, -1):
        own = k[rest] & ((1 << 8 * order) - 1)
        p = _lookup(tables[order, "logp"], own)
        known = ~np.isnan(p)
        out[rest[known]] += p[known]
        rest, own = rest[~known], own[~known]
        if not len(rest):
            return out
        out[rest] += np.nan_to_num(_lookup(tables[order, "loggamma"], own >> 8))
    out[rest] += math.log(1 / 256)
    return out


def score(docs: DataFrame, model: DataFrame, text: str = "text", table_rows: int = TABLE_ROWS) -> DataFrame:
    """All columns of ``docs`` with n_bytes and perplexity added (replacing columns of these names)."""
    return _held(docs, model, text) if model.count() <= table_rows else _dealt(docs, model, text)


def _held(docs: DataFrame, model: DataFrame, text: str) -> DataFrame:
    spark = ship(docs.sparkSession)
    tables = {}
    for order in range(1, ORDER + 1):
        for name in ("logp", "loggamma"):
            t = model.where((F.col("ord") == order) & F.col(name).isNotNull()).select("key", name).toArrow()
            k, v = t.column(0).to_numpy(), t.column(1).to_numpy()
            at = np.argsort(k)
            tables[order, name] = (k[at], v[at])
    shared = spark.sparkContext.broadcast(tables)
    rest = [c for c in docs.columns if c not in ("n_bytes", "perplexity", text)]
    schema = docs.select(text, *rest).schema.add("n_bytes", "long").add("perplexity", "double")

    def run(batches):
        t = shared.value
        for b in batches:
            n, ppl = [], []
            for x in b.column(0):
                k = keys(x.as_py())
                n.append(len(k))
                ppl.append(round(math.exp(-_logp(t, k).sum() / len(k)), DIGITS) if len(k) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(ppl, pa.float64())], names=schema.names)

    return docs.select(text, *rest).mapInArrow(run, schema)


def _dealt(docs: DataFrame, model: DataFrame, text: str) -> DataFrame:
    """The same by joins: the distinct keys of all documents against each order's table, then each document's keys against those."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("n_bytes", "perplexity")]
    rows = stored(docs.select(*rest).select(F.struct(*(F.col(c) for c in rest)).alias("_doc"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text")))

    def run(batches):
        for b in batches:
            for r, x in zip(b.column(0).to_pylist(), b.column(1)):
                k, n = np.unique(keys(x.as_py()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), r, np.int64)), pa.array(k), pa.array(n.astype(np.int64))], names=["_row", "key", "n"])

    found = stored(rows.select("_row", "_text").mapInArrow(run, "_row long, key long, n long"))
    known = found.select("key").distinct()
    p: Column = F.lit(math.log(1 / 256))
    for order in range(1, ORDER + 1):
        mine = F.col("key").bitwiseAND((1 << 8 * order) - 1)
        logp = model.where((F.col("ord") == order) & F.col("logp").isNotNull()).select(F.col("key").alias(f"_k{order}"), F.col("logp").alias(f"_p{order}"))
        gamma = model.where((F.col("ord") == order) & F.col("loggamma").isNotNull()).select(F.col("key").alias(f"_c{order}"), F.col("loggamma").alias(f"_g{order}"))
        known = known.join(logp, mine == F.col(f"_k{order}"), "left").join(gamma, F.shiftright(mine, 8) == F.col(f"_c{order}"), "left")
        p = F.coalesce(F.col(f"_p{order}"), F.coalesce(F.col(f"_g{order}"), F.lit(0.0)) + p)
    known = stored(known.select("key", p.alias("p")))
    sums = found.join(known, "key").groupBy("_row").agg(F.sum("n").alias("n_bytes"), F.round(F.exp(-F.sum(F.col("n") * F.col("p")) / F.sum("n")), DIGITS).alias("perplexity"))
    return rows.select("_row", "_doc").join(sums, "_row", "left").select("_doc.*", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "perplexity")


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose _key is one of ids: bits of hashes first, then an exact join."""
    place = F.pmod(F.xxhash64("_key"), F.lit(FILTER_BITS))
    bits = ids.groupBy(F.shiftright(place, 15).alias("_part")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("_bits"))
    at = place.bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = rows.withColumn("_part", F.shiftright(place, 15)).join(F.broadcast(bits), "_part").where(F.getbit(byte.cast("long"), at.bitwiseAND(7).cast("int")) == 1)
    return likely.drop("_part", "_bits").join(ids.hint("merge"), "_key", "left_semi")


def verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality") -> DataFrame:
    """key, language, n_bytes, perplexity, threshold of the language, kept."""
    trusted = labels.where(F.col(label) == 1).select(F.col(key).alias("_key")).distinct().withColumn("_good", F.pmod(F.xxhash64("_key"), F.lit(5)) == 0)
    base = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.col(text).alias("_text"))
    model = train(_among(base, trusted.where("not _good").select("_key")), "_text")
    # only the numbers are kept, so the second reading of the corpus is the last
    scored = stored(score(base, model, "_text").select("_key", "_lang", "n_bytes", "perplexity").join(trusted, "_key", "left"))
    limit = F.percentile(F.round("perplexity", 3), F.lit(QUANTILE))  # exact: thousandths take few values
    good = scored.where("_good and perplexity is not null")
    own = good.groupBy("_lang").agg(limit.alias("_own"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST).select("_lang", "_own")
    whole = good.agg(limit.alias("all")).first()["all"]  # one number
    out = scored.join(own, "_lang", "left").withColumn("threshold", F.coalesce("_own", F.lit(whole).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.round("perplexity", 3) <= F.col("threshold"), F.lit(True))
    return out.select(F.col("_key").alias(key), F.col("_lang").alias(lang), "n_bytes", "perplexity", "threshold", kept.alias("kept"))
