"""Stupid-backoff scores (Brants et al., 2007) from n-gram counts of the whole corpus, as joins.

The n-grams of all orders are counted with a groupBy on their hashes: a table of counts, partitioned by
hash, without the n-grams of a single document, which no other document can ask for. Then each document
explodes to one row for each distinct n-gram of the highest order. A row joins the table of its order; if
the n-gram isn't there it goes on to the order below with its last words, and if it is, to the count of
its context. What is found is summed per document.

An n-gram with at least 1 / `hot` of all words is hot. There are at most `hot` of each order, so their
counts are broadcast and settled while exploding; only the others are joined, and none of those can
make up more than 1 / `hot` of the rows. Documents are joined in `portions` by a hash of their ids, which
bounds what is shuffled at once; the files of a portion's shuffles go when it is written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarena.llm.common import chain, few_texts, save, text_slices, word_hashes

ORDER = 2
BACKOFF = 0.4
HOT = 1_000_000
PORTIONS = 4
SCALE = 1_000_000
SLICE_BYTES = 1 << 20  # text that a task hashes at once
COUNT_WORDS = 1 << 18  # words whose n-grams a task sums before Spark does


def _grams(raw: np.ndarray, offs: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """([hash of the n-gram that ends at each word, for n = 1..order; 0 where the text is too short], index of each word's text)."""
    word, doc = word_hashes(raw, offs)
    out = []
    for n in range(1, order + 1):
        g = np.zeros(len(word), np.uint64)
        if len(word) >= n:
            g[n - 1 :] = chain([word[j : len(word) - n + 1 + j] for j in range(n)])
            g[n - 1 :][doc[n - 1 :] != doc[: len(word) - n + 1]] = 0
        out.append(g)
    return out, doc


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def ngram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(n, gram, c) of the n-grams of two documents or more in texts (text); n = 0 has the number of all words."""

    def summed(held: list[tuple[list[np.ndarray], np.ndarray]]) -> pa.RecordBatch:
        base = np.cumsum([0, *(doc[-1] + 1 for _, doc in held)])
        doc = np.concatenate([d + b for (_, d), b in zip(held, base[:-1], strict=True)])
        parts = [(0, np.zeros(1, np.int64), np.array([len(doc)]), np.array([2]))]
        for n in range(order):
            g = np.concatenate([grams[n] for grams, _ in held])
            live = g != 0
            g, d = g[live], doc[live]
            at = np.argsort(g, kind="stable")
            g, d = g[at], d[at]
            first = _starts(g) if len(g) else np.empty(0, np.int64)
            pairs = np.searchsorted(_starts(g, d), np.append(first, len(g))) if len(g) else np.zeros(1, np.int64)
            parts.append((n + 1, g[first].view(np.int64), np.diff(np.append(first, len(g))), np.diff(pairs)))
        n = np.concatenate([np.full(len(g), n, np.int32) for n, g, _, _ in parts])
        return pa.RecordBatch.from_arrays([pa.array(n), *(pa.array(np.concatenate([p[i] for p in parts])) for i in (1, 2, 3))], names=["n", "gram", "c", "docs"])

    def run(batches):
        held, words = [], 0
        for batch in batches:
            for _, _, raw, offs in text_slices(batch.column(0), limit=SLICE_BYTES):
                grams, doc = _grams(raw, offs, order)
                if len(doc):
                    held.append((grams, doc))
                    words += len(doc)
                if words >= COUNT_WORDS:
                    yield summed(held)
                    held, words = [], 0
        if held:
            yield summed(held)

    # tasks have summed what they hold already: another sum before the shuffle would find few equal n-grams
    counted = rows.select("text").mapInArrow(run, "n int, gram long, c long, docs long").repartition("gram").groupBy("n", "gram")
    return counted.agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")).where("docs > 1").select("n", "gram", "c")


def _chain_columns(order: int) -> list[str]:
    """For j < order: the n-gram of the last j words and the context of the (j + 1)-gram, each as hash and count.

    The hash is null if the n-gram is hot: the count is then what the other documents have of it, else
    it is the document's own, to be taken off the corpus's.
    """
    return [f"{c}{j}" for j in range(1, order) for c in ("suffix", "suffix_n", "context", "context_n")]


def exploded(rows: DataFrame, order: int, backoff: float, hot, total: int) -> DataFrame:
    """Of each document (doc_id, d, text) a row with o = 0 and the sum of what is settled, and a row for each n-gram that is to be joined.

    d names the document by a hash; o is the order of n-gram g and own how often it occurs in the document.
    Only a row with o = 0 has doc_id and micro. An n-gram of the highest order scores own words, a shorter one
    (at the start of a text) one word.
    """
    names = ["d", "n_words", "o", "g", "own", "doc_id", "micro", *_chain_columns(order)]
    schema = ", ".join(f"{c} {'int' if c == 'o' else 'long'}" for c in names)

    def run(batches):
        tables = hot.value
        for batch in batches:
            for first, last, raw, offs in text_slices(batch.column(2), limit=SLICE_BYTES):
                ids, d = batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first)
                grams, doc = _grams(raw, offs, order)
                texts = last - first
                n_words = np.bincount(doc, minlength=texts)
                place = np.arange(len(doc)) - (np.cumsum(n_words) - n_words)[doc]
                own = []
                for g in grams:
                    live = np.flatnonzero(g)
                    key = chain([doc[live].astype(np.uint64), g[live]])
                    by = np.argsort(key)
                    starts = _starts(key[by]) if len(by) else np.empty(0, np.int64)
                    size = np.diff(np.append(starts, len(by)))
                    n = np.zeros(len(g), np.int64)
                    n[live[by]] = np.repeat(size, size)
                    own.append(n)
                at = np.sort(np.concatenate((live[by[starts]], np.flatnonzero(place < order - 1))))
                top = np.minimum(place[at] + 1, order)

                def others(n: int, where: np.ndarray) -> np.ndarray:
                    """What the other documents have of the n-grams that end there, if hot; else -1."""
                    keys, counts = tables[n - 1]
                    if not len(keys):
                        return np.full(len(where), -1)
                    g = grams[n - 1][where]
                    i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                    return np.where(keys[i] == g, counts[i] - own[n - 1][where], -1)

                rest = {n: others(n, at) for n in range(1, order + 1)}
                before = {n: others(n, np.maximum(at - 1, 0)) for n in range(1, order)}
                score, done = np.zeros(len(at)), np.zeros(len(at), bool)
                for n in range(1, order + 1):
                    here = (top == n) & (rest[n] >= 0)
                    done |= here
                    if n == 1:
                        score[here] = np.log((rest[1][here] + 1) / (total - n_words[doc[at[here]]] + 1))
                    else:
                        score[here] = np.log(rest[n][here] / before[n - 1][here])
                m = np.where(top == order, own[-1][at], 1)
                settled = np.bincount(doc[at], weights=np.where(done, m * np.rint(score * SCALE), 0), minlength=texts).astype(np.int64)
                i, top = at[~done], top[~done]
                owner = doc[i]
                level = lambda arrays: np.choose(top - 1, [a[i] for a in arrays]) if len(i) else np.empty(0, np.int64)
                cells = [d.take(pa.array(owner)), n_words[owner], top.astype(np.int32), level([g.view(np.int64) for g in grams]), level(own), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64())]
                ends = [d, n_words, np.zeros(texts, np.int32), d, np.zeros(texts, np.int64), ids, settled]
                for j in range(1, order):
                    for known, where in ((rest[j][~done], i), (before[j][~done], np.maximum(i - 1, 0))):
                        cells.append(pa.array(grams[j - 1][where].view(np.int64), mask=(known >= 0) | (top <= j)))
                        cells.append(np.where(known >= 0, known, own[j - 1][where]))
                ends += [pa.nulls(texts, pa.int64())] * (4 * (order - 1))
                for part in (ends, cells):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in part], names=names)

    return rows.select("doc_id", "d", "text").mapInArrow(run, schema)


def _level(rows: DataFrame, counts: DataFrame, o: int, backoff: float, total: int) -> DataFrame:
    """rows after the join with the table of order o: summed (o = 0), or to be joined with a lower order.

    A row whose num is set has found its n-gram, in num places of other documents, and looks up the context.
    """
    table = counts.where(F.col("n") == o).select(F.col("gram").alias("g"), "c")
    col = F.col
    here, found, rest = col("o") == o, col("c").isNotNull(), col("c") - col("own")
    value = lambda x, order: F.rint(F.lit(SCALE) * (x + F.lit(math.log(backoff)) * (col("top") - F.lit(order)))).cast("long")
    word = lambda n: F.log((n + 1) / (F.lit(total) - col("n_words") + 1))
    score = F.when(here & col("num").isNotNull(), value(F.log(col("num") / rest), o + 1))
    if o == 1:
        score = score.when(here, value(word(F.coalesce(rest, F.lit(0))), 1))
        to: dict[str, Column] = {}
    else:
        suffix, n_suffix, context, n_context = (col(f"{c}{o - 1}") for c in ("suffix", "suffix_n", "context", "context_n"))
        score = score.when(here & found & context.isNull(), value(F.log(rest / n_context), o))
        lower = value(word(n_suffix), 1) if o == 2 else value(F.log(n_suffix / col(f"context_n{o - 2}")), o - 1)
        score = score.when(here & ~found & suffix.isNull(), lower)
        to = {"g": F.when(found, context).otherwise(suffix), "own": F.when(found, n_context).otherwise(n_suffix), "num": F.when(found, rest)}
    wait = (col("o") > 0) & ~here
    moved = here & score.isNull()
    out = {
        "micro": F.when(here, score * col("m")).otherwise(col("micro")),
        "m": F.when(moved | wait, col("m")).when(col("o") == 0, 1).otherwise(0),
        "o": F.when(moved, o - 1).otherwise(F.when(wait, col("o")).otherwise(0)),
        "top": F.when(moved | wait, col("top")),
    }
    for c, kind in (("g", "long"), ("own", "long"), ("num", "long")):
        out[c] = F.when(moved, to[c] if to else F.lit(None).cast(kind)).when(wait, col(c))
    below = [f"{c}{j}" for j in range(1, o - 1) for c in ("suffix", "suffix_n", "context", "context_n")]
    out |= {c: F.when(moved | wait, col(c)) for c in below}
    keys = ["d", "n_words", "o", "top", "g", "own", "num", *below]
    rows = rows.join(table, "g", "left").select("d", "n_words", "doc_id", *(e.alias(c) for c, e in out.items()))
    return rows.groupBy(*keys).agg(F.max("doc_id").alias("doc_id"), F.sum("micro").alias("micro"), F.sum("m").alias("m"))


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, hot: int = HOT, portions: int = PORTIONS) -> DataFrame:
    """doc_id, n_words, score_micro of each document; the mean log score of a word is score_micro / n_words / 1e6.

    Counts are those of all documents, without the document's own (so no text vouches for itself). With
    c the count of an n-gram, the score of a word after its context is c(context word) / c(context) if
    both counts are positive, else backoff times the score with a context shorter by one; a single word
    has (c(word) + 1) / (N + 1), N all words but the document's own. Natural logs are rounded to millionths,
    so that sums don't depend on their order. score_micro is 0 for a text without words; null texts
    are empty; rows that repeat a doc_id are documents of their own, also with one text (documents are
    told apart by 64-bit hashes of id and text, and their words). A text of any length is one row of a task. An empty table gives an empty one. Extra columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with few_texts(spark):
        counts = save(ngram_counts(rows, order), "ngram-counts")
    total = (counts.where("n = 0").first() or {"c": 0})["c"]
    often = counts.where((F.col("n") > 0) & (F.col("c") >= F.lit(max(total, 1) / hot))).orderBy("gram").toPandas()  # at most hot of each order
    tables = [often[often["n"] == n] for n in range(1, order + 1)]
    tables = [(t["gram"].to_numpy().view(np.uint64), t["c"].to_numpy()) for t in tables]
    tables = [(k[by], c[by]) for k, c in tables for by in [np.argsort(k)]]
    shared = spark.sparkContext.broadcast(tables)
    rows = rows.withColumn("d", F.xxhash64("doc_id", "text"))
    out = None
    for p in range(portions):
        some = rows.where(F.pmod(F.xxhash64("d"), F.lit(portions)) == p)
        m = F.when(F.col("o") == order, F.col("own")).otherwise(F.lit(1))
        todo = exploded(some, order, backoff, shared, total).withColumns({"num": F.lit(None).cast("long"), "top": F.col("o"), "m": m})
        done = None
        for o in range(order, 0, -1):
            with few_texts(spark):
                joined = save(_level(todo, counts, o, backoff, total), "ngram-rows")
            ended = joined.where("o = 0").select("d", "n_words", "doc_id", "micro", "m")
            done = ended if done is None else done.unionAll(ended)
            todo = joined.where("o > 0")
        # a row with o = 0 comes from each copy of a document, and copies have equal sums
        whole = done.groupBy("d", "n_words").agg(F.max("doc_id").alias("doc_id"), F.sum("micro").alias("micro"), F.sum("m").alias("copies"))
        each = whole.select("doc_id", "n_words", F.expr("micro div copies").alias("score_micro"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        part = save(each.select("doc_id", "n_words", "score_micro"), "ngram-scores")
        out = part if out is None else out.unionAll(part)
    return out
