"""Toxicity from two Kneser-Ney bigram models, one of toxic and one of ordinary texts.

Words are the letters and digits of a text in lower case. Each class has interpolated Kneser-Ney counts
of its own: bigrams back off to words, words to their stems (the first STEM bytes, as inflected and compound
words of one stem are many and each of them rare), and both classes' stems to the continuation counts of the
two together, so a rare expression weighs only by what its class adds. A word that neither class has
shown weighs as its stem does. A text's evidence is the difference of the two log-likelihoods,
divided by length: over the whole text and, as toxic expressions are short, the largest over windows of
1, 4, 16 and 64 words. A logistic curve fitted on labelled texts that the counts have not seen turns
these into a score, and the same texts choose the discount (a large one leaves expressions that a class
has shown a few times only to the shared counts) and the point of the curve that scores 0.5: the one
with the highest F1.

The models are fitted on a bounded sample of labelled texts (TRAIN_DOCS of each class at most, by hash
of doc_id) with all their bigrams. What is broadcast grows with the bigrams of that sample, not with
the table: about 12 bytes a bigram and 16 a word, one discount at a time. Scoring reads whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarena.llm.common import chain, save, text_slices, word_hashes
from lexarena.llm.decontam import _ALNUM

TRAIN_DOCS = 8_000
WINDOWS = (1, 4, 16, 64)
DISCOUNTS = (0.75, 1.5, 3.0, 6.0, 12.0)
STEM = 6  # bytes of a word that it shares with the words of its stem
FIT_SHARE = 4  # one labelled text in this many fits the curve, the others the counts
CHUNK = 1 << 20  # bigrams that the driver's arithmetic takes at once
PARTS = 8  # in which the counts come to the driver


def _clean(raw: np.ndarray) -> np.ndarray:
    """Letters and digits in lower case (A-Z, Latin-1), everything else a space."""
    out = np.where(_ALNUM[raw], raw, np.uint8(32))
    if len(out) > 1:
        high = np.zeros(len(out), bool)
        high[1:] = out[:-1] == 0xC3
        high &= (out >= 0x80) & (out <= 0x9E) & (out != 0x97)
        out = np.where(high, out + np.uint8(0x20), out)
    return out


def _ngrams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before or 0 at a text's start, bigram, index of its text) of every word."""
    word, doc = word_hashes(_clean(raw), offs)
    before = np.zeros_like(word)
    if len(word) > 1:
        same = doc[1:] == doc[:-1]
        before[1:] = np.where(same, word[:-1], np.uint64(0))
    return word, before, chain([before, word]), doc


def _stems(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The stem of every word: a hash of its first STEM bytes."""
    return word_hashes(_clean(raw), offs, most=STEM)[0]


def _counts(texts: DataFrame) -> DataFrame:
    """(before, word, stem, ordinary, toxic) of every bigram, summed over texts (text, toxic)."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy()
            for first, _, raw, offs in text_slices(batch.column(0)):
                word, before, both, doc = _ngrams(raw, offs)
                if not len(word):
                    continue
                toxic = label[first + doc] == 1
                _, at, back = np.unique(both, return_index=True, return_inverse=True)
                n1 = np.bincount(back, weights=toxic, minlength=len(at)).astype(np.int64)
                n0 = np.bincount(back, weights=~toxic, minlength=len(at)).astype(np.int64)
                cells = [before[at].view(np.int64), word[at].view(np.int64), _stems(raw, offs)[at].view(np.int64), n0, n1]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["before", "word", "stem", "ordinary", "toxic"])

    rows = texts.select("text", "toxic").mapInArrow(run, "before long, word long, stem long, ordinary long, toxic long")
    return rows.groupBy("before", "word").agg(F.max("stem").alias("stem"), F.sum("ordinary").cast("int").alias("ordinary"), F.sum("toxic").cast("int").alias("toxic"))


def _fetched(counts: DataFrame) -> list[np.ndarray]:
    """The columns of a table of counts, brought over in PARTS parts, so that no second copy of the whole is held."""
    counts = save(counts, "toxicity-counts")
    n, at = counts.count(), 0
    out = [np.empty(n, np.int32 if kind == "int" else np.int64) for _, kind in counts.dtypes]
    for p in range(PARTS):
        t = counts.where(F.pmod(F.xxhash64("before", "word"), F.lit(PARTS)) == p).toArrow()
        for a, c in zip(out, t.column_names, strict=True):
            a[at : at + t.num_rows] = t.column(c).to_numpy()
        at += t.num_rows
    return out


def _chunks(n: int) -> list[slice]:
    return [slice(i, i + CHUNK) for i in range(0, n, CHUNK)]


class Index:
    """The counted bigrams in order of their hashes, and their words; the models of all discounts share it."""

    def __init__(self, counts: DataFrame):
        before, word, stem, *n = _fetched(counts)
        before, word, stem = before.view(np.uint64), word.view(np.uint64), stem.view(np.uint64)
        self.words = np.union1d(np.unique(word), np.unique(before))
        self.bigrams = np.empty(len(word), np.uint64)
        for s in _chunks(len(word)):
            self.bigrams[s] = chain([before[s], word[s]])
        self.word, self.before = self._places(word), self._places(before)
        of = np.zeros(len(self.words), np.uint64)  # a text's start has the stem 0
        of[self.word] = stem
        self.stems, self.stem = np.unique(of, return_inverse=True)
        del before, word, stem, of
        order = np.argsort(self.bigrams).astype(np.int32)
        self.bigrams = self.bigrams[order]
        self.word, self.before = self.word[order], self.before[order]
        self.counts = {c: n[c][order] for c in (0, 1)}

    def _places(self, words: np.ndarray) -> np.ndarray:
        out = np.empty(len(words), np.int32)
        for s in _chunks(len(words)):
            out[s] = np.searchsorted(self.words, words[s])
        return out

    def total(self, at: np.ndarray, weights) -> np.ndarray:
        """Sums by word of weights(slice) over the bigrams' words or words before."""
        out = np.zeros(len(self.words))
        for s in _chunks(len(at)):
            out += np.bincount(at[s], weights=weights(s), minlength=len(out))
        return out


class Model:
    """Log-likelihood ratios of seen bigrams, and of words and contexts for the others."""

    def __init__(self, index: Index, d: float):
        words, w, v, n = index.words, index.word, index.before, index.counts
        pooled = index.total(w, lambda s: None) + 1.0  # distinct contexts in either class, one more for the unseen
        by_stem = lambda x: np.bincount(index.stem, weights=x, minlength=len(index.stems))
        pooled_stem = by_stem(pooled)
        shared = pooled_stem / (pooled_stem.sum() + len(words))
        rest = 1.0 / (pooled_stem.sum() + len(words))
        within = pooled / pooled_stem[index.stem]  # of the words of a stem, in either class
        lower, back, unseen, total, stems = {}, {}, {}, {}, {}
        for c in (0, 1):
            kinds = index.total(w, lambda s: n[c][s] > 0)
            all_kinds = max(kinds.sum(), 1)
            gap = np.minimum(kinds, d).sum() / all_kinds
            kinds_stem = by_stem(kinds)
            gap_stem = np.minimum(kinds_stem, d).sum() / all_kinds
            stems[c] = np.maximum(kinds_stem - d, 0) / all_kinds + gap_stem * shared
            lower[c] = np.maximum(kinds - d, 0) / all_kinds + gap * stems[c][index.stem] * within
            stems[c] = gap * stems[c]
            unseen[c] = gap * gap_stem * rest
            total[c] = index.total(v, lambda s: n[c][s])
            freed = index.total(v, lambda s: np.minimum(n[c][s], d))
            back[c] = np.where(total[c] > 0, freed / np.maximum(total[c], 1), 1.0)
        self.bigrams = index.bigrams
        self.seen = np.empty(len(w), np.float32)
        for s in _chunks(len(w)):
            ratio = [np.maximum(n[c][s] - d, 0) / np.maximum(total[c][v[s]], 1) + back[c][v[s]] * lower[c][w[s]] for c in (0, 1)]
            self.seen[s] = np.log(ratio[1] / ratio[0])
        self.words = words
        self.word = np.log(lower[1] / lower[0]).astype(np.float32)
        self.context = np.log(back[1] / back[0]).astype(np.float32)
        self.stems = index.stems
        self.stem = np.log(stems[1] / stems[0]).astype(np.float32)
        self.unseen = float(np.log(unseen[1] / unseen[0]))

    def evidence(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, features) of each text: mean log-likelihood ratio of the text, largest mean of each window length."""
        word, before, both, doc = _ngrams(raw, offs)
        texts = len(offs) - 1
        n = np.bincount(doc, minlength=texts)
        out = np.zeros((texts, 1 + len(WINDOWS)))
        if not len(word):
            return n, out
        w = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        stem = _stems(raw, offs)
        at = np.minimum(np.searchsorted(self.stems, stem), len(self.stems) - 1)
        s = np.where(self.stems[at] == stem, self.stem[at], np.float32(self.unseen))
        s = np.where(self.words[w] == word, self.word[w], s)
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[0] = 0
        start = before == 0
        v[start] = np.searchsorted(self.words, np.uint64(0))
        known = np.where(start, True, np.append(True, (self.words[w] == word)[:-1]))
        s = s + np.where(known, self.context[np.minimum(v, len(self.words) - 1)], 0)
        b = np.minimum(np.searchsorted(self.bigrams, both), len(self.bigrams) - 1)
        s = np.where(self.bigrams[b] == both, self.seen[b], s).astype(np.float64)
        run = np.concatenate(([0.0], np.cumsum(s)))
        full = np.flatnonzero(n)
        ends = np.cumsum(n)
        at = ends - n
        out[full, 0] = (run[ends] - run[at])[full] / n[full]
        for k, size in enumerate(WINDOWS, 1):
            mean = np.full(len(s), -np.inf)
            i = np.arange(len(s) - size + 1) if len(s) >= size else np.arange(0)
            i = i[doc[i] == doc[i + size - 1]]
            mean[i] = (run[i + size] - run[i]) / size
            top = np.maximum.reduceat(mean, at[full])
            out[full, k] = np.where(np.isfinite(top), top, out[full, 0])
        return n, out


def _features(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, np.log1p(n)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(loss, (mean, scale, coefficients with the intercept last)) by Newton steps with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    beta, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 1.0), 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
    loss = -(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum()
    return loss, (mean, scale, beta)


def _best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit from which on predicting 1 has the highest F1 on the weighted texts; halfway to the next lower one."""
    by = np.argsort(-z, kind="stable")
    z, hit, said = z[by], np.cumsum((weight * y)[by]), np.cumsum(weight[by])
    last = np.append(z[1:] != z[:-1], True)
    f1 = np.where(last, 2 * hit / (said + (weight * y).sum()), -1)
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2 if i + 1 < len(z) else z[i] - 1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """The models and the curve, from labelled documents outside the held-out fold."""
    given = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    given = given.where(~held_out(F.col("doc_id"))).withColumn("mark", F.xxhash64("doc_id", F.lit(8)))
    total = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = total.get(1, 0) / max(sum(total.values()), 1)
    if not total.get(0) or not total.get(1):
        return {"prior": prior}
    drawn = None
    for c in (0, 1):
        some = given.where(F.col("toxic") == c).orderBy("mark", "doc_id").limit(train_docs)
        drawn = some if drawn is None else drawn.unionAll(some)
    texts = docs.join(F.broadcast(drawn), "doc_id")  # at most 2 * train_docs rows
    fits = F.pmod(F.col("mark"), F.lit(FIT_SHARE)) == 0
    index = Index(_counts(texts.where(~fits)))
    if not all(index.counts[c].any() for c in (0, 1)):
        return {"prior": prior}
    spark = docs.sparkSession
    fitting = save(texts.where(fits).select("text", "toxic"), "toxicity-fit")
    names = [f"f{i}" for i in range(1 + len(WINDOWS))]
    curves = []
    for d in DISCOUNTS:
        shared = spark.sparkContext.broadcast(Model(index, d))
        seen = fitting.mapInArrow(_measured(shared, names), "n long, " + ", ".join(f"{f} double" for f in names) + ", toxic int").where("n > 0").toPandas()
        shared.destroy()
        if seen["toxic"].nunique() < 2:
            return {"prior": prior, "model": spark.sparkContext.broadcast(Model(index, DISCOUNTS[0]))}
        y = seen["toxic"].to_numpy().astype(float)
        share = {c: total[c] / (y == c).sum() for c in (0, 1)}
        weight = np.where(y == 1, share[1], share[0])
        weight *= len(y) / weight.sum()
        x = _features(seen["n"].to_numpy(), seen[names].to_numpy())
        loss, (mean, scale, beta) = _logistic(x, y, weight)
        beta[-1] -= _best_cut((x - mean) / scale @ beta[:-1] + beta[-1], y, weight)
        curves.append((loss, (mean, scale, beta)))
    best = min(range(len(curves)), key=lambda i: curves[i][0])
    return {"prior": prior, "model": spark.sparkContext.broadcast(Model(index, DISCOUNTS[best])), "curve": curves[best][1], "discount": DISCOUNTS[best]}


def _measured(shared, names: list[str]):
    """Texts' evidence under one broadcast model, with their labels."""

    def run(batches):
        for batch in batches:
            for first, last, raw, offs in text_slices(batch.column(0)):
                n, x = shared.value.evidence(raw, offs)
                yield pa.RecordBatch.from_arrays([pa.array(n), *(pa.array(x[:, i].copy()) for i in range(x.shape[1])), batch.column(1).slice(first, last - first)], names=["n", *names, "toxic"])

    return run


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs' doc_id with held_out, score and predicted.

    A text without words scores the share of toxic labels, as does every text if a class has no label. A
    text of any length is read whole, and equal texts score alike.
    Labels that repeat a doc_id count as toxic if any of them is; null labels are left out. Rows that
    repeat a doc_id are scored each. A null doc_id is hashed as the empty text. Extra columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fitted = fit(docs, labels, **options)
    prior, shared, curve = fitted["prior"], fitted.get("model"), fitted.get("curve")

    def run(batches):
        for batch in batches:
            if shared is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, prior))], names=["doc_id", "score"])
                continue
            for first, last, raw, offs in text_slices(batch.column(1)):
                n, x = shared.value.evidence(raw, offs)
                if curve is not None:
                    mean, scale, beta = curve
                    z = (_features(n, x) - mean) / scale @ beta[:-1] + beta[-1]
                else:
                    z = x[:, 0] + np.log(prior / (1 - prior))
                p = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), prior)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(p)], names=["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
