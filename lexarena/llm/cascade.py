"""Quality rules as a short-circuit cascade, in Spark expressions only.

Each rule is a Column that says whether a text is rejected. measure() times every rule on a sample and
counts which rules reject the same texts; the cascade asks the rules in the order that rejects most
per second among the texts that the rules before have let through, and CASE stops at the first that
rejects. A text is split into words once, for all rules. The order changes the work, never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarena.llm.common import save

SPACE = r"[\x20\x09-\x0D]+"
TRIM = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 4_000
REPEATS = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where the optimiser would copy its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(TRIM))


def words(text: Column) -> Column:
    """The words of a text; none for null or white space."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.translate(F.coalesce(text.cast("string"), F.lit("")), TRIM, "")).cast("long")


def n_chars_of(text: Column, chars: str) -> Column:
    """How often any of some ASCII characters occurs."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(TRIM)) != "")


def line_counts(text: Column) -> Column:
    """struct(n_dup_lines, n_lines): lines that hold a word and equal an earlier line, and lines that hold a word."""
    return let(lines(text), lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines")))


def n_repeat_words(w: Column, n: int = 3) -> Column:
    """Words inside n-word windows that occur at least twice among the words w, the first occurrence included.

    Windows are compared by 64-bit hashes. Only a text with an equal pair sorts (hash, position); the
    sum over repeated windows of min(n, distance from the one before) is the number of words they cover.
    """

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, n))))
        return F.slice(hashes, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda e, other: F.coalesce(other["h"] == e["h"], F.lit(False))
            return F.filter(s, lambda e, i: same(e, F.get(s, i - 1)) | same(e, F.get(s, i + 1)))

        at = F.array_sort(F.transform(let(placed, repeated), lambda e: e["i"]))
        zero = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum"))
        step = lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(n), i - a["last"])).alias("sum"))
        return F.aggregate(at, zero, step, lambda a: a["sum"])

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)

    return let(windows(w), count).cast("long")


def n_shouts(text: Column) -> Column:
    """Runs of two or more capital letters."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\p{Lu}{2,}")).cast("long")


@dataclass(frozen=True)
class Rule:
    """A named rule; reject says of the measures (name -> Column) whether the text is rejected."""

    name: str
    reject: Callable[[dict[str, Column]], Column]


def measures(text: Column, w: Column) -> dict[str, Column]:
    """The measures of a text with words w. Each is an expression of its own: what no rule asks for is not computed."""
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": word_chars(text),
        "n_symbols": n_chars_of(text, SYMBOLS),
        "line_counts": line_counts(text),
        "n_repeat_words": n_repeat_words(w),
        "n_exclaims": n_chars_of(text, "!"),
        "n_shouts": n_shouts(text),
    }


RULES = (
    Rule("short", lambda m: m["n_words"] < 50),
    Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    Rule("duplicate_lines", lambda m: let(m["line_counts"], lambda c: 100 * c["n_dup_lines"] > 30 * c["n_lines"])),
    Rule("word_length", lambda m: let(m["word_chars"], lambda c: (c < 2 * m["n_words"]) | (c > 15 * m["n_words"]))),
    Rule("exclaims", lambda m: 100 * m["n_exclaims"] > 30 * m["n_words"]),
    Rule("shouting", lambda m: 100 * m["n_shouts"] > 30 * m["n_words"]),
)
BASE = ("short", "repeats")


@dataclass(frozen=True)
class Measured:
    """Seconds of each rule on the sample, and how many of its texts each set of rules (bits, in the rules' order) rejects."""

    rules: tuple[Rule, ...]
    seconds: tuple[float, ...]
    rejected: dict[int, int]


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> Measured:
    """Costs and rejections on a random sample of about `rows` documents; they only set the order of the rules.

    The sample is written once, with its words, as those are split for all rules alike. One job asks a text
    every rule in turn and reads the clock before and after each, so all rules meet the same texts in the
    same warm code; it runs REPEATS times, and a rule's cost is its least sum of a run after the first.
    The same job counts the sets of rules that reject a text.
    """
    total = docs.count()
    sample = docs.select(F.col("text").cast("string").alias("text")).sample(fraction=min(1.0, rows / max(total, 1)), seed=4)
    sample = save(sample.withColumn("w", words(F.col("text"))), "rule-sample")
    m = measures(F.col("text"), F.col("w"))
    clock = lambda: F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")  # noqa: E731 - evaluated for each row
    steps = [clock()]
    for rule in rules:
        steps += [F.coalesce(rule.reject(m), F.lit(False)).cast("long"), clock()]
    asked = sample.select(F.array(*steps).alias("t"))
    bits = sum((F.get("t", F.lit(2 * i + 1)) * (1 << i) for i in range(len(rules))), F.lit(0).cast("long"))
    nanos = [F.sum(F.get("t", F.lit(2 * i + 2)) - F.get("t", F.lit(2 * i))).alias(f"s{i}") for i in range(len(rules))]
    counted = asked.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"), *nanos)
    runs = [counted.collect() for _ in range(REPEATS)]  # at most 2 ** rules rows
    seconds = (min(sum(r[f"s{i}"] for r in run) for run in runs[1:]) / 1e9 for i in range(len(rules)))
    return Measured(rules, tuple(max(x, 1e-9) for x in seconds), {r["bits"]: r["n"] for r in runs[0]})


def ordered(measured: Measured) -> list[Rule]:
    """The rules by rejection per cost among the texts that the rules before let through; ties by cost, then name."""
    left, left_texts, out = list(range(len(measured.rules))), dict(measured.rejected), []
    while left:
        hit = {i: sum(n for bits, n in left_texts.items() if bits >> i & 1) for i in left}
        best = min(left, key=lambda i: (-hit[i] / measured.seconds[i], measured.seconds[i], measured.rules[i].name))
        left.remove(best)
        left_texts = {bits: n for bits, n in left_texts.items() if not bits >> best & 1}
        out.append(measured.rules[best])
    return out


def rejected_by(order: list[Rule], m: dict[str, Column]) -> Column:
    """The first rule of the order that rejects, or null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(rule.reject(m), F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the base measures, base_failed, rejected_by and kept.

    A null or empty text has no words, so it fails the rule on short texts; a text of any length is measured
    whole; an empty table stays empty. Columns of docs of the same names are replaced, other columns and
    repeated rows stay. rejected_by is the first of the measured order, so it may differ between runs
    where several rules reject; kept doesn't.
    """
    order = ordered(measure(docs, rules))
    text = F.col("text")
    whole = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words")))
    out = docs.withColumns({"_w": whole, "_l": line_counts(text)})
    base = {"n_words": F.col("_w.n_words"), "word_chars": word_chars(text), "n_symbols": n_chars_of(text, SYMBOLS), "n_dup_lines": F.col("_l.n_dup_lines"), "n_repeat_words": F.col("_w.n_repeat_words")}
    out = out.withColumns(base)
    known = measures(text, F.array()) | {n: F.col(n) for n in base} | {"line_counts": F.col("_l")}
    failed = F.lit(False)
    for rule in (r for r in rules if r.name in BASE):
        failed = failed | rule.reject(known)
    out = out.withColumns({"base_failed": failed, "rejected_by": rejected_by(order, known)})
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop("_w", "_l")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, columns unchanged; a rule's measures are computed only where it is asked."""
    order = ordered(measure(docs, rules))
    text = F.col("text")
    return docs.where(let(words(text), lambda w: rejected_by(order, measures(text, w))).isNull())
