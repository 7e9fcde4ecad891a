"""Mixing to target weights: iterative proportional fitting, then Poisson sampling by calibrated probabilities.

Documents are summed into cells (source, language, topic); raking scales the cells' token mass in turn
to each marginal's target shares. A cell's weight over its mass, scaled so that the expected tokens
meet the budget and no probability passes 1, is the probability of each of its documents.

The table of cells may have any size: a step sums it by level before anything is shuffled, and writes it
scaled, so that the next one's plan starts from a file. Raking ends when a round's factors of each
dimension differ by less than a tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarena.llm.cascade import n_words
from lexarena.llm.common import discard, save

DIMS = ("source", "lang", "topic")
ROUNDS = 20
TOLERANCE = 1e-9


def topic_of(text: Column) -> Column:
    """A topic by lexical cues, first match wins: tables, contacts, figures, else prose."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    cue = F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("@")), "contact")
    return cue.when(text.rlike("[0-9]{4}"), "figures").otherwise("prose")


def sample_point(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the document's id and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def flattened(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(level, target): shares in proportion to mass to a power, which lifts rare levels."""
    mass = cells.groupBy(F.col(dim).alias("level")).agg(F.pow(F.sum("mass").cast("double"), F.lit(power)).alias("target"))
    return mass.where("target > 0")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, mass) with weight: shares of the whole, raked to the target shares.

    targets gives (level, target) for each dimension, in any units. A level without a target gets none;
    targets of levels without mass are left out. It takes at most `rounds` rounds; marginals() tells how
    far the weights are from the targets after them.
    """
    weight = F.col("mass").cast("double")
    for dim in DIMS:
        cells = cells.join(targets[dim].select(F.col("level").alias(dim), F.col("target").cast("double").alias(f"t_{dim}")), dim, "left").withColumn(f"f_{dim}", F.lit(1.0))
        weight = F.when(F.coalesce(f"t_{dim}", F.lit(0.0)) > 0, weight).otherwise(0.0)
    state = save(cells.withColumn("weight", weight), "raking")
    columns = state.columns
    for _ in range(rounds):
        for dim in DIMS:  # a table each: a step reads one, sums it by level and scales it
            total = state.where("weight > 0").groupBy(dim).agg(F.sum("weight").alias("total"))
            scaled = state.join(total, dim, "left").withColumn(f"f_{dim}", F.try_divide(f"t_{dim}", "total"))
            before, state = state, save(scaled.withColumn("weight", F.col("weight") * F.coalesce(f"f_{dim}", F.lit(0.0))).select(*columns), "raking")
            discard(before)
        # once a dimension's factors are all alike, its shares are right; weights add up to the last one's targets
        spread = [(F.try_divide(F.max(f"f_{d}"), F.min(f"f_{d}")) - 1) for d in DIMS]
        whole, *spread = state.where("weight > 0").agg(F.sum("weight"), *spread).first()
        if whole is None or max(spread) <= tolerance:
            break
    return state.select(*DIMS, "mass", (F.col("weight") / F.lit(whole or 1.0)).alias("weight"))


def marginals(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dim, level, share, target, residual) of raked cells: the shares of the weights beside those asked for."""
    out = None
    for dim in DIMS:
        got = raked.groupBy(F.col(dim).alias("level")).agg(F.sum("weight").alias("share")).where("share > 0").join(targets[dim], "level")
        whole = got.agg(F.sum("target").alias("whole"))  # one row
        part = got.crossJoin(F.broadcast(whole)).select(F.lit(dim).alias("dim"), "level", "share", (F.col("target") / F.col("whole")).alias("target"))
        part = part.withColumn("residual", F.col("share") - F.col("target"))
        out = part if out is None else out.unionAll(part)
    return out


def scale_for(cells: DataFrame, budget: float) -> float | None:
    """The scale with which the cells' min(mass, scale * weight) add up to the budget; None if all mass isn't more than it.

    It starts from no cell at its mass; each step puts the cells that the scale would take beyond theirs
    at it, and divides what the budget leaves by the weight of the others. The scale only grows, so a
    step that adds no cell is the last, and each is one sum over the cells.
    """
    rows = cells.where("mass > 0 AND weight > 0")
    if (rows.agg(F.sum("mass")).first()[0] or 0) <= budget:
        return None
    scale, full = 0.0, -1
    while True:
        at_mass = F.col("weight") * F.lit(scale) >= F.col("mass")
        n, held, rest = rows.agg(F.count_if(at_mass), F.sum(F.when(at_mass, F.col("mass"))), F.sum(F.when(~at_mass, F.col("weight")))).first()
        if n == full or not rest:
            return scale
        full, scale = n, max(scale, (budget - (held or 0)) / rest)


def probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """cells with probability = min(1, scale * weight / mass), the scale such that the expected tokens are the budget."""
    scale = scale_for(cells, budget)
    ratio = F.col("weight") / F.col("mass")
    p = F.when(F.col("weight") > 0, F.lit(1.0) if scale is None else F.least(F.lit(1.0), F.lit(scale) * ratio)).otherwise(0.0)
    return cells.where("mass > 0").select(*DIMS, "mass", "weight", p.alias("probability"))


def mix_to_targets(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = 0.5, power: float = 0.5, seed: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """docs with topic, n_tokens (words), weight, probability and sampled.

    targets maps a dimension (source, lang, topic) to shares of its levels; a dimension without one is
    flattened: shares in proportion to its token mass to `power`. share is the part of all tokens to
    expect. Null sources and languages are the level ''. A document without words has probability 0 and
    isn't sampled. Rows that repeat a doc_id are sampled together. A text of any length is read whole.
    Columns of docs named like the new ones are replaced. An empty table gives an empty one.
    """
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text = F.col("text")
    rows = docs.withColumns({"_source": level("source"), "_lang": level("lang"), "topic": topic_of(text), "n_tokens": n_words(text)})
    cells = rows.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), "topic").agg(F.sum("n_tokens").alias("mass"))
    cells = save(cells, "cells")
    spark = docs.sparkSession
    goal = {}
    for dim in DIMS:
        given = (targets or {}).get(dim)
        goal[dim] = spark.createDataFrame([(k, float(v)) for k, v in given.items()], "level string, target double") if given else flattened(cells, dim, power)
    total = cells.agg(F.sum("mass")).first()[0] or 0
    cells = probabilities(rake(cells, goal, rounds), share * total) if total else cells.selectExpr(*DIMS, "mass", "0.0D weight", "0.0D probability")
    cells = cells.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), "topic", "weight", "probability")
    out = rows.drop("weight", "probability", "sampled").join(cells, ["_source", "_lang", "topic"], "left").drop("_source", "_lang")
    out = out.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "probability": F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)})
    return out.withColumn("sampled", sample_point(F.col("doc_id"), seed) < F.col("probability"))


def oracle(share: float = 0.5, power: float = 0.5, seed: int = 1, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the query over documents: raking unrolled, one step for each round and dimension."""
    steps = ["w0 AS (SELECT *, CAST(mass AS DOUBLE) AS w FROM cells)"]
    n = 0
    for _ in range(rounds):
        for d in DIMS:
            steps.append(f"w{n + 1} AS (SELECT * EXCLUDE (w), w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM w{n})")
            n += 1
    goals = ", ".join(f"g_{d} AS (SELECT {d}, pow(CAST(sum(mass) AS DOUBLE), {power}) AS t FROM mass GROUP BY {d} HAVING sum(mass) > 0)" for d in DIMS)
    shares = ", ".join(f"s_{d} AS (SELECT {d}, t / (SELECT sum(t) FROM g_{d}) AS t_{d} FROM g_{d})" for d in DIMS)
    order = "ORDER BY ratio DESC, source, lang, topic"
    return rf"""WITH d AS (
      SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
             WHEN regexp_matches(coalesce(text, ''), '[0-9]{{4}}') THEN 'figures' ELSE 'prose' END AS topic,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
      FROM documents),
    mass AS (SELECT source, lang, topic, sum(n_tokens) AS mass FROM d GROUP BY ALL),
    {goals}, {shares},
    cells AS MATERIALIZED (SELECT mass.*, t_source, t_lang, t_topic FROM mass JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic) WHERE mass > 0),
    {", ".join(steps)},
    r AS MATERIALIZED (SELECT source, lang, topic, mass, w, w / mass AS ratio FROM w{n}),
    k AS (SELECT ratio, ({share} * (SELECT sum(mass) FROM r) - coalesce(sum(mass) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM r WHERE ratio > 0),
    e AS (SELECT k.scale, (SELECT sum(least(r.mass, k.scale * r.w)) FROM r) AS expected FROM (SELECT DISTINCT scale FROM k WHERE scale > 0) k),
    s AS (SELECT scale FROM e ORDER BY abs(expected - {share} * (SELECT sum(mass) FROM r)), scale LIMIT 1),
    p AS (SELECT source, lang, topic, w, least(1.0, scale * ratio) AS probability FROM r, s)
    SELECT doc_id, topic, n_tokens, round(coalesce(w, 0), 6) AS weight, round(CASE WHEN n_tokens > 0 THEN coalesce(probability, 0) ELSE 0 END, 6) AS probability,
      CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < CASE WHEN n_tokens > 0 THEN coalesce(probability, 0) ELSE 0 END AS sampled
    FROM d LEFT JOIN p USING (source, lang, topic)"""
