"""Plackett-Luce ratings after Weng and Lin (2011): one match in closed form, and an ordered fold over matches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarena.functions.text import let
from lexarena.sources.tables import written

KAPPA = 1e-4
PACKED = 200_000  # rows that a task sorts before a group's own task gets them
# Fixed: the tau of partial wins, and what each outcome means for team A (1 win, 0 loss, 0.5 draw).
PARTIAL_TAU = 0.7
OUTCOMES = {"win_a": 1.0, "win_b": 0.0, "draw": 0.5, "partial_a": 1.0, "partial_b": 0.0}
#: From results of decisions to outcomes; deployments override it.
RESULT_OUTCOMES = {
    "procedente": "win_a", "provido": "win_a", "reformada": "win_a", "improcedente": "win_b", "negado_provimento": "win_b",
    "confirmada": "win_b", "parcialmente_procedente": "partial_a", "extinto": "draw",
}


@dataclass(frozen=True)
class Model:
    """Parameters of the rating model."""

    mu: float = 25.0
    sigma: float = 25.0 / 3
    beta: float = 25.0 / 6
    tau: float = 25.0 / 15

    def rating(self, mu: float | None = None, sigma: float | None = None) -> tuple[float, float]:
        """A rating: the default one, or a given one if both values are."""
        return (self.mu, self.sigma) if mu is None or sigma is None else (mu, sigma)


def conservative_skill(mu: Column, sigma: Column) -> Column:
    return mu - 3 * sigma


def outcome_of(result: Column, mapping: dict[str, str] | None = None) -> Column:
    """The outcome of a decision's result; null for an unknown one."""
    pairs = F.create_map(*(F.lit(x) for kv in (mapping or RESULT_OUTCOMES).items() for x in kv))
    return F.get(F.array(pairs[F.lower(F.translate(F.trim(result), " ", "_"))]), F.lit(0))


def rate_teams(team_a: Column, team_b: Column, outcome: Column, model: Model = Model(), weight: Column | None = None) -> Column:
    """struct(a, b) of two teams' ratings (arrays of struct mu, sigma) after a match; an unknown outcome raises.

    A weight (none or null: 1) multiplies how far the match moves the means and narrows the deviations.

    The teams' sums are taken first, then what follows from them, then each player's update.
    """
    score = F.create_map(*(F.lit(x) for kv in OUTCOMES.items() for x in kv))[outcome]
    weight = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))
    won = F.coalesce(score, F.raise_error(F.concat(F.lit("unknown outcome "), F.coalesce(outcome, F.lit("null")))).cast("double"))
    tau2 = F.when(outcome.isin("partial_a", "partial_b"), PARTIAL_TAU**2).otherwise(model.tau**2)
    total = lambda team, f: F.aggregate(team, F.lit(0.0), lambda s, p: s + f(p))
    v = lambda p: p["sigma"] * p["sigma"]
    sums = F.struct(
        total(team_a, lambda x: x["mu"]).alias("mu_a"), total(team_b, lambda x: x["mu"]).alias("mu_b"), tau2.alias("tau2"), won.alias("won"),
        (total(team_a, v) + F.size(team_a) * tau2).alias("s2_a"), (total(team_b, v) + F.size(team_b) * tau2).alias("s2_b"))

    def chances(t: Column) -> Column:
        c = F.sqrt(t["s2_a"] + t["s2_b"] + 2 * model.beta**2)
        return F.struct(c.alias("c"), (1 / (1 + F.exp((t["mu_b"] - t["mu_a"]) / c))).alias("p"), t.alias("t"))

    def steps(q: Column) -> Column:
        t, c, p = q["t"], q["c"], q["p"]
        of = lambda s2, sign: F.struct(
            (sign * (t["won"] - p) / c * weight).alias("omega"), (F.sqrt(s2) / c / (c * c) * p * (1 - p) * weight).alias("delta"))
        return F.struct(t["tau2"].alias("tau2"), of(t["s2_a"], 1).alias("a"), of(t["s2_b"], -1).alias("b"))

    def updated(u: Column) -> Column:
        one = lambda k: lambda x: let(
            x["sigma"] * x["sigma"] + u["tau2"],
            lambda w: F.struct((x["mu"] + w * k["omega"]).alias("mu"), F.sqrt(w * F.greatest(1 - w * k["delta"], F.lit(KAPPA))).alias("sigma")))
        return F.struct(F.transform(team_a, one(u["a"])).alias("a"), F.transform(team_b, one(u["b"])).alias("b"))

    return let(let(let(sums, chances), steps), updated)


def win_probability(mu_a: Column, sigma2_a: Column, mu_b: Column, sigma2_b: Column, model: Model = Model()) -> Column:
    """Chance that team A beats team B, by the logistic form of the model."""
    return 1 / (1 + F.exp((mu_b - mu_a) / F.sqrt(sigma2_a + sigma2_b + 2 * model.beta**2)))


def draw_probability(mu_a: Column, sigma2_a: Column, mu_b: Column, sigma2_b: Column, margin: float = 1.0, model: Model = Model()) -> Column:
    """Chance that two teams end within `margin` of each other, by the same logistic form."""
    c = F.sqrt(sigma2_a + sigma2_b + 2 * model.beta**2)
    below = lambda d: 1 / (1 + F.exp((mu_a - mu_b - d) / c))
    return below(F.lit(margin)) - below(F.lit(-margin))


def area_ratings(matches: DataFrame, area: str, order: list[str], model: Model = Model()) -> DataFrame:
    """Ratings of each legal area for itself: the same fold with the area as its group."""
    return rate_sequence(matches, area, order, model)


def decayed_sigma(sigma: Column, idle_days: Column, per_day: float = 0.01, most: float = 25.0 / 3) -> Column:
    """Sigma after idle days: its square grows by a constant a day, up to the prior."""
    return F.least(F.sqrt(sigma * sigma + F.greatest(idle_days, F.lit(0)) * per_day**2), F.lit(most))


def _update(a: list[tuple[float, float]], b: list[tuple[float, float]], outcome: str, m: Model, weight: float) -> tuple[list, list]:
    tau2 = PARTIAL_TAU**2 if outcome.startswith("partial") else m.tau**2
    va, vb = [s * s + tau2 for _, s in a], [s * s + tau2 for _, s in b]
    s2a, s2b = sum(va), sum(vb)
    c2 = s2a + s2b + 2 * m.beta**2
    c = math.sqrt(c2)
    p = 1 / (1 + math.exp((sum(x for x, _ in b) - sum(x for x, _ in a)) / c))
    out = []
    for team, v, s2, sign in ((a, va, s2a, 1), (b, vb, s2b, -1)):
        omega, delta = weight * sign * s2 / c * (OUTCOMES[outcome] - p), weight * math.sqrt(s2) / c * s2 / c2 * p * (1 - p)
        out.append([(mu + w / s2 * omega, math.sqrt(w * max(1 - w / s2 * delta, KAPPA))) for (mu, _), w in zip(team, v, strict=True)])
    return out[0], out[1]


def values(column: pa.Array) -> list:
    """A column's values; numbers by way of numpy, which takes a fraction of the time."""
    plain = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
    return column.to_numpy().tolist() if plain else column.to_pylist()


def lists(column: pa.ListArray) -> list[list]:
    """The lists of an array column; a null one is None."""
    if column.null_count:
        return column.to_pylist()
    bounds, cells = column.offsets.to_numpy().tolist(), values(column.flatten())
    return [cells[a - bounds[0] : b - bounds[0]] for a, b in zip(bounds, bounds[1:], strict=False)]


def prepare_matches(decisions: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Matches (match_id, group, date, outcome, team_a, team_b) of decisions with lawyers' ids on both sides.

    Decisions that repeat (case, date, result, source) count once; unknown results, empty sides and a
    lawyer on both sides are left out.
    """
    once = decisions.dropDuplicates(["numero_processo", "data_decisao", "resultado", "source"])
    teams = once.select(
        F.struct("data_decisao", "numero_processo", "source", "position").alias("match_id"), F.col("tribunal").alias("group"), F.col("data_decisao").alias("date"),
        outcome_of(F.col("resultado"), mapping).alias("outcome"), F.array_distinct("advogados_polo_ativo_ids").alias("team_a"), F.array_distinct("advogados_polo_passivo_ids").alias("team_b"),
    )
    return teams.where((F.size("team_a") > 0) & (F.size("team_b") > 0) & ~F.arrays_overlap("team_a", "team_b") & F.col("outcome").isNotNull())


def rate_history(matches: DataFrame, group: str, order: list[str], stored: DataFrame | None = None, model: Model = Model(), final: bool = False, packed: bool = True, before: bool = False) -> DataFrame:
    """(group, order columns, player, side, mu_before, sigma_before, mu, sigma, matches) of each player of each match, in order.

    matches: the group and order columns, team_a and team_b (arrays of longs or strings), outcome, and
    a weight if there is such a column (see rate_teams). A match reads its players' latest ratings: those after their last match of the group, else the stored ones
    (group, player, mu, sigma, matches), else the model's; matches counts the stored and this one. A rating
    depends on all earlier matches of both teams, so a group (a court, an area) is the unit of parallel
    work: its rows are sorted by Spark and stream through one fold, which holds its players only, never its
    matches. With final, one row (group, player, mu, sigma, matches) of each player instead, stored ones included.
    A group's rows are packed before its task sorts them (see _packed); not with packed=False, for groups of a few matches.
    """
    types = dict(matches.dtypes)
    player, kind = types["team_a"].removeprefix("array<").removesuffix(">"), types[group]
    order = [c for c in order if c != group]
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in types else F.lit(1.0)
    rows = matches.select(group, F.lit(1).alias("_what"), *order, "team_a", "team_b", "outcome", F.lit(0.0).alias("mu"), F.lit(0.0).alias("sigma"), F.lit(0).cast("long").alias("matches"), weight.alias("_weight"))
    if stored is not None:
        none = [F.lit(None).cast(types[c]).alias(c) for c in (*order,)]
        first = stored.select(F.col(group).cast(kind), F.lit(0).alias("_what"), *none, F.array(F.col("player").cast(player)).alias("team_a"), F.array().cast(f"array<{player}>").alias("team_b"), F.lit("").alias("outcome"), "mu", "sigma", F.col("matches").cast("long"), F.lit(1.0))
        rows = rows.unionAll(first)
    keys = [group, "_what", *(F.asc_nulls_last(c) for c in order)]
    names = [group, "player", *(["mu_before", "sigma_before"] if before else []), "mu", "sigma", "matches"] if final else [group, *order, "player", "side", "mu_before", "sigma_before", "mu", "sigma", "matches"]
    kinds = {group: kind, "player": player, "side": "string", "matches": "long"} | {c: types[c] for c in order}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in names)
    if packed:
        batches_of, rows = _unpacked, _packed(rows, group, kind, keys)
    else:
        batches_of, rows = iter, rows.repartition(group).sortWithinPartitions(*keys)

    def fold(batches):
        default, held, now, arrow = (model.mu, model.sigma, 0, None, None), {}, None, None

        def ended():
            shown = {x: v for x, v in held.items() if v[3] is not None} if before else held
            cells = [pa.array([now[0]] * len(shown), arrow[0]), pa.array(list(shown), arrow[1])]
            cells += [pa.array([v[i] for v in shown.values()], pa.float64()) for i in ((3, 4, 0, 1) if before else (0, 1))]
            return pa.RecordBatch.from_arrays([*cells, pa.array([v[2] for v in shown.values()], pa.int64())], names=names)

        for batch in batches_of(batches):
            n = len(order) + 2
            arrow = (batch.schema.types[0], batch.schema.types[n].value_type)
            groups, outcomes = (batch.column(i).to_pylist() for i in (0, n + 2))
            team_a, team_b = (lists(batch.column(i)) for i in (n, n + 1))
            what, mus, sigmas, counts, weights = (values(batch.column(i)) for i in (1, *range(n + 3, n + 7)))
            at, players, sides, then, after = [], [], [], [], []
            for r, g in enumerate(groups):
                if now is None or g != now[0]:
                    if final and now:
                        yield ended()
                    held, now = {}, (g,)
                a, b = team_a[r], team_b[r]
                if what[r] == 0:
                    held[a[0]] = (mus[r], sigmas[r], counts[r], None, None)
                    continue
                old = [held.get(x, default) for x in a + b]
                new_a, new_b = _update([x[:2] for x in old[: len(a)]], [x[:2] for x in old[len(a) :]], outcomes[r], model, weights[r])
                new = [(mu, sigma, was[2] + 1, was[0], was[1]) for was, (mu, sigma) in zip(old, new_a + new_b, strict=True)]
                held.update(zip(a + b, new, strict=True))
                if not final:
                    at += [r] * len(old)
                    players += a + b
                    sides += ["a"] * len(a) + ["b"] * len(b)
                    then += old
                    after += new
            if not final:
                took = [batch.column(i).take(pa.array(at, pa.int64())) for i in (0, *range(2, n))]
                cells = [pa.array(players, arrow[1]), pa.array(sides, pa.string()), *(pa.array([x[i] for x in rated], pa.float64()) for rated in (then, after) for i in (0, 1)), pa.array([x[2] for x in after], pa.int64())]
                yield pa.RecordBatch.from_arrays([*took, *cells], names=names)
        if final and now:
            yield ended()

    return rows.mapInArrow(fold, schema)


def _packed(rows: DataFrame, group: str, kind: str, keys: list) -> DataFrame:
    """(group, part, at, rows): the rows in order of keys, which begin with the group, a few thousand of a group as one compressed value.

    Tasks of about PACKED rows sort them by ranges. What a group's own task then sorts are these values: they take
    a fraction of the rows' memory, and no other rows of the group stand in memory than those of one value.
    """
    rows = written(rows, "fold")
    cut = rows.repartitionByRange(max(1, math.ceil(rows.count() / PACKED)), *keys).sortWithinPartitions(*keys)

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            groups = batch.column(0).to_pylist()
            starts = [i for i in range(len(groups)) if not i or groups[i] != groups[i - 1]]
            for first, last in zip(starts, [*starts[1:], len(groups)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(first, last - first))
                cells = [batch.column(0).slice(first, 1), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=[group, "_part", "_at", "_rows"])
                n += 1

    found = cut.mapInArrow(run, f"`{group}` {kind}, _part int, _at long, _rows binary")
    return found.repartition(group).sortWithinPartitions(group, "_part", "_at")


def _unpacked(batches):
    for batch in batches:
        for value in batch.column(3):
            yield from pa.ipc.open_stream(value.as_buffer())


def rate_sequence(matches: DataFrame, group: str, order: list[str], model: Model = Model(), stored: DataFrame | None = None) -> DataFrame:
    """(group, player, mu, sigma, matches) after every match of each group in order; see rate_history."""
    return rate_history(matches, group, order, stored, model, final=True)


def last_matches(matches: DataFrame, group: str, order: list[str], stored: DataFrame | None = None, model: Model = Model()) -> DataFrame:
    """(group, player, mu_before, sigma_before, mu, sigma, matches) of each player's last match in each group; see rate_history.

    The fold has these at its end: the history of all matches is neither put out nor sorted for them.
    """
    return rate_history(matches, group, order, stored, model, final=True, before=True)
