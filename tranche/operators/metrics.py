"""Discrimination, accuracy and calibration of scored rows (y 0 or 1, pd, loan_id).

Scores are rounded to SCORE_DIGITS first, so ties don't depend on the last bits of exp(). A row without y or pd (null or NaN)
fails the job: it has no place among the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .radix import at_ranks
from .ranks import running_before, settled

SCORE_DIGITS = 9


def _rounded(scored: DataFrame) -> DataFrame:
    whole = lambda c: F.when(F.col(c).isNull() | F.isnan(c), F.raise_error(F.concat(F.lit(f"no {c}: "), F.coalesce("loan_id", F.lit("(none)"))))).otherwise(F.col(c))
    return scored.select("loan_id", whole("y").cast("long").alias("y"), F.round(whole("pd"), SCORE_DIGITS).alias("pd"))


def auc(scored: DataFrame) -> DataFrame:
    """One row, auc: chance that a random event scores above a random non-event, ties counting half; null for one class."""
    return settled(_rounded(scored), _auc)


def _auc(rows: DataFrame) -> DataFrame:
    by_score = rows.groupBy("pd").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return running_before(by_score, "pd", ["neg"]).agg((won / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def brier(scored: DataFrame) -> DataFrame:
    """One row: n, brier, realised, mean_predicted, climatology (Brier of the constant realised rate), skill (null if that is 0)."""
    return _brier(_rounded(scored))


def _brier(rows: DataFrame) -> DataFrame:
    n, p, y = F.count(F.lit(1)), F.avg("pd"), F.avg("y")
    rows = rows.agg(n.alias("n"), F.avg((F.col("pd") - F.col("y")) * (F.col("pd") - F.col("y"))).alias("brier"), y.alias("realised"), p.alias("mean_predicted"))
    base = F.col("realised") * (1 - F.col("realised"))
    return rows.withColumn("climatology", base).withColumn("skill", 1 - F.col("brier") / F.nullif(base, F.lit(0.0)))


@dataclass
class Slice:
    """What a slice of rows adds up to."""

    n: int = 0
    y: int = 0
    pd: float = 0.0
    values: list[float] = field(default_factory=list)

    def add(self, n: int, y: int, pd: float, *values: float) -> None:
        self.n, self.y, self.pd = self.n + n, self.y + y, self.pd + pd
        self.values += values


def _slices(rows: DataFrame, k: int, rising: bool) -> list[Slice]:
    """Rows in order of pd (rising: equal ones by y; falling: by loan_id) in k slices, the first n mod k a row longer (as ntile).

    The scores at the slices' ends are found by counting. Rows between two of them are added up as they are; of the rows that
    have such a score only counts matter, split by arithmetic, unless the order by loan_id decides which y goes where: those
    rows alone are ranked.
    """
    x = F.col("pd") if rising else -F.col("pd")
    keyed = rows.select(F.lit(0).alias("g"), "loan_id", "y", "pd", x.alias("x"))

    def ends(n: int) -> list[int]:
        k_ = min(k, n)
        return [(i + 1) * (n // k_) + min(i + 1, n % k_) for i in range(k_)]

    at = at_ranks(keyed, "g", "x", lambda n: ends(n)[:-1])
    if not at:
        return []
    n, found = at[0]
    borders = sorted(set(found.values()))
    edges = F.array(*[F.lit(v) for v in borders]).cast("array<double>")
    cell = 2 * F.size(F.filter(edges, lambda e: e < F.col("x"))) + F.array_contains(edges, F.col("x")).cast("int")
    stats = keyed.groupBy(cell.alias("cell"), "y").agg(F.count(F.lit(1)).alias("n"), F.sum("pd").alias("pd"), F.min("pd").alias("lo"), F.max("pd").alias("hi"))
    cells: dict[int, list] = {}
    for r in sorted(stats.collect(), key=lambda r: (r["cell"], r["y"])):  # two rows a cell
        cells.setdefault(r["cell"], []).append(r)
    stops, out, done = ends(n), [Slice()], 0
    begins = {}
    for c in sorted(cells):
        begins[c], done = done, done + sum(r["n"] for r in cells[c])
    parts = {c: [t - begins[c] for t in stops if begins[c] < t < begins[c] + sum(r["n"] for r in cells[c])] for c in cells}
    mixed = {borders[c // 2]: parts[c] for c in cells if not rising and c % 2 and len(cells[c]) > 1 and parts[c]}
    events = _events_ahead(keyed, mixed) if mixed else {}
    done = 0
    for c in sorted(cells):
        pieces = [(r["n"], r["y"] * r["n"], r["pd"], r["lo"], r["hi"]) for r in cells[c]]
        if c % 2 and borders[c // 2] in mixed:  # cut at the slices' ends, with the events that loan_id puts there
            v, cuts = cells[c][0]["lo"], [0, *parts[c], sum(p[0] for p in pieces)]
            ahead = [0, *events[borders[c // 2]], sum(p[1] for p in pieces)]
            pieces = [(b - a, e - d, v * (b - a), v, v) for a, b, d, e in zip(cuts, cuts[1:], ahead, ahead[1:])]
        for size, y, pd, lo, hi in pieces:
            while size:
                if done == stops[len(out) - 1]:
                    out.append(Slice())
                take = min(size, stops[len(out) - 1] - done)
                part = (take, y, pd) if take == size else (take, y * take // size, lo * take)  # what is cut has one score, and one y
                out[-1].add(*part, lo, hi)
                size, y, pd, done = size - take, y - part[1], pd - part[2], done + take
    return out


def _events_ahead(keyed: DataFrame, borders: dict[float, list[int]]) -> dict[float, list[int]]:
    """Of the rows that have a border's score, in order of loan_id: the events among the first t, for each t given."""
    kind = keyed.sparkSession.createDataFrame([(v, t) for v, t in borders.items()], "x double, t array<long>")
    tied = keyed.join(F.broadcast(kind), "x").withColumn("_n", F.lit(1))
    ranked = running_before(tied, "loan_id", ["_n"], ["x"])
    parts = ranked.groupBy("x", F.size(F.filter("t", lambda t: t <= F.col("_n_before"))).alias("part")).agg(F.sum("y").alias("y")).collect()
    by = {(r["x"], r["part"]): r["y"] for r in parts}
    return {v: [sum(by.get((v, j), 0) for j in range(i + 1)) for i in range(len(t))] for v, t in borders.items()}


def reliability(scored: DataFrame, k: int = 10, strategy: str = "quantile") -> DataFrame:
    """bin, n, mean_predicted, realised, p_lo, p_hi. quantile: slices of equal count; uniform: equal parts of 0 to 1, empty ones left out."""
    if strategy == "quantile":
        return settled(_rounded(scored), lambda rows: _reliability(rows, k).orderBy("bin"))
    if strategy != "uniform":
        raise ValueError(f"unknown strategy {strategy!r}")
    return _reliability(_rounded(scored), k, uniform=True).orderBy("bin")


CURVE = "bin int, n long, mean_predicted double, realised double, p_lo double, p_hi double"


def _reliability(rows: DataFrame, k: int, uniform: bool = False) -> DataFrame:
    if not uniform:
        found = [(i, s.n, s.pd / s.n, s.y / s.n, min(s.values), max(s.values)) for i, s in enumerate(_slices(rows, k, True))]
        return rows.sparkSession.createDataFrame(found, CURVE)
    stats = [F.count(F.lit(1)).alias("n"), F.avg("pd").alias("mean_predicted"), F.avg("y").alias("realised")]
    edges = F.array(*[F.lit(b / k) for b in range(1, k)])
    inside = (F.col("pd") >= 0) & (F.col("pd") <= 1)
    rows = rows.withColumn("bin", F.when(inside, F.size(F.filter(edges, lambda e: e <= F.col("pd")))).otherwise(-1))
    # asked of the aggregate, so that the test isn't pushed down into the score's expression
    return rows.groupBy("bin").agg(*stats, F.max(inside).alias("_in")).where("_in").drop("_in").select("*", (F.col("bin") / k).alias("p_lo"), ((F.col("bin") + 1) / k).alias("p_hi"))


def deciles(scored: DataFrame, k: int = 10) -> DataFrame:
    """decile (1: riskiest), n, mean_predicted, realised, lift over the overall rate (null if that is 0)."""
    return settled(_rounded(scored), lambda rows: _deciles(rows, k).orderBy("decile"))


def _deciles(rows: DataFrame, k: int) -> DataFrame:
    found = _slices(rows, k, False)
    overall = sum(s.y for s in found) / max(1, sum(s.n for s in found))
    table = [(i, s.n, s.pd / s.n, s.y / s.n, s.y / s.n / overall if overall else None) for i, s in enumerate(found, 1)]
    return rows.sparkSession.createDataFrame(table, "decile int, n long, mean_predicted double, realised double, lift double")


METRICS = ("n", "realised", "mean_predicted", "ratio", "auc", "brier", "climatology", "skill")


def _long(df: DataFrame, names: tuple[str, ...], *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*keys, "m.*")


def evaluation(scored: DataFrame) -> DataFrame:
    """metric, value: n, realised, mean_predicted, ratio, auc, brier, climatology, skill. An empty table has no report."""
    return settled(_rounded(scored), _evaluation)


def _evaluation(rows: DataFrame) -> DataFrame:
    one = _brier(rows).where("n > 0").withColumn("ratio", F.when(F.col("mean_predicted") > 0, F.col("realised") / F.col("mean_predicted")))
    return _long(one.withColumn("_one", F.lit(0)).join(_auc(rows).withColumn("_one", F.lit(0)), "_one"), METRICS)


def full_evaluation(scored: DataFrame, k: int = 10) -> DataFrame:
    """part, bin, metric, value: the figures of evaluation() (part overall, bin 0), the reliability curve by slices (from bin 0)
    and the decile table (from bin 1), all from one look at the scores."""

    def every(rows: DataFrame) -> DataFrame:
        parts = {
            "overall": _evaluation(rows).withColumn("bin", F.lit(0)),
            "reliability": _long(_reliability(rows, k), ("n", "mean_predicted", "realised", "p_lo", "p_hi"), "bin"),
            "decile": _long(_deciles(rows, k).withColumnRenamed("decile", "bin"), ("n", "mean_predicted", "realised", "lift"), "bin"),
        }
        return united({name: df.select("bin", "metric", "value") for name, df in parts.items()}, "part")

    return settled(_rounded(scored), every)


def united(reports: dict[str, DataFrame], name: str = "protocol") -> DataFrame:
    """Long tables one below another, with the name of each."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias(name), "*") for k, df in reports.items()])
