"""A two-component diagonal Gaussian mixture by expectation-maximisation as DataFrame aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component of less weight than this keeps its place: its sums say nothing.
LEAST_SHARE = 1e-9


def _log_density(model: dict, k: int, dims: int) -> list[float]:
    """constant, then means, then halved precisions of component k: what the row's expression takes from its start."""
    constant = math.log(max(model["weights"][k], 1e-300)) - 0.5 * sum(math.log(2 * math.pi * v) for v in model["variances"][k])
    return [constant, *model["means"][k][:dims], *(0.5 / v for v in model["variances"][k])]


def _starts(used: DataFrame, dims: int, starts: int, seed: int, mean: list[float], var: list[float], floor: float) -> list[dict]:
    """The first splits the widest dimension a deviation to either side of its mean; every other takes as its means the two rows
    whose values hash lowest and highest under its number, so that neither row order nor partitioning tells."""
    spread = [v + floor for v in var]
    wide = max(range(dims), key=lambda d: (var[d], -d))
    ends = [[m + (s * math.sqrt(var[d]) if d == wide else 0.0) for d, m in enumerate(mean)] for s in (1, -1)]
    means = [ends]
    if starts > 1:
        row = F.struct(*(f"x{d}" for d in range(dims)))
        by = [F.xxhash64(*(f"x{d}" for d in range(dims)), F.lit(seed + k)) for k in range(1, starts)]
        drawn = used.agg(*(f(row, h).alias(f"_{k}_{n}") for k, h in enumerate(by) for n, f in enumerate((F.min_by, F.max_by)))).first()
        means += [[list(drawn[2 * k]), list(drawn[2 * k + 1])] for k in range(starts - 1)]
    return [{"weights": [0.5, 0.5], "means": m, "variances": [spread, spread]} for m in means]


def fits(samples: DataFrame, dims: int, starts: int = 10, rounds: int = 100, tolerance: float = 1e-3, floor: float = 1e-3, least: int = 100, seed: int = 42) -> list[dict]:
    """The model each start ends at: weights, means, variances, the mean log-likelihood of a sample, rounds, converged.

    samples: array column colour; NULL and all-zero ones don't count. No models with fewer than least samples.
    All starts still running advance in one aggregate a round, grouped by start: a row meets their models (at most
    starts literals), map tasks sum by start, and 2 * dims + 2 sums a start reach the driver. A start ends when its
    likelihood changes by less than tolerance; the likelihood is that of the model returned.
    """
    x = [F.get("colour", F.lit(d)).cast("double") for d in range(dims)]
    used = samples.filter(F.col("colour").isNotNull() & (sum((v * v for v in x[1:]), x[0] * x[0]) > 0)).select(*(v.alias(f"x{d}") for d, v in enumerate(x))).persist()
    try:
        first = used.agg(F.count("*"), *(F.avg(f"x{d}") for d in range(dims)), *(F.var_pop(f"x{d}") for d in range(dims))).first()
        n, mean, var = first[0], list(first[1 : dims + 1]), list(first[dims + 1 :])
        if n < least:
            return []
        models = [m | {"likelihood": -math.inf, "rounds": 0, "converged": False} for m in _starts(used, dims, starts, seed, mean, var, floor)]
        for _ in range(rounds):
            running = [s for s, m in enumerate(models) if not m["converged"]]
            if not running:
                break
            for row in _expect(used, dims, {s: models[s] for s in running}).collect():  # a row for each start
                models[row["_s"]] = _advance(models[row["_s"]], row, n, mean, var, dims, floor, tolerance)
        return [m.pop("known", m) for m in models]
    finally:
        used.unpersist()


def _expect(used: DataFrame, dims: int, running: dict[int, dict]) -> DataFrame:
    """_s, the log-likelihood of all samples, and the first component's weight, sums and sums of squares under each running model."""
    literals = [F.struct(F.lit(s).alias("s"), *(F.array(*(F.lit(float(v)) for v in _log_density(m, k, dims))).alias(f"m{k}") for k in range(2))) for s, m in running.items()]
    rows = used.withColumn("_m", F.explode(F.array(*literals)))

    def log(k: int) -> Column:
        part = F.col(f"_m.m{k}")
        apart = [(F.col(f"x{d}") - part[1 + d]) for d in range(dims)]
        return sum((-(a * a) * part[1 + dims + d] for d, a in enumerate(apart)), part[0])

    rows = rows.select(F.col("_m.s").alias("_s"), *(f"x{d}" for d in range(dims)), log(0).alias("_l0"), log(1).alias("_l1"))
    rows = rows.withColumns({"_p": 1.0 / (1.0 + F.exp(F.col("_l1") - F.col("_l0"))), "_l": F.greatest("_l0", "_l1") + F.log1p(F.exp(-F.abs(F.col("_l1") - F.col("_l0"))))})
    p = F.col("_p")
    sums = [F.sum(p).alias("w"), *(F.sum(p * F.col(f"x{d}")).alias(f"a{d}") for d in range(dims)), *(F.sum(p * F.col(f"x{d}") * F.col(f"x{d}")).alias(f"b{d}") for d in range(dims))]
    return rows.groupBy("_s").agg(F.sum("_l").alias("likelihood"), *sums)


def _advance(model: dict, row, n: int, mean: list[float], var: list[float], dims: int, floor: float, tolerance: float) -> dict:
    """The model after a round; known is the model whose likelihood was just measured, which is the one to return."""
    likelihood = row["likelihood"] / n
    known = {k: model[k] for k in ("weights", "means", "variances")} | {"likelihood": likelihood, "rounds": model["rounds"] + 1}
    known["converged"] = abs(likelihood - model["likelihood"]) < tolerance
    one = [row["w"], *(row[f"a{d}"] for d in range(dims)), *(row[f"b{d}"] for d in range(dims))]
    every = [float(n), *(n * m for m in mean), *(n * (v + m * m) for v, m in zip(var, mean, strict=True))]
    out = {"weights": [], "means": [], "variances": []}
    for k, part in enumerate((one, [a - b for a, b in zip(every, one, strict=True)])):
        if part[0] < LEAST_SHARE * n:
            out["means"].append(model["means"][k])
            out["variances"].append(model["variances"][k])
        else:
            m = [part[1 + d] / part[0] for d in range(dims)]
            out["means"].append(m)
            out["variances"].append([max(part[1 + dims + d] / part[0] - m[d] ** 2, 0.0) + floor for d in range(dims)])
        out["weights"].append(max(part[0], 0.0) / n)
    return out | {"likelihood": likelihood, "rounds": known["rounds"], "converged": known["converged"], "known": known}


def fit(samples: DataFrame, dims: int, starts: int = 10, **options) -> dict | None:
    """The likeliest of fits(...), its larger component first; None with too few samples. Ties go to the earlier start."""
    models = fits(samples, dims, starts, **options)
    if not models:
        return None
    best = max(models, key=lambda m: m["likelihood"])
    order = sorted(range(2), key=lambda k: -best["weights"][k])
    return {k: [best[k][i] for i in order] for k in ("weights", "means", "variances")}
