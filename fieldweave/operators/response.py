"""Yield response curves and the rate that pays best, for all fields and zones at once.

The input is a table of cells (keys, rate, yield).  It is reduced to one row per distinct rate
with its count, sum and sum of squares; every model is then a closed-form least squares over
those few rows.  Models that are not linear are linear once one parameter is fixed, so that
parameter runs over a grid (joined as rows, refined once around the best), which finds the
least squared error everywhere on the grid and needs no start value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut

MODELS = ("quadratic", "quadratic_plateau", "linear_plateau", "mitscherlich")
#: Grid points of the profiled parameter, in each of the two passes.
GRID = 60
FITS = ("model", "a", "b", "c", "plateau", "sse", "n", "r2", "rmse")


def by_rate(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per rate: count, mean yield and squares about it; with the key's totals."""
    c = cells.where("rate is not null and `yield` is not null")
    g = c.groupBy(*keys, "rate").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("yield").alias("m"), F.coalesce(F.var_pop("yield"), F.lit(0.0)).alias("v"))
    w = Window.partitionBy(*keys)
    total = F.sum("n").over(w)
    g = g.withColumns({"total": total, "k": F.count(F.lit(1)).over(w), "rm": F.sum(F.col("n") * F.col("rate")).over(w) / total, "ym": F.sum(F.col("n") * F.col("m")).over(w) / total, "r0": F.min("rate").over(w), "r1": F.max("rate").over(w)})
    # squares within rates: no model can explain them
    return g.withColumns({"within": F.sum(F.col("n") * F.col("v")).over(w), "sst": F.sum(F.col("n") * (F.col("v") + F.pow(F.col("m") - F.col("ym"), 2))).over(w)})


def _good(df: DataFrame) -> DataFrame:
    """ECO5: R2 (0 without spread) and RMSE from sse, sst and N."""
    return df.withColumns({"r2": F.when(F.col("sst") > 0, 1 - F.col("sse") / F.nullif("sst", F.lit(0.0))).otherwise(0.0), "rmse": F.sqrt(F.greatest(F.col("sse"), F.lit(0.0)) / F.col("total")), "n": F.col("total").cast("long")})


def quadratic(rates: DataFrame, keys: list[str]) -> DataFrame:
    """ECO1: a + b r + c r^2 from sums about the mean rate."""
    t, y, n = F.col("rate") - F.col("rm"), F.col("m") - F.col("ym"), F.col("n")
    s = lambda e: F.sum(n * e)
    a = rates.groupBy(*keys).agg(
        *[F.first(x).alias(x) for x in ("total", "rm", "ym", "within", "sst", "k", "r0", "r1")],
        s(F.pow(t, 2)).alias("s2"), s(F.pow(t, 3)).alias("s3"), s(F.pow(t, 4)).alias("s4"), s(t * y).alias("sty"), s(F.pow(t, 2) * y).alias("st2y"), s(y * y).alias("syy"),
    ).where("k >= 3")
    q = F.col("s4") - F.pow(F.col("s2"), 2) / F.col("total")  # of t^2 about its mean; the mean of t is 0
    det = F.col("s2") * q - F.pow(F.col("s3"), 2)
    b1 = F.try_divide(F.col("sty") * q - F.col("st2y") * F.col("s3"), det)
    c1 = F.try_divide(F.col("st2y") * F.col("s2") - F.col("sty") * F.col("s3"), det)
    a = a.withColumns({"b1": b1, "c": c1})
    a = a.withColumn("sse", F.col("within") + F.greatest(F.lit(0.0), F.col("syy") - F.col("b1") * F.col("sty") - F.col("c") * F.col("st2y")))
    a = a.withColumn("a1", F.col("ym") - F.col("c") * F.col("s2") / F.col("total"))
    a = a.withColumns({"b": F.col("b1") - 2 * F.col("c") * F.col("rm"), "a": F.col("a1") - F.col("b1") * F.col("rm") + F.col("c") * F.pow(F.col("rm"), 2)})
    a = a.withColumn("plateau", F.when(F.col("c") < 0, -F.col("b") / (2 * F.nullif("c", F.lit(0.0)))))
    return _good(a.withColumn("model", F.lit("quadratic"))).select(*keys, *FITS)


def _profile(rates: DataFrame, keys: list[str], grid: DataFrame, feature: Column) -> DataFrame:
    """Closed-form y = p + s * feature at each grid value g: (keys, g, p, s, sse, ...)."""
    w = rates.join(grid, keys).withColumn("f", feature)
    n, f, y = F.col("n"), F.col("f"), F.col("m") - F.col("ym")
    a = w.groupBy(*keys, "g").agg(
        *[F.first(x).alias(x) for x in ("total", "ym", "within", "sst", "k", "r0", "r1")], F.sum(n * f).alias("sf"), F.sum(n * f * f).alias("sff"), F.sum(n * f * y).alias("sfy"), F.sum(n * y * y).alias("syy")
    )
    sxx = F.col("sff") - F.col("sf") * F.col("sf") / F.col("total")
    a = a.withColumn("s", F.when(sxx > 1e-12 * F.col("sff"), F.try_divide(F.col("sfy"), sxx))).where("s is not null")
    return a.withColumns({"sse": F.col("within") + F.greatest(F.lit(0.0), F.col("syy") - F.col("s") * F.col("sfy")), "p": F.col("ym") - F.col("s") * F.col("sf") / F.col("total")})


def _best(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("sse", "g")
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _searched(rates: DataFrame, keys: list[str], lo: Column, hi: Column, feature: Column, allowed: Column, log: bool = False) -> DataFrame:
    """The best allowed fit over a grid of g in [lo, hi], refined once around the best."""
    ends = rates.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"), F.first("k").alias("k")).where("k >= 4").drop("k")
    i = F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("i")
    to, back = (F.log, F.exp) if log else (lambda c: c, lambda c: c)
    grid = ends.select(*keys, "lo", "hi", i).withColumn("g", back(to(F.col("lo")) + (to(F.col("hi")) - to(F.col("lo"))) * F.col("i") / GRID))
    first = cut(_best(_profile(rates, keys, grid.select(*keys, "g"), feature).where(allowed), keys))
    near = first.select(*keys, F.col("g").alias("g0")).join(ends, keys)
    step = (to(F.col("hi")) - to(F.col("lo"))) / GRID
    near = near.select(*keys, "lo", "hi", "g0", step.alias("step"), i)
    fine = back(F.least(to(F.col("hi")), F.greatest(to(F.col("lo")), to(F.col("g0")) + F.col("step") * (2 * F.col("i") / GRID - 1))))
    second = _profile(rates, keys, near.select(*keys, fine.alias("g")).distinct(), feature).where(allowed)
    return _best(first.unionByName(second), keys)


def linear_plateau(rates: DataFrame, keys: list[str]) -> DataFrame:
    """ECO3: a + b min(r, g), flat from the critical rate g on."""
    best = _searched(rates, keys, F.min("rate") + (F.max("rate") - F.min("rate")) * 1e-3, F.max("rate"), F.least("rate", "g"), F.lit(True))
    return _good(best.withColumns({"model": F.lit("linear_plateau"), "a": F.col("p"), "b": F.col("s"), "c": F.col("g"), "plateau": F.col("g")})).select(*keys, *FITS)


def quadratic_plateau(rates: DataFrame, keys: list[str]) -> DataFrame:
    """ECO2: a quadratic up to its top g, flat beyond: y = p + s (m^2 - 2 m g), m = min(r, g), s < 0.

    Where no such fit exists, or the plain quadratic (whose top lies beyond the rates) is
    better, the model is that quadratic.
    """
    m = F.least("rate", "g")
    best = _searched(rates, keys, F.min("rate") + (F.max("rate") - F.min("rate")) * 1e-3, F.max("rate"), m * m - 2 * m * F.col("g"), F.col("s") < 0)
    flat = _good(best.withColumns({"model": F.lit("quadratic_plateau"), "a": F.col("p"), "b": -2 * F.col("s") * F.col("g"), "c": F.col("s"), "plateau": F.col("g")})).select(*keys, *FITS)
    ends = rates.where("k >= 4").groupBy(*keys).agg(F.max("rate").alias("r1"))
    plain = quadratic(rates, keys).join(ends, keys).where(F.coalesce(F.col("c") >= 0, F.lit(True)) | (F.col("plateau") >= F.col("r1"))).drop("r1").withColumn("model", F.lit("quadratic_plateau"))
    w = Window.partitionBy(*keys).orderBy("sse", "plateau")
    return flat.unionByName(plain).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def mitscherlich(rates: DataFrame, keys: list[str]) -> DataFrame:
    """ECO4: A (1 - exp(-c (r + b))) with A >= 0 and 1e-6 <= c <= 1; a is A.  Fits without a real b are left out."""
    f = F.exp(-F.col("g") * F.col("rate"))
    best = _searched(rates, keys, F.lit(1e-6), F.lit(1.0), f, (F.col("p") > 0) & (F.col("s") < 0), log=True)
    b = -F.log(-F.col("s") / F.col("p")) / F.col("g")
    return _good(best.withColumns({"model": F.lit("mitscherlich"), "a": F.col("p"), "b": b, "c": F.col("g"), "plateau": F.lit(None).cast("double")})).select(*keys, *FITS)


#: Model registry: name -> (rates, keys) -> fits.
REGISTRY = {"quadratic": quadratic, "quadratic_plateau": quadratic_plateau, "linear_plateau": linear_plateau, "mitscherlich": mitscherlich}


def fit_all(cells: DataFrame, keys: list[str], models: tuple[str, ...] = MODELS) -> DataFrame:
    """All fits of each key; with three rates only the quadratic, with fewer none."""
    rates = cut(by_rate(cells, keys))  # one row a rate, which every model reads several times
    return reduce(DataFrame.unionByName, [REGISTRY[m](rates, keys) for m in models])


def fit_best(cells: DataFrame, keys: list[str], models: tuple[str, ...] = MODELS) -> DataFrame:
    """ECO6: the fit of greatest R2, then least RMSE."""
    order = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))])[F.col("model")]
    w = Window.partitionBy(*keys).orderBy(F.desc("r2"), "rmse", order)
    return fit_all(cells, keys, models).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def predict(r: Column) -> Column:
    """A fit's yield at rate r (columns model, a, b, c, plateau)."""
    m = F.least(r, F.coalesce("plateau", r))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return (
        F.when(F.col("model") == "quadratic", a + b * r + c * r * r)
        .when(F.col("model") == "quadratic_plateau", a + b * F.when(c < 0, m).otherwise(r) + c * F.pow(F.when(c < 0, m).otherwise(r), 2))
        .when(F.col("model") == "linear_plateau", a + b * m)
        .otherwise(a * (1 - F.exp(-c * (r + b))))
    )


def slope(r: Column) -> Column:
    """The derivative of predict."""
    below = r < F.coalesce("plateau", F.lit(float("inf")))
    b, c = F.col("b"), F.col("c")
    return (
        F.when(F.col("model") == "quadratic", b + 2 * c * r)
        .when(F.col("model") == "quadratic_plateau", F.when((c >= 0) | below, b + 2 * c * r).otherwise(0.0))
        .when(F.col("model") == "linear_plateau", F.when(below, b).otherwise(0.0))
        .otherwise(F.col("a") * c * F.exp(-c * (r + b)))
    )


def _curve(fits: DataFrame, price: float, cost: float, lo, hi, points: int) -> DataFrame:
    """Each fit at so many equally spaced rates."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    g = fits.withColumns({"_lo": lo, "_hi": hi}).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    g = g.withColumn("r", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / (points - 1))
    return g.withColumn("yhat", predict(F.col("r"))).withColumn("profit", F.col("yhat") * price - F.col("r") * cost)


def optimum(fits: DataFrame, keys: list[str], price: float, cost: float, lo=0.0, hi=400.0) -> DataFrame:
    """ECO7: the rate of greatest profit on 2001 rates, or the first place where the marginal yield falls through cost / price if it pays as much."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    # a fit's curve is an array of its row: as rows it would be sorted by key, with 2001 rows a fit
    rate = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / 2000
    sign = lambda r: F.signum(slope(r) - cost / price)
    g = fits.withColumns({"_lo": lo, "_hi": hi})
    g = g.withColumn("_g", F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: F.struct(i.alias("i"), rate(i).alias("r"), predict(rate(i)).alias("yhat"))))
    g = g.withColumn("_g", F.transform("_g", lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r"), x["yhat"].alias("yhat"), (x["yhat"] * price - x["r"] * cost).alias("profit"))))
    best = F.array_min(F.transform("_g", lambda x: F.struct((-x["profit"]).alias("k"), x["i"].alias("i"), x["r"].alias("r"), x["yhat"].alias("yhat"), x["profit"].alias("profit"))))
    cross = F.array_min(F.filter("_g", lambda x: (x["i"] > 0) & (sign(x["r"]) < sign(rate(x["i"] - 1)))))
    a = g.withColumns({"best": best, "cross": cross})
    use = F.coalesce(F.col("cross.profit") >= F.col("best.profit") - 1e-6, F.lit(False))
    pick = lambda c: F.when(use, F.col(f"cross.{c}")).otherwise(F.col(f"best.{c}"))
    return a.select(
        *keys, "model", "r2", "rmse", "n",
        pick("r").alias("optimum_rate"), pick("yhat").alias("yield_at_optimum"), pick("profit").alias("profit_at_optimum"), F.col("plateau").alias("agronomic_maximum"),
        ((pick("r") >= F.col("_hi") - 1e-6) | (pick("r") <= F.col("_lo") + 1e-6)).alias("at_range_limit"),
    )


def profit_curve(fits: DataFrame, keys: list[str], price: float, cost: float, lo=0.0, hi=400.0, points: int = 60) -> DataFrame:
    """ECO8."""
    return _curve(fits, price, cost, lo, hi, points).select(*keys, "i", F.col("r").alias("rate"), F.col("yhat").alias("yield"), "profit")


def uniform_or_variable(cells: DataFrame, price: float, cost: float, hi: float, zone: str = "zone", ds: str = "ds", models: tuple[str, ...] = MODELS) -> DataFrame:
    """ECO9: per log the best single rate, the profit of each zone at its own best, and the gain; two zones at least."""
    fits = cut(fit_best(cells, [ds, zone], models))
    g = _curve(fits, price, cost, 0.0, hi, 1001)
    weight = F.col("n").cast("double")
    own = g.groupBy(ds, zone).agg(F.max("profit").alias("top"), F.first(weight).alias("w")).groupBy(ds).agg((F.sum(F.col("w") * F.col("top")) / F.sum("w")).alias("variable_profit"), F.count(F.lit(1)).alias("zones"))
    one = g.groupBy(ds, "i", "r").agg((F.sum(weight * F.col("profit")) / F.sum(weight)).alias("p"))
    one = one.groupBy(ds).agg(F.min(F.struct((-F.col("p")).alias("k"), "i", "r", "p")).alias("b"))
    return own.where("zones >= 2").join(one, ds).select(ds, F.col("b.r").alias("best_uniform_rate"), F.col("b.p").alias("uniform_profit"), "variable_profit", (F.col("variable_profit") - F.col("b.p")).alias("gain"))
