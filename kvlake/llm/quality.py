"""Quality rules: base counts and robust multivariate outliers, in DataFrame functions only.

Base counts follow the text's words, lines and 8-word windows.  Documents that
pass the base rule are then held against their own language and source: the
minimum covariance determinant estimate of location and scatter of a vector of
transformed statistics, and the Mahalanobis distance to it.

The estimate is found by concentration steps: take the ``support`` share of rows
nearest by distance, re-estimate mean and covariance from them, and repeat.  The
steps run from several starts (medians, shortest halves, lower and upper
quartiles), that of the least determinant stays, and is estimated once more from
all rows within the 97.5 % quantile of it.  Both the order statistics and the sums are
aggregates with map-side combine over (group, bin), so a group that holds a
third of all rows is no one task's work, and all rows take part.

Every language and source has an estimate of its own, and every language one over
all its sources.  A group of n rows is judged by the mean of the two, its own with
weight n / (n + ``prior``): continuous in n, and never across languages.

Defined results: a null or empty text has no words and fails the base rule.
Null language or source is a value of its own.  Rows with equal doc_id are
judged one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.common import store, without

WINDOW = 8
SUPPORT = 0.5
STEPS = 4
#: Share of a normal law's rows that the last estimate takes.
REWEIGHT = 0.975
#: Quantiles of each statistic that the starts are made from, less one.
GRID = 16
#: Rows at which a group's own estimate and its language's count alike.
PRIOR = 100
#: Least spread taken for each statistic: what differs by less is no outlier.
FLOORS = (0.6, 0.35, 0.25, 0.15)
#: Squared distance in floored spreads beyond which a document is an outlier.
CUTOFF = 40.0
DIMS = len(FLOORS)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
ADDED = (*BASE, "distance2", "kept")
_SPACE = "\t\n\x0b\x0c\r"


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and base_failed."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = without(docs, *BASE)
    names = [f"`{c}`" for c in out.columns]
    split = F.array_remove(F.split(F.translate(text, _SPACE, " " * len(_SPACE)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" " + _SPACE))) > 0)
    out = out.select(
        *names,
        split.alias("_w"),
        lines.alias("_l"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    out = out.select(
        *names,
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("_n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    carried = [*names, "n_symbols", "n_words", "word_chars", "_n_lines", "n_dup_lines"]
    # 64-bit hashes of all 8-word windows, each with its place
    starts = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(1), F.size("_h") - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    out = out.select(*carried, "_h", starts.alias("_s"))
    out = out.select(*carried, F.transform("_s", lambda i: F.xxhash64(F.slice("_h", i, WINDOW))).alias("_g"))
    twice = F.size(F.array_distinct("_g")) < F.size("_g")
    placed = F.when(twice, F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    out = out.select(*carried, placed.alias("_p"))
    # neighbours in hash order with the same hash are repeats
    n = F.size("_p")
    none = F.lit(None).cast("struct<g:bigint,i:int>")
    before = F.concat(F.array(none), F.slice("_p", F.lit(1), n - 1))
    after = F.concat(F.slice("_p", F.lit(2), n - 1), F.array(none))
    same = F.zip_with(before, after, lambda a, b: F.struct(a["g"].alias("a"), b["g"].alias("b")))
    hit = F.zip_with("_p", same, lambda p, s: F.when((p["g"] == s["a"]) | (p["g"] == s["b"]), p["i"]))
    out = out.select(*carried, F.array_sort(F.filter(hit, lambda i: i.isNotNull())).alias("_r"))
    gaps = F.zip_with(F.slice("_r", F.lit(1), F.size("_r") - 1), F.slice("_r", F.lit(2), F.size("_r") - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda acc, x: acc + x)
    out = out.select(*carried, F.when(F.size("_r") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def statistics() -> list[Column]:
    """The transformed statistics: length, mean word length, symbols, repeated lines."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.ln(n + 1),
        F.col("word_chars") / n,
        F.ln(1 + 20 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))),
    ]


def chi2(share: float) -> float:
    """Squared distance that ``share`` of a normal law's rows in four dimensions are within."""
    lo, hi = 0.0, 100.0
    for _ in range(80):
        q = (lo + hi) / 2
        lo, hi = (q, hi) if 1 - math.exp(-q / 2) * (1 + q / 2) < share else (lo, q)
    return lo


def consistency(support: float) -> float:
    """Factor that makes the scatter of the nearest ``support`` share that of all
    rows of a normal law in four dimensions."""
    q = chi2(support)
    return support / (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8))


def _distance2(dims: int) -> Column:
    """Squared Mahalanobis distance by forward substitution with the factor l."""
    z: list[Column] = []
    for i in range(dims):
        r = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            r = r - F.col(f"l{i}{j}") * z[j]
        z.append(r / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _factor(scatter: DataFrame, dims: int, keep: list[str]) -> DataFrame:
    """Cholesky factor l of the scatter columns s, a column at a time."""
    out = scatter
    for j in range(dims):
        under = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"s{j}{j}") - under, F.lit(1e-6))))
        for i in range(j + 1, dims):
            dot = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", (F.col(f"s{i}{j}") - dot) / F.col(f"l{j}{j}"))
    return out.select(*keep, *[f"m{i}" for i in range(dims)], *[f"l{i}{j}" for i in range(dims) for j in range(i + 1)])


def _running(rows: DataFrame, by: list[str], bin_: str) -> DataFrame:
    """Rows of each bin of a group as n, up to its end as upto, and of the group as total."""
    counts = rows.groupBy(*by, bin_).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    return counts.withColumn("upto", F.sum("n").over(group.orderBy(bin_))).withColumn("total", F.sum("n").over(group))


def _starts(rows: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """The first models of each ``g``, numbered k: a centre and a spread of each statistic."""
    dims = len(floors)
    long = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") * 256).cast("long") for i in range(dims)])).alias("d", "b"))
    at = [F.min(F.when(F.col("upto") * GRID >= F.col("total") * k, (F.col("b") + 0.5) / 256)) for k in range(GRID + 1)]
    grid = _running(long, ["g", "d"], "b").groupBy("g", "d").agg(F.array(*at).alias("q"))
    q = [F.col("q")[k] for k in range(GRID + 1)]
    half, quarter = GRID // 2, GRID // 4
    shortest = F.array_min(F.array(*[F.struct((q[k + half] - q[k]).alias("w"), ((q[k + half] + q[k]) / 2).alias("c")) for k in range(GRID - half + 1)]))
    grid = grid.withColumn("h", shortest)
    spread = F.col("h.w")
    pairs = [(q[half], q[half + quarter] - q[quarter]), (F.col("h.c"), spread), (q[quarter], spread), (q[half + quarter], spread)]
    each = grid.select("g", "d", F.posexplode(F.array(*[F.struct(c.alias("c"), (w / 1.349).alias("w")) for c, w in pairs])).alias("k", "v"))
    aggs = []
    for i, floor in enumerate(floors):
        on = F.col("d") == i
        aggs.append(F.max(F.when(on, F.col("v.c"))).alias(f"m{i}"))
        aggs.append(F.max(F.when(on, F.greatest(F.col("v.w"), F.lit(floor)))).alias(f"l{i}{i}"))
    return each.groupBy("g", "k").agg(*aggs).select("*", *[F.lit(0.0).alias(f"l{i}{j}") for i in range(dims) for j in range(i)])


def _estimate(taken: DataFrame, by: list[str], scale: float, floors: tuple[float, ...]) -> DataFrame:
    """Mean and scatter of the rows of ``taken``, which count by their weight w."""
    dims = len(floors)
    x = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(dims)]  # centred: no cancellation
    new = taken.groupBy(*by).agg(
        F.sum("w").alias("n"),
        *[F.sum(F.col("w") * x[i]).alias(f"a{i}") for i in range(dims)],
        *[F.sum(F.col("w") * x[i] * x[j]).alias(f"b{i}{j}") for i in range(dims) for j in range(i + 1)],
        *[F.first(f"m{i}").alias(f"c{i}") for i in range(dims)],
    )
    for i in range(dims):
        new = new.withColumn(f"m{i}", F.col(f"c{i}") + F.col(f"a{i}") / F.col("n"))
        for j in range(i + 1):
            cov = (F.col(f"b{i}{j}") / F.col("n") - F.col(f"a{i}") * F.col(f"a{j}") / (F.col("n") * F.col("n"))) * F.lit(scale)
            new = new.withColumn(f"s{i}{j}", cov + F.lit(floors[i] ** 2 if i == j else 0.0))
    return _factor(new, dims, by)


def fit(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Minimum covariance determinant estimate of each ``g``: columns m and l.

    ``rows`` has g and x0, x1, ...; at every step the nearest rows are taken by
    bins of the log distance.  All rows of the last bin count by the same part, so
    ties are not split and the rows taken weigh ``support`` of the group.
    """
    dims = len(floors)
    model = store(_starts(rows, floors))
    names = [c for c in model.columns if c not in ("g", "k")]
    for _ in range(steps):
        near = rows.join(model, "g").withColumn("b", F.floor(F.ln(_distance2(dims) + 1e-9) * 64).cast("long"))
        want = F.lit(support) * F.col("total")
        last = _running(near, ["g", "k"], "b").where((F.col("upto") >= want) & (F.col("upto") - F.col("n") < want))
        cut = store(last.select("g", "k", F.col("b").alias("cut"), ((want - F.col("upto") + F.col("n")) / F.col("n")).alias("part")))
        taken = near.join(cut, ["g", "k"]).where("b <= cut").withColumn("w", F.when(F.col("b") < F.col("cut"), F.lit(1.0)).otherwise(F.col("part")))
        model = store(_estimate(taken, ["g", "k"], consistency(support), floors))
    # rounded: starts that meet differ by the order of sums only
    size = F.round(sum((F.ln(f"l{i}{i}") for i in range(dims)), F.lit(0.0)), 6)
    best = model.groupBy("g").agg(F.min(F.struct(size.alias("size"), "k", *names)).alias("v")).select("g", *[f"v.{c}" for c in names])
    within = rows.join(store(best), "g").where(_distance2(dims) <= chi2(REWEIGHT)).withColumn("w", F.lit(1.0))
    return store(_estimate(within, ["g"], consistency(REWEIGHT), floors))


def _shrunk(sizes: DataFrame, model: DataFrame, prior: float, dims: int) -> DataFrame:
    """Estimate of each _g0 of ``sizes`` (_g0, _l0, _k): its own, drawn towards that of _l0."""
    names = [f"m{i}" for i in range(dims)] + [f"l{i}{j}" for i in range(dims) for j in range(i + 1)]
    own = model.select(F.col("g").alias("_g0"), *[F.col(c).alias(f"own_{c}") for c in names])
    lang = model.select(F.col("g").alias("_l0"), *[F.col(c).alias(f"lang_{c}") for c in names])
    both = sizes.join(own, "_g0").join(lang, "_l0")
    weight = F.col("_k") / (F.col("_k") + F.lit(float(prior)))

    def mean(of) -> Column:
        return weight * of("own_") + (1 - weight) * of("lang_")

    def scatter(i: int, j: int) -> Column:
        return mean(lambda p: sum((F.col(f"{p}l{i}{k}") * F.col(f"{p}l{j}{k}") for k in range(j + 1)), F.lit(0.0)))

    ms = [mean(lambda p, i=i: F.col(f"{p}m{i}")).alias(f"m{i}") for i in range(dims)]
    return _factor(both.select("_g0", *ms, *[scatter(i, j).alias(f"s{i}{j}") for i in range(dims) for j in range(i + 1)]), dims, ["_g0"])


def judge(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, cutoff: float = CUTOFF, prior: float = PRIOR, **how
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with the base counts,
    distance2 (null if the base rule failed) and kept."""
    docs = without(docs, *ADDED)
    keep = docs.columns if keep is None else keep
    lang, source = F.col(f"`{lang_col}`").cast("string").alias("l"), F.col(f"`{source_col}`").cast("string").alias("s")
    named = base_counts(docs.withColumn("_g0", F.concat(F.lit("g"), F.to_json(F.struct(lang, source)))).withColumn("_l0", F.concat(F.lit("l"), F.to_json(F.struct(lang)))), text_col)
    rows = store(named.select(*[f"`{c}`" for c in keep], "_g0", "_l0", *BASE, *[x.cast("double").alias(f"x{i}") for i, x in enumerate(statistics())]))
    passed = rows.where("not base_failed").select("_g0", "_l0", *[f"x{i}" for i in range(DIMS)])
    model = fit(passed.select(F.explode(F.array("_g0", "_l0")).alias("g"), *[f"x{i}" for i in range(DIMS)]), **how)
    sizes = passed.groupBy("_g0", "_l0").agg(F.count("*").alias("_k"))
    out = rows.join(store(_shrunk(sizes, model, prior, DIMS)), "_g0", "left")
    d2 = F.when(~F.col("base_failed"), _distance2(DIMS))
    out = out.withColumn("distance2", d2)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))).select(*[f"`{c}`" for c in keep], *ADDED)
