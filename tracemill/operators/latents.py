"""Quantile fit and binning of scalars into categorical traits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.phonology import ACOUSTIC, GROUPS, PHONOLOGY
from tracemill.operators import quantiles
from tracemill.operators.held import held

#: The lower and the upper quantile.
LOWER, UPPER = 0.33, 0.66


def number(df: DataFrame, scalar: str) -> Column:
    """The scalar as a double; what is no number is null."""
    v = df[scalar].cast("double")
    return F.when(~F.isnan(v), v)


def long_form(df: DataFrame, scalars: Sequence[str], weight: str | None = None) -> DataFrame:
    """(scalar, v, w): one row for each row and scalar, and how often it counts."""
    cells = F.array(*[F.struct(F.lit(s).alias("scalar"), number(df, s).alias("v")) for s in scalars])
    w = df[weight].cast("long") if weight else F.lit(1).cast("long")
    return df.select(F.explode(cells).alias("x"), w.alias("w")).select("x.*", "w")


def sketches(df: DataFrame, scalars: Sequence[str], weight: str | None = None) -> DataFrame:
    """(scalar, sketch, n, min, max) of one scan; see quantiles.sketched(). They can be kept by writers.write_sketches() and merged
    with those of later rows by quantiles.merged()."""
    if weight:
        return quantiles.sketched(long_form(df, scalars, weight), weight="w")
    rows = [F.struct(F.lit(s).alias("scalar"), *quantiles.sums_of(number(df, s), F.count(number(df, s)))) for s in scalars]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def fit(df: DataFrame, scalars: Sequence[str], weight: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """One row per scalar: q33, q66, min, max over its values that are numbers; without any, the quantiles are 0 and the others null.

    Exact, in two scans of ``df``: sketches (or those ``found`` before, of the same rows), then counts within their brackets.
    ``weight`` says how often a row counts.
    """
    found = held(found if found is not None else sketches(df, scalars, weight), "sketches")
    rows = long_form(df, scalars, weight)
    each = quantiles.exact(rows, found, (LOWER, UPPER), weight="w" if weight else None, few=True)
    return _both(found, each)


def _both(found: DataFrame, each: DataFrame) -> DataFrame:
    at = lambda q: F.coalesce(F.max(F.when(F.col("q") == q, F.col("value"))), F.lit(0.0))
    return found.join(each, "scalar", "left").groupBy("scalar", "min", "max").agg(at(LOWER).alias("q33"), at(UPPER).alias("q66")).select("scalar", "q33", "q66", "min", "max")


def fit_by_rank(df: DataFrame, scalars: Sequence[str], weight: str | None = None) -> DataFrame:
    """As fit(), without sketches: all distinct values are counted and sorted in ranges. An empty table gives no rows."""
    rows = long_form(df, scalars, weight)
    counts = held(rows.filter("v IS NOT NULL AND w > 0").groupBy("scalar", "v").agg(F.sum("w").alias("n")), "counts")
    whole = counts.groupBy("scalar").agg(F.sum("n").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    wanted = whole.select("scalar", F.explode(F.array(F.lit(LOWER), F.lit(UPPER))).alias("q"), "n").select("scalar", "q", (F.col("q") * (F.col("n") - 1)).alias("place"))
    every = rows.select("scalar").distinct().join(whole.select("scalar", "min", "max"), "scalar", "left")
    return _both(every, quantiles.by_rank(counts, wanted, ["scalar"]))


def fit_row(df: DataFrame, scalars: Sequence[str], weight: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """The same fit as one row with columns <scalar>_q33 and <scalar>_q66, to be joined by broadcast."""
    rows = fit(df, scalars, weight, found)
    return rows.agg(*[F.coalesce(F.max(F.when(F.col("scalar") == s, F.col(n))), F.lit(0.0)).alias(f"{s}_{n}") for s in scalars for n in ("q33", "q66")])


def bin_label(value: Column, q33: Column, q66: Column, labels: Sequence[str]) -> Column:
    """Edges are inclusive; NaN and null go to the last label, an unfitted scalar (null quantiles) to the middle one."""
    low, mid, high = labels
    v = F.coalesce(value.cast("double"), F.lit(float("nan")))
    return F.when(q33.isNull() | q66.isNull(), F.lit(mid)).when(v <= q33, F.lit(low)).when(v <= q66, F.lit(mid)).otherwise(F.lit(high))


def apply(df: DataFrame, stats: DataFrame, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """``df`` with a column <scalar>_bin for each scalar of ``labels``; ``stats`` is one row of fit_row()."""
    return df.crossJoin(F.broadcast(stats)).select(*[df[c] for c in df.columns], *[bin_label(df[s], stats[f"{s}_q33"], stats[f"{s}_q66"], ls).alias(f"{s}_bin") for s, ls in labels.items()])


def traits(df: DataFrame, stats: DataFrame | None = None, version: str = "v3") -> DataFrame:
    """``df`` with latent_json, the 17 traits of its scalars in two groups; ``stats`` is one row of fit_row(), else fitted on
    ``df``, which is then written to the shared folder first, as it is read three times."""
    named = {**ACOUSTIC, **PHONOLOGY}
    scalars = [s for s, _ in named.values()]
    if stats is None:
        df = held(df, "scalars")
        stats = fit_row(df, scalars)
    label = {t: bin_label(df[s], stats[f"{s}_q33"], stats[f"{s}_q66"], ls).alias(t) for t, (s, ls) in named.items()}
    label["syllabic_consonants"] = F.when(df["has_syllabic"] > 0.5, "present").otherwise("absent").alias("syllabic_consonants")
    groups = [F.struct(*[label[t] for t in ts]).alias(g) for g, ts in GROUPS.items()]
    return df.crossJoin(F.broadcast(stats)).select(*[df[c] for c in df.columns], F.struct(F.lit(version).alias("latent_version"), *groups).alias("latent_json"))


def flattened(latent: Column) -> Column:
    """The traits of all groups and the version as one map from names to labels."""
    pairs = [F.struct(F.lit("latent_version").alias("k"), latent["latent_version"].alias("v"))]
    pairs += [F.struct(F.lit(t).alias("k"), latent[g][t].alias("v")) for g, ts in GROUPS.items() for t in ts]
    return F.map_from_entries(F.array(*pairs))
