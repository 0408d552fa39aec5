"""Mixing documents to target weights by iterative proportional fitting.

The tokens of the documents are summed by cell (source, language, topic). Each dimension has target weights: a mapping from
values to weights, a table of them, or a power, which makes the shares that the corpus has more even. The tokens to keep of
each value follow from its target, ``share`` of all tokens in all; a value with fewer tokens is kept whole and the others of its
dimension share the rest (reachable). Then the cells are raked to these marginals in turn, never above their tokens, until all
fit; a document is kept with the probability that its cell's raked tokens ask for.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm._shared import discard, id_text, parked

#: What a dimension is raked to: a power of its shares, weights by value, or a table (value, weight).
Target = float | Mapping[str, float] | DataFrame
#: The dimensions of a cell, and the powers of production.
DIMS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Turns at most, and the share of all tokens by which no value may be off; bounds of a weight against its cell's tokens.
TURNS, TOLERANCE, FAR = 300, 1e-12, 1e12


def topic_of(text: Column) -> Column:
    """A coarse topic: licensed (speaks of a licence or of rights), tabular (more than five bars), contact (an at sign), else prose."""
    t = F.coalesce(text, F.lit(""))
    bars = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    return F.when(t.contains("icense") | t.contains("rights reserved"), "licensed").when(bars > 5, "tabular").when(t.contains("@"), "contact").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Words between blanks and line ends, 1 at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \n]+"))).cast("long")


def marked(docs: DataFrame, topic: Callable[[Column], Column] | str = topic_of, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``docs`` with _source, _lang, _topic (of the text, or the column that ``topic`` names) and _tokens; null values are empty texts."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kind = F.col(topic) if isinstance(topic, str) else topic(F.col(text_col))
    return docs.select("*", named(F.col(source_col)).alias("_source"), named(F.col(lang_col)).alias("_lang"), named(kind).alias("_topic"), tokens_of(F.col(text_col)).alias("_tokens"))


def wanted(cells: DataFrame, targets: Mapping[str, Target], share: float) -> dict[str, DataFrame]:
    """For each dimension (value, n, target, want): the tokens of each value, its share of the targets, its reachable tokens.

    Values are ordered by tokens against target: those that run out at their share of what is left come first. A value without
    a target has the target 0, and so has a target's value that no document has.
    """
    found = {}
    for dim, target in targets.items():
        sums = cells.groupBy(F.col(f"_{dim}").alias("value")).agg(F.sum("tokens").alias("n"))
        if isinstance(target, (int, float)):
            named = sums.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(target))))
        else:
            given = target if isinstance(target, DataFrame) else cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in target.items()], "value string, weight double")
            named = sums.join(given.groupBy("value").agg(F.sum("weight").alias("weight")), "value", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        found[dim] = parked(named.select("value", "n", "weight"), "targets")
    return {dim: _reachable(t, share) for dim, t in found.items()}


def _reachable(values: DataFrame, share: float) -> DataFrame:
    whole = values.agg(F.sum("n").alias("all"), F.sum("weight").alias("weights"))
    of = values.crossJoin(F.broadcast(whole)).select("value", "n", "all", F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0).alias("target"))
    scale, full = 0.0, -1  # tokens for a target of 1, and how many values run out at that
    while True:
        out = F.col("target") * F.lit(scale) >= F.col("n")
        kept, free = F.sum(F.when(out, F.col("n")).otherwise(0)), F.sum(F.when(out, 0.0).otherwise(F.col("target")))
        r = of.agg(kept.alias("kept"), free.alias("free"), F.count_if(out).alias("full"), F.max("all").alias("all")).first()
        if r["all"] is None or not r.free or r.full == full:
            break
        # those that run out are kept whole, which leaves more to the others, so that more of them may run out
        full, scale = r.full, max(scale, (share * r["all"] - r.kept) / r.free)
    part = F.col("target") * F.lit(scale)
    return parked(of.select("value", "n", "target", F.when(part >= F.col("n"), F.col("n").cast("double")).otherwise(part).alias("want")), "wanted")


def raked_here(tokens: np.ndarray, codes: list[np.ndarray], wants: list[np.ndarray], share: float) -> tuple[np.ndarray, float]:
    """Rates of the cells, and the share of all tokens by which some value is off: for cells that fit the driver."""
    weight, off = tokens * share, 0.0
    for _ in range(TURNS):
        off = 0.0
        for code, want in zip(codes, wants):
            full = weight >= tokens
            kept, filled, free = np.bincount(code, np.minimum(weight, tokens)), np.bincount(code, tokens * full), np.bincount(code, weight * ~full)
            off = max(off, float(np.abs(kept - want).max()) / tokens.sum())
            down = np.divide(want, kept, out=np.zeros_like(want), where=kept > 0)
            up = np.divide(want - filled, free, out=np.ones_like(want), where=free > 0)
            weight = np.clip(weight * np.where(want < kept, down, up)[code], tokens / FAR, tokens * FAR)
        if off <= TOLERANCE:
            break
    return np.minimum(1.0, weight / tokens), off


def raked(cells: DataFrame, wants: Mapping[str, DataFrame], share: float) -> tuple[DataFrame, float]:
    """``cells`` with _rate, and the share of all tokens by which some value is off: raked_here() for a table of cells that is never gathered;
    each turn is written to the shared folder."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    w, n = F.col("weight"), F.col("tokens")
    now = before = parked(cells.withColumn("weight", n * F.lit(share)), "raked")
    left = 0.0
    for _ in range(TURNS):
        off = F.lit(0.0)
        for dim, t in wants.items():
            d = f"_{dim}"
            sums = now.groupBy(d).agg(F.sum(F.least(w, n.cast("double"))).alias("kept"), F.sum(F.when(w >= n, n).otherwise(0)).alias("filled"), F.sum(F.when(w >= n, 0.0).otherwise(w)).alias("free"))
            sums = sums.join(t.select(F.col("value").alias(d), "want"), d)
            down = F.when(F.col("kept") > 0, F.col("want") / F.col("kept")).otherwise(0.0)
            up = F.when(F.col("free") > 0, (F.col("want") - F.col("filled")) / F.col("free")).otherwise(1.0)
            sums = sums.select(d, F.when(F.col("want") < F.col("kept"), down).otherwise(up).alias("factor"), (F.abs(F.col("kept") - F.col("want")) / total).alias(f"off{d}"))
            now = now.drop(f"off{d}").join(sums, d).withColumn("weight", F.greatest(n / FAR, F.least(n * FAR, w * F.col("factor")))).drop("factor")
            off = F.greatest(off, F.col(f"off{d}"))
        now = parked(now, "raked")
        discard(before)
        before = now
        left = now.agg(F.max(off)).first()[0] or 0.0
        if left <= TOLERANCE:
            break
    return now.select(*cells.columns, F.least(F.lit(1.0), w / n).alias("_rate")), left


def weighted(rows: DataFrame, targets: Mapping[str, Target] = POWERS, share: float = 0.5, driver_cells: int = 50_000) -> DataFrame:
    """The rows of marked() with _rate, the chance with which a row of its cell is to be kept.

    Up to ``driver_cells`` cells are raked on the driver and their rates broadcast; more are raked as a table and joined. Both end when every
    value fits within TOLERANCE. Marginals that contradict each other never do; then a warning says by how much, as does the
    result's attribute ``off``.
    """
    keys = [f"_{d}" for d in DIMS]
    cells = parked(rows.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")), "cells")
    wants = wanted(cells, targets, share)
    if cells.count() > driver_cells:
        rates, off = raked(cells, wants, share)
        return _told(rows.join(parked(rates, "rates").select(*keys, "_rate"), keys), off)
    here, spark = cells.collect(), rows.sparkSession
    codes, marks = [], []
    for dim, t in wants.items():
        want = {r.value: r.want for r in t.collect()}
        number = {v: i for i, v in enumerate(want)}
        codes.append(np.array([number[r[f"_{dim}"]] for r in here], np.int64))
        marks.append(np.array(list(want.values())))
    found, off = raked_here(np.array([r.tokens for r in here], np.float64), codes, marks, share) if here else (np.zeros(0), 0.0)
    chances = spark.createDataFrame([(*[r[k] for k in keys], x) for r, x in zip(here, found.tolist())], ", ".join(f"{k} string" for k in keys) + ", _rate double")
    return _told(rows.join(F.broadcast(chances), keys), off)


def _told(found: DataFrame, off: float) -> DataFrame:
    found.off = off
    if off > TOLERANCE:
        warnings.warn(f"the targets contradict each other: after {TURNS} turns a value is off by {off:.2g} of all tokens", stacklevel=3)
    return found


def achieved(found: DataFrame, targets: Mapping[str, Target], share: float) -> DataFrame:
    """(dimension, value, target, reachable, kept) for a result of weighted(): the share of the kept tokens that the targets ask
    for, the one that the documents allow, and the one that the rates give."""
    cells = parked(found.groupBy(*[f"_{d}" for d in DIMS]).agg(F.sum("_tokens").alias("tokens"), F.sum(F.col("_tokens") * F.col("_rate")).alias("part")), "achieved")
    total = cells.agg(F.sum("tokens").alias("n"), F.sum("part").alias("part")).first()
    out = None
    for dim, t in wanted(cells, targets, share).items():
        sums = cells.groupBy(F.col(f"_{dim}").alias("value")).agg(F.sum("part").alias("part")).join(t, "value")
        part = sums.select(F.lit(dim).alias("dimension"), "value", "target", (F.col("want") / (share * (total.n or 1))).alias("reachable"), (F.col("part") / (total.part or 1)).alias("kept"))
        out = part if out is None else out.unionByName(part)
    return out


def uniform(id_col: str, seed: str) -> Column:
    """A number from 0 to 1 from the id alone: the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(id_text(id_col), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixed(docs: DataFrame, targets: Mapping[str, Target] = POWERS, share: float = 0.5, topic: Callable[[Column], Column] | str = topic_of, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", driver_cells: int = 50_000) -> DataFrame:
    """A sample of ``docs`` with about ``share`` of its tokens, in the proportions of raked source, language and topic weights.

    A value with fewer tokens than its target asks for is kept whole, and the others of its dimension keep their proportions;
    marginals that contradict each other are fitted as far as TURNS turns get; achieved() tells. A document is kept if a number
    hashed from its id is below its cell's chance, so repeated rows stay or go together. Null sources, languages and topics are
    values of their own (the empty text); a null or empty text has one token. Columns of ``docs`` are kept whatever their names
    are. No document, no result.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = marked(docs.toDF(*at.values()), at[topic] if isinstance(topic, str) else topic, at[text_col], at[source_col], at[lang_col])
    kept = weighted(rows, targets, share, driver_cells).filter(uniform(at[id_col], seed) < F.col("_rate"))
    return kept.select(*at.values()).toDF(*docs.columns)


def mixing_of(docs: DataFrame, targets: Mapping[str, Target] = POWERS, share: float = 0.5, seed: str = "mix") -> DataFrame:
    """(doc_id, topic, n_tokens, rate, kept) of each document; texts are read once."""
    rows = parked(marked(docs).select("doc_id", "_source", "_lang", "_topic", "_tokens"), "marked")
    found = weighted(rows, targets, share)
    return found.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_rate", 6).alias("rate"), (uniform("doc_id", seed) < F.col("_rate")).alias("kept"))


def oracle(powers: Mapping[str, float] = POWERS, share: float = 0.5, seed: str = "mix") -> str:
    """DuckDB SQL for the rows of mixing_of(), with TURNS turns."""
    names = {"source": "s", "lang": "l", "topic": "t"}
    steps = [
        """d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') s, coalesce(lang, '') l,
                CASE WHEN contains(text, 'icense') OR contains(text, 'rights reserved') THEN 'licensed' WHEN length(text) - length(replace(text, '|', '')) > 5 THEN 'tabular'
                     WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END t,
                greatest(1, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\n]'), lambda w: w <> ''))) n FROM documents)""",
        "c AS MATERIALIZED (SELECT s, l, t, sum(n)::DOUBLE n FROM d GROUP BY s, l, t)",
    ]
    for d, p in powers.items():
        k = names[d]
        steps += [
            f"g{k} AS (SELECT {k}, sum(n) n, pow(sum(n), {p}) / sum(pow(sum(n), {p})) OVER () target, {share} * sum(sum(n)) OVER () budget FROM c GROUP BY {k})",
            # in the order of tokens against target, the first ones run out
            f"""o{k} AS (SELECT *, (budget - coalesce(sum(n) OVER (ORDER BY n / target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(target) OVER (ORDER BY n / target ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) z FROM g{k})""",
            f"f{k} AS (SELECT *, bool_and(target * z >= n) OVER (ORDER BY n / target ROWS UNBOUNDED PRECEDING) AS gone FROM o{k})",
            f"""m{k} AS MATERIALIZED (SELECT {k}, CASE WHEN gone THEN n ELSE target * (budget - coalesce(sum(CASE WHEN gone THEN n END) OVER (), 0)) / sum(CASE WHEN NOT gone THEN target END) OVER () END want FROM f{k})""",
        ]
    inner = "r"
    for d in powers:
        k = names[d]
        sums = f"SELECT x.*, want, sum(least(w, n)) OVER p kept, sum(CASE WHEN w >= n THEN n ELSE 0 END) OVER p filled, sum(CASE WHEN w >= n THEN 0 ELSE w END) OVER p free FROM {inner} x JOIN m{k} USING ({k}) WINDOW p AS (PARTITION BY x.{k})"
        factor = "CASE WHEN want < kept THEN want / kept WHEN free > 0 THEN (want - filled) / free ELSE 1.0 END"
        inner = f"(SELECT i, s, l, t, n, greatest(n / {FAR}, least(n * {FAR}, w * {factor})) w FROM ({sums}))"
    steps.append(f"r AS (SELECT 0 i, s, l, t, n, n * {share} w FROM c UNION ALL SELECT i + 1, s, l, t, n, w FROM {inner} WHERE i < {TURNS})")
    uniform_sql = f"(('0x' || substr(md5(doc_id::VARCHAR || ':{seed}'), 1, 13))::BIGINT / pow(2, 52))"
    rate = "least(1.0, w / r.n)"
    return f"WITH RECURSIVE {', '.join(steps)} SELECT doc_id, t AS topic, d.n::BIGINT AS n_tokens, round({rate}, 6) AS rate, {uniform_sql} < {rate} AS kept FROM d JOIN (SELECT * FROM r WHERE i = {TURNS}) r USING (s, l, t)"
