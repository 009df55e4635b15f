"""Mixing sources to target weights: iterative proportional fitting, in DataFrame operations only.

Documents are counted into cells (source, language, topic).  Token weights of the cells are raked in turn to the
target marginals of each dimension; the raked weights give every cell a budget of tokens, hence an inclusion
probability, calibrated so that what saturated cells cannot give is spread over the others.  A document is sampled
when a hash of its doc_id, uniform on [0, 1), lies under its cell's probability.

Raking goes on in blocks of rounds until all marginals are met within ``TOLERANCE``; where they can't be (a source of one
language only, and targets that contradict each other), it ends after ``MAX_ROUNDS`` with a warning that gives what is
left, and the sample follows the last dimension.  Calibration likewise ends when the budget is met or nothing is left
to spread.

Targets follow tempered shares: a value's target is its share of tokens raised to a power, normalised (0: all values
alike, 1: as they are), or fixed shares given as a dictionary (values not named share what is left by their tokens).

Scale: one pass with map-side partial counts makes the cells; raking touches cells alone, a table of
|sources| x |languages| x |topics| rows at most, in windows by one dimension; what sums over all cells is a number on
the driver.  Documents meet their cell's probability in a size-checked broadcast join.  A source that holds a third of
all rows is one cell row per task before the shuffle.

Defined results: null source or lang is the value ''.  Null or blank text has no tokens: topic 'empty', probability 0,
not kept.  Null doc_id hashes as ''.  Repeated rows share one fate.  An empty table gives no rows.  Extra columns of
the documents pass through ``sample``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stage, small, stage, table

DIMS = ("source", "lang", "topic")
#: Powers of the tempered target shares.
TEMPER = {"source": 0.0, "lang": 0.5, "topic": 0.7}
#: Share of all tokens that the sample should hold; raking and calibration rounds at least.
BUDGET, ROUNDS, CALIBRATION = 0.5, 10, 6
#: Rounds between two looks at the marginals; how far they may be off, as a share of all tokens; rounds at most.
BLOCK, TOLERANCE, MAX_ROUNDS = 5, 1e-9, 200
#: Cells up to this number are raked in one task and broadcast; beyond it they are shuffled by the dimension in turn.
MAX_CELLS = 200_000

#: Word characters are all but white space.
_NOT_SPACE = r"[^\x20\x09-\x0D]+"


def features_sql(words: str) -> str:
    """SQL of a document's columns, valid in either engine but for how words are counted."""
    return f"""
SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_tokens,
       CASE WHEN n_tokens = 0 THEN 'empty'
            WHEN 10 * (length(text) - length(replace(text, '|', ''))) >= n_tokens THEN 'table'
            WHEN 20 * (length(text) - length(replace(text, '!!', ''))) >= n_tokens THEN 'loud'
            WHEN 20 * (length(text) - length(replace(text, '#', ''))) >= n_tokens THEN 'marked'
            WHEN n_tokens < 50 THEN 'brief' WHEN n_tokens < 800 THEN 'prose' ELSE 'long' END AS topic
FROM (SELECT doc_id, source, lang, text, {words} AS n_tokens FROM {{docs}})"""


def _features(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_NOT_SPACE)), F.lit(0)).cast("bigint")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = lambda m: F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))
    t = F.col("__n")
    topic = F.when(t == 0, "empty").when(marks("|") * 10 >= t, "table").when(marks("!!") * 20 >= t, "loud").when(marks("#") * 20 >= t, "marked").when(t < 50, "brief").when(t < 800, "prose").otherwise("long")
    return docs.withColumn("__n", n).withColumn("__source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("__lang", F.coalesce(F.col("lang").cast("string"), F.lit(""))).withColumn("__topic", topic)


def rake_sql(cells: str, temper: dict[str, float], rounds: int, calibration: int, budget: float) -> str:
    """SQL from a cell table (source, lang, topic, n) to (..., p), the calibrated probabilities."""
    ctes = [f"c0 AS (SELECT *, CAST(n AS DOUBLE) AS w, CAST(sum(n) OVER () AS DOUBLE) AS total FROM {cells} WHERE n > 0)"]
    for d in DIMS:
        ctes.append(f"s_{d} AS (SELECT {d}, power(CAST(sum(n) AS DOUBLE), CAST({temper[d]} AS DOUBLE)) AS share FROM c0 GROUP BY {d})")
        ctes.append(f"t_{d} AS (SELECT {d}, share / sum(share) OVER () AS target_{d} FROM s_{d})")
    ctes.append("r0 AS (SELECT c0.*, target_source, target_lang, target_topic FROM c0 JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    step = 0
    for _ in range(rounds):
        for d in DIMS:
            ctes.append(f"r{step + 1} AS (SELECT source, lang, topic, n, total, target_source, target_lang, target_topic, w * target_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM r{step})")
            step += 1
    ctes.append(f"k0 AS (SELECT source, lang, topic, n, total, w / sum(w) OVER () * total * {budget} AS want, CAST(1.0 AS DOUBLE) AS scale FROM r{step})")
    for i in range(calibration):
        ctes.append(f"k{i + 1} AS (SELECT source, lang, topic, n, total, want, scale * coalesce((total * {budget} - sum(CASE WHEN want * scale >= n THEN n ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN want * scale < n THEN want * scale ELSE 0 END) OVER (), 0), 1) AS scale FROM k{i})")
    return f"WITH {', '.join(ctes)} SELECT source, lang, topic, n, want / (total * {budget}) AS weight, least(CAST(1.0 AS DOUBLE), greatest(CAST(0.0 AS DOUBLE), want * scale / n)) AS p FROM k{calibration}"


def rake(cells: DataFrame, temper: dict[str, float], rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """((source, lang, topic, n, w), what is left): weights that sum to 1, and the largest distance from a target."""
    for d in DIMS:
        shares = cells.groupBy(d).agg(F.pow(F.sum("n").cast("double"), F.lit(float(temper[d]))).alias("share"))
        every = shares.agg(F.sum("share")).first()[0]
        cells = cells.join(small(stage(shares.select(d, (F.col("share") / every).alias(f"target_{d}")), f"targets-{d}"), MAX_CELLS), d)
    now, done, left = cells.withColumn("w", F.col("n").cast("double")), 0, 1.0
    few = now.limit(MAX_CELLS + 1).count() <= MAX_CELLS
    while done < rounds or (left > TOLERANCE and done < MAX_ROUNDS):
        if few:
            now = now.coalesce(1)  # one small partition: the windows need no exchange
        for _ in range(BLOCK):
            for d in DIMS:
                now = now.withColumn("w", F.col("w") * F.col(f"target_{d}") / F.sum("w").over(Window.partitionBy(d)))
        now, before = stage(now, "raked"), now
        drop_stage(before)
        done += BLOCK
        off = [now.groupBy(d).agg(F.abs(F.sum("w") - F.first(f"target_{d}")).alias("off")).select("off") for d in DIMS[:-1]]  # the last is met
        left = max([0.0, *(x.agg(F.max("off")).first()[0] or 0.0 for x in off)])
    return now, left


def probabilities(featured: DataFrame, temper: dict[str, float] | None = None, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, n, weight, p): raked weight (all sum to 1) and probability of each cell with tokens."""
    cells = featured.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__n").alias("n"))
    cells = stage(cells.where("n > 0"), "cells")
    total = cells.agg(F.sum("n").cast("double")).first()[0]
    if not total:
        return cells.select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("p"))
    raked, left = rake(cells, temper or TEMPER, rounds)
    if left > TOLERANCE:
        warnings.warn(f"the targets contradict each other: a marginal is off by {left:.3g} of all tokens", stacklevel=2)
    weights = raked.agg(F.sum("w")).first()[0]
    want = F.col("w") / weights * total * budget
    scale, rounds = 1.0, 0
    while True:
        full = want * scale >= F.col("n")
        held, rest = raked.agg(F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)), F.sum(F.when(~full, want * scale))).first()
        factor = (total * budget - held) / rest if rest else 1.0
        scale, rounds = scale * factor, rounds + 1
        if rounds >= CALIBRATION and (abs(factor - 1) < TOLERANCE or rounds >= MAX_ROUNDS):
            break
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), want * scale / F.col("n")))
    return stage(raked.select("source", "lang", "topic", "n", (want / (total * budget)).alias("weight"), p.alias("p")), "probabilities")


def sampled(docs: DataFrame, **kw) -> DataFrame:
    """The documents with __n, __source, __lang, __topic, __weight, __p and __kept."""
    featured = _features(docs)
    cells = small(probabilities(featured, **kw).select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), F.round("p", 9).alias("__p"), F.round("weight", 9).alias("__weight")), MAX_CELLS)
    u = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    joined = featured.join(cells, ["__source", "__lang", "__topic"], "left").fillna(0.0, ["__p", "__weight"])
    return joined.withColumn("__kept", u < F.col("__p"))


def sample(docs: DataFrame, **kw) -> DataFrame:
    """The sampled documents: all columns, and their calibrated probability as ``mix_p`` (in place of one of that name)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")  # so that no column clashes with those of sampled
    kept = sampled(docs.select("doc_id", "text", "lang", "source", row), **kw).where("__kept")
    return kept.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c.lower() != "mix_p"], F.col("__p").alias("mix_p"))


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = sampled(docs)
    return out.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__n").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__p").alias("p"), F.col("__kept").alias("kept"))


_DOCS = features_sql(f"coalesce(len(regexp_extract_all(text, '{_NOT_SPACE}')), 0)::BIGINT").format(docs="documents")
SQL = {
    "op10_mixing": f"""
WITH f AS ({_DOCS}), cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS n FROM f GROUP BY 1, 2, 3),
pr AS ({rake_sql("cells", TEMPER, ROUNDS, CALIBRATION, BUDGET)})
SELECT doc_id, f.source, f.lang, f.topic, n_tokens, coalesce(round(weight, 9), 0) AS weight, coalesce(round(p, 9), 0) AS p,
       ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < coalesce(round(p, 9), 0) AS kept
FROM f LEFT JOIN pr ON f.source = pr.source AND f.lang = pr.lang AND f.topic = pr.topic""",
}
QUERIES = {"op10_mixing": op10_mixing}
