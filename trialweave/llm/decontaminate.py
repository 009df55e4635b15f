"""Benchmark decontamination through a distributed positional inverted index.

Steps (documents D, benchmark items B):

1. Every benchmark item gives windows of 13 consecutive words (a shorter item is one window).
2. One pass over D counts the terms that the windows use; each window is planned by its rarest terms.
3. A second pass stores postings ``(term, text, positions)`` for the planned terms, one for each different text,
   dealt by term and text, so that the postings of a common term are spread.
4. Offset-adjusted lists are intersected from the rarest term: a posting of term t at position p proposes the start
   ``p - offset(t)``; the next terms must have ``start + offset`` in their own list of the same document.
5. What survives is compared word by word with the document (exact phrase), and covered words are counted.

``proximity`` answers the looser question (all words of a short phrase within a span) on the same postings.

Scale: D is never shuffled.  Only counts of window terms, postings of planned (rare) terms and surviving
candidates move.  Windows are handled in blocks of at most ``MAX_WINDOWS``, so what each task holds is bounded.

Defined results: null text has no words (0, 0, 0, hash of the empty string, false).  Rows that repeat a
(doc_id, text) each get their row.  Null doc_id is a value like any other.  A null benchmark text has no windows;
a null item_id counts as the id ''.  Empty tables give empty results or zero hits.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, small, stage, text_key, unused
from .textkit import ALNUM_WORDS

WINDOW = 13
#: Windows whose lists are intersected at a time; what a task holds of the benchmark is bounded by it.
MAX_WINDOWS = 200_000
#: Lists intersected before the exact comparison.
LISTS = 3
#: Candidate documents up to this many rows are sent to all tasks; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000

_TABLE = ALNUM_WORDS.tobytes()


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win, items): the distinct windows as space-joined words, with the ids of their items."""

    def of(batches):
        for b in batches:
            win, item = [], []
            for i, text in zip(b["item"].to_pylist(), b["text"].to_pylist(), strict=True):
                w = split_words(text)
                for s in range(max(len(w) - size + 1, 1) if w else 0):
                    win.append(b" ".join(w[s : s + size]))
                    item.append(i)
            yield pa.record_batch({"win": pa.array(win, pa.binary()), "item": pa.array(item, pa.string())})

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "win binary, item string").groupBy("win").agg(F.collect_set("item").alias("items"))


def term_counts(docs: DataFrame, vocabulary: set[bytes]) -> DataFrame:
    """(term, df): occurrences of each term of the vocabulary in all documents."""

    def of(batches):
        for b in batches:
            c: Counter = Counter()
            for text in b["text"].to_pylist():
                c.update(split_words(text))
            hit = {t: n for t, n in c.items() if t in vocabulary}
            yield pa.record_batch({"term": pa.array(hit.keys(), pa.binary()), "n": pa.array(hit.values(), pa.int64())})

    return docs.select("text").mapInArrow(of, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: set[bytes]) -> DataFrame:
    """(term, tk, positions), positions ascending, for the given terms; rows of equal text each give theirs."""

    def of(batches):
        for b in batches:
            keys, ts, ps = [], [], []
            for k, text in zip(b["tk"].to_pylist(), b["text"].to_pylist(), strict=True):
                found: dict[bytes, list[int]] = {}
                for p, w in enumerate(split_words(text)):
                    if w in terms:
                        found.setdefault(w, []).append(p)
                keys += [k] * len(found)
                ts += found.keys()
                ps += found.values()
            yield pa.record_batch({"term": pa.array(ts, pa.binary()), "tk": pa.array(keys, pa.int64()), "positions": pa.array(ps, pa.list_(pa.int32()))})

    return docs.select("tk", "text").mapInArrow(of, "term binary, tk bigint, positions array<int>")


def inverted(docs: DataFrame, terms: set[bytes]) -> DataFrame:
    """The index: postings of each different text once."""
    return postings(docs, terms).groupBy("term", "tk").agg(F.first("positions").alias("positions")).sortWithinPartitions("term")


def _keyed(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tk", text_key())


def candidates(index: DataFrame, plan: DataFrame, lists: int) -> DataFrame:
    """(tk, wid, start) whose offset-adjusted lists meet, from each window's rarest term on."""
    bounded = F.broadcast  # a block's plan: at most MAX_WINDOWS * lists rows
    first = index.join(bounded(plan.where("r = 1")), "term")
    found = first.select("tk", "wid", F.explode("positions").alias("p"), "offset").select("tk", "wid", (F.col("p") - F.col("offset")).alias("start")).where("start >= 0")
    for r in range(2, lists + 1):
        step = bounded(plan.where(F.col("r") == r).select("wid", F.col("term").alias("t_r"), F.col("offset").alias("o_r")))
        want = found.join(step, "wid", "left")
        other = index.select(F.col("term").alias("t_r"), F.col("tk").alias("k_r"), F.col("positions").alias("p_r"))
        met = want.join(other, (want["t_r"] == other["t_r"]) & (want["tk"] == other["k_r"]), "left")
        found = met.where(want["t_r"].isNull() | F.array_contains("p_r", F.col("start") + F.col("o_r"))).select("tk", "wid", "start")
    return found.distinct()


def _verify(docs: DataFrame, cand: DataFrame, wins: dict[int, tuple[list[bytes], list[str]]]) -> DataFrame:
    """Exact phrases: (tk, hits as [from, to) pairs that don't touch, items) of the texts that have any."""
    per_text = stage(cand.groupBy("tk").agg(F.collect_list(F.struct("wid", "start")).alias("c")), "cand")
    per_text = small(per_text, MAX_BROADCAST_ROWS, F.size("c"))
    rows = docs.join(per_text, "tk").select("tk", "text", "c")

    def of(batches):
        for b in batches:
            keys, hits, items = [], [], []
            for k, text, c in zip(b["tk"].to_pylist(), b["text"].to_pylist(), b["c"].to_pylist(), strict=True):
                w = split_words(text)
                spans, own = [], set()
                for x in sorted(c, key=lambda x: x["start"]):
                    want, of_items = wins[x["wid"]]
                    s = x["start"]
                    if w[s : s + len(want)] == want:
                        if spans and s <= spans[-1]["b"]:
                            spans[-1]["b"] = max(spans[-1]["b"], s + len(want))
                        else:
                            spans.append({"a": s, "b": s + len(want)})
                        own.update(of_items)
                if spans:
                    keys.append(k), hits.append(spans), items.append(sorted(own))
            span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.record_batch({"tk": pa.array(keys, pa.int64()), "hits": pa.array(hits, span), "items": pa.array(items, pa.list_(pa.string()))})

    found = rows.mapInArrow(of, "tk bigint, hits array<struct<a:int,b:int>>, items array<string>")
    return found.groupBy("tk").agg(F.first("hits").alias("hits"), F.first("items").alias("items"))  # rows of equal text say the same


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, lists: int = LISTS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(tk, hits, items) of texts with exact occurrences of benchmark windows, one row a block of windows."""
    spark = docs.sparkSession
    docs = _keyed(docs)
    wins = stage(windows(benchmark, size).withColumn("wid", F.xxhash64("win")), "windows")
    n = wins.count()
    blocks = max(1, math.ceil(n / max_windows))
    parts = []
    for block in range(blocks if n else 0):
        mine = {r["wid"]: (bytes(r["win"]).split(), list(r["items"])) for r in wins.where(F.pmod("wid", F.lit(blocks)) == block).toLocalIterator()}
        counts = dict.fromkeys((t for w, _ in mine.values() for t in w), 0)
        counted = term_counts(docs, set(counts))
        counts |= {bytes(r["term"]): r["n"] for r in counted.collect()}  # at most the block's own terms
        rows = []
        for wid, (w, _) in mine.items():
            if all(counts[t] for t in w):  # else the phrase occurs nowhere
                rarest = sorted(range(len(w)), key=lambda j: (counts[w[j]], j))[:lists]
                rows += [(wid, r, w[j], j) for r, j in enumerate(rarest, 1)]
        if not rows:
            continue
        plan = spark.createDataFrame(rows, "wid bigint, r int, term binary, offset int")
        index = stage(inverted(docs, {x[2] for x in rows}), "postings")
        parts.append(_verify(docs, candidates(index, plan, lists), mine))
    if not parts:
        return spark.createDataFrame([], "tk bigint, hits array<struct<a:int,b:int>>, items array<string>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def proximity(docs: DataFrame, phrases: DataFrame, span: int, max_phrases: int = MAX_WINDOWS) -> DataFrame:
    """(item_id, doc_id, at): per phrase, the first place where all its words lie within ``span`` words, in any order.

    ``phrases`` (item_id, text) are searched in blocks of about ``max_phrases``; an item may have several.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    asked = phrases.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text.alias("text")).distinct()
    asked = stage(asked.withColumn("phrase", F.sha2(F.concat_ws("\0", "item", "text"), 256)), "phrases")
    blocks = math.ceil(asked.count() / max_phrases)
    parts = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block).toLocalIterator()
        rows = [(r["item"], r["phrase"], t, len(ts)) for r in mine if (ts := sorted(set(split_words(r["text"])))) for t in ts]
        if not rows:
            continue
        plan = F.broadcast(spark.createDataFrame(rows, "item_id string, phrase string, term binary, need int"))
        at = inverted(keyed, {x[2] for x in rows}).join(plan, "term").select("item_id", "phrase", "tk", "need", "term", F.explode("positions").alias("p"))
        w = Window.partitionBy("phrase", "tk").orderBy("p").rangeBetween(0, span - 1)
        near = at.withColumn("have", F.size(F.collect_set("term").over(w))).where("have = need")
        near = near.groupBy("item_id", "phrase", "tk").agg(F.min("p").alias("at"))
        parts.append(near.join(keyed.select("doc_id", "tk").distinct(), "tk").select("item_id", "doc_id", "at"))
    if not parts:
        return spark.createDataFrame([], "item_id string, doc_id bigint, at int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per input row: doc_id, tk, n_words, n_hit, n_items, items_sha256, contaminated."""
    keyed = _keyed(docs)

    def count(batches):
        for b in batches:
            n = [len(split_words(t)) for t in b["text"].to_pylist()]
            yield pa.record_batch({"doc_id": b["doc_id"], "tk": b["tk"], "n_words": pa.array(n, pa.int64())})

    counted = keyed.select("doc_id", "tk", "text").mapInArrow(count, "doc_id bigint, tk bigint, n_words bigint")
    found = matches(docs, benchmark)
    # one list a block of windows: covered words are counted once
    count = lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["end"]), F.lit(0))).alias("n"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    hit = F.aggregate(F.array_sort(F.flatten(F.collect_list("hits"))), zero, count, lambda acc: acc["n"])
    found = stage(found.groupBy("tk").agg(hit.cast("bigint").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "hits")
    found = small(found, MAX_BROADCAST_ROWS, F.size("items"))
    zero = F.coalesce(F.col("n_hit"), F.lit(0).cast("bigint"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return counted.join(found, "tk", "left").select(
        "doc_id", "tk", "n_words", zero.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((zero > 0) & (zero * 20 >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that the benchmark contaminates; all columns stay."""
    bad = judged(docs, benchmark).where("contaminated").select("doc_id", "tk").distinct()
    bad = small(stage(bad, "contaminated"), MAX_BROADCAST_ROWS)
    tk = unused(docs, "__tk")
    mine = docs.withColumn(tk, text_key())
    return mine.join(bad, (mine[tk] == bad["tk"]) & mine["doc_id"].cast("bigint").eqNullSafe(bad["doc_id"]), "left_anti").drop(tk)


def op3_decontaminate(spark, sf_dir):
    from .common import table

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tk")


_W = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op3_decontaminate": rf"""
WITH d AS (SELECT doc_id, coalesce({_W}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, coalesce({_W}, []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[s:s+12], ' ') AS win, least(len(w), 13) AS n
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s+n-1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, s, bw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
QUERIES = {"op3_decontaminate": op3_decontaminate}
