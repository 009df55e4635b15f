"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Base findings (email, ip, card, phone) are the protected entities.  A term discloses an entity when their pointwise
mutual information over the corpus' contexts comes close to the entity's own information content:

    PMI(t; e) = log2(n_te * N / (n_t * n_e))      IC(e) = log2(N / n_e)      disclosure = PMI / IC

with N contexts in the corpus, n_e of them holding the entity, n_t the term and n_te both.  Contexts are the corpus'
lines and, where asked for, its whole documents, estimated apart.  Terms at or over ``REMOVE`` in either are removed,
at or over ``GENERALISE`` replaced by a general word, wherever they stand in a document that holds the entity.  A pair
needs ``SUPPORT`` different contexts, so that copies of one line or document prove nothing.

Scale: texts are never shuffled.  The first pass keeps spans and the terms of entity contexts; the second counts only
the candidate terms over all contexts, with map-side partial sums.  Hot entities and terms are partially aggregated.
What is gathered inside a document is gathered in pieces of ``PIECE`` items, so that copying stays linear.

Positions are code points.  The patterns are the contract's, written with possessive parts and a look-behind so that
long runs cost linear time; the matches are the same, since a run that fails from its start fails from any later start.

Defined results: null text is empty and has no spans.  Null doc_id is a value like any other.  Rows that repeat a
(doc_id, text) each get their row; repeats count as further lines but not as support.  Empty tables give empty
results.  Extra columns pass through ``sanitise`` and are dropped by ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import same, small, stage, table, text_key, unused

#: Kinds in their fixed order.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11}(?:[ -]?+[0-9])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap necessary sign of each kind.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Disclosure from which a term is generalised, and removed; different lines that a pair needs; letters of a term.
GENERALISE, REMOVE, SUPPORT, LETTERS = 0.8, 0.95, 3, 3
#: The contexts; items gathered in one array before it is put aside.
LINE, DOCUMENT, PIECE = 0, 1, 256
#: Rows up to which a table of findings is sent to all tasks.
MAX_BROADCAST_ROWS = 500_000


def _luhn(digits: Column) -> Column:
    def step(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":  # every part at most 255, leading zeros allowed
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda m: _passes(kind, m["value"])


def _valid(kind: str):
    return lambda m: _passes(kind, m)


_ITEM = "struct<start:int,k:int,end:int,value:string>"


def _gather(items: Column, step, kind: str) -> Column:
    """array<kind>: ``step(at, item)`` gives the next ``at`` (an int, 0 at first) and the item's value, in order."""

    def add(acc, item):
        at, value = step(acc["at"], item)
        full = F.size(acc["now"]) >= PIECE
        now = F.when(full, F.array(value)).otherwise(F.concat(acc["now"], F.array(value)))
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(at.alias("at"), now.alias("now"), done.alias("done"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("now"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.aggregate(items, zero, add, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, k, end, value>> of the pattern's matches: the text's pieces around them tell the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    k = KINDS.index(kind)

    def step(at, pair):
        start = at + F.length(pair["piece"])
        end = start + F.length(pair["m"])
        return end, F.struct(start.alias("start"), F.lit(k).alias("k"), end.alias("end"), pair["m"].alias("value"))

    pairs = F.filter(F.arrays_zip(pieces.alias("piece"), found.alias("m")), lambda x: x["m"].isNotNull())
    return F.when(F.size(found) > 0, _gather(pairs, step, _ITEM)).otherwise(F.array().cast(f"array<{_ITEM}>"))


def _entities(line: Column) -> Column:
    """Distinct lower-cased base findings of a line: no pattern crosses lines, so they are the text's own."""
    found = []
    for kind, pattern in PATTERNS.items():
        values = F.filter(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), _valid(kind))
        found.append(F.when(F.contains(line, F.lit(SIGNS[kind])), values).otherwise(F.array().cast("array<string>")) if SIGNS[kind] else values)
    return F.array_distinct(F.transform(F.concat(*found), F.lower))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tk, base (spans by start, then kind), ctx (level, key, entities, terms), n_lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("tk", text_key())
    by_kind = []
    for kind, pattern in PATTERNS.items():
        all_ = matches(F.col("text"), pattern, kind)
        kept = F.filter(all_, _checked(kind))
        if SIGNS[kind]:
            kept = F.when(F.contains(F.col("text"), F.lit(SIGNS[kind])), kept).otherwise(F.array().cast(f"array<{_ITEM}>"))
        by_kind.append(kept)
    rows = rows.withColumn("base", F.array_sort(F.concat(*by_kind)))
    held = F.filter(F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("s"), _entities(s).alias("entities"))), lambda x: F.size(x["entities"]) > 0)
    lines = F.transform(held, lambda x: F.struct(F.lit(LINE).alias("level"), F.xxhash64(x["s"]).alias("key"), x["entities"].alias("entities"), _terms(_clean(x["s"])).alias("terms")))
    whole = F.struct(F.lit(DOCUMENT).alias("level"), F.col("tk").alias("key"), F.array_distinct(F.transform("base", lambda m: F.lower(m["value"]))).alias("entities"), _terms(_clean(F.col("text"))).alias("terms"))
    none = F.array().cast("array<struct<level:int,key:bigint,entities:array<string>,terms:array<string>>>")
    return rows.select("doc_id", "tk", "base", F.when(F.size("base") > 0, F.concat(lines, F.array(whole))).otherwise(none).alias("ctx"), F.size(F.split("text", "\n")).alias("n_lines"))


def _clean(text: Column) -> Column:
    """Lower-cased text without base findings."""
    for p in PATTERNS.values():
        text = F.regexp_replace(text, p, " ")
    return F.lower(text)


def _terms(clean: Column) -> Column:
    """Distinct words of a cleaned text."""
    return F.filter(F.array_distinct(F.split(clean, r"\P{L}+")), lambda t: F.length(t) >= LETTERS)


def disclosing(docs: DataFrame, base: DataFrame, contexts=(LINE,)) -> DataFrame:
    """(entity, term, remove): terms whose disclosure of an entity reaches the thresholds in one of the contexts."""
    asked = F.filter("ctx", lambda c: c["level"].isin(*contexts))
    held = base.where(F.size("base") > 0).select(F.explode(asked).alias("c")).select("c.level", "c.key", "c.terms", F.explode("c.entities").alias("entity"))
    # entity frequencies and co-occurrence, partially aggregated per entity and context before any term is exploded
    per = held.groupBy("level", "entity", "key").agg(F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"))
    per = stage(per, "entity-contexts")
    n_e = per.groupBy("level", "entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") >= SUPPORT)
    n_e = small(stage(n_e, "entities"), MAX_BROADCAST_ROWS)
    pairs = per.join(n_e, ["level", "entity"]).select("level", "entity", "n", "n_e", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("level", "entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("support"), F.first("n_e").alias("n_e")).where(F.col("support") >= SUPPORT)
    pairs = stage(pairs, "pairs")
    lines, documents = base.agg(F.coalesce(F.sum("n_lines"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = small(stage(pairs.select("level", "term").distinct(), "wanted"), MAX_BROADCAST_ROWS)
    clean = docs.select(_clean(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("clean"))
    in_lines = clean.select(F.flatten(F.transform(F.split("clean", "\n"), _terms)).alias("t"))
    named = lambda level, terms: F.transform(terms, lambda t: F.struct(F.lit(level).alias("level"), t.alias("term")))
    terms = {LINE: named(LINE, F.col("t")), DOCUMENT: named(DOCUMENT, F.array_distinct("t"))}
    every = in_lines.select(F.explode(F.concat(*[terms[c] for c in contexts])).alias("x")).select("x.*")
    n_t = every.join(wanted, ["level", "term"]).groupBy("level", "term").agg(F.count(F.lit(1)).alias("n_t"))
    total = F.when(F.col("level") == LINE, F.lit(lines)).otherwise(F.lit(documents))
    scored = pairs.join(n_t, ["level", "term"]).withColumn("N", total)
    pmi = F.log2(F.col("n_te") * F.col("N") / (F.col("n_t") * F.col("n_e")))
    ratio = F.when(F.col("N") > F.col("n_e"), pmi / F.log2(F.col("N") / F.col("n_e"))).otherwise(0.0)
    return scored.groupBy("entity", "term").agg(F.max(ratio).alias("ratio")).where(F.col("ratio") >= GENERALISE).select("entity", "term", (F.col("ratio") >= REMOVE).alias("remove"))


def spans(docs: DataFrame, contexts=(LINE,)) -> DataFrame:
    """One row per input row: doc_id, tk, base, terms (spans of disclosing terms; value: the replacement)."""
    base = stage(base_spans(docs), "base")
    out = stage(disclosing(docs, base, contexts), "disclosing")
    hot = base.where(F.size("base") > 0).select("doc_id", "tk", F.explode(F.transform("base", lambda m: F.lower(m["value"]))).alias("entity")).distinct()
    flagged = hot.join(small(out, MAX_BROADCAST_ROWS), "entity").groupBy("doc_id", "tk", "term").agg(F.max("remove").alias("remove"))
    flagged = flagged.groupBy("doc_id", "tk").agg(F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias("flagged"))
    flagged = small(stage(flagged, "flagged"), MAX_BROADCAST_ROWS, F.size("flagged"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("tk", text_key())
    words = F.filter(matches(F.col("text"), r"\p{L}++", "term"), lambda m: F.col("flagged")[F.lower(m["value"])].isNotNull())
    named = F.transform(words, lambda m: F.struct(m["start"].alias("start"), m["k"].alias("k"), m["end"].alias("end"), F.when(F.col("flagged")[F.lower(m["value"])], "").otherwise("[TERM]").alias("value")))
    found = rows.join(flagged, same(rows, flagged, "doc_id", "tk")).select(rows["doc_id"], rows["tk"], named.alias("terms"))
    found = small(stage(found.groupBy("doc_id", "tk").agg(F.first("terms").alias("terms")), "terms"), MAX_BROADCAST_ROWS, F.size("terms"))
    empty = F.array().cast("array<struct<start:int,k:int,end:int,value:string>>")
    return base.join(found, same(base, found, "doc_id", "tk"), "left").select(base["doc_id"], base["tk"], "base", F.coalesce("terms", empty).alias("terms"))


def _said(array: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(array, lambda m: F.concat_ws(":", F.element_at(kinds, m["k"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, contexts=(LINE,)) -> DataFrame:
    """The documents with findings replaced by [KIND] and disclosing terms generalised or removed; all columns stay."""
    found = spans(docs, contexts)
    found = found.where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "tk"])
    of_doc, of_tk, of_base, of_terms, tk, put = (unused(docs, f"__{x}") for x in ("doc_id", "found_tk", "base", "terms", "tk", "new"))
    found = found.withColumnsRenamed({"doc_id": of_doc, "tk": of_tk, "base": of_base, "terms": of_terms})
    found = small(stage(found, "spans"), MAX_BROADCAST_ROWS, F.size(of_base) + F.size(of_terms))
    mine = docs.withColumn(tk, text_key())
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform(of_base, lambda m: F.struct(m["start"].alias("start"), m["k"].alias("k"), m["end"].alias("end"), F.element_at(marks, m["k"] + 1).alias("value")))
    every = F.array_sort(F.concat(base, F.col(of_terms)))
    text = F.col("text")

    def step(at, m):
        piece = F.when(m["start"] >= at, F.concat(F.substring(text, at + 1, m["start"] - at), m["value"])).otherwise("")
        return F.greatest(at, m["end"]), piece

    kept = F.array_join(_gather(every, step, "string"), "")
    last = F.array_max(F.transform(every, lambda m: m["end"]))
    done = F.concat(kept, F.substring(text, last + 1, F.length(text)))
    joined = mine.join(found, (mine[tk] == F.col(of_tk)) & mine["doc_id"].cast("bigint").eqNullSafe(F.col(of_doc)), "left")
    new = F.when(F.col(of_tk).isNotNull(), done).otherwise(text)
    out = joined.withColumn(put, new).select(*[F.col(put).alias("text") if c == "text" else mine[c] for c in docs.columns])
    if "n_chars" in docs.columns:  # follows the text where it was changed
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def op9_privacy(spark, sf_dir):
    found = spans(table(spark, sf_dir, "documents"), (LINE, DOCUMENT))
    count = lambda kind: F.size(F.filter("base", lambda m: m["k"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "terms"))
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(every).alias("spans"), F.size(every).cast("bigint").alias("n_spans"))


QUERIES = {"op9_privacy": op9_privacy}
SQL: dict = {}
