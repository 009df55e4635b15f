"""Terminology dictionaries as tables: terms by level, code registries, hierarchy."""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The terminologies.
TYPES = ("meddra", "whodrug", "loinc", "unii", "snomed", "medrt", "neoplasm")
#: A dictionary side up to this number of rows is broadcast; a larger one is joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000
#: Steps up a hierarchy.
MAX_DEPTH = 16


#: How each terminology writes its versions.
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_DATES = {"snomed": r"^(\d{4})(\d{2})(\d{2})$", "neoplasm": r"^(\d{4})-(\d{2})-(\d{2})$", "medrt": r"^(\d{4})\.(\d{2})\.(\d{2})$"}


def version_key(kind: str, token: Column) -> Column:
    """array<bigint> by which a terminology's versions are ordered; NULL, which is lowest, for what is none."""
    t, kind = F.trim(token), kind.lower()
    part = lambda p, i: F.regexp_extract(t, p, i)
    month = lambda name: F.when(F.array_position(F.array(*map(F.lit, _MONTHS)), F.upper(name)) > 0, F.array_position(F.array(*map(F.lit, _MONTHS)), F.upper(name)))
    dotted = F.when(t.rlike(r"^\d{1,9}(\.\d{1,9})*$"), F.transform(F.split(t, r"\."), lambda x: x.cast("bigint")))
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    date_key = lambda d: F.when(d.isNotNull(), F.array(F.unix_date(d).cast("bigint")))
    if kind in ("meddra", "loinc"):
        return dotted
    if kind == "whodrug":
        p = r"^([A-Za-z]{3})_(\d{4})$"
        return F.when(month(part(p, 1)).isNotNull(), F.array(part(p, 2).try_cast("bigint"), month(part(p, 1)).cast("bigint")))
    if kind in _DATES:
        p = _DATES[kind]
        found = date_key(F.when(t.rlike(p), day(part(p, 1), part(p, 2), part(p, 3))))
        return F.coalesce(found, dotted) if kind == "medrt" else found
    if kind == "unii":
        p = r"^(\d{1,2})([A-Za-z]{3})(\d{4})$"
        return date_key(F.when(t.rlike(p) & month(part(p, 2)).isNotNull(), day(part(p, 3), month(part(p, 2)).cast("string"), part(p, 1))))
    return F.lit(None).cast("array<bigint>")


def by_version(df: DataFrame, kind: str, column: str, installed: str | None = None) -> DataFrame:
    """Versions, the latest first; those that cannot be read come last, by their date of installation, then by text."""
    key = version_key(kind, F.col(column))
    more = [F.col(installed).desc_nulls_last()] if installed else []
    return df.orderBy(key.desc_nulls_last(), *more, F.col(column).desc())


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


@dataclass(frozen=True)
class Dictionary:
    """levels: level, term (preferred).  pairs: registry, code, decode.  edges: level, term, up_level, ancestor."""

    levels: DataFrame
    pairs: DataFrame
    edges: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        """From a house file (JSON): levels {level: {UPPER: preferred}}, pairs {registry: {code: decode}}, hierarchy."""
        text = spark.read.text(path, wholetext=True).first()[0]
        house = json.loads(text)
        rows = [(lv, t) for lv, terms in house.get("levels", {}).items() for t in (terms.values() if isinstance(terms, dict) else terms)]
        pairs = [(r, c, str(d)) for r, m in house.get("pairs", {}).items() for c, d in m.items()]
        by_level = house.get("hierarchy_by_level", {})
        edges = [(lv, t, up, a) for lv, m in by_level.items() for t, ups in m.items() for up, many in ups.items() for a in (many if isinstance(many, list) else [many])]
        edges += [("", t, "", a) for t, many in house.get("hierarchy", {}).items() for a in many]
        make = lambda x, s: spark.createDataFrame(x, s)
        return cls(make(rows, "level string, term string"), make(pairs, "registry string, code string, decode string"), make(edges, "level string, term string, up_level string, ancestor string"))

    def check_terms(self, df: DataFrame, column: str, level: str | None = None) -> DataFrame:
        """Adds valid (member, whatever its case) and exact (in the preferred spelling)."""
        terms = self.levels if level is None else self.levels.where(F.col("level") == level)
        terms = _sized(terms.groupBy(F.upper("term").alias("__u")).agg(F.collect_set("term").alias("__p")))
        out = df.join(terms, F.upper(F.col(column)) == F.col("__u"), "left")
        return out.withColumn("valid", F.col("__u").isNotNull()).withColumn("exact", F.coalesce(F.array_contains("__p", F.col(column)), F.lit(False))).drop("__u", "__p")

    def decode(self, df: DataFrame, column: str, registry: str) -> DataFrame:
        p = _sized(self.pairs.where(F.col("registry") == registry).groupBy(F.col("code").alias("__c")).agg(F.min("decode").alias("decode")))
        return df.join(p, F.col(column) == F.col("__c"), "left").drop("__c")

    def code_pair(self, df: DataFrame, code: str, decode: str, registry: str | None = None, case_sensitive: bool = False) -> DataFrame:
        """Adds pair: code and decode belong together in the registry (or in any)."""
        fold = (lambda c: c) if case_sensitive else F.upper
        p = self.pairs if registry is None else self.pairs.where(F.col("registry") == registry)
        p = _sized(p.select(fold(F.col("code")).alias("__c"), fold(F.col("decode")).alias("__d")).distinct())
        return df.join(p, (fold(F.col(code)) == F.col("__c")) & (fold(F.col(decode)) == F.col("__d")), "left").withColumn("pair", F.col("__c").isNotNull()).drop("__c", "__d")

    def has_decode(self, df: DataFrame, code: str) -> DataFrame:
        p = _sized(self.pairs.select(F.col("code").alias("__c")).distinct())
        return df.join(p, F.col(code) == F.col("__c"), "left").withColumn("known", F.col("__c").isNotNull()).drop("__c")

    def closure(self) -> DataFrame:
        """(level, term, up_level, ancestor) of all ancestors; stops when a step adds none."""
        now = self.edges.select("level", F.upper("term").alias("term"), "up_level", F.upper("ancestor").alias("ancestor")).distinct()
        n = now.count()
        for depth in itertools.count(1):
            if depth > MAX_DEPTH:
                raise ValueError(f"a hierarchy deeper than {1 << MAX_DEPTH} levels")
            up = now.select(F.col("level").alias("up_level"), F.col("term").alias("ancestor"), F.col("up_level").alias("l2"), F.col("ancestor").alias("a2"))
            now = now.unionByName(now.join(up, ["up_level", "ancestor"]).select("level", "term", F.col("l2").alias("up_level"), F.col("a2").alias("ancestor"))).distinct()
            if (m := now.count()) == n:
                break
            n = m
        return now

    def under(self, df: DataFrame, column: str, level: str, up_level: str, ancestor: str) -> DataFrame:
        """Adds under: the ancestor is on the term's path."""
        hit = _sized(self.closure().where((F.col("level") == level) & (F.col("up_level") == up_level) & (F.col("ancestor") == ancestor.upper())).select(F.col("term").alias("__t")).distinct())
        return df.join(hit, F.upper(F.col(column)) == F.col("__t"), "left").withColumn("under", F.col("__t").isNotNull()).drop("__t")

    def problems(self) -> DataFrame:
        """(check, level, term) of what breaks the house rules: spellings that differ only in case, blank terms."""
        twice = self.levels.groupBy("level", F.upper("term").alias("term")).agg(F.count_distinct("term").alias("n")).where("n > 1").select(F.lit("two spellings").alias("check"), "level", "term")
        blank = self.levels.where("trim(term) = ''").select(F.lit("blank term").alias("check"), "level", "term")
        return twice.unionByName(blank)
