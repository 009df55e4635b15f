"""Relationships between datasets (RELREC): which records are linked, and primary rows with their related rows.

A relationship is (STUDYID, subject, RELID); under SEND (STUDYID, RELID).  A link is a row of the primary's domain with
a row of another domain in one relationship: of record level if both give a value, of dataset level if neither does.
Links are planned from their distinct (domain, level, columns), which schemas bound; everything else is joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import join_token, strip
from ..model.table import ROW, Table, quoted
from .merge import MATCHED, MAX_NAMES, SUBJECTS, CardinalityViolation, Merged, refuse_many

#: Link rows that an issue names; relationships of one dataset-level kind up to which they are broadcast.
NAMED, MAX_BROADCAST_ROWS = 20, 100_000


def links(relrec: Table, send: bool = False) -> DataFrame:
    """(rel, rel_first, relid, study, subject, domain, idvar, idvarval, reltype, __row) of every link row."""
    subject = F.coalesce(*[F.when(strip(relrec.col(s)) != "", relrec.col(s)) for s in SUBJECTS if relrec.find(s)], F.lit(""))
    text = lambda c: F.coalesce(strip(relrec.col(c)), F.lit("")) if relrec.find(c) else F.lit("")
    rows = relrec.df.select(F.col(ROW), text("STUDYID").alias("study"), subject.alias("subject"), F.upper(text("RDOMAIN")).alias("domain"), F.upper(text("IDVAR")).alias("idvar"), text("IDVARVAL").alias("idvarval"), text("RELID").alias("relid"), F.upper(text("RELTYPE")).alias("reltype"))
    group = ["study", "relid"] if send else ["study", "subject", "relid"]
    return rows.withColumn("rel", F.xxhash64(*group)).withColumn("rel_first", F.min(ROW).over(Window.partitionBy(*group))).where("relid <> '' AND domain <> ''")


def link_pairs(primary: Table, relrec: Table, send: bool = False, domains: list[str] | None = None, relids: list[str] | None = None, answers_to: str | None = None) -> DataFrame:
    """(rel, rel_first, relid, study, domain, level, l*, r*) of the links of the primary; ``answers_to``: its domain, if not its name.

    l and r: sub, v (the column), val, row, one (RELTYPE is ONE), of the primary's and the related side.
    """
    rows = links(relrec, send)
    if relids:
        rows = rows.where(F.col("relid").isin(*relids))
    me = [x.upper() for x in (primary.name, answers_to) if x]
    side = lambda p: [F.col("subject").alias(f"{p}sub"), F.col("idvar").alias(f"{p}v"), F.col("idvarval").alias(f"{p}val"), F.col(ROW).alias(f"{p}row"), F.col("reltype").alias(f"{p}type")]
    left = rows.where(F.col("domain").isin(*me)).select("rel", "rel_first", "relid", "study", *side("l"))
    right = rows.where(~F.col("domain").isin(*me)).select("rel", "domain", *side("r"))
    if domains:
        right = right.where(F.col("domain").isin(*[d.upper() for d in domains]))
    level = F.when((F.col("lval") != "") & (F.col("rval") != ""), "RECORD").when((F.col("lval") == "") & (F.col("rval") == ""), "DATASET")
    return left.join(right, "rel").withColumn("level", level).where("level IS NOT NULL")


def scan(primary: Table, relrec: Table, send: bool = False, **selection) -> DataFrame:
    """(domain, first, n_record, n_dataset, mixed): what could be merged; a mixed domain can't."""
    found = link_pairs(primary, relrec, send, **selection).groupBy("domain").agg(F.min("rrow").alias("first"), F.count(F.when(F.col("level") == "RECORD", 1)).alias("n_record"), F.count(F.when(F.col("level") == "DATASET", 1)).alias("n_dataset"))
    return found.withColumn("mixed", (F.col("n_record") > 0) & (F.col("n_dataset") > 0))


class _Plan:
    """What the links' distinct columns and levels ask for, and what is wrong with them."""

    def __init__(self, primary: Table, related: dict[str, Table], pairs: DataFrame):
        found = pairs.groupBy("domain", "level", "lv", "rv").agg(F.min("rrow").alias("first"), F.bool_or((F.col("ltype") != "") | (F.col("rtype") != "")).alias("typed")).limit(MAX_NAMES + 1).collect()
        found = sorted(refuse_many(found, "kinds of links"), key=lambda r: r["first"])
        self.issues: list[str] = []
        self.domains = list(dict.fromkeys(r["domain"] for r in found))
        self.levels = {d: {r["level"] for r in found if r["domain"] == d} for d in self.domains}
        self.typed = any(r["typed"] and r["level"] == "DATASET" for r in found)
        self.usable: dict[str, list[tuple[str, str]]] = {}
        self.left = sorted({r["lv"] for r in found if primary.find(r["lv"])})
        named = lambda cond, column: ", ".join(str(r[0] + 1) for r in pairs.where(cond).select(column).distinct().orderBy(column).limit(NAMED).collect())
        for d in self.domains:
            here = F.col("domain") == d
            if d not in related:
                self.issues.append(f"{d}: no such dataset")
                continue
            if len(self.levels[d]) > 1:
                self.issues.append(f"{d}: links of record and of dataset level, nothing of it is merged (rows {named(here, 'rrow')})")
                continue
            self.usable[d] = []
            for r in (r for r in found if r["domain"] == d):
                ok = True
                for t, v, column in ((related[d], "rv", "rrow"), (primary, "lv", "lrow")):
                    if not t.find(r[v]):
                        self.issues.append(f"{d}: {t.name} has no column {r[v]} (rows {named(here & (F.col(v) == r[v]), column)})")
                        ok = False
                if ok:
                    self.usable[d].append((r["lv"], r["rv"]))


def _addressable(t: Table, columns: list[str]) -> DataFrame:
    """(row, subject, study, idvar, token) of a table's rows for each pointer column that it has."""
    subject = F.coalesce(*[F.when(strip(t.col(s)) != "", t.col(s)) for s in SUBJECTS if t.find(s)], F.lit(""))
    study = F.coalesce(strip(t.col("STUDYID")), F.lit("")) if t.find("STUDYID") else F.lit("")
    tokens = [F.struct(F.lit(c).alias("idvar"), join_token(t.col(c).cast("string"), t.kind(c) != "STRING").alias("token")) for c in columns]
    rows = t.df.select(F.col(ROW).alias("row"), subject.alias("subject"), study.alias("study"), (F.explode(F.array(*tokens)) if len(tokens) > 1 else tokens[0]).alias("t"))
    return rows.select("row", "subject", "study", "t.*").where("token <> ''")


def _canonical(t: Table, v: str, value: str) -> Column:
    """A link's value as the token of the column that it names."""
    numeric = [c.upper() for c in t.columns if t.kind(c) != "STRING"]
    text = join_token(F.col(value), False)
    return F.when(F.col(v).isin(*numeric), join_token(F.col(value), True)).otherwise(text) if numeric else text


def _of_domain(d: str, level: str, primary: Table, t: Table, found: DataFrame, usable: list[tuple[str, str]]) -> DataFrame:
    """Pairs of rows of one related domain."""
    used = F.lit(False)
    for lv, rv in usable:
        used = used | ((F.col("lv") == lv) & (F.col("rv") == rv))
    found = found.where((F.col("domain") == d) & used)
    mine = _addressable(primary, sorted({x for x, _ in usable})).select(F.col("row"), F.col("subject").alias("asub"), F.col("study").alias("astudy"), F.col("idvar").alias("lv"), F.col("token").alias("lt"))
    theirs = _addressable(t, sorted({x for _, x in usable})).select(F.col("row").alias("related_row"), F.col("subject").alias("bsub"), F.col("study").alias("bstudy"), F.col("idvar").alias("rv"), F.col("token").alias("rt"))
    in_study = (F.col("study") == "") | (F.col("study") == F.col("astudy"))
    out = ["rel", "rel_first", "relid", "row", "related_row", "lone", "rone"]
    none = F.lit(False)
    if level == "RECORD":
        found = found.select("rel", "rel_first", "relid", "study", "lsub", "rsub", "lv", "rv", _canonical(primary, "lv", "lval").alias("lt"), _canonical(t, "rv", "rval").alias("rt"), none.alias("lone"), none.alias("rone")).distinct()
        left = found.join(mine, ["lv", "lt"]).where(in_study & ((F.col("lsub") == "") | (F.col("lsub") == F.col("asub"))))
        # a side that names no subject is joined within the subject
        same = ((F.col("rsub") == "") | (F.col("rsub") == F.col("bsub"))) & ((F.col("lsub") != "") | (F.col("rsub") != "") | (F.col("asub") == F.col("bsub")))
        return left.join(theirs, ["rv", "rt"]).where(same & (F.col("astudy") == F.col("bstudy"))).select(*out).distinct()
    stated = Window.partitionBy("rel").orderBy("lrow", "rrow")
    found = found.withColumn("lone", F.first("ltype").over(stated) == "ONE").withColumn("rone", F.first("rtype").over(stated) == "ONE")
    found = found.select("rel", "rel_first", "relid", "study", "lsub", "lv", "rv", "lone", "rone").distinct()
    if found.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        found = F.broadcast(found)
    left = mine.join(found, "lv").where(in_study & ((F.col("lsub") == "") | (F.col("lsub") == F.col("asub"))))
    met = left.join(theirs, (left["rv"] == theirs["rv"]) & (F.col("lt") == F.col("rt")) & (F.col("astudy") == F.col("bstudy")) & (F.col("asub") == F.col("bsub")))
    return met.select(*out).distinct()


def related_rows(primary: Table, related: dict[str, Table], relrec: Table, send: bool = False, **selection) -> DataFrame:
    """(row, domain, related_row, rel, rel_first, relid, lone, rone): pairs of a primary and a related row, distinct."""
    related = {n.upper(): t for n, t in related.items()}
    found = link_pairs(primary, relrec, send, **selection)
    return _pairs(primary, related, found, _Plan(primary, related, found))


def _pairs(primary: Table, related: dict[str, Table], found: DataFrame, plan: _Plan) -> DataFrame:
    out = None
    for d, usable in plan.usable.items():
        if usable:
            one = _of_domain(d, next(iter(plan.levels[d])), primary, related[d], found, usable).withColumn("domain", F.lit(d))
            out = one if out is None else out.unionByName(one)
    if out is None:
        return primary.df.sparkSession.createDataFrame([], "rel bigint, rel_first bigint, relid string, row bigint, related_row bigint, lone boolean, rone boolean, domain string")
    return out


def in_order(pairs: DataFrame, domains: list[str]) -> DataFrame:
    """Pairs by primary row, the domains' order, related row, and the relationships' first appearance."""
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain"))
    return pairs.orderBy("row", place, "related_row", "rel_first")


def addressed(primary: Table, found: DataFrame, columns: list[str]) -> DataFrame:
    """(row) of the primary rows that some link addresses, whether or not its dataset or partner is found."""
    mine = _addressable(primary, columns) if columns else primary.df.select(F.col(ROW).alias("row"), *[F.lit("").alias(c) for c in ("subject", "study", "idvar", "token")]).limit(0)
    of = found.select(F.col("lv").alias("v"), "level", _canonical(primary, "lv", "lval").alias("to"), F.col("lsub").alias("of"), F.col("study").alias("in")).distinct()
    here = ((F.col("of") == F.col("subject")) | (F.col("of") == "")) & ((F.col("in") == F.col("study")) | (F.col("in") == ""))
    by_record = mine.join(of.where("level = 'RECORD'"), (F.col("idvar") == F.col("v")) & (F.col("to") == F.col("token")) & here, "left_semi").select("row")
    by_dataset = mine.join(of.where("level = 'DATASET'").select("v", "of", "in").distinct(), (F.col("idvar") == F.col("v")) & here, "left_semi").select("row")
    return by_record.unionByName(by_dataset).distinct()


def _check(pairs: DataFrame, cardinality: str | None, typed: bool) -> None:
    """A side declared 1 pairs each of its rows with one row of the other side at most.

    An authored cardinality holds over all pairs of a domain; else RELTYPE's, within its relationship.
    """
    if cardinality is None and not typed:
        return
    one_left, one_right = (cardinality or "?:?").split(":")
    within = ["domain"] if cardinality else ["domain", "rel", "relid"]
    for side, other, holds in (("row", "related_row", F.lit(one_right == "1") if cardinality else F.col("rone")), ("related_row", "row", F.lit(one_left == "1") if cardinality else F.col("lone"))):
        if cardinality and "1" not in (one_right if side == "row" else one_left):
            continue
        twice = pairs.where(holds).groupBy(*within, side).agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a <> b").orderBy(side).limit(1).collect()
        if twice:
            r = twice[0]
            what = "related rows" if side == "row" else "primary rows"
            raise CardinalityViolation(f"{r['domain']}: {what} {r['a'] + 1} and {r['b'] + 1} of row {r[side] + 1}" + ("" if cardinality else f" in relationship {r['relid']}"))


def _overridden(found: DataFrame, cardinality: str) -> list[str]:
    """Warnings where RELTYPE states another cardinality than the authored one."""
    said = F.concat(F.when(F.col("ltype") == "ONE", "1").otherwise("n"), F.lit(":"), F.when(F.col("rtype") == "ONE", "1").otherwise("m"))
    stated = found.where("level = 'DATASET' AND (ltype <> '' OR rtype <> '')").groupBy("domain", "relid", "rel").agg(F.min_by(said, F.struct("lrow", "rrow")).alias("said"))
    rows = stated.where(F.translate("said", "m", "n") != cardinality.replace("m", "n")).orderBy("domain", "relid").limit(NAMED).collect()
    return [f"{r['domain']}: the cardinality {cardinality} is checked, RELTYPE states {r['said']} for relationship {r['relid']}" for r in rows]


def merge_relrec(primary: Table, related: dict[str, Table], relrec: Table, how: str = "left", send: bool = False, cardinality: str | None = None, unmatched_domains: bool = True, **selection) -> Merged:
    """Primary rows with related rows: per relationship the cross product over domains, equal tuples once.

    ``how="inner"`` drops the rows that no link addresses; addressed rows without a partner stay.
    ``unmatched_domains=False`` leaves out the columns of domains that nothing pairs with and that have no issue.
    A part is its columns (``CM.CMTERM``), ``CM._matched_``, ``__sup__CM`` and ``__row_CM``.
    """
    related = {n.upper(): t for n, t in related.items() if n.upper() != primary.name.upper()}
    found = link_pairs(primary, relrec, send, **selection)
    plan = _Plan(primary, related, found)
    pairs = _pairs(primary, related, found, plan)
    if cardinality:
        plan.issues += _overridden(found, cardinality)
    _check(pairs, cardinality, plan.typed)
    names = list(related)
    if not unmatched_domains:
        used = {r["domain"] for r in pairs.select("domain").distinct().collect()}  # some of the related tables
        names = [d for d in names if d in used or any(i.startswith(f"{d}:") for i in plan.issues)]
    return Merged(primary.with_df(_joined(primary, related, names, pairs, how, lambda: addressed(primary, found, plan.left))), plan.issues)


def _joined(primary: Table, related: dict[str, Table], names: list[str], pairs: DataFrame, how: str, stays: Callable[[], DataFrame]) -> DataFrame:
    tuples = None
    for d in names:
        one = pairs.where(F.col("domain") == d).select("row", "rel", F.col("related_row").alias(f"__row_{d}"))
        tuples = one if tuples is None else tuples.join(one, ["row", "rel"], "full_outer")
    rows = [f"__row_{d}" for d in names]
    out = primary.df
    if how == "inner":
        kept = stays().select(F.col("row").alias(ROW))
        out = out.join(kept if tuples is None else kept.unionByName(tuples.select(F.col("row").alias(ROW))), ROW, "left_semi")
    if tuples is not None:
        out = out.join(tuples.select(F.col("row").alias(ROW), *rows).distinct(), ROW, "left")
    for d in names:
        q = related[d].df.select(F.col(ROW).alias(f"__row_{d}"), *[F.col(quoted(c)).alias(f"{d}.{c}") for c in related[d].columns])
        met = F.col(f"__row_{d}").isNotNull()
        out = out.join(q, f"__row_{d}", "left").withColumn(f"__sup__{d}", met).withColumn(f"{d}.{MATCHED}", met)
    any_row = F.coalesce(*[F.col(r) for r in rows]).isNotNull() if rows else F.lit(False)
    return out.withColumn(f"RELREC.{MATCHED}", any_row)
