"""The merge family: keyed joins, child-to-parent pointers, relationship links and supplemental qualifiers.

All of it is planned on the driver from schemas and small distinct lists, and runs as joins on tagged keys; adaptive
execution picks broadcast or sort-merge and splits skewed keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import blank, tag, text_tag
from ..functions.values import join_token, strip
from ..model.table import ROW, Table, mis, quoted
from .relational import blank_columns, union

MATCHED = "_matched_"
#: Flags of a qualifier's cells: supplied by exactly one row, by several.
SUPPLIED, DOUBLED = "__sup__", "__dup__"
SUBJECTS = ("USUBJID", "APID", "POOLID", "SPDEVID")
#: Most qualifier names, and pointers to columns or datasets that do not exist, of one merge; more are refused.
MAX_NAMES = 2000


class MergeError(ValueError):
    """A merge that cannot be planned."""


class DegenerateKey(MergeError):
    """No component of the key is on both sides."""


class KeyTypeClash(MergeError):
    """A key compares numbers with text."""


class CardinalityViolation(MergeError):
    """A side declared unique is not."""


@dataclass(frozen=True)
class Keyed:
    """A partner of a keyed join.  keys: names, or (left, right) pairs."""

    table: Table
    keys: list
    how: str = "left"
    name: str = ""
    as_text: bool = False
    keep_missings: bool = True
    type_checked: bool = True
    mask: Column | None = None
    cardinality: str = "n:m"
    #: The first of the partner's matching rows only: by these columns, then by row.
    first_match: bool = False
    first_by: tuple[str, ...] = ()
    #: Columns of which only the number of values in matching rows is wanted: the partner is grouped by key before the
    #: join, so that n:m keys multiply no rows, and the part has these numbers (no row: NULL) in their place.
    counted: tuple[str, ...] = ()
    #: Supplemental qualifiers of the partner, merged with it before the join; their columns are named as its own.
    supp: tuple[Table, ...] = ()

    @property
    def label(self) -> str:
        return self.name or self.table.name


@dataclass(frozen=True)
class Naming:
    """QUALIFIED: ``DM.AGE``.  BROWSER: bare names, key columns of partners left out, clashes numbered."""

    style: str = "QUALIFIED"

    def rename(self, taken: set[str], part: str, column: str) -> str:
        if self.style == "QUALIFIED":
            return f"{part}.{column}"
        name, n = column, 1
        while name.lower() in taken:
            n += 1
            name = f"{column}_{n}"
        return name


@dataclass
class Merged:
    table: Table
    issues: list[str] = field(default_factory=list)

    @property
    def df(self) -> DataFrame:
        return self.table.df


def _components(left: Table, spec: Keyed) -> list[tuple[str, str]]:
    """The key's active components: those that both sides hold; and their types agree."""
    if not spec.keys:
        raise MergeError("a keyed join needs a key")
    pairs = [k if isinstance(k, tuple) else (k, k) for k in spec.keys]
    active = [(left.find(a), spec.table.find(b)) for a, b in pairs if left.find(a) and spec.table.find(b)]
    for a, _ in pairs:
        if "." in a and not left.find(a):
            raise MergeError(f"{a} is not carried by the tables joined before")
    if not active:
        raise DegenerateKey(f"no key component of {spec.label} is on both sides")
    if spec.type_checked and not spec.as_text:
        differ = [(a, b) for a, b in active if (left.kind(a) == "STRING") != (spec.table.kind(b) == "STRING")]
        blank_left, blank_right = (blank_columns(left, [a for a, _ in differ]), blank_columns(spec.table, [b for _, b in differ])) if differ else (set(), set())
        for a, b in differ:
            if a not in blank_left and b not in blank_right:
                raise KeyTypeClash(f"{a} is {left.kind(a)}, {spec.label}.{b} is {spec.table.kind(b)}")
    return active


def _check_unique(t: Table, names: list[str], spec: Keyed, side: str) -> None:
    make = text_tag if spec.as_text else tag
    df = t.df if side == "primary" or spec.mask is None else t.df.where(spec.mask)
    rows = df.select(ROW, *[make(t, n).alias(f"k{i}") for i, n in enumerate(names)], *([] if spec.keep_missings else [_any_blank(t, names).alias("b")]))
    rows = rows if spec.keep_missings else rows.where("NOT b")
    twice = rows.groupBy(*[f"k{i}" for i in range(len(names))]).agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"), F.max(ROW).alias("last")).where("n > 1").orderBy("first").limit(1).collect()
    if twice:
        r = twice[0]
        raise CardinalityViolation(f"{side} {t.name or spec.label}: key {[r[f'k{i}'] for i in range(len(names))]} in rows {r['first'] + 1} and {r['last'] + 1}")


def _any_blank(t: Table, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | blank(t, n)
    return out


def _plain(left: Table, a: str, right: Table, b: str) -> bool:
    """Whether cells of two columns are one key exactly if they are equal: one type, and missing in one way only."""
    return left.kind(a) == right.kind(b) in ("LONG", "STRING", "BOOLEAN") and mis(a) not in left.df.columns and mis(b) not in right.df.columns


def _whole(t: Table, name: str) -> Column:
    return t.col(name).cast("bigint") if t.kind(name) == "LONG" else t.col(name)


def merge_keyed(primary: Table, partners: list[Keyed], naming: Naming = Naming(), matched: bool = True) -> Merged:
    """Primary rows with each partner's matching rows, n:m, in partner order.

    A partner part is: its columns (renamed), ``<part>._matched_``, ``__sup__<part>`` and ``__row_<part>``.
    """
    current, issues = primary, []
    for place, spec in enumerate(partners, 1):
        if spec.supp:
            with_supp = merge_supp(spec.table, *spec.supp)
            issues += [f"{spec.label}: {x}" for x in with_supp.issues]
            spec = replace(spec, table=with_supp.table)
        active = _components(current, spec)
        lefts, rights = [a for a, _ in active], [b for _, b in active]
        one_left, one_right = spec.cardinality.split(":")
        if one_left == "1":
            _check_unique(current, lefts, spec, "primary")
        if one_right == "1" and not spec.first_match:
            _check_unique(spec.table, rights, spec, "partner")
        make = text_tag if spec.as_text else tag
        part = spec.label or f"part{place}"
        q = spec.table.df if spec.mask is None else spec.table.df.where(spec.mask)
        if not spec.keep_missings:
            q = q.where(~_any_blank(spec.table, rights))
        plain = [not spec.as_text and _plain(current, a, spec.table, b) for a, b in active]
        for i, b in enumerate(rights):
            q = q.withColumn(f"__k{i}", _whole(spec.table, b) if plain[i] else make(spec.table, b))
        keys = [f"__k{i}" for i in range(len(rights))]
        if spec.first_match:
            first = [F.col(quoted(spec.table.require(c))) for c in spec.first_by]
            q = q.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*first, ROW))).where("__rn = 1").drop("__rn")
        taken = {c.lower() for c in current.df.columns}
        if spec.counted:
            carried = [spec.table.require(c) for c in spec.counted]
            q = q.groupBy(*keys).agg(F.min(ROW).alias(ROW), *[F.count(quoted(c)).alias(c) for c in carried])
        else:
            carried = spec.table.columns if naming.style == "QUALIFIED" else [c for c in spec.table.columns if c not in rights]
        out = [F.col(k).alias(f"__r{k}") for k in keys] + [F.col(ROW).alias(f"__row_{part}")]
        for c in carried:
            new = naming.rename(taken, part, c)
            if new.lower() in taken:
                raise MergeError(f"column {new} occurs twice")
            taken.add(new.lower())
            out.append(F.col(quoted(c)).alias(new, metadata={**spec.table.df.schema[c].metadata, "merged_from": part, "merged_source_column": c, "merge_kind": "KEYED"}))
            if spec.counted:
                continue
            if mis(c) in spec.table.df.columns:
                out.append(F.col(quoted(mis(c))).alias(mis(new)))
            out += [F.col(quoted(f"{flag}{c}")).alias(f"{flag}{new}") for flag in (SUPPLIED, DOUBLED) if f"{flag}{c}" in spec.table.df.columns]
        q = q.select(*out)
        left = current.df
        for i, a in enumerate(lefts):
            left = left.withColumn(f"__k{i}", _whole(current, a) if plain[i] else make(current, a))
        # blank keys were left out of the partner, so that equality doesn't meet them where they don't count
        same = [F.col(k).eqNullSafe(F.col(f"__r{k}")) if p and spec.keep_missings else F.col(k) == F.col(f"__r{k}") for k, p in zip(keys, plain, strict=True)]
        cond = _all(same)
        joined = left.join(q, cond, "inner" if spec.how == "inner" else "left").drop(*keys, *[f"__r{k}" for k in keys])
        found = F.col(quoted(f"__row_{part}")).isNotNull()
        joined = joined.withColumn(f"__sup__{part}", found)
        if matched:
            joined = joined.withColumn(f"{part}.{MATCHED}", found)
        current = current.with_df(joined)
    return Merged(current, issues)


def ordered(t: Table, *parts: str) -> DataFrame:
    """The result in its order: primary row, then each part's row."""
    return t.df.orderBy(ROW, *[F.col(quoted(f"__row_{p}")).asc_nulls_first() for p in parts])


def is_row_mapped(t: Table) -> Column:
    """Aggregate: some primary row was dropped or expanded (identity, not count)."""
    return (F.count(F.lit(1)) != F.count_distinct(ROW)) | (F.max(ROW) + 1 != F.count_distinct(ROW))


def refuse_many(found: list, what: str) -> list:
    """What was collected up to MAX_NAMES + 1, if it is not more than MAX_NAMES."""
    if len(found) > MAX_NAMES:
        raise MergeError(f"more than {MAX_NAMES} {what}")
    return found


def _upper_names(*tables: Table) -> list[str]:
    return sorted({c.upper() for t in tables for c in t.columns})


def merge_child(child: Table, parents: dict[str, Table], keys: list[str] = ("STUDYID", "USUBJID"), send: bool = False, fixed_parent: str | None = None, cardinality: str = "n:m") -> Merged:
    """Child rows with the parent rows that (RDOMAIN, IDVAR, IDVARVAL) point at, one part per parent domain.

    The pointer's column is looked up by name, its value compared as text (canonically with numeric columns); key
    columns count where both sides have them.  Under SEND a child without any subject matches on the rest of the key.
    """
    issues: list[str] = []
    domain = F.lit(fixed_parent) if fixed_parent else F.upper(strip(child.col("RDOMAIN")))
    pointers = child.df.select(domain.alias("d"), F.upper(strip(child.col("IDVAR"))).alias("v"), F.col(ROW)).groupBy("d", "v").agg(F.min(ROW).alias("first"))
    real = F.lit(False)
    for d, t in parents.items():
        real = real | ((F.col("d") == d) & (F.coalesce(F.col("v"), F.lit("")) == "")) | ((F.col("d") == d) & F.col("v").isin(*_upper_names(t)))
    real = F.coalesce(real, F.lit(False))
    strange = pointers.where(~real & (F.col("d") != "")).orderBy("first").limit(MAX_NAMES + 1).collect()
    pointers = pointers.where(real).collect() + refuse_many(strange, "pointers to no dataset or column")  # real ones: the parents' columns at most
    pointers.sort(key=lambda r: r["first"])
    names: dict[str, list[str]] = {}
    for r in pointers:
        if r["d"]:
            names.setdefault(r["d"], [])
            if r["v"]:
                names[r["d"]].append(r["v"])
    keys = list(keys) + (["POOLID"] if send and "POOLID" not in keys else [])
    slots = [f"__k{i}" for i in range(len(keys))]
    found, numeric = {}, {}
    for d, columns in names.items():
        if (parent := parents.get(d)) is None:
            issues.append(f"{d}: no such dataset")
            continue
        issues += [f"{d}: no column {c}" for c in columns if not parent.find(c)]
        found[d] = [c for c in columns if parent.find(c)]
        numeric[d] = [c for c in found[d] if parent.kind(c) != "STRING"]
    if not found:
        return Merged(child, issues)
    shared = {d: [k for k in keys if child.find(k) and parents[d].find(k)] for d in found}
    # every parent's pointed-at columns in one table, its own columns as a struct: the children are joined once
    long = None
    for d, columns in found.items():
        parent = parents[d]
        tokens = [F.struct(F.lit(c).alias("v"), join_token(parent.col(c) if parent.kind(c) == "STRING" else parent.col(c).cast("string"), parent.kind(c) != "STRING").alias("token")) for c in columns]
        if not tokens:
            continue
        own = [F.when(F.lit(x == d), F.struct(F.col(ROW).alias("__row"), *[F.col(quoted(c)).alias(c) for c in parents[x].columns])).alias(f"__s_{x}") if x == d else F.lit(None).alias(f"__s_{x}") for x in found]
        held = [tag(parent, k).alias(s) if k in shared[d] else F.lit("").alias(s) for k, s in zip(keys, slots, strict=True)]
        rows = parent.df.select(F.lit(d).alias("__pd"), *held, *own, (F.explode(F.array(*tokens)) if len(tokens) > 1 else tokens[0]).alias("__t"))
        rows = rows.select("__pd", F.col("__t.v").alias("__pv"), F.col("__t.token").alias("__pt"), *[F.col(s).alias(f"__p{s}") for s in slots], *[f"__s_{x}" for x in found]).where("__pt <> ''")
        long = rows if long is None else long.unionByName(rows)
    value = child.col("IDVARVAL")
    pointer = F.upper(strip(child.col("IDVAR")))
    as_number = F.lit(False)
    for d, columns in numeric.items():
        if columns:
            as_number = as_number | ((domain == d) & pointer.isin(*columns))
    token = F.when(as_number, join_token(value, True)).otherwise(join_token(value, False))
    of_key = lambda k: F.when(domain.isin(*[d for d in found if k in shared[d]]), tag(child, k)).otherwise("") if any(k in x for x in shared.values()) else F.lit("")
    left = child.df.select("*", domain.alias("__d"), pointer.alias("__v"), F.when(token != "", token).alias("__token"), *[of_key(k).alias(s) for k, s in zip(keys, slots, strict=True)])
    if long is None:
        out = left
        for d in found:
            kinds = ", ".join(f"{quoted(f.name)}: {f.dataType.simpleString()}" for f in parents[d].df.select(*[F.col(quoted(c)) for c in parents[d].columns]).schema.fields)
            out = out.withColumn(f"__s_{d}", F.lit(None).cast(f"struct<__row: bigint{', ' + kinds if kinds else ''}>"))
    else:
        on = lambda x, y, without=(): (x["__d"] == y["__pd"]) & (x["__v"] == y["__pv"]) & (x["__token"] == y["__pt"]) & _all([x[s] == y[f"__p{s}"] for k, s in zip(keys, slots, strict=True) if k not in without])
        subjects = [k for k in keys if k in SUBJECTS and child.find(k)]
        if send and subjects:  # a child without any subject meets the rows of all
            lost = F.lit(True)
            for k in subjects:
                lost = lost & blank(child, k)
            some, none = left.where(~lost), left.where(lost)
            out = some.join(long, on(some, long), "left").unionByName(none.join(long, on(none, long, SUBJECTS), "left"))
        else:
            out = left.join(long, on(left, long), "left")
    for d in found:
        part = F.col(quoted(f"__s_{d}"))
        met = part["__row"].isNotNull()
        held = {f"{d}.{c}": part[c] for c in parents[d].columns}
        out = out.withColumns({f"__row_{d}": part["__row"], **held, f"__sup__{d}": met, f"{d}.{MATCHED}": met})
    out = out.drop("__d", "__v", "__token", "__pd", "__pv", "__pt", *slots, *[f"__p{s}" for s in slots], *[f"__s_{d}" for d in found])
    merged = child.with_df(out)
    _check_children(merged, list(found), cardinality)
    return Merged(merged, issues)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _check_children(t: Table, parts: list[str], cardinality: str) -> None:
    """1 on the left: a parent row has one child at most; on the right: a child has one parent row at most."""
    one_left, one_right = cardinality.split(":")
    for d in parts:
        met = t.df.where(F.col(quoted(f"__sup__{d}"))).select(F.col(ROW).alias("child"), F.col(quoted(f"__row_{d}")).alias("parent"))
        for one, side, other in ((one_right, "child", "parent"), (one_left, "parent", "child")):
            twice = met.groupBy(side).agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a <> b").orderBy(side).limit(1).collect() if one == "1" else []
            if twice:
                r = twice[0]
                raise CardinalityViolation(f"{d}: {other} rows {r['a'] + 1} and {r['b'] + 1} of {side} row {r[side] + 1}")


def supp_name(dataset: str) -> str:
    """Name of a dataset's supplemental dataset: SQ<name> for associated persons (AP--), else SUPP<name>."""
    name = dataset.strip().upper()
    return ("SQ" if len(name) >= 4 and name.startswith("AP") else "SUPP") + name


def supp_names(dataset: str, domain: str = "") -> list[str]:
    """Names of the supplemental datasets of a split dataset and of its domain, to be stacked."""
    return list(dict.fromkeys([supp_name(dataset), *([supp_name(domain)] if domain.strip() else [])]))


def merge_supp(base: Table, *supp: Table, send: bool = False, keys: list[str] = ("STUDYID", "USUBJID", "POOLID", "APID", "SPDEVID")) -> Merged:
    """Base rows with one column per qualifier name (QNAM, first-seen order) from supplemental rows.

    Subject level (IDVAR blank), record level (IDVAR's column equals IDVARVAL) and, without a subject, study-wide.
    A cell is supplied by exactly one hit; several hits, or subject and record rows for one subject, leave it
    unsupplied and make an issue.  A base column of the same name wins; names that differ only in case can't both be
    columns: the first stays, unsupplied, with an issue.  Rows for another domain (RDOMAIN is not the base's DOMAIN) are
    not the base's.
    """
    s = supp[0] if len(supp) == 1 else union(*supp, name=supp[0].name)
    issues: list[str] = []
    if s.find("RDOMAIN") and not base.find("DOMAIN") and base.meta.get("domain"):
        s = s.with_df(s.df.where(F.upper(strip(s.col("RDOMAIN"))) == base.meta["domain"].upper()))
    shared = [k for k in keys if base.find(k) and s.find(k)]
    subjects = [k for k in shared if k in SUBJECTS]
    names = s.df.where(strip(s.col("QNAM")) != "").groupBy(strip(s.col("QNAM")).alias("q")).agg(F.min(ROW).alias("first")).orderBy("first").limit(MAX_NAMES + 1).collect()
    names = [r["q"] for r in names]
    if len(names) > MAX_NAMES:
        raise MergeError(f"more than {MAX_NAMES} qualifier names")
    lower = {c.lower(): c for c in base.columns}
    skipped = [q for q in names if q.lower() in lower]
    issues += [f"{q}: the base column stays" for q in skipped]
    first_of: dict[str, str] = {}
    for q in (q for q in names if q.lower() not in lower):
        if first_of.setdefault(q.lower(), q) != q:
            issues.append(f"{first_of[q.lower()]}: {q} differs only in case, neither is supplied")
    clashing = {first for first in first_of.values() if any(x.startswith(f"{first}: ") and x.endswith("neither is supplied") for x in issues)}
    use = list(first_of.values())
    idvar = F.coalesce(F.upper(strip(s.col("IDVAR"))), F.lit("")) if s.find("IDVAR") else F.lit("")
    value = F.coalesce(strip(s.col("IDVARVAL")), F.lit("")) if s.find("IDVARVAL") else F.lit("")
    subject = F.lit(False)
    for k in subjects:
        subject = subject | ~blank(s, k)
    both_domains = base.find("DOMAIN") and s.find("RDOMAIN")
    of_domain = lambda t, c: [F.coalesce(F.upper(strip(t.col(c))), F.lit("")).alias(f"k{len(shared)}")] if both_domains else []
    level = F.when(idvar == "", F.when(subject, "SUBJECT")).when(value == "", None).when(~subject, F.when(F.lit(send or not subjects), "STUDY")).otherwise("RECORD")
    rows = s.df.select(F.col(ROW).alias("srow"), strip(s.col("QNAM")).alias("q"), s.col("QVAL").alias("v"), idvar.alias("idvar"), value.alias("value"), level.alias("level"), *[tag(s, k).alias(f"k{i}") for i, k in enumerate(shared)], *of_domain(s, "RDOMAIN")).where(F.col("level").isNotNull() & F.col("q").isin(*(set(use) - clashing)) if set(use) - clashing else F.lit(False))
    pointed = rows.where("level <> 'SUBJECT'").select("idvar").distinct()
    real = F.col("idvar").isin(*_upper_names(base))
    columns = [r["idvar"] for r in pointed.where(real).collect()]  # the base's columns at most
    columns += refuse_many([r["idvar"] for r in pointed.where(~real).orderBy("idvar").limit(MAX_NAMES + 1).collect()], "pointers to no column")
    issues += [f"{c}: no such column" for c in columns if not base.find(c)]
    held = [c for c in columns if base.find(c)]
    numeric = [c for c in held if base.kind(c) != "STRING"]
    token = F.when(F.col("idvar").isin(*numeric), join_token(F.col("value"), True)).otherwise(F.col("value")) if numeric else F.col("value")
    rows = rows.withColumn("token", token)
    key = [f"k{i}" for i in range(len(shared) + bool(both_domains))]
    study_key = [k for i, k in enumerate(key) if i >= len(shared) or shared[i] not in subjects]
    # a subject with rows of both levels for one name supplies nothing
    both = rows.where("level <> 'STUDY'").groupBy("q", *key).agg(F.count_distinct("level").alias("levels")).where("levels > 1").drop("levels")
    rows = rows.join(both.withColumn("__both", F.lit(True)), ["q", *key], "left") if key else rows.withColumn("__both", F.lit(None).cast("boolean"))
    clean = rows.where(F.col("__both").isNull()).drop("__both")
    b = base.df.select(ROW, *[tag(base, k).alias(f"k{i}") for i, k in enumerate(shared)], *of_domain(base, "DOMAIN"), *[join_token(base.col(c).cast("string"), base.kind(c) != "STRING").alias(f"__t{j}") for j, c in enumerate(held)])
    pieces = [b.join(clean.where("level = 'SUBJECT'").select("q", "v", *key), key).select(ROW, "q", "v")] if key else []
    if held:
        long = b.select(ROW, *key, F.explode(F.array(*[F.struct(F.lit(c).alias("idvar"), F.col(f"__t{j}").alias("token")) for j, c in enumerate(held)])).alias("t")).select(ROW, *key, "t.idvar", "t.token")
        pieces.append(long.join(clean.where("level = 'RECORD'").select("q", "v", "idvar", "token", *key), [*key, "idvar", "token"]).select(ROW, "q", "v"))
        pieces.append(long.join(clean.where("level = 'STUDY'").select("q", "v", "idvar", "token", *study_key), [*study_key, "idvar", "token"]).select(ROW, "q", "v"))
    if not pieces or not use:
        return Merged(base, issues)
    hits = pieces[0]
    for p in pieces[1:]:
        hits = hits.unionByName(p)
    one = hits.groupBy(ROW, "q").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    cells = F.collect_list(F.struct("q", F.struct("n", "v").alias("x")))  # names are different: no more than they are
    wide = one.groupBy(ROW).agg(F.map_from_entries(cells).alias("__cells"))
    out = base.df.join(wide, ROW, "left")
    cell = {q: F.col("__cells")[q] for q in use}
    many = {q: F.coalesce(cell[q]["n"], F.lit(0)) for q in use}
    out = out.withColumns({q: F.when(cell[q]["n"] == 1, cell[q]["v"]) for q in use} | {f"{SUPPLIED}{q}": many[q] == 1 for q in use} | {f"{DOUBLED}{q}": many[q] > 1 for q in use}).drop("__cells")
    return Merged(base.with_df(out), issues)


from .relrec import merge_relrec  # noqa: E402  the relationships build on the names above

__all__ = ["CardinalityViolation", "DegenerateKey", "KeyTypeClash", "Keyed", "MergeError", "Merged", "Naming", "merge_child", "merge_keyed", "merge_relrec", "merge_supp", "ordered"]
