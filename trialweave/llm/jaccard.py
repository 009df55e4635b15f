"""Exact Jaccard join of word-shingle sets: a size-aware heavy-light join.

Sets are ordered by one global token order, rare tokens first.  Two sets that are similar enough share at least k
tokens among their first ``n - ceil(t n) + k`` (prefixes).  Small sets enumerate all two-token subsets of that prefix
(k = 2) as signatures; large sets scan the inverted lists of their single prefix tokens (k = 1).  The boundary between
small and large is the one of least estimated cost: subsets written against list entries scanned.

1. Equal sets are one class (its documents are linked through the class).
2. Classes that cannot have a partner leave early: tokens in hash order, prefixes with k = n/8; what a prefix token
   needs is one other class that holds it.  A task first aggregates its own classes, so a token that a third of all
   documents hold is one row per task, not one per document.
3. The rest is ordered by exact (saturated) frequency, and cut to prefixes.
4. Components come from verified links.  Sets that meet in lists form families, cut to blocks, each compared in itself
   and with the typical set of its family; when components of those links are known, only blocks whose members share a list
   across different components are compared with each other.  So a group of many near copies costs about its size,
   not its square, pairs are never written, and no link that could join two components is left out.

Hashes of shingles and sets have 64 bits; a collision could only matter between sets within one shingle of the
threshold.  Defined results: null or blank text has the empty set, n_shingles 0 and a component of its own.  Repeated
rows (of one doc_id or of several) are equal sets.  A null doc_id gets its class's component but never names one
(alone in it, component_id is null).  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, same, small, stage, table, text_key, unused
from .graph import components, forest
from .textkit import SPACE_WORDS, batch_bytes, distinct_by_row, set_keys, shingles, slices, word_hashes, words

SHINGLE, THRESHOLD = 5, 75  # words; percent
#: Prefix tokens gathered in a task before they are aggregated and shipped; frequency from which tokens rank alike.
FLUSH, SATURATED = 250_000, 1024
#: Rows up to which the chosen documents are broadcast to fetch their texts.
MAX_BROADCAST_ROWS = 500_000
#: Cost of comparing with one list entry inside a block, where writing and shuffling one subset costs 1.
SCAN = 0.01
#: Sets, and tokens, that a block holds about; a task compares two blocks at a time.
BLOCK, BLOCK_TOKENS = 128, 1_000_000

#: Bits of a class key that the first pass keeps; tokens of a bucket of that pass, about.
_CUT, BUCKET = np.int64((1 << 40) - 1), 250_000


def need(n):
    """Smallest intersection with any partner: ceil(t * n)."""
    return (np.asarray(n, np.int64) * THRESHOLD + 99) // 100


def sets_of(column):
    """(values, offsets, n, key) of the shingle sets of a text column."""
    data, offsets = batch_bytes(column)
    low, starts, ends, at = words(data, offsets, SPACE_WORDS)
    row, h = shingles(word_hashes(low, starts, ends), at, SHINGLE)
    values, so = distinct_by_row(row, h, len(offsets) - 1)
    return values, so, np.diff(so), set_keys(values, so).view(np.int64)


def _measure(batches):
    for b in batches:
        for part in slices(b):
            _, _, n, key = sets_of(part["text"])
            yield pa.record_batch({"doc_id": part["doc_id"], "tk": part["tk"], "n": pa.array(n), "sk": pa.array(key)})


def _credits(buckets: int):
    """Hash-ordered prefixes, packed: one row per task flush and bucket of tokens, nine bytes an entry.

    A token of several classes of one flush is one entry without a class.  Rows (sk, n, credit) tell what the flush
    knows already.  Tokens and classes are cut to 32 bits (within a bucket) and 40: a clash can only let a class stay.
    """

    def of(batches):
        seen: dict[int, int] = {}
        toks, keys, held = [], [], 0

        def flush():
            t, k = np.concatenate(toks), np.concatenate(keys)
            order = np.lexsort((k, t))
            t, k = t[order], k[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.concatenate([first, [len(t)]]))
            sk, credit = np.unique(k[np.repeat(size > 1, size)], return_counts=True)
            known = dict(zip(sk.tolist(), credit.tolist(), strict=True))
            t, k = t[first], np.where(size > 1, 0, (k[first] & _CUT) | 1)
            bucket = (t.view(np.uint64) & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, t, k = bucket[order], (t[order] >> 32).astype(np.int32), k[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.concatenate([cut[1:], [len(bucket)]])
            low, high = (k & 0xFFFFFFFF).astype(np.uint32), (k >> 32).astype(np.uint8)
            raw = [t[i:j].tobytes() + low[i:j].tobytes() + high[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]
            none = pa.nulls(len(cut), pa.int64())
            yield pa.record_batch({"bucket": pa.array(bucket[cut].astype(np.int32)), "packed": pa.array(raw, pa.binary()), "sk": none, "n": none, "credit": none})
            spread = [int(s % buckets) for s in seen]
            yield pa.record_batch({"bucket": pa.array(spread, pa.int32()), "packed": pa.nulls(len(seen), pa.binary()), "sk": pa.array([s & int(_CUT) | 1 for s in seen], pa.int64()), "n": pa.array(seen.values(), pa.int64()), "credit": pa.array([known.get(s, 0) for s in seen], pa.int64())})

        for b in batches:
            for part in slices(b):
                v, so, n, sk = sets_of(part["text"])
                length = np.minimum(n, n - need(n) + np.maximum(1, n // 8))
                for i in np.flatnonzero(n > 1):
                    if (s := int(sk[i])) not in seen:
                        seen[s] = int(n[i])
                        toks.append(v[so[i] : so[i] + length[i]].view(np.int64))
                        keys.append(np.full(length[i], sk[i]))
                        held += length[i]
                if held >= FLUSH:
                    yield from flush()
                    seen, toks, keys, held = {}, [], [], 0
        if toks:
            yield from flush()

    return of


def _met(batches):
    """From rows sorted by bucket: (sk, n, credit) of entries whose token has two different classes, and of known credits."""
    now, packed = None, []

    def close():
        if not packed:
            return None
        parts = [(np.frombuffer(x, np.int32, len(x) // 9), np.frombuffer(x, np.uint32, len(x) // 9, len(x) // 9 * 4), np.frombuffer(x, np.uint8, len(x) // 9, len(x) // 9 * 8)) for x in packed]
        t = np.concatenate([x[0] for x in parts])
        k = np.concatenate([x[1] for x in parts]).astype(np.int64) | (np.concatenate([x[2] for x in parts]).astype(np.int64) << 32)
        order = np.lexsort((k, t))
        t, k = t[order], k[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.concatenate([first, [len(t)]]))
        several = (k[first] != k[first + size - 1]) | (k[first] == 0)  # sorted by class; 0: several in one flush
        once = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        sk, credit = np.unique(k[np.repeat(several, size) & once & (k != 0)], return_counts=True)
        return pa.record_batch({"sk": pa.array(sk), "n": pa.nulls(len(sk), pa.int64()), "credit": pa.array(credit.astype(np.int64))})

    for b in batches:
        yield b.filter(pa.compute.is_valid(b["n"])).select(["sk", "n", "credit"])
        b = b.filter(pa.compute.is_null(b["n"]))
        for bucket, raw in zip(b["bucket"].to_pylist(), b["packed"].to_pylist(), strict=True):
            if bucket != now:
                if (done := close()) is not None:
                    yield done
                now, packed = bucket, []
            packed.append(raw)
    if (done := close()) is not None:
        yield done


def _tokens(batches):
    for b in batches:
        for sk, raw in zip(b["sk"].to_pylist(), b["tokens"], strict=True):
            v = np.frombuffer(raw.as_buffer(), np.int64)
            yield pa.record_batch({"token": pa.array(v), "sk": pa.array(np.full(len(v), sk))})


def _frequencies(batches):
    """From rows sorted by token: (sk, token, df) of tokens in two sets or more; df saturates."""
    ct, ck, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def out(k, t, df):
        return pa.record_batch({"sk": pa.array(k), "token": pa.array(t), "df": pa.array(df.astype(np.int32))})

    for b in batches:
        t, k = np.concatenate([ct, np.asarray(b["token"])]), np.concatenate([ck, np.asarray(b["sk"])])
        if not len(t):
            continue
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.concatenate([first, [len(t)]]))
        df = np.minimum(size, SATURATED)
        if over is not None and t[0] == over:
            df[0] = SATURATED
        done = np.ones(len(first), bool)
        done[-1] = df[-1] == SATURATED  # the last run may go on; a saturated one needs no waiting
        over = t[-1] if done[-1] else None
        rows = np.repeat(done & (df > 1), size)
        yield out(k[rows], t[rows], np.repeat(df, size)[rows])
        keep = slice(len(t), None) if done[-1] else slice(first[-1], None)
        ct, ck = t[keep], k[keep]
    if len(ct) > 1:
        yield out(ck, ct, np.full(len(ct), len(ct)))


def _prefixes(batches):
    """From rows sorted by (sk, df, token): the prefix rows (k = 2) of sets that may have a partner.

    A set's first row has df -1 and its size for a token.

    ``pos`` counts places left in the prefix of k = 1 (0 or less: only in that of k = 2); ``lone`` is the share of
    tokens that no other set holds.
    """

    def close(sk, token, df):
        n, token, df = token[0], token[1:], df[1:]
        c = len(token)
        lone = n - c
        room = int(n - need(n) + 2 - lone)
        if c < need(n) or room <= 0:
            return None
        take = min(room, c)
        return {"sk": np.full(take, sk), "n": np.full(take, n, np.int32), "token": token[:take], "df": df[:take], "pos": (room - 1 - np.arange(take)).astype(np.int32), "lone": np.full(take, lone / n, np.float32)}

    cur = None
    for b in batches:
        sk, tok, df = (np.asarray(b[c]) for c in ("sk", "token", "df"))
        if cur is not None:
            sk, tok, df = (np.concatenate(x) for x in zip(cur, (sk, tok, df), strict=True))
        if not len(sk):
            continue
        first = np.flatnonzero(np.concatenate([[True], sk[1:] != sk[:-1]]))
        ends = np.concatenate([first[1:], [len(sk)]])
        rows = [r for a, e in zip(first[:-1], ends[:-1], strict=True) if (r := close(sk[a], tok[a:e], df[a:e])) is not None]
        cur = (sk[first[-1] :], tok[first[-1] :], df[first[-1] :])
        if rows:
            yield pa.record_batch({c: pa.array(np.concatenate([r[c] for r in rows])) for c in rows[0]})
    if cur is not None and (r := close(cur[0][0], cur[1], cur[2])) is not None:
        yield pa.record_batch({c: pa.array(v) for c, v in r.items()})


_PREFIX = "sk bigint, n int, token bigint, df int, pos int, lone float"


def boundary(prefixes: DataFrame) -> int:
    """Largest size of a small set: least cost of subsets written and list entries scanned, over sizes up to 512 by octaves."""
    per = prefixes.groupBy("sk", "n").agg(F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col("pos") > 0, F.col("df"))).alias("scan"))
    rows = per.groupBy(F.least("n", F.lit(1024)).alias("n")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("subsets"), F.sum("scan").alias("scan")).collect()  # 1024 rows at most
    cost = lambda x: sum(r["subsets"] or 0 for r in rows if r["n"] * THRESHOLD <= x * 100) + SCAN * sum(r["scan"] or 0 for r in rows if r["n"] > x)
    return min((0, 8, 16, 32, 64, 128, 256, 512), key=lambda x: (cost(x), x))


def signatures(prefixes: DataFrame, x: int) -> DataFrame:
    """(sig, sk, n, lone): single tokens of sets larger than x, two-token subsets of those of x / t at most."""
    large = prefixes.where((F.col("n") > x) & (F.col("pos") > 0)).select(F.xxhash64(F.lit(1), "token").alias("sig"), "sk", "n", "lone")
    few = prefixes.where(F.col("n") * THRESHOLD <= x * 100).groupBy("sk", "n", "lone").agg(F.array_sort(F.collect_list("token")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.xxhash64(F.lit(2), a, b))))
    return large.unionByName(few.select(F.explode(pairs).alias("sig"), "sk", "n", "lone"))


def _overlaps(tokens: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over the tokens of two sets or more, some columns at a time."""
    n = len(tokens)
    row = np.repeat(np.arange(n), [len(t) for t in tokens])
    _, col, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    for c in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(col, [c, c + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[row[lo:hi], col[lo:hi] - c] = 1
        out += part @ part.T
    return out


def _compare(batches):
    """From rows sorted by (ba, bb): links (a, b) between sets of the two sides that are of different components.

    Only links that connect what the block did not connect before are returned.
    """
    group, now = [], None

    def close():
        if len(group) < 2:
            return None
        sk = np.array([g[0] for g in group])
        side, comp = np.array([g[1] for g in group]), np.array([g[2] for g in group])
        tokens = [g[3] for g in group]
        n = np.array([len(t) for t in tokens])
        both = _overlaps(tokens).astype(np.int64)
        linked = 100 * both >= THRESHOLD * (n[:, None] + n[None, :] - both)
        linked &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
        linked &= comp[:, None] != comp[None, :]
        i, j = np.nonzero(np.triu(linked, 1))
        tree = forest(comp[i], comp[j])
        return pa.record_batch({"a": pa.array(sk[i[tree]]), "b": pa.array(sk[j[tree]])}) if tree else None

    for b in batches:
        for ba, bb, sk, side, comp, raw in zip(*(b[c].to_pylist() for c in ("ba", "bb", "sk", "side", "comp")), b["tokens"], strict=True):
            if (ba, bb) != now:
                if (done := close()) is not None:
                    yield done
                group, now = [], (ba, bb)
            group.append((sk, side, comp, np.frombuffer(raw.as_buffer(), np.int64).copy()))
    if (done := close()) is not None:
        yield done


def _links(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the sets dealt to blocks: dealt has ba, bb, sk, side, comp."""
    rows = dealt.join(sets.select("sk", "tokens"), "sk").select("ba", "bb", "sk", "side", "comp", "tokens")
    return rows.repartition("ba", "bb").sortWithinPartitions("ba", "bb").mapInArrow(_compare, "a bigint, b bigint")


def _blocks(sigs: DataFrame) -> DataFrame:
    """(sk, typical, block): sets that meet in lists, directly or through others, are a family; families are cut to blocks."""
    centres = sigs.groupBy("sig").agg(F.min_by("sk", F.struct("lone", "sk")).alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    edges = sigs.join(centres, "sig").select(F.col("sk").alias("a"), F.col("centre").alias("b")).distinct()
    family = small(stage(components(edges), "families"), MAX_BROADCAST_ROWS).withColumnsRenamed({"node": "sk", "component": "family"})
    of = sigs.groupBy("sk").agg(F.first("n").alias("n"), F.first("lone").alias("lone")).join(family, "sk")
    cut = of.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("bigint").alias("blocks"), F.min_by("sk", F.struct("lone", "sk")).alias("typical"))
    return stage(of.join(cut, "family").select("sk", "typical", F.xxhash64("family", F.pmod(F.xxhash64("sk"), F.col("blocks"))).alias("block")), "blocks")


def _class_links(sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of classes that have links: from blocks with their typical set, then across components."""
    blocks = _blocks(sigs)
    own = blocks.select("block", "sk").unionByName(blocks.select("block", F.col("typical").alias("sk"))).distinct()
    edges = stage(_links(own.select(F.col("block").alias("ba"), F.col("block").alias("bb"), "sk", F.lit(2).alias("side"), F.col("sk").alias("comp")), sets), "block-links")
    comp = stage(components(edges), "components")
    lists = stage(_across(sigs, comp).join(small(blocks.select("sk", "block"), MAX_BROADCAST_ROWS), "sk"), "across")
    members = stage(lists.select("block", "sk", "comp").distinct(), "members")
    meet = stage(_block_pairs(lists, members), "meet")
    left = meet.join(members, meet["ba"] == members["block"]).select("ba", "bb", "sk", F.lit(0).alias("side"), "comp")
    right = meet.join(members, meet["bb"] == members["block"]).select("ba", "bb", "sk", F.lit(1).alias("side"), "comp")
    new = stage(_links(left.unionByName(right), sets), "across-links")
    return components(edges.unionByName(new))


def _block_pairs(lists: DataFrame, members: DataFrame) -> DataFrame:
    """(ba, bb): blocks that meet in a list and are not of one component.

    Lists that meet in the same blocks are one group.  Most blocks of a large group are wholly of its main component;
    these need not meet each other, so only the others are paired, with all of the group: as rows, never in one array.
    """
    together = lists.groupBy("sig").agg(F.array_sort(F.collect_set("block")).alias("met")).where(F.size("met") > 1).select("met").distinct()
    ends = members.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    groups = together.select(F.xxhash64("met").alias("group"), F.explode("met").alias("block")).join(small(stage(ends, "ends"), MAX_BROADCAST_ROWS), "block")
    groups = stage(groups, "groups")
    main = groups.where("lo = hi").groupBy("group", "lo").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("lo", F.struct("n", "lo")).alias("main"))
    marked = stage(groups.join(small(stage(main, "main"), MAX_BROADCAST_ROWS), "group", "left").withColumn("odd", ~F.coalesce((F.col("lo") == F.col("main")) & (F.col("hi") == F.col("main")), F.lit(False))), "marked")
    odd = marked.where("odd").select("group", F.col("block").alias("x"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = marked.join(odd, "group").where((F.col("block") != F.col("x")) & ((F.col("lo") != F.col("hi2")) | (F.col("hi") != F.col("lo2"))))
    return met.select(F.least("block", "x").alias("ba"), F.greatest("block", "x").alias("bb")).distinct()


def _across(sigs: DataFrame, comp: DataFrame) -> DataFrame:
    """The lists in which more than one component meets, with each member's component."""
    known = small(comp.select(F.col("node").alias("sk"), F.col("component").alias("comp")), MAX_BROADCAST_ROWS)
    named = sigs.select("sig", "sk", "n", "lone").join(known, "sk", "left").withColumn("comp", F.coalesce("comp", "sk"))
    mixed = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    return named.join(mixed, "sig")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tk, n, sk) of every row and (sk, component) of the classes that link with others."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tk", text_key())
    measured = stage(rows.mapInArrow(_measure, "doc_id bigint, tk bigint, n bigint, sk bigint"), "measured")
    size = measured.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(64, size * 3 // 8 // BUCKET)
    shipped = rows.select("text").mapInArrow(_credits(buckets), "bucket int, packed binary, sk bigint, n bigint, credit bigint")
    met = shipped.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "sk bigint, n bigint, credit bigint")
    total = met.groupBy("sk").agg(F.max("n").alias("n"), F.sum("credit").alias("credit"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * THRESHOLD / 100) / 8))
    alive = stage(total.where(F.col("credit") >= least).select(F.col("sk").alias("cut")), "alive")
    cut = F.col("sk").bitwiseAND(F.lit(int(_CUT))).bitwiseOR(F.lit(1)).alias("cut")
    heads = measured.select("*", cut).join(small(alive, MAX_BROADCAST_ROWS), "cut").groupBy("sk").agg(F.min(F.struct("doc_id", "tk")).alias("d")).select("sk", "d.doc_id", "d.tk")
    heads = small(stage(heads, "heads"), MAX_BROADCAST_ROWS)
    texts = rows.join(heads, same(rows, heads, "doc_id", "tk")).select(heads["sk"].alias("sk"), "text")

    def tokens(batches):
        for b in batches:
            for part in slices(b):
                v, so, n, sk = sets_of(part["text"])
                yield pa.record_batch({"sk": pa.array(sk), "n": pa.array(n), "tokens": pa.array([v[so[i] : so[i + 1]].tobytes() for i in range(len(n))], pa.binary())})

    sets = stage(texts.mapInArrow(tokens, "sk bigint, n bigint, tokens binary").dropDuplicates(["sk"]), "sets")
    counted = sets.select("sk", "tokens").mapInArrow(_tokens, "token bigint, sk bigint").repartition("token").sortWithinPartitions("token").mapInArrow(_frequencies, "sk bigint, token bigint, df int")
    counted = counted.unionByName(sets.select("sk", F.col("n").alias("token"), F.lit(-1).alias("df")))
    prefixes = stage(counted.repartition("sk").sortWithinPartitions("sk", "df", "token").mapInArrow(_prefixes, _PREFIX), "prefixes")
    sigs = stage(signatures(prefixes, boundary(prefixes)), "signatures")
    return measured, _class_links(sigs, sets)


def _grouped(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, tk, n and ``least`` (absent, doc_id, tk), the least row of its component, null for empty sets."""
    measured, linked = classes(docs)
    linked = small(stage(linked, "linked"), MAX_BROADCAST_ROWS)
    named = measured.join(linked.withColumnRenamed("node", "sk"), "sk", "left").withColumn("component", F.coalesce("component", "sk"))
    row = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "tk")
    least = stage(named.where("n > 0").groupBy("component").agg(F.min(row).alias("least")), "least")
    return named.join(least, "component", "left").select("doc_id", "tk", "n", F.when(F.col("n") > 0, F.col("least")).alias("least"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, tk, n_shingles, component_id."""
    return _grouped(docs).select("doc_id", "tk", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id (null ones last), of equal ids that of the smallest text key."""
    found = _grouped(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tk") == F.col("least.tk"))
    gone = found.where((F.col("n") > 0) & ~stays).select("doc_id", "tk").distinct()
    gone = small(stage(gone, "gone"), MAX_BROADCAST_ROWS)
    tk = unused(docs, "__tk")
    mine = docs.withColumn(tk, text_key())
    kept = mine.join(gone, (mine[tk] == gone["tk"]) & mine["doc_id"].cast("bigint").eqNullSafe(gone["doc_id"]), "left_anti")
    return kept.dropDuplicates(["doc_id", tk]).drop(tk)


def op4_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("tk")


QUERIES = {"op4_jaccard": op4_jaccard}
SQL: dict = {}
