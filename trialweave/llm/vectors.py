"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

Index: every distinct vector x (unit length) is rotated by random orthogonal matrices; the signs are its binary code,
and ``factor`` = <x, code> corrects the code's shrinkage, so that <y, code> / factor is an unbiased estimate of <x, y>
with a known error bound.  Slices of the code are bucket keys: vectors meet if any of ``tables`` slices agree.  In a
bucket, estimate plus bound under the threshold rejects a pair; all others are recomputed exactly in double
precision, so nothing below the threshold is ever linked.

Key width and number of tables follow from the number of vectors and ``MISS``: a pair of exactly the threshold's cosine
is missed with probability ``MISS`` at most; nearer pairs are missed less.

Scale: exact copies are one vector with a multiplicity (map-side aggregated).  Buckets over ``BLOCK`` rows are split
into pairs of blocks that different tasks compare, so no task holds more than two blocks, whatever the group.  A
pair is counted only in the first table in which it meets, and a block returns counts and a spanning forest of its
links, never the pairs.

Defined results: null label, null or empty vector, zero vector, or null or non-finite components: no link, a component
of its own, kept.  Vectors of different lengths do not link.  Repeated rows are copies of each other and link.  A null
vec_id counts as a vector but not as a smallest id, and is not kept.  Empty tables give no rows; extra columns go.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, table
from .graph import components, forest

THRESHOLD = 0.98
#: Probability of missing a pair at the threshold; standard errors in a confidence bound; rows of a block.
MISS, SIGMAS, BLOCK = 0.003, 5.0, 2048
#: Rows up to which a table of one row per vector is broadcast.
MAX_BROADCAST_ROWS = 200_000
SEED = 20240607

_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, bits: int) -> np.ndarray:
    """(bits, dim): stacked random orthogonal matrices, the same in every task."""
    if (dim, bits) not in _rotations:
        rng = np.random.RandomState(SEED + dim)
        blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(math.ceil(bits / dim))]
        _rotations[dim, bits] = np.concatenate(blocks)[:bits]
    return _rotations[dim, bits]


def shape(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, tables) for n vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    width = min(40, max(8, math.ceil(math.log2(max(n, 1) / 64 + 1))))
    return width, math.ceil(math.log(miss) / math.log(1 - agree**width))


def _valid():
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def _encode(width: int, tables: int):
    bits = width * tables

    def of(batches):
        weights = (np.uint64(1) << np.arange(width, dtype=np.uint64)).astype(np.uint64)
        for b in batches:
            n = len(b)
            code, factor, keys, vec = [None] * n, np.zeros(n), [None] * n, [None] * n
            lists = [np.asarray(v, np.float64) for v in b["embedding"].to_pylist()]
            for dim in {len(v) for v in lists}:
                at = [i for i, v in enumerate(lists) if len(v) == dim]
                x = np.stack([lists[i] for i in at])
                big = np.abs(x).max(1, keepdims=True)
                unit = x / big
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                turned = unit @ rotation(dim, bits).T
                sign = turned > 0
                f = np.abs(turned).sum(1) / math.sqrt(bits)
                ks = (sign.reshape(len(at), tables, width) * weights).sum(2).astype(np.int64)
                packed = np.packbits(sign, axis=1)
                for j, i in enumerate(at):
                    code[i], factor[i], keys[i], vec[i] = packed[j].tobytes(), f[j], ks[j].tolist(), unit[j].tobytes()
            yield pa.record_batch({"vk": b["vk"], "label": b["label"], "m": b["m"], "code": pa.array(code, pa.binary()), "factor": pa.array(factor), "keys": pa.array(keys, pa.list_(pa.int64())), "vec": pa.array(vec, pa.binary())})

    return of


def links_in(rows: dict[str, np.ndarray], table_no: int, threshold: float, bits: int):
    """Linked (left, right) positions of a bucket or of a pair of its blocks, each pair in its first table only."""
    dims = rows["dim"]
    left_all = np.flatnonzero(rows["side"] <= 1)
    right_all = np.flatnonzero(rows["side"] >= 1)
    same_block = not (rows["side"] != 1).any()
    found_a, found_b = [], []
    for dim in np.unique(dims):
        left, right = left_all[dims[left_all] == dim], right_all[dims[right_all] == dim]
        if not len(left) or not len(right):
            continue
        y = np.stack([np.frombuffer(rows["vec"][i], np.float64) for i in right])
        x = y if same_block else np.stack([np.frombuffer(rows["vec"][i], np.float64) for i in left])
        r = rotation(int(dim), bits)
        signs = np.stack([np.unpackbits(np.frombuffer(rows["code"][i], np.uint8), count=bits) for i in right]).astype(np.float32) * 2 - 1
        f = rows["factor"][right]
        turned = (x @ r.T).astype(np.float32)
        # unit code c = signs / sqrt(bits), unit rotated y = r y / sqrt(rounds), with rounds = bits / dim rotations
        along = f / math.sqrt(bits / dim)  # <rotated y, c>
        estimate_scale = 1 / (f * math.sqrt(bits))
        bound = SIGMAS * np.sqrt(np.maximum(1 - along * along, 0)) / (along * math.sqrt(max(dim - 1, 1))) + 1e-4
        for s in range(0, len(left), 512):
            ok = (turned[s : s + 512] @ signs.T) * estimate_scale + bound >= threshold
            i, j = np.nonzero(ok)
            keep = left[i + s] < right[j] if same_block else np.ones(len(i), bool)
            i, j = i[keep] + s, j[keep]
            for c in range(0, len(i), 200_000):  # exact, in bounded pieces
                ci, cj = i[c : c + 200_000], j[c : c + 200_000]
                exact = np.einsum("ij,ij->i", x[ci], y[cj]) >= threshold
                ci, cj = left[ci[exact]], right[cj[exact]]
                fresh = ~(rows["keys"][ci, :table_no] == rows["keys"][cj, :table_no]).any(1) if table_no else np.ones(len(ci), bool)
                found_a.append(ci[fresh]), found_b.append(cj[fresh])
    if not found_a:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(found_a), np.concatenate(found_b)


def _compare(threshold: float, bits: int):
    out_schema = pa.schema([("vk", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def close(group: list[dict]):
        if len(group) < 2:
            return None
        rows = {
            "vk": np.array([g["vk"] for g in group]), "m": np.array([g["m"] for g in group]), "side": np.array([g["side"] for g in group]), "factor": np.array([g["factor"] for g in group]),
            "keys": np.array([g["keys"] for g in group]), "vec": [g["vec"] for g in group], "code": [g["code"] for g in group], "dim": np.array([len(g["vec"]) // 8 for g in group])}
        a, b = links_in(rows, group[0]["t"], threshold, bits)
        if not len(a):
            return None
        n = np.bincount(a, rows["m"][b], len(group)) + np.bincount(b, rows["m"][a], len(group))
        hit = np.flatnonzero(n)
        tree = forest(a, b)
        return pa.record_batch({
            "vk": pa.array(np.concatenate([rows["vk"][hit], rows["vk"][a[tree]]])), "n": pa.array(np.concatenate([n[hit].astype(np.int64), np.zeros(len(tree), np.int64)])),
            "other": pa.array([None] * len(hit) + rows["vk"][b[tree]].tolist(), pa.int64())}, schema=out_schema)

    def of(batches):
        now, group = None, []
        for b in batches:
            for r in b.to_pylist():
                key = (r["t"], r["label"], r["key"], r["bi"], r["bj"])
                if key != now:
                    if (done := close(group)) is not None:
                        yield done
                    now, group = key, []
                group.append(r)
        if (done := close(group)) is not None:
            yield done

    return of


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    valid = rows.where(_valid()).withColumn("vk", F.xxhash64("label", "embedding"))
    distinct = stage(valid.groupBy("vk", "label", "embedding").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least")), "distinct")
    width, tables = shape(distinct.count(), threshold)
    bits = width * tables
    index = stage(distinct.select("vk", "label", "m", "embedding").mapInArrow(_encode(width, tables), "vk bigint, label string, m bigint, code binary, factor double, keys array<bigint>, vec binary"), "codes")
    met = index.select("*", F.posexplode("keys").alias("t", "key"))
    sizes = met.groupBy("t", "label", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = met.join(sizes, ["t", "label", "key"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("vk", "t"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("bi"), F.greatest(o, F.col("mine")).alias("bj"), F.when(o == F.col("mine"), 1).when(F.col("mine") < o, 0).otherwise(2).alias("side")))
    dealt = met.select("t", "label", "key", "vk", "m", "code", "factor", "keys", "vec", F.explode(others).alias("o")).select("t", "label", "key", "o.bi", "o.bj", "o.side", "vk", "m", "code", "factor", "keys", "vec")
    group = ["t", "label", "key", "bi", "bj"]
    met = stage(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(threshold, bits), "vk bigint, n bigint, other bigint"), "links")
    counts = met.where("other IS NULL").groupBy("vk").agg(F.sum("n").alias("n"))
    comp = components(met.where("other IS NOT NULL").select(F.col("vk").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "vk")
    per = distinct.select("vk", "label", "embedding", "m", "least").join(counts, "vk", "left").join(comp, "vk", "left").withColumn("component", F.coalesce("component", "vk"))
    least = per.groupBy("component").agg(F.min("least").alias("component_id"))
    per = small(stage(per.join(least, "component").select("vk", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "classes"), MAX_BROADCAST_ROWS)
    out = rows.withColumn("vk", F.when(_valid(), F.xxhash64("label", "embedding"))).join(per, "vk", "left")
    component = F.when(F.col("vk").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_vectors(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_vectors": op8_vectors}
SQL: dict = {}
