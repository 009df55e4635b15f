"""Language identification by hierarchical discrimination.

A text's family (Germanic, Romance, ...) is predicted first; inside the family, one-versus-one linear support
vector machines separate the related languages.  Features are relative frequencies of hashed byte trigrams centred
on letters of the whole text.  A prediction is a weighted mean over the text's trigrams, so that it needs one table
look-up per byte and classifier: the corpus is read once, nothing is shuffled.

Training uses a bounded sample: at most about ``SAMPLE`` different labelled texts per language, chosen by a hash of
the text, as ``DIM`` floats each; every other step covers all rows.  Every labelled language is learned.  Where
families are more than ``FAN``, like ones share a node, until no node of the tree has more than ``FAN`` branches.  The
nodes are fitted as Spark tasks, each on about ``SAMPLE`` texts a branch that its languages share evenly (``LEAST`` a
language at least); the model grows by about ``FAN / 2`` machines a language.  The driver gets a centre a language
and the machines, no texts and no features.

Defined results: a null text or one without letters gives ``und`` with score 0.  Null lang is never trained on.
Null doc_id counts as held out.  With no labelled row at all every text is ``und``; with one language every text
with letters gets it, score 1.  Repeated rows and extra columns change nothing but the sample.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, small, stage
from .textkit import batch_bytes, slices

#: Labelled texts per language that the classifiers are fitted on, at most about.
SAMPLE = 600
#: Branches of a node of the tree; the largest family has as many.
FAN = 12
#: Texts of a language, at least, that a node is fitted on where its branches hold many languages.
LEAST = 4
DIM = 4096
#: Languages up to which their counts are broadcast.
MAX_BROADCAST_ROWS = 200_000
#: Penalty of the squared hinge loss, and passes of the dual coordinate descent.
PENALTY, PASSES = 10.0, 30

#: Families of related languages (ISO 639-1 codes); a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def _letters() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(97, 123):
        t[b], t[b - 32] = b, b
    t[128:] = np.arange(128, 256)
    return t


_LETTER = _letters()
_TAB = np.random.RandomState(20240607).randint(0, DIM, (3, 256)).astype(np.uint16)


def trigrams(column):
    """(index of each letter-centred trigram, n+1 offsets of the rows)."""
    data, offsets = batch_bytes(column)
    b = _LETTER[data]
    left, right = np.zeros_like(b), np.zeros_like(b)
    if len(b):
        left[1:], right[:-1] = b[:-1], b[1:]
        cut = offsets[1:-1]
        left[cut[cut < len(b)]] = 0
        right[cut[cut > 0] - 1] = 0
    at = np.flatnonzero(b)
    idx = _TAB[0][left[at]] ^ _TAB[1][b[at]] ^ _TAB[2][right[at]]
    return idx, np.searchsorted(at, offsets)


def means(weights: np.ndarray, idx: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row, the mean weight of its trigrams; 0 without any."""
    total = np.concatenate([[0.0], np.cumsum(weights[idx], dtype=np.float64)])
    n = np.diff(offsets)
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by dual coordinate descent; y is +1 or -1.  Returns weights and bias."""
    n = len(x)
    weight = n / (2.0 * np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1)))
    alpha, w, bias = np.zeros(n), np.zeros(x.shape[1]), 0.0
    diag = 0.5 / (PENALTY * weight)
    q = (x * x).sum(1) + 1.0 + diag
    order = np.random.RandomState(7)
    for _ in range(PASSES):
        for i in order.permutation(n):
            g = y[i] * (x[i] @ w + bias) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * x[i]
                bias += step
                alpha[i] = new
    return w, bias


class Tree:
    """One-versus-one machines at every node of a tree whose leaves are languages; a text goes down from node 0.

    ``nodes``: the children of each node, a language or the number of a node.  ``machines``: those of each node, as
    (child, child, weights, bias) by the children's places.
    """

    def __init__(self, nodes: list[list], machines: dict[int, list]):
        self.nodes, self.machines = nodes, machines

    @staticmethod
    def grow(langs: list[str], centres: np.ndarray) -> list[list]:
        """Families under the root; where they are more than FAN, like ones share a node."""
        family: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            family.setdefault(_FAMILY.get(lang, "\0" + lang), []).append(i)
        groups = [family[f] for f in sorted(family)]
        middle = np.stack([centres[g].mean(0) for g in groups])
        nodes: list[list] = [[]]

        def leaf(g):
            if len(g) == 1:
                return langs[g[0]]
            nodes.append([langs[i] for i in g])
            return len(nodes) - 1

        def halves(part):
            x = middle[part] - middle[part].mean(0)
            axis = np.linalg.eigh(x @ x.T)[1][:, -1]
            order = [part[i] for i in np.argsort(axis, kind="stable")]
            return order[: len(order) // 2], order[len(order) // 2 :]

        def fill(at, part):
            if len(part) <= FAN:
                nodes[at] = [leaf(groups[i]) for i in part]
                return
            parts = [part]
            while len(parts) < min(FAN, -(-len(part) // FAN)):
                parts.sort(key=len)
                parts += halves(parts.pop())
            for p in parts:
                if len(p) == 1:
                    nodes[at].append(leaf(groups[p[0]]))
                else:
                    nodes.append([])
                    nodes[at].append(len(nodes) - 1)
                    fill(len(nodes) - 1, p)

        fill(0, list(range(len(groups))))
        return nodes

    def below(self, node) -> list[tuple[str, list[tuple[int, int]]]]:
        """(language, (node, place of the child) from the given node down) of each language under it."""
        out = []
        for place, child in enumerate(self.nodes[node]):
            if isinstance(child, str):
                out.append((child, [(node, place)]))
            else:
                out += [(lang, [(node, place), *way]) for lang, way in self.below(child)]
        return out

    @staticmethod
    def _vote(kids: int, margins: dict[tuple[int, int], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Winner by most duels won, then by summed margins; and its least certain duel."""
        wins, total = np.zeros((kids, n)), np.zeros((kids, n))
        for (i, j), m in margins.items():
            wins[i] += m >= 0
            wins[j] += m < 0
            total[i] += m
            total[j] -= m
        best = np.lexsort((total.T, wins.T), axis=-1)[:, -1] if kids > 1 else np.zeros(n, int)
        sure = np.full(n, np.inf)
        for pair, m in margins.items():
            for k, sign in zip(pair, (1, -1), strict=True):
                sure = np.where(best == k, np.minimum(sure, sign * m), sure)
        return best, sure

    def predict(self, column) -> tuple[np.ndarray, np.ndarray]:
        idx, offsets = trigrams(column)
        n = len(offsets) - 1
        out, score = np.empty(n, object), np.full(n, np.inf)

        def down(node, rows):
            size = offsets[rows + 1] - offsets[rows]
            ends = np.concatenate([[0], np.cumsum(size)])
            mine = idx[np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], size)]
            kids = self.nodes[node]
            margins = {(a, b): means(w, mine, ends) + bias for a, b, w, bias in self.machines.get(node, ())}
            best, sure = self._vote(len(kids), margins, len(rows))
            score[rows] = np.minimum(score[rows], sure)
            for place, child in enumerate(kids):
                if len(there := rows[best == place]):
                    if isinstance(child, str):
                        out[there] = child
                    else:
                        down(child, there)

        if n:
            down(0, np.arange(n))
        return out, 1.0 / (1.0 + np.exp(-3.0 * np.clip(score, -200, 200)))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(batches):
    """(lang, x) of the texts with letters."""
    for batch in batches:
        for b in slices(batch):
            idx, at = trigrams(b["text"])
            keep = np.flatnonzero(np.diff(at) > 0)
            x = [(np.bincount(idx[at[i] : at[i + 1]], minlength=DIM) / (at[i + 1] - at[i])).astype(np.float32).tobytes() for i in keep]
            yield pa.record_batch({"lang": b["lang"].take(pa.array(keep)), "x": pa.array(x, pa.binary())})


def _centres(batches):
    """From rows sorted by lang: (lang, rows, sum of their features)."""
    now, n, total = None, 0, None
    for b in batches:
        for lang, raw in zip(b["lang"].to_pylist(), b["x"].to_pylist(), strict=True):
            if lang != now:
                if n:
                    yield pa.record_batch({"lang": [now], "n": pa.array([n], pa.int64()), "x": pa.array([total.tobytes()], pa.binary())})
                now, n, total = lang, 0, np.zeros(DIM)
            n += 1
            total += np.frombuffer(raw, np.float32)
    if n:
        yield pa.record_batch({"lang": [now], "n": pa.array([n], pa.int64()), "x": pa.array([total.tobytes()], pa.binary())})


def _fit_nodes(scale: np.ndarray):
    """From rows sorted by node: (node, a, b, weights, bias) of all pairs of a node's children."""

    def of(batches):
        now, places, rows = None, [], []

        def close():
            x, y = np.stack([np.frombuffer(r, np.float32) for r in rows]) * scale, np.array(places)
            for a, b in itertools.combinations(sorted(set(places)), 2):
                pick = (y == a) | (y == b)
                w, bias = fit_svm(x[pick], np.where(y[pick] == a, 1.0, -1.0))
                yield pa.record_batch({"node": pa.array([now], pa.int32()), "a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()), "w": pa.array([(w * scale).astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([float(bias)])})

        for part in batches:
            for node, place, raw in zip(part["node"].to_pylist(), part["place"].to_pylist(), part["x"].to_pylist(), strict=True):
                if node != now:
                    if rows:
                        yield from close()
                    now, places, rows = node, [], []
                places.append(place)
                rows.append(raw)
        if rows:
            yield from close()

    return of


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tree | None:
    """Fit on a bounded sample of the labelled documents that are not held out.

    Repeated texts count once: a group of copies, of one doc_id or of many, doesn't lengthen the sample.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pool = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = stage(pool.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")), "languages")
    share = F.least(F.lit(1.0), 1.2 * sample / F.col("n")) * float(1 << 40)
    chosen = pool.join(small(sizes, MAX_BROADCAST_ROWS), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < share)
    rows = stage(chosen.select("text", "lang").distinct().mapInArrow(_features, "lang string, x binary"), "language-sample")
    found = rows.repartition("lang").sortWithinPartitions("lang").mapInArrow(_centres, "lang string, n bigint, x binary").collect()  # one row a language
    if not found:
        return None
    found.sort(key=lambda r: r["lang"])
    count = {r["lang"]: r["n"] for r in found}
    sums = np.stack([np.frombuffer(r["x"], np.float64) for r in found])
    scale = (1.0 / np.sqrt(sums.sum(0) / sum(count.values()) + 1e-4)).astype(np.float32)
    tree = Tree(Tree.grow(list(count), sums / np.array(list(count.values()))[:, None] * scale), {})
    ways = tree.below(0)
    under: dict[tuple[int, int], int] = {}
    for _, way in ways:
        for step in way:
            under[step] = under.get(step, 0) + 1
    plan = [(lang, node, place, min(1.0, max(LEAST, 1.2 * sample / under[node, place]) / count[lang])) for lang, way in ways for node, place in way]
    dealt = rows.join(F.broadcast(spark.createDataFrame(plan, "lang string, node int, place int, share double")), "lang")  # some rows a language
    dealt = dealt.where(F.pmod(F.xxhash64("x", "node"), F.lit(1 << 40)) < F.col("share") * float(1 << 40))
    dealt = dealt.select("node", "place", "x").repartition("node").sortWithinPartitions("node", "place", F.xxhash64("x"))  # one order, whatever task is run again
    for r in dealt.mapInArrow(_fit_nodes(scale), "node int, a int, b int, w binary, bias double").toLocalIterator():
        tree.machines.setdefault(r["node"], []).append((r["a"], r["b"], np.frombuffer(r["w"], np.float32), r["bias"]))
    return tree


def _predicted(model: Tree | None, text) -> tuple[np.ndarray, np.ndarray]:
    """The model's languages and scores, ``und`` and 0 where a text has no letters."""
    if model is None:
        return np.full(len(text), "und", object), np.zeros(len(text))
    pred, score = model.predict(text)
    data, offsets = batch_bytes(text)
    ascii_letters = np.concatenate([[0], np.cumsum((_LETTER[data] > 0) & (data < 128))])
    for i in np.flatnonzero(ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]]):
        if not has_letters(text[int(i)].as_py()):
            pred[i], score[i] = "und", 0.0
    return pred, score


def identify(docs: DataFrame, model: Tree | None) -> DataFrame:
    """The documents with two more columns, lang_pred and score (replacing columns of those names)."""
    bounded_batches(docs.sparkSession)
    base = docs.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # machines of the languages, no rows

    def of(batches):
        for batch in batches:
            for b in slices(batch):
                pred, score = _predicted(shared.value, b["text"])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return base.mapInArrow(of, schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; what is ``und`` (no text, no letters) goes."""
    mine = docs.withColumn("text", F.col("text").cast("string"))
    found = identify(mine, fit(mine))
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def op6_language(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": op6_language}
SQL: dict = {}
