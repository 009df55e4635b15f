"""Cases that the operators' own tests leave out: predictions by brute force, clashing names, nulls, long texts, and the
pipeline on a small nasty table, stage by stage against plain Python."""

import random
import re
import warnings
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import chat, decontaminate, graph, jaccard, language, mixing, revisits, urlrules, vectors


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_language_predictions_by_brute_force(spark):
    rng = random.Random(2)
    tongue = {"en": ["the", "and", "with", "thing", "ship"], "de": ["der", "und", "schlich", "zeit", "für"], "fr": ["les", "est", "aux", "même", "où"], "eu": ["eta", "bat", "zen", "ditu", "etxe"]}
    rows = [(i, " ".join(rng.choices(tongue[lang], k=rng.randrange(1, 30))), lang) for i in range(400) for lang in [rng.choice(list(tongue))]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(d, sample=60)
    texts = [t for _, t, _ in rows[:60]] + ["mixed the und les", "É", "x" * 20000, "the " * 30000]

    def features(text):
        raw = [b if b >= 128 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 0 for b in text.encode()]
        raw, x, n = [0, *raw, 0], np.zeros(language.DIM), 0
        for i in range(1, len(raw) - 1):
            if raw[i]:
                x[language._TAB[0][raw[i - 1]] ^ language._TAB[1][raw[i]] ^ language._TAB[2][raw[i + 1]]] += 1
                n += 1
        return x / max(n, 1)

    def predicted(text):
        x, node = features(text), 0
        while True:
            kids = model.nodes[node]
            margin = {(a, b): x @ w + bias for a, b, w, bias in model.machines.get(node, ())}
            wins = [(sum((m >= 0) if a == k else (m < 0) for (a, b), m in margin.items() if k in (a, b)), sum(m if a == k else -m for (a, b), m in margin.items() if k in (a, b)), k) for k in range(len(kids))]
            best = kids[max(wins)[2]]
            if isinstance(best, str):
                return best
            node = best

    got = language.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), model).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == [predicted(t) for t in texts]


def test_language_sample_is_bounded_by_different_texts(spark):
    rows = [(8, "the same text again", "en")] * 500 + [(i, f"der text {i} und so", "de") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language.fit(d, sample=20).nodes  # a repeated row is one row of the sample
    assert {r["lang_pred"] for r in language.identify(d, language.fit(d, sample=20)).where("doc_id = 8 AND text LIKE 'the%'").collect()} == {"en"}


def test_vectors_components_are_those_of_all_links(spark):
    rng = np.random.RandomState(14)
    centres = rng.standard_normal((9, 48))
    rows = [(i, (centres[i % 9] + 0.02 * rng.standard_normal(48)).tolist(), i % 3) for i in range(270)]  # far above the threshold, or far below
    want = {}
    for i, _, label in rows:
        want.setdefault((i % 9, label), []).append(i)
    want = {(i, len(x) - 1, x[0], i == x[0]) for x in want.values() for i in x}
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == want


def test_unsettled_components_are_an_error(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r["component"] for r in graph.components(chain).collect()} == {0}
    monkeypatch.setattr(graph, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        graph.components(chain)


def test_block_pairs_of_a_large_group(spark):
    # 60 blocks of component 1 meet in many lists; one block holds another set, one is of another component
    lists = [(s, f"b{k}") for s in range(20) for k in range(62)]
    names = {f"b{k}": k for k in range(62)}
    comp = {k: [1] for k in range(60)} | {60: [1, 5], 61: [9]}
    lists = spark.createDataFrame([(s, names[b]) for s, b in lists], "sig bigint, block bigint")
    members = spark.createDataFrame([(k, c) for k, cs in comp.items() for c in cs], "block bigint, comp bigint")
    got = {tuple(r) for r in jaccard._block_pairs(lists, members).collect()}
    assert got == {(k, x) for x in (60, 61) for k in range(x)}


def test_mixing_meets_its_marginals_or_says_so(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["en", "de"]), rng.choice("abc"), 0.5) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, MIX_P double")
    got = mixing.sampled(d).collect()
    weight = {(r["__source"], r["__lang"], r["__topic"]): r["__weight"] for r in got if r["__n"]}
    by = Counter()
    for (source, _, _), w in weight.items():
        by[source] += w
    assert all(abs(by[s] - 1 / 3) < 1e-6 for s in "abc")
    assert mixing.sample(d).columns == ["doc_id", "text", "lang", "source", "mix_p"]
    torn = spark.createDataFrame([(i, "w " * 60, "en" if i % 4 else "de", "a" if i % 4 else "b") for i in range(100)], "doc_id bigint, text string, lang string, source string")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert mixing.sampled(torn).count() == 100  # a is all of en: 1/2 and 0.634 cannot both be met
    assert any("contradict" in str(w.message) for w in said)


def test_revisits_of_no_kind(spark):
    record = "record_id string, url string, ts timestamp, kind string, etag string, last_modified string, digest string, n_bytes bigint, headers map<string,string>"
    rows = [("a", "http://x.org/", None, None, None, None, None, None, None), ("b", None, None, "revisit", None, None, None, None, None), ("c", "http://x.org/", None, "response", None, None, "d", 1, None)]
    assert {(r["record_id"], r["verdict"]) for r in revisits.resolve(spark.createDataFrame(rows, record)).collect()} == {("a", "orphan"), ("b", "orphan")}


def test_urls_of_odd_rows(spark):
    pages = [(None, "http://h.com/a/1"), (1, "http://h.com/" + "s/" * 3000), (1, "http://h.com/a/2"), (2, None), (3, "HTTP://USER@H.com?x"), (4, "http://a.net/"), (5, "://"), (6, "x" * 50000)]
    labels = [(1, 1), (1, 0), (1, 1), (None, 1)]
    p = spark.createDataFrame([(*r, "clash") for r in pages], "page_id bigint, url string, host string")
    got = urlrules.judge(p, spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    assert len(got) == len(pages) and {r["rule"] for r in got if r["page_id"] == 4} == {"net/"}
    assert {(r["host"], r["path"]) for r in got if r["page_id"] in (2, 5, 6)} == {("", "")} and {r["host"] for r in got if r["page_id"] == 3} == {"user@h.com"}
    assert urlrules.judge(p.limit(0), spark.createDataFrame([], "page_id bigint, bad int")).count() == 0
    hot = spark.createDataFrame([(i, f"http://hot.com/p/slug{i}/x") for i in range(2000)], "page_id bigint, url string")
    marks = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(2000)], "page_id bigint, bad int")
    assert {r["template"] for r in urlrules.judge(hot, marks).collect()} >= {"/p/slug{n}/x"}


def test_chat_length_of_a_rewriting_template(spark):
    class Renumbering:
        """Rewrites history: the number of turns stands in front."""

        AFTER_ROLE, CLOSE = "|", "\n"

        def render(self, messages):
            return f"{len(messages)}\n" + "".join(f"{r}|{t}\n" for r, t in messages)

        def content_span(self, piece):
            return 0, 0

        def read(self, piece):
            return "", ""

        def unescape(self, text):
            return text

    rows = [(1, i, "user", f"turn {i}") for i in range(12)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    t = Renumbering()
    got = chat.read_back(chat.format_conversations(d, t), t).first()
    assert got["rewrites"] and got["formatted_chars"] == len(t.render([(r, x) for _, _, r, x in rows])) and got["n_turns"] == 12


def test_decontamination_of_copies_and_long_texts(spark):
    rng = random.Random(5)
    item = words(rng, 20, 3000)
    text = " ".join(words(rng, 30, 3000) + item + words(rng, 30, 3000))
    rows = [(i, text, 0) for i in range(50)] + [(7, text, 0)] * 50 + [(None, text, 0), (100, " ".join(words(rng, 60000, 3000) + item), 0), (101, None, 0), (102, "", 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, tk int")
    b = spark.createDataFrame([("q", " ".join(item), 1), ("q", " ".join(item[3:]), 1), (None, None, 1), ("r", "", 1)], "item_id string, text string, hits int")
    got = decontaminate.judged(d, b).collect()
    assert len(got) == len(rows)
    assert {(r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got} == {(80, 20, 1, True), (60020, 20, 1, False), (0, 0, 0, False)}


def test_pipeline_on_a_nasty_table(spark, tmp_path):
    import corpus_pipeline as cp
    from trialweave.llm.common import stage

    rng = random.Random(12)
    base, item = words(rng, 120, 4000), words(rng, 15, 4000)
    edit = lambda k: " ".join([*base[:-k], *words(rng, k, 10**6)])
    rows = [(i, edit(1 + i % 3)) for i in range(12)] + [(None, edit(2)), (5, edit(1)), (5, edit(1))]
    rows += [(30 + i, " ".join(words(rng, 60, 4000) + item + words(rng, 20, 4000))) for i in range(3)]
    rows += [(40 + i, " ".join(words(rng, 50, 4000)) + f"\nmail me{i}@x.org or +1 (555) 010-99{i}{i}") for i in range(5)]
    rows += [(60, None), (61, ""), (62, " 12 34 !?"), (63, "w1 " * 40000), (64, "w2 w3"), (64, "w2 w3"), (None, None), (65, " ".join(words(rng, 40, 4000)))]
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 0.5) for i, t in rows]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, tk int, __tk string, mix_p double").repartition(4)
    spark.createDataFrame([("q", " ".join(item))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = dict(cp.STAGES)
    assert list(steps) == ["language", "near duplicates", "decontamination", "personal data", "mixture"]
    plain = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    now = stage(steps["language"](spark, d, str(tmp_path)), "t1")
    want = Counter((r[0], r[1]) for r in rows if r[1] and any(map(str.isalpha, r[1])))
    assert plain(now) == want and now.columns == d.columns

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}

    docs = sorted(want.elements(), key=repr)
    sets, group = [shingles(t) for _, t in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, t) in zip(group, docs, strict=True):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    now = stage(steps["near duplicates"](spark, now, str(tmp_path)), "t2")
    kept = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert Counter(i for i, _ in kept) == Counter(None if absent else i for absent, i in least.values()) and set(kept) <= set(docs)
    now = stage(steps["decontamination"](spark, now, str(tmp_path)), "t3")
    clean = [(i, t) for i, t in kept if " ".join(item[:13]) not in t and " ".join(item[1:14]) not in t]
    assert plain(now) == Counter(clean) and len(clean) == len(kept) - 3
    now = stage(steps["personal data"](spark, now, str(tmp_path)), "t4")
    hidden = lambda t: re.sub(r"\+1 \(555\) 010-99\d\d", "[PHONE]", re.sub(r"me\d@x\.org", "[EMAIL]", t))
    assert plain(now) == Counter((i, hidden(t)) for i, t in clean) and all(r["n_chars"] == len(r["text"]) for r in now.collect())
    last = steps["mixture"](spark, now, str(tmp_path))
    assert set(last.columns) == set(d.columns) and not plain(last) - plain(now)
    none = d.limit(0)
    for step in steps.values():
        none = stage(step(spark, none, str(tmp_path)), "none")
        assert none.where(F.lit(True)).count() == 0
