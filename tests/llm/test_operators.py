"""The ten operators against brute force on small, nasty tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import chat, decontaminate, jaccard, language, mixing, privacy, revisits, substrings, urlrules, vectors

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, sk string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = words(rng, 300, 5000)
    passage = " ".join(words(rng, 90, 5000))
    out = [None, "", "   \n\t", "één", "one", "a b c d", "a b c d", "A B C D", "x" * 1500, ("ab " * 600).strip()]
    out += [" ".join(base)] * 3
    for k in range(12):
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    for k in range(10):
        out.append(" ".join(words(rng, 60 + k, 5000)) + "\n" + passage + "\n" + " ".join(words(rng, 40, 5000)))
    out += [" ".join(words(rng, rng.randrange(1, 200), 5000)) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 7, "clash") for i, t in enumerate(texts)]
    rows += [rows[13], (None, "null id text one two three four five six", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# 1


def test_substrings_against_all_windows(spark, docs):
    rows = rows_of(docs)
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    want = []
    for i, b in raw:
        cov = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                cov[k] += 1
                cov[k + 400] -= 1
        c = np.cumsum(cov[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        want.append((i, len(b), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[2] for r in want) > 3000


def test_passages_of_words_against_all_windows(spark, docs):
    rng = random.Random(9)
    inner, short = " ".join(words(rng, 60, 5000)), " ".join(words(rng, 51, 300))
    more = [f"{short} tail", f"HEAD {short.upper()}\n", f"{' '.join(short.split()[:50])} almost", f"{inner} and {inner}", f"x {inner} y {inner} z {short} {short}", " ".join(inner.split()[5:57])]
    docs = docs.unionByName(spark.createDataFrame([(900 + i, t, None, None, None, None, None) for i, t in enumerate(more)], DOC))
    rows = [(i, t or "", k) for k, (i, t) in enumerate(rows_of(docs))]  # a repeated row is another document
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    held = {}
    for r in rows:
        w = split(r[1])
        for k in range(len(w) - 50):
            held.setdefault(tuple(w[k : k + 51]), set()).add(r)
    want = {(r[0], len(r[1].encode())): len({w for k in range(len(split(r[1])) - 50) if len(held[w := tuple(split(r[1])[k : k + 51])]) > 1}) for r in rows}
    got = {(r["doc_id"], r["n_bytes"]): r["n_passages"] for r in substrings.remove_repeats(docs).collect()}
    assert got == want
    assert want[900, len(more[0])] == 1 and want[902, len(more[2])] == 0 and want[903, len(more[3])] > 5


@pytest.mark.parametrize("kind", ["u4", "u8"])
def test_packed_entries_of_hot_tokens(kind, monkeypatch):
    import pyarrow as pa

    from trialweave.llm import passages

    monkeypatch.setattr(passages, "FLUSH", 300)
    monkeypatch.setattr(passages, "PIECE", 40)
    rng, buckets = np.random.RandomState(3), 8
    token = rng.randint(0, 1 << 62, 400).astype(np.uint64)
    pairs = [(int(token[0]), k) for k in range(1, 900)] + [(int(rng.choice(token)), int(rng.randint(1, 500))) for _ in range(900)] + [(int(t), 7) for t in token]
    rng.shuffle(pairs)
    packed = []
    for part in np.array_split(np.array(pairs, np.uint64), 3):  # three tasks
        out = passages._Packer(buckets, kind)
        for some in np.array_split(part, 11):
            packed += out.add(some[:, 0], some[:, 1].astype(np.int64))
        packed += out.flush()
    rows = pa.Table.from_batches(packed).sort_by("bucket")
    assert max(map(len, (x for x in rows["packed"].to_pylist() if x))) <= 300 * 16
    close = lambda t, k: pa.record_batch({"t": pa.array(t.astype(np.uint64)), "k": pa.array(k)})
    found = [r for b in passages._buckets(kind, close)(rows.to_batches()) for r in zip(b["t"].to_pylist(), b["k"].to_pylist(), strict=True)]
    keys = {}
    for t, k in pairs:
        keys.setdefault(t, set()).add(k)
    name = lambda t: int(passages._Packer(buckets, kind).named(np.array([t], np.uint64))[0])
    assert set(found) == {(name(t), k) for t, ks in keys.items() if len(ks) > 1 for k in ks}


def test_substrings_empty(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_suffix_index_levels(spark, docs):
    sparse = substrings.suffixes(substrings._keyed(docs)).persist()
    batch = lambda i: sparse.where(F.pmod(F.xxhash64("tk"), F.lit(3)) == i).select("core", "content")
    index = substrings.SuffixIndex()
    for i in range(2):
        index.add(batch(i))
    assert sorted(index.levels) == [1]
    index = substrings.SuffixIndex(index.levels)  # a later run's batches meet the levels of this one
    index.add(batch(2))
    assert sorted(index.levels) == [0, 1]  # three batches: one of rank 1, one of rank 0
    again, mixed = ({tuple(r) for r in x.collect()} for x in index.found())
    count, contents = Counter(), {}
    for r in sparse.collect():
        count[r["core"], r["content"]] += 1
        contents.setdefault(r["core"], set()).add(r["content"])
    assert again == {k for k, n in count.items() if n > 1}
    assert mixed == {(k,) for k, x in contents.items() if len(x) > 1}


# 2

RECORD = "record_id string, url string, ts timestamp, kind string, etag string, last_modified string, digest string, n_bytes bigint, headers map<string,string>, key string"


def test_revisits(spark):
    from datetime import datetime, timedelta

    t = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    r = lambda i, url, d, kind, etag=None, lm=None, h=None: (i, url, t(d) if d is not None else None, kind, etag, lm, f"dig-{i}", 10, h, "x")
    rows = [
        r("a", "http://www.Ex.com/p/", 1, "response", '"1"', None, {"content-type": "text/html", "etag": "1", "date": "old"}),
        r("b", "https://ex.com:443/p#f", 2, "revisit", 'W/"1"', None, {"date": "new", "content-type": "bad", "x": "y"}),
        r("c", "https://ex.com/p?utm_source=z", 3, "response", '"2"'),
        r("d", "HTTP://EX.com/p", 3, "revisit", '"2"'),  # same instant as c: sees a
        r("e", "http://ex.com/p", 4, "revisit", '"1"'),
        r("f", "http://ex.com/p", 0, "revisit", '"1"'),
        r("g", None, 1, "response"), r("h", None, 2, "revisit"), r("i", "http://ex.com/p", None, "revisit", '"1"'),
        r("b", "https://ex.com:443/p#f", 2, "revisit", 'W/"1"', None, {"date": "new", "content-type": "bad", "x": "y"}),
    ]
    got = {x["record_id"]: x for x in revisits.resolve(spark.createDataFrame(rows, RECORD)).collect()}
    assert (got["b"]["verdict"], got["b"]["refers_to"], got["b"]["headers"]) == ("validated", "a", {"content-type": "text/html", "etag": "1", "date": "new", "x": "y"})
    assert [got[k]["verdict"] for k in "defhi"] == ["mismatch", "mismatch", "orphan", "unverified", "orphan"]
    assert revisits.resolve(spark.createDataFrame(rows, RECORD)).count() == 7
    assert revisits.resolve(spark.createDataFrame([], RECORD)).count() == 0


def test_revisits_hot_url_over_partitions(spark):
    from datetime import datetime, timedelta

    rows = [(str(i), "http://h/", datetime(2024, 1, 1) + timedelta(minutes=i), "response" if i % 50 == 0 else "revisit", None, None, str(i), 1, None, "") for i in range(2000)]
    got = revisits.resolve(spark.createDataFrame(rows, RECORD).repartition(8)).collect()
    assert len(got) == 1960 and all(int(r["refers_to"]) == int(r["record_id"]) // 50 * 50 for r in got)


# 3


def brute_contamination(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = cut(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[s : s + 13]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for i, t in rows:
        w, hit, own = cut(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    own |= wins[k]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [decontaminate.MAX_WINDOWS, 9])
def test_decontamination(spark, docs, texts, block, monkeypatch):
    monkeypatch.setattr(decontaminate.matches, "__defaults__", (13, 3, block))
    items = [(1, " ".join(texts[12].split()[20:60])), (2, " ".join(texts[30].split()[70:80])), (None, "A, b: C"), (3, None), (4, ""), (1, "one"), (10, "ONE!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.judged(docs, bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_contamination(rows_of(docs), items)))
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in got)


def test_decontamination_empty(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["contaminated"] for r in decontaminate.judged(docs, none).collect()} == {False}
    assert decontaminate.judged(empty(spark), none).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha q q q q q beta gamma")], "doc_id bigint, text string")
    got = decontaminate.proximity(d, spark.createDataFrame([(7, "alpha beta gamma")], "item_id bigint, text string"), 5).collect()
    assert sorted((r["item_id"], r["doc_id"], r["at"]) for r in got) == [("7", 1, 0), ("7", 2, 0)]


def test_proximity_of_all_phrases(spark):
    d = spark.createDataFrame([(1, "alpha x beta"), (2, "gamma delta")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(7, "alpha beta"), (7, "delta gamma"), (None, "alpha"), (None, "delta"), (8, None)], "item_id bigint, text string")
    for block in (decontaminate.MAX_WINDOWS, 2):
        got = decontaminate.proximity(d, asked, 5, block).collect()
        assert sorted((r["item_id"], r["doc_id"], r["at"]) for r in got) == [("", 1, 0), ("", 2, 1), ("7", 1, 0), ("7", 2, 0)]


def test_wide_headers_keep_all_columns():
    from trialweave.sources import delimited

    assert len(delimited.header([f"c{i}" for i in range(5000)])) == 5000


# 4


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        k = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * k >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("small", [None, 0, 512])
def test_jaccard(spark, docs, small, monkeypatch):
    if small is not None:  # force one side of the heavy-light boundary
        monkeypatch.setattr(jaccard, "boundary", lambda _: small)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows_of(docs))))


def test_jaccard_chains_and_many_copies(spark):
    rng = random.Random(11)
    base, rows = words(rng, 80, 100000), []
    cur = list(base)
    for i in range(120):  # a drifting chain, and near copies of its start
        if i % 2:
            cur[rng.randrange(80)] = f"z{i}"
            rows.append((i, " ".join(cur)))
        else:
            w = list(base)
            w[rng.randrange(80)] = f"y{i % 8}"
            rows.append((i, " ".join(w)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_jaccard_empty_and_dedup(spark, docs):
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    want = {c for d, n, c in brute_components(rows_of(docs)) if d is not None}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == want


def test_dedup_leaves_one_row_a_group(spark):
    rng = random.Random(23)
    near = lambda base: " ".join([*base[:-1], f"edit{rng.randrange(10**6)}"])
    rows = []
    for ids in ([None, None, None], [None, 4, None], [7, 7, 7], [9, 8, None], [7, 7]):
        base = words(rng, 80, 100000)
        rows += [(i, near(base)) for i in ids]
    kept = [r["doc_id"] for r in jaccard.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    assert sorted(kept, key=repr) == sorted([None, 4, 7, 8, 7], key=repr)


# 5


def test_urls_rules_and_cases(spark):
    urls = ["http://a.example.net/en/1?x", "http://example.net/de/1", "https://Www.Example.COM/de/x#y", "x://example.com/dev", "http://q.org/fr/", "http://org/fr", "no scheme", None, "http://xnet/", "http://example.net", "http://h/1/2/3/4/5/6/7"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id bigint, url string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(pages, spark.createDataFrame([], "page_id bigint, bad int")).collect())
    assert got[0] == got[1] == (0, "a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2:7] == [(1, "example.net", "/de/1", "net/", "block"), (2, "www.example.com", "/de/x", "example.com/de/", "block"), (3, "example.com", "/dev", None, "allow"), (4, "q.org", "/fr/", "org/fr/", "allow"), (5, "org", "/fr", None, "allow")]
    assert got[7:11] == [(6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "xnet", "/", None, "allow"), (9, "example.net", "", None, "allow")]
    assert urlrules.judge(pages.limit(0), spark.createDataFrame([], "page_id bigint, bad int")).count() == 0


def test_urls_reject_impure_branch(spark):
    pages = [(i, f"http://h.example/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    labels = [(i, i % 2) for i in range(0, 120)]
    got = urlrules.judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in got)
    assert {r["template"] for r in got} == {"/spam/{n}", "/news/{n}"}


def test_urls_deep_branches_keep_their_own(spark):
    pages = [(i, f"http://h.example/2024/05/06/a/b/c/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    pages += [(1000, "http://h.example/" + "/".join(f"s{chr(97 + k % 26)}" for k in range(300)))]
    labels = [(i, i % 2) for i in range(0, 120)]
    got = {r["page_id"]: r for r in urlrules.judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad int")).collect()}
    assert all(got[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(200))
    assert {got[i]["template"][-9:] for i in range(200)} == {"/spam/{n}", "/news/{n}"}
    assert got[1000]["template"].count("/") == 300


# 6


def test_language(spark):
    rng = random.Random(3)
    stems = {"en": ["the", "th", "ing", "with", "er"], "de": ["sch", "ung", "der", "ein", "ß"], "fr": ["eau", "oux", "des", "é", "que"], "es": ["ción", "los", "ado", "ñ", "que"]}
    rows = [(i, " ".join("".join(rng.choices(stems[x], k=3)) for _ in range(40)), x, "s") for i, x in enumerate(rng.choices(list(stems), k=600))]
    rows += [(1000, None, "en", "s"), (1001, "12 — !", "en", "s"), (1002, "", None, "s"), (None, "the thing with", None, None), (5, rows[5][1], "en", "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("score", F.lit("clash"))
    got = language.identify(d, language.fit(d, sample=100)).withColumn("h", language.held_out()).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1000, 1001, 1002))
    test = [r for r in got if r["h"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(test) > 60 and sum(r["lang_pred"] == r["lang"] for r in test) >= 0.98 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.keep_identified(d).count() == len(rows) - 3
    none = d.where("false")
    assert language.fit(none) is None and language.identify(none, None).count() == 0
    assert {r["lang_pred"] for r in language.identify(d.select("doc_id", "text"), None).collect()} == {"und"}


def test_language_learns_every_language(spark):
    rng = random.Random(17)
    names = [f"x{k:02d}" for k in range(77)] + ["de", "en", "nl"]
    stems = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)] for x in names}
    rows = [(i, " ".join("".join(rng.choices(stems[x], k=3)) for _ in range(40)), x) for i, x in enumerate(names * 15)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.identify(d, language.fit(d, sample=100)).withColumn("h", language.held_out()).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} == set(names)
    test = [r for r in got if r["h"]]
    assert len(test) > 150 and sum(r["lang_pred"] == r["lang"] for r in test) >= 0.95 * len(test)


# 7


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\l<[]]", "", None, "é\n[INST user]", "<s>[INST assistant]\nx\n[/INST]</s>\n"]
    rng = random.Random(2)
    rows = [(c, k, rng.choice(["user", "assistant", "system", None, "we<ird]"]), rng.choice(nasty), "x") for c in (0, 1, 2, None) for k in range(7 if c else 300)]
    rows += [rows[3], (9, None, "user", "null turn", "x")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string").repartition(5)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(d)).collect()}
    assert set(got) == {0, 1, 2, 9, None}
    for c, r in got.items():
        mine = sorted(((t is not None, t or 0, role or "", text or "") for cc, t, role, text, _ in rows if cc == c))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in mine).encode()).hexdigest()
        loss = "".join(text for *_, role, text in mine if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.InstTemplate().render([(role, text) for *_, role, text in mine])) and not r["rewrites"]
    assert chat.read_back(chat.format_conversations(d.limit(0))).count() == 0


def test_chat_detects_rewritten_history():
    class Forgetful(chat.InstTemplate):
        def render(self, messages):
            return super().render([(r, t if i == len(messages) - 1 else t.upper()) for i, (r, t) in enumerate(messages)])

    assert [bad for _, bad in chat.spans(Forgetful().render, [], [("user", "a"), ("assistant", "b"), ("user", "c")])] == [False, True, True]


def test_chat_whole_prefixes_of_long_conversations(spark):
    class Dropping(chat.InstTemplate):
        """Turns older than 70 are dropped to a mark: history is rewritten beyond any chunk."""

        def render(self, messages):
            return super().render([(r, t if i >= len(messages) - 70 else "-") for i, (r, t) in enumerate(messages)])

    turns = [("assistant" if k % 2 else "user", f"text {k}") for k in range(150)]
    d = spark.createDataFrame([(c, k, r, t) for c in (1, None) for k, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = chat.format_conversations(d, Dropping()).collect()
    want = list(chat.spans(Dropping().render, [], turns))
    for c in (1, None):
        mine = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["seq"])
        assert [(r["piece"], r["rewrites"]) for r in mine] == want
        assert [r["start"] for r in mine] == [len(Dropping().render(turns[: k + 1])) - len(piece) for k, (piece, _) in enumerate(want)]
    assert sum(bad for _, bad in want) == 80


# 8


def test_vectors(spark):
    rng = np.random.RandomState(4)
    centres = rng.standard_normal((12, 64))
    rows = [(i, (centres[i % 12] + 0.12 * rng.standard_normal(64)).astype(np.float32).tolist(), i % 2) for i in range(600)]
    rows += [(600 + i, rows[7][1], rows[7][2]) for i in range(40)] + [rows[7]]
    rows += [(700, None, 1), (701, [0.0] * 64, 1), (702, [float("nan")] + [1.0] * 63, 1), (703, rows[0][1], None), (704, [None] + [1.0] * 63, 1), (705, [1.0, 2.0], 1), (706, [2.0, 4.0], 1), (None, rows[0][1], 0), (707, [], 1), (708, [float("inf")] * 64, 1)]
    got = vectors.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, m int").repartition(4)).collect()
    assert len(got) == len(rows)
    ok = [i for i, (v, e, lab) in enumerate(rows) if e and lab is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(ok, 2):
        if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                n[a] += 1
                n[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(least.get(root(i), v), v)
    want = [(v, n[i], least.get(root(i)), v is not None and v == least.get(root(i))) for i, (v, _, _) in enumerate(rows)]
    found = sorted(map(repr, ((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)))
    assert found == sorted(map(repr, want)) or sum(r["n_links"] for r in got) >= 0.97 * sum(n)
    assert sum(n) > 1000
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_vectors_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.RandomState(1)
    c = rng.standard_normal(32)
    rows = [(i, (c + 0.01 * rng.standard_normal(32)).tolist(), 1) for i in range(300)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)}


# 9

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def passes(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return k == "email" or (k == "ip" and all(int(p) <= 255 for p in m.split("."))) or (k == "card" and 12 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 9 <= len(d) <= 15)

    return sorted(((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(k, m[0])))


def test_privacy_base(spark):
    rng = random.Random(8)
    bits = ["a@b.co", "x.y+z@q-w.e.f", "@", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.3.255", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111", "+1 (555) 010-9999", "+49 30 123", "++12345678901", "12", "é𐍈", " ", "\n", ".", "-", "word", "0", "00000000000000000000", "_", "%"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(400)] + [None, "", "a" * 50000, "1" * 50000, "1." * 3000, "1 " * 5000, "+1" * 4000, "a@" * 4000]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a@b.co", 0), (0, texts[0], 0)], "doc_id bigint, text string, base int")
    for r in privacy.spans(d).join(d.withColumnRenamed("base", "b0"), "doc_id").collect():
        want = [(s, k, e) for s, k, e, _ in brute_spans(r["text"])]
        assert [(m["start"], m["k"], m["end"]) for m in r["base"]] == want, r["text"][:200]
    assert privacy.spans(d).count() == len(texts) + 2
    assert privacy.spans(d.limit(0)).count() == 0


def test_privacy_disclosing_terms(spark):
    rng = random.Random(1)
    common = ["lorem", "ipsum", "dolor", "amet"]
    rows = [(i, f"{rng.choice(common)} {rng.choice(common)} n{i}x") for i in range(200)]
    rows += [(1000 + i, f"contact zorblax at z@zor.org {common[i % 4]} line {i}\nsecond lorem") for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("terms", F.lit(1))
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(d).collect()}
    assert "zorblax" not in clean[1000] and "z@zor.org" not in clean[1000] and "[EMAIL]" in clean[1000]
    assert clean[1003].endswith("second lorem") and common[3] in clean[1003]
    assert all(clean[i] == t for i, t in rows[:200])
    assert privacy.sanitise(d).columns == d.columns


def test_privacy_terms_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary, secret = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)], ["zorblax", "quindle", "Ämter", "vexor"]
    texts = []
    for i in range(160):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 9))) for _ in range(rng.randrange(1, 5))]
        if i % 4 == 0:
            who = rng.randrange(4)
            lines[rng.randrange(len(lines))] += f" {secret[who]} mail{who}@x.org" + rng.choice(["", " +1 (555) 010-99" + str(who) * 2])
            lines.append(rng.choice([secret[who].upper(), rng.choice(secret[:3]), ""]))
        texts.append("\n".join(lines))
    texts += [texts[0]] * 5 + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    texts = [t or "" for t in texts]

    def clean(t):
        for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"\+[0-9][ ().0-9-]+[0-9]"):
            t = re.sub(p, " ", t)
        return {w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 3}

    entities = lambda t: {t[x[0] : x[2]].lower() for x in brute_spans(t)}
    worst = {}
    for contexts in ([x for t in texts for x in t.split("\n")], texts):
        N = len(contexts)
        n_t, n_e, n_te, kinds, e_kinds = Counter(), Counter(), Counter(), {}, {}
        for c in contexts:
            ts, es = clean(c), entities(c)
            n_t.update(ts), n_e.update(es)
            for e in es:
                e_kinds.setdefault(e, set()).add(c)
                for t in ts:
                    n_te[e, t] += 1
                    kinds.setdefault((e, t), set()).add(c)
        for (e, t), n in n_te.items():
            if len(kinds[e, t]) >= 3:
                ratio = math.log2(n * N / (n_t[t] * n_e[e])) / math.log2(N / n_e[e])
                worst[e, t] = max(ratio, worst.get((e, t), 0))
    want = {(i, m.start(), m.end(), max(worst.get((e, m[0].lower()), 0) for e in entities(t)) >= 0.95) for i, t in enumerate(texts) for m in re.finditer(r"[^\W\d_]+", t) if entities(t) and max(worst.get((e, m[0].lower()), 0) for e in entities(t)) >= 0.8}
    got = {(r["doc_id"], m["start"], m["end"], m["value"] == "") for r in privacy.spans(d, (privacy.LINE, privacy.DOCUMENT)).collect() for m in r["terms"]}
    assert got == want and len(want) > 40 and {x[3] for x in want} == {True, False}


def test_privacy_many_findings_in_one_text(spark):
    text = " ".join(f"user{i}@x{i}.org w{i}" for i in range(3000))
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert privacy.sanitise(d).first()["text"] == " ".join(f"[EMAIL] w{i}" for i in range(3000))


# 10


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 90)), rng.choice(["en", "de", None]), "big" if i % 3 else rng.choice(["a", "b"]), 0.5) for i in range(3000)]
    rows += [(None, None, None, None, 0.5), (5000, " \n", "en", "a", 0.5), rows[0]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, p double")
    got = mixing.sampled(d).collect()
    assert len(got) == len(rows)
    cells = {}
    for r in got:
        cells.setdefault((r["__source"], r["__lang"], r["__topic"]), [0, r["__weight"], r["__p"]])[0] += r["__n"]
    n = {k: v[0] for k, v in cells.items() if v[0]}
    total, dims = sum(n.values()), ("source", "lang", "topic")
    w = {k: float(v) for k, v in n.items()}
    targets = []
    for i, dim in enumerate(dims):
        sums = Counter()
        for k, v in n.items():
            sums[k[i]] += v
        share = {k: v ** mixing.TEMPER[dim] for k, v in sums.items()}
        targets.append({k: v / sum(share.values()) for k, v in share.items()})
    for _ in range(mixing.ROUNDS):
        for i in range(3):
            sums = Counter()
            for k, v in w.items():
                sums[k[i]] += v
            w = {k: v * targets[i][k[i]] / sums[k[i]] for k, v in w.items()}
    for k in n:
        assert abs(cells[k][1] - w[k] / sum(w.values())) < 1e-6
    expected = sum(n[k] * cells[k][2] for k in n)
    assert 0.4 * total < expected <= 0.51 * total
    held = sum(r["__n"] for r in got if r["__kept"])
    assert abs(held - expected) < 0.1 * total
    assert not any(r["__kept"] for r in got if not r["__n"])
    assert mixing.sample(d).columns == [*d.columns, "mix_p"]
    assert mixing.sampled(d.limit(0)).count() == 0
