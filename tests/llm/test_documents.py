"""Operators on documents against brute force, and their behaviour on odd rows."""

import random
import re
import time
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumentrail.llm import components, decontam, linededup, mixing, simhash, tokencount, toxicity
from lumentrail.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(3000)]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


ODD = [None, "", "   ", "\n", "one", "two words", "x" * 3000, "a b c " * 4000, "same text here", "same text here", "é ß 中 文字 😀", "tab\tand\x0bvt"]


def odd(spark):
    """Nulls in all columns, blank and long texts, repeated rows, and extra columns with names used inside."""
    rows = [(k, t, None, None, None, -k, "z", k) for k, t in enumerate(ODD)] + [(None, "no id", "en", "s", 5, 0, "z", 0), (None, "no id", "en", "s", 5, 0, "z", 0), (3, "third", "fr", "", 5, 1, "z", 1), (3, "third", "fr", "", 5, 1, "z", 1)]
    return spark.createDataFrame(rows, SCHEMA + ", __id long, __th string, c0 long")


def empty(spark):
    return odd(spark).where("false")


# --- words ---


def brute_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_spans_and_hashes():
    data, off = W.utf8(pa.array(ODD))
    starts, ends, first = W.spans(data, off)
    got = [[bytes(data[starts[i] : ends[i]]).decode() for i in range(first[k], first[k + 1])] for k in range(len(ODD))]
    assert got == [brute_words(t) for t in ODD]
    by = {}
    for h, s, e in zip(W.word_hashes(data, starts, ends), starts, ends, strict=True):
        assert by.setdefault(bytes(data[s:e]), h) == h
    assert len(set(by.values())) == len(by)


def test_xxh64():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(3000))
    start = np.array([rng.randrange(2000) for _ in range(400)])
    size = np.array([rng.choice([0, 1, 3, 4, 7, 8, 15, 31, 32, 33, 64, 100, 900]) for _ in range(400)])
    got = W.xxh64(np.frombuffer(raw, np.uint8), start, size, 42)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[s : s + n], 42) for s, n in zip(start, size, strict=True)]


# --- SimHash ---


def brute_fingerprint(t):
    w = brute_words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, fps):
    """Least id by merging all linked pairs."""
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, i in zip(group, items, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in group]


def near_copies(seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(40, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies() + ODD
    fps = [brute_fingerprint(t) for t in texts]
    want = {(i, f"{f:016x}", c) for i, f, c in zip(range(len(texts)), fps, brute_components(range(len(texts)), fps), strict=True)}
    got = {tuple(r) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == want
    assert len({c for *_, c in want}) < len(texts) - 10


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(3):
            fps.add(x ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))))
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 1), (7, 5), (9, 9), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 5: 1, 7: 1}
    assert components.components(edges.where("false")).count() == 0


def test_one_of_each_group_stays(spark):
    texts = near_copies(6)
    fps = [brute_fingerprint(t) for t in texts]
    kept = sorted(r.doc_id for r in simhash.keep_first(docs(spark, texts)).collect())
    assert kept == sorted(set(brute_components(range(len(texts)), fps)))
    out = simhash.keep_first(odd(spark))
    assert out.columns == odd(spark).columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert len(rows) == len(set(rows)) and sum(t is None or not t.strip() for _, t in rows) == 1
    assert (8, "same text here") in rows and (9, "same text here") not in rows and (None, "no id") in rows
    assert simhash.keep_first(empty(spark)).count() == 0 and simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.near_duplicates(odd(spark)).count() == odd(spark).count()


# --- winnowing ---


def brute_winnow(t, k, w):
    data, off = W.utf8(pa.array([t]))
    s, e, _ = W.spans(data, off)
    g = W.gram_hashes(W.word_hashes(data, s, e), k).tolist()
    return {i + j for i in range(max(1, len(g) - w + 1)) for j, x in enumerate(g[i : i + w]) if x == min(g[i : i + w])}


def test_winnowing():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 4, 5, 8, 9, 12, 60]))) for _ in range(120)]
    data, off = W.utf8(pa.array(texts))
    s, e, first = W.spans(data, off)
    at, _ = linededup.winnow(W.word_hashes(data, s, e), first, 5, 4)
    row = np.searchsorted(first, at, "right") - 1
    got = {}
    for r, p in zip(row.tolist(), (at - first[row]).tolist(), strict=True):
        got.setdefault(r, set()).add(p)
    for i, t in enumerate(texts):
        assert got.get(i, set()) == brute_winnow(t, 5, 4)


def brute_repeats(texts, n):
    """Per text which words lie in an n-word run that occurred before, in order of texts and positions."""
    seen, out = set(), []
    for t in texts:
        w = brute_words(t)
        gone = [False] * len(w)
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        for i, g in enumerate(grams):
            if g in seen:
                gone[i : i + n] = [True] * n
            seen.add(g)
        out.append(gone)
    return out


def passages(seed=4):
    rng = random.Random(seed)
    fresh = lambda n: [rng.choice(WORDS) + rng.choice("abcdefghij") for _ in range(n)]
    shared = [fresh(n) for n in (51, 60, 130, 20, 31)]
    texts = []
    for k in range(60):
        w = fresh(rng.randrange(5, 60))
        for _ in range(rng.randrange(3)):
            w += shared[rng.randrange(5)] + fresh(rng.randrange(1, 60))
        texts.append("".join(x + rng.choice(["\n", "  "] + [" "] * 6) for x in w).strip())
    cycle = " ".join(fresh(20) * 12)
    return texts + [texts[7], cycle, None, ""]


def test_winnowing_many_texts_holds_little_memory():
    rng = random.Random(4)
    col = pa.array([" ".join(rng.choices(WORDS, k=500)) for _ in range(2000)])
    tracemalloc.start()
    found = [winnowed for _, _, data, off in W.blocks(*W.utf8(col)) for starts, ends, first in [W.spans(data, off)] for winnowed in linededup.winnow(W.word_hashes(data, starts, ends), first)[:1]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, found)) > 2000 and peak < 30e6


def test_repeats_go_and_first_occurrences_stay(spark):
    texts = passages()
    out = {r.doc_id: (r.text, r.n) for r in linededup.delete_repeats(docs(spark, texts), removed_col="n").collect()}
    must, may = brute_repeats(texts, 51), brute_repeats(texts, 32)
    hit = 0
    for i, t in enumerate(texts):
        left, n = brute_words(out[i][0]), out[i][1]
        words = brute_words(t)
        assert len(words) - len(left) == n
        assert sum(must[i]) <= n <= sum(may[i])
        it = iter(left)
        assert all(any(x == y for y in it) for x in [w for w, m in zip(words, may[i], strict=True) if not m])
        if not n:
            assert out[i][0] == t
        hit += n > 0
    assert hit >= 15 and not brute_words(out[60][0])


def test_repeats_on_odd_rows(spark):
    out = linededup.delete_repeats(odd(spark))
    assert out.columns == odd(spark).columns and out.count() == odd(spark).count()
    by = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert by[0] is None and by[8] == by[9] == "same text here" and brute_words(by[7]) == ["a", "b", "c"] * 11 or len(brute_words(by[7])) < 60
    assert linededup.delete_repeats(empty(spark)).count() == 0


# --- decontamination ---


def semi_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, x in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != x)))
        prev = cur
    return min(prev)


def test_matches_equal_edit_distance():
    rng = random.Random(1)
    for _ in range(150):
        p = decontam.normalize("".join(rng.choice("abc ") for _ in range(rng.randrange(20, 90))))
        q = list(p)
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(q))
            q[i : i + rng.randrange(2)] = rng.choice(["", "a", "d"])
        t = decontam.normalize("".join(rng.choice("abcd ") for _ in range(80)) + "".join(q) + " abc")
        budget = int(decontam.RATE * len(p))
        got = decontam.Matcher([(7, p)]).find(t)
        if len(p) < decontam.SHORT:
            assert got == ({7: 0} if f" {p} " in f" {t} " else {})
        else:
            want = semi_distance(p, t)
            assert got == ({7: want} if want <= budget else {})


def test_contaminated_rows_and_clean_ones(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    texts = [f"start {item.upper()} end", f"x {item.replace('lazy', 'crazy')}\nx", "nothing to see here", item[:40], None]
    bench = spark.createDataFrame([(1, item, 5), (1, item, 5), (2, None, 5), (None, "", 5), (3, "short", 5)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(0, 1, 0), (1, 1, 2)}
    assert sorted(r.doc_id for r in decontam.clean(docs(spark, texts), bench).collect()) == [2, 3, 4]
    assert decontam.clean(odd(spark), bench).count() == odd(spark).count()
    assert decontam.clean(odd(spark), bench.where("false")).columns == odd(spark).columns
    assert decontam.contaminated(empty(spark), bench).count() == 0


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PASS_CHARS", 100)
    items = [" ".join(random.Random(i).choice(WORDS) for _ in range(12)) for i in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, [f"a {t} b" for t in items]), bench).collect()}
    assert got == {(i, i) for i in range(20)}


# --- tokens ---


def test_tokens_equal_the_library(spark):
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    ref = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    bits = ["'s", "'re", "'ll", "'", "t", "s", "l", " ", "  ", "\n", "\t", " ", "　", "é", "ß", "中", "1", "½", "!", "<|endoftext|>", "<|endof", "😀", "́", "\x85", "\x1c", "don't", "-", "\r\n", "hello world", "Ⅷ"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500)] + ["=" * 5000, "\n" * 700 + "z", " " * 3000, "ab" * 2000]
    got = {r.doc_id: r for r in tokencount.token_counts(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(ref.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), repr(t)
    assert tokencount.token_counts(empty(spark), path).count() == 0
    assert tokencount.token_counts(odd(spark), path).count() == odd(spark).count()


def test_ranks_count_like_their_library():
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    import base64

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for t in ODD]
    assert tokencount.count_tokens(*W.utf8(pa.array(texts)), path).tolist() == [len(enc.encode_ordinary(t)) for t in texts]


def test_a_small_table_of_states_changes_nothing(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randrange(1, 9))) for _ in range(200)) for _ in range(20)]
    path = P.path("byte_bpe_50k.json")
    want = tokencount.count_tokens(*W.utf8(pa.array(texts)), path)
    monkeypatch.setattr(tokencount, "MOST_STATES", 50)
    assert (tokencount.count_tokens(*W.utf8(pa.array(texts)), path) == want).all()
    with pytest.raises(ValueError):
        tokencount.load(P.path("word_bpe_49k.json"))


# --- mixing ---


def water(sizes, weights):
    total, t = 1.5 * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        rest = total - sum(t[i] for i in range(len(sizes)) if i not in free)
        for i in free:
            t[i] = rest * weights[i] / sum(weights[j] for j in free)
        over = {i for i in free if t[i] > 2 * sizes[i]}
        for i in over:
            t[i] = 2.0 * sizes[i]
        free -= over
        if not over:
            break
    return t


@pytest.mark.parametrize("sizes", [[10, 100, 50, 7, 0, 1000], [5], [1, 1, 1, 1], [0, 0], [100, 1, 1, 1]])
def test_targets_fill_like_water(spark, sizes):
    df = spark.createDataFrame([(f"s{i}" if i < 5 else None, s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy(F.col("source").isNull(), "source").collect()]
    assert got == pytest.approx(water(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_fit_is_near_the_budget():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = np.unique(rng.integers(1, rng.choice([5, 300, 20000]), rng.integers(1, 60))).astype(np.int64)
        counts = rng.integers(1, rng.choice([2, 50, 3000]), len(sizes)).astype(np.int64)
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        take = mixing.fit(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((sizes * take).sum()) - budget) <= sizes.max() // 2 + 1


def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(100):
        sizes = np.unique(rng.integers(1, 40, 4)).astype(np.int64)
        free = rng.integers(0, 4, len(sizes)).astype(np.int64)
        room = int(rng.integers(1, 120))
        sums = {0}
        for s, n in zip(sizes, free, strict=True):
            sums = {a + k * s for a in sums for k in range(n + 1)}
        add = mixing._knapsack(sizes, free, room)
        assert (add <= free).all() and (sizes * add).sum() == max(x for x in sums if x <= room)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)  # several hash ranges even here
    rng = random.Random(8)
    texts = [" ".join(["w"] * rng.choice([1, 2, 3, 50, 400])) for _ in range(600)] + [None, ""]
    df = docs(spark, texts)
    a = mixing.mix(df).collect()
    assert {(r.doc_id, r.taken) for r in a} == {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert len(a) == len(texts) and all(r.size == len(brute_words(texts[r.doc_id])) and r.taken in (0, r.size, 2 * r.size) for r in a)
    for s in {r.source for r in a}:
        mine = [r for r in a if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and mine[0].source_size == sum(r.size for r in mine)
    assert mixing.mix(odd(spark)).count() == odd(spark).count() and mixing.mix(empty(spark)).count() == 0


# --- toxicity ---


def toxic_corpus(n=900, seed=2):
    rng = random.Random(seed)
    syl = ["ra", "to", "mi", "ne", "sa", "lo", "ku", "pe"]
    word = lambda k: "".join(rng.choice(syl) for _ in range(k))
    bad = ["grobian", "schuft", "vilain"]
    out = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        w = [word(rng.randrange(1, 4)) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 5) if y else 0):
            w[rng.randrange(len(w))] = rng.choice(bad) + word(1)
        out.append((" ".join(w), y))
    return out


def test_held_out_accuracy(spark):
    rows = toxic_corpus()
    df = docs(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(None, 0, 1), (3, 0, None), (5, 0, 7), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    right = [r.predicted == rows[r.doc_id][1] for r in out]
    assert len(out) > 100 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = {r.doc_id for r in toxicity.accepted(df, model).collect()}
    assert kept == {r.doc_id for r in got if not r.rejected}
    same = toxicity.score(df.withColumn("lang", F.lit("xx")).withColumn("doc_id", -F.col("doc_id")), model).collect()
    assert Counter(round(r.score, 12) for r in same) == Counter(round(r.score, 12) for r in got)
    assert toxicity.score(odd(spark), model).count() == odd(spark).count() and toxicity.accepted(empty(spark), model).count() == 0
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), labels)).count() == 0


def test_training_takes_every_label(spark):
    """One insult stands only in those 3,000 of 10,000 toxic documents that the 5,000 of least hash don't reach."""
    rng = random.Random(5)
    late = [r.id for r in spark.range(10_000).orderBy(F.xxhash64("id")).collect()][7000:]
    plain = [f"{a}{b}" for a in ("ra", "to", "mi", "ne", "sa") for b in ("lo", "ku", "pe", "du", "vi")]
    insult = dict.fromkeys(range(10_000), "grobian") | dict.fromkeys(late, "schuft")
    rows = [(" ".join([*rng.choices(plain, k=6), insult[i]]) if i in insult else " ".join(rng.choices(plain, k=7)), int(i in insult)) for i in range(12_000)]
    df = docs(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.train(df, labels)).collect() if r.held_out}
    caught = [got[i].predicted for i in late if i in got]
    assert len(caught) > 500 and np.mean(caught) > 0.99
    assert np.mean([r.predicted == rows[i][1] for i, r in got.items()]) > 0.99


def test_shards_hold_every_label_and_reruns_agree(spark, monkeypatch):
    rows = toxic_corpus(1500)
    df = docs(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SHARD", 400)
    data, shards = toxicity._labelled(df, labels, "doc_id", "text", "lang", "toxic")
    told = [i for i in range(len(rows)) if crc32(str(i).encode()) % 5]
    assert shards == data.rdd.getNumPartitions() == -(-len(told) // 400)
    assert Counter(r.y for r in data.collect()) == Counter(rows[i][1] for i in told)
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert np.mean([r.predicted == rows[r.doc_id][1] for r in got if r.held_out]) > 0.95
    assert toxicity.score(df, toxicity.train(df, labels)).collect() == got


def test_the_pool_equals_a_loop():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(toxicity.PRODUCTS, 30)).astype(np.float32)
    table[:, 0] = 0
    parts = [list(rng.integers(1, 30, n)) for n in (0, 1, 2, 5, 40)]
    bias = rng.normal(size=len(toxicity.ROWS)).astype(np.float32)
    got, where = toxicity.pool(table, *toxicity.lay_out(parts, 0), bias, places=True)
    for i, p in enumerate(parts):
        padded = p + [0] * toxicity.GAP * 2
        for f, rows in enumerate(toxicity.ROWS):
            r = [sum(table[row, padded[k + o]] for o, row in enumerate(rows)) for k in range(len(p) + 1)]
            assert got[i, f] == pytest.approx(max(0, max(r) + bias[f]), abs=1e-5)


def test_hashed_words_are_those_of_the_pattern():
    texts = [(t or "").lower() for t in ODD] + ["", "".join(map(chr, [*range(0x100), *range(0x370, 0x3000), 0xFF21, 0x1F600, 0x20000, 0x10FFFF])).lower(), "snake_case x2y ½ ² a", ""]
    pieces, first = toxicity.hashed(texts)
    assert np.diff(first).tolist() == [len(toxicity.words_of(t)) for t in texts]
    words = [w for t in texts for w in toxicity.words_of(t)]
    for i, n in enumerate((99, *toxicity.BEGINNINGS)):
        by = {}
        for w, bucket in zip(words, pieces[:, i].tolist(), strict=True):
            assert by.setdefault(w[:n], bucket) == bucket
            assert (bucket == toxicity.BUCKETS) == (n < 99 and len(w) < n)
    assert len({*map(tuple, pieces.tolist())}) > 0.99 * len(set(words))
    assert toxicity.hashed([])[0].shape == (0, pieces.shape[1]) and toxicity.hashed([])[1].tolist() == [0]


def test_scoring_rare_words_is_quick_and_keeps_none():
    """Most words of a large corpus are rare, as are these: 400,000 words, hardly one of them twice."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=7)) for _ in range(400)) for _ in range(1000)]
    scorer = toxicity.Scorer(toxicity.Learner(10, 5).model)
    scorer.score(texts[:100])

    def seconds(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    assert min(seconds(lambda: scorer.score(texts)) for _ in range(3)) < 3 * min(seconds(lambda: [toxicity.words_of(t) for t in texts]) for _ in range(3))
    tracemalloc.start()
    scorer.score(texts)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1e6 and peak < 40e6


def test_long_texts_are_scored_in_parts(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(1, 9))) for _ in range(n)) for n in (0, 1, 2, 7, 300, 40, 999, 3)]
    model = toxicity.Learner(10, 5).model
    whole = toxicity.Scorer(model).score(texts)
    pieces, first = toxicity.hashed(texts)
    flat, at = toxicity.lay_out([np.arange(a, b) for a, b in zip(first[:-1], first[1:], strict=True)], len(pieces))
    padded = np.vstack([pieces, np.full((1, pieces.shape[1]), toxicity.BUCKETS, np.uint16)])[flat]
    pooled, where = toxicity.respond(model, padded, at, places=True)
    for step in (1, 2, 10, 64):
        monkeypatch.setattr(toxicity, "STEP", step)
        assert (toxicity.hashed(texts)[0] == pieces).all()
        assert toxicity.Scorer(model).score(texts) == pytest.approx(whole, abs=1e-6)
        got, there = toxicity.respond(model, padded, at, places=True)
        assert got == pytest.approx(pooled, abs=1e-5) and (there == where)[got > 0].mean() > 0.99
    monkeypatch.undo()
    long = " ".join(rng.choices(WORDS, k=100)) + " " + "many words of one text " * 400_000
    tracemalloc.start()
    toxicity.Scorer(model).score([long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(long)
