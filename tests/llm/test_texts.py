"""SimHash, substring dedup, language model, tokens: against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyfuse.llm import bpe, components, ctw, simhash, substrings
from skyfuse.llm.rolling import LOWER, Words, normal


def words_of(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


def key(r):
    return tuple((v is None, str(v)) for v in r)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


# rolling hashes


def test_window_hashes_tell_windows_apart(texts):
    normals = [normal((t or "").encode()) for t in texts[:70]]
    w = Words(normals)
    assert w.counts().tolist() == [len(x.split()) for x in normals]
    first, h = w.hashes(5)
    by_hash, n = {}, 0
    flat = [(d, x) for d, t in enumerate(normals) for x in t.split()]
    for i, x in zip(first.tolist(), h.tolist(), strict=True):
        seq = tuple(v for _, v in flat[i : i + 5])
        assert by_hash.setdefault(x, seq) == seq
        n += 1
    assert n == sum(max(0, len(x.split()) - 4) for x in normals) and len(set(by_hash.values())) == len(by_hash)


# components


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 150), (120, 150), (100, 199), (300, 301)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and {got[i] for i in (100, 120, 150, 199)} == {100} and got[301] == 300
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def plain_fingerprint(text):
    w = words_of(text, True)
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """pairs: (id, fingerprint)."""
    prints = sorted({f for _, f in pairs})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f, least.get(find(f))) for i, f in pairs]


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_simhash(docs, rows, none, crowded):
    want = sorted(((i, signed(f), c) for i, f, c in plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])), key=key)
    got = simhash.simhash_dedup(docs)
    assert collected(got, "doc_id", "fp", "component_id") == want
    assert collected(simhash.simhash_dedup(crowded), "doc_id", "fp", "component_id") == want
    assert simhash.simhash_dedup(none).count() == 0


@pytest.mark.parametrize("m", [2, 3, 4])
def test_hamming_links_lose_nothing(spark, m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for f in base.tolist():
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            prints.add(f ^ sum(1 << int(b) for b in flips))
    prints |= {7, 7 ^ (1 << 63), 0}
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.hamming_links(df, m=m).collect()}
    own = sorted(prints)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(own) for b in own[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert got == want


def test_thresholds_add_up_and_cost_least():
    rng = np.random.default_rng(1)
    costs = [np.cumsum(rng.random((50, 4)), axis=1) for _ in range(3)]
    got = simhash.allocate(costs, 2)
    assert (got.sum(1) == 0).all()
    for q in range(50):
        best = min(sum(costs[i][q, t + 1] for i, t in enumerate(c)) for c in [(a, b, -a - b) for a in range(-1, 3) for b in range(-1, 3) if -1 <= -a - b <= 2])
        assert sum(costs[i][q, got[q, i] + 1] for i in range(3)) == pytest.approx(best)


def test_one_of_each(docs, rows):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in plain_components([(r[0], plain_fingerprint(r[1])) for r in rows]) if i is not None and i == c}
    got = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(got) == sorted(want)


# substrings


def plain_removal(rows, window):
    own = [words_of(r[1]) for r in rows]
    count = Counter(tuple(w[i : i + window]) for w in own for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, own, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("window", [3, 35])
def test_substrings(docs, rows, none, crowded, window):
    def digest(df):
        cut = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
        return collected(df.select("doc_id", "n_words", cut.alias("n"), F.sha2("kept_text", 256).alias("h")), "doc_id", "n_words", "n", "h")

    assert digest(substrings.substring_dedup(docs, window)) == plain_removal(rows, window)
    assert digest(substrings.substring_dedup(crowded, window)) == plain_removal(rows, window)
    assert substrings.substring_dedup(none, window).count() == 0


def test_unlike_windows_of_equal_rolling_hashes_stay(spark, monkeypatch):
    a = "".join("ab"[k.bit_count() & 1] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(34))
    texts = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{rest} {a}"), (4, f"{rest} {a} x")]
    spread = [" ".join((a if k else b)[i : i + 60] for i in range(0, 2040, 60)) for k in (0, 1)]  # the same, over many short words
    texts += [(5, f"{spread[0]} end"), (6, f"{spread[1]} end")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    first = [Words([t.encode()]).hashes(35)[1][0] for _, t in texts[:2]]
    assert first[0] == first[1]
    got = {r["doc_id"]: sum(x["end"] - x["start"] for x in r["removed"]) for r in substrings.substring_dedup(df).collect()}
    assert got == {1: 0, 2: 0, 3: 35, 4: 35, 5: 0, 6: 0}


@pytest.mark.parametrize("window", [1, 2, 7, 35, 64])
def test_window_hashes_do_not_depend_on_the_place(window):
    import random

    rng = random.Random(window)
    words = [rng.choice(["a", "b", "cc", "d" * 40]) for _ in range(400)]
    text = " ".join(words).encode()
    high, low = Words([b"x y z", text, b"", text[2:]]).windows(window)
    whole = [w for t in (b"x y z", text, b"", text[2:]) for w in [t.split()]]
    seqs = [tuple(w[i : i + window]) for w in whole for i in range(len(w) - window + 1)]
    assert len(seqs) == len(high)
    for h in (high, low):
        by = {}
        for s, x in zip(seqs, h.tolist(), strict=True):
            assert by.setdefault(s, x) == x
        assert len(set(by.values())) == len(by)


def test_wide_hashes_and_many_buckets(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET", 100)
    monkeypatch.setattr(substrings, "PART", 3000)
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    got = substrings.substring_dedup(docs, 5).select("doc_id", "n_words", cut.alias("n"), F.sha2("kept_text", 256).alias("h"))
    assert collected(got, "doc_id", "n_words", "n", "h") == plain_removal(rows, 5)


def test_removal_intervals_are_maximal(docs):
    for r in substrings.substring_dedup(docs).collect():
        for a, b in zip(r["removed"], r["removed"][1:], strict=False):
            assert a["end"] < b["start"]


# language model


def training(rows):
    return [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]


def test_base_scores(docs, rows, none, crowded):
    counts = Counter()
    for r in training(rows):
        counts.update(words_of(r[1], True))
        counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        tokens = [*words_of(r[1], True), "end"]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        want.append((r[0], len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 5)))
    for df in (docs, crowded):
        got = ctw.score_texts(df, df.where(~ctw.in_fold()))
        found = collected(got.withColumn("base_score", F.round("base_score", 5)), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score")
        assert [x[:4] for x in found] == [x[:4] for x in sorted(want, key=key)]
        np.testing.assert_allclose([x[4] for x in found], [x[4] for x in sorted(want, key=key)], atol=2e-4)
    assert ctw.score_texts(none, none).count() == 0
    assert ctw.score_texts(docs, none).where("n_known > 0").count() == 0


def direct_score(train, text, depth, nodes):
    """The mixture by its definition, decision by decision, from plain counts."""
    runs = Counter()
    for t in train:
        data = b"\n" * depth + t + b"\n"
        for i in range(depth, len(data)):
            runs[data[i - depth : i + 1]] += 1
    known = sorted({r[-1] for r in runs})
    width = ctw.width_for(len(known))
    bits = width.bit_length() - 1
    at = {b: i for i, b in enumerate(known)}
    after = {}
    for r, n in runs.items():
        for d in range(depth + 1):
            after.setdefault(r[depth - d : depth], Counter())[at[r[-1]]] += n
    order = sorted(after, key=lambda c: (-sum(after[c].values()), len(c), int.from_bytes(c, "big") - (1 << 64 if len(c) == 8 and c[0] > 127 else 0)))
    kept = set(order[:nodes])

    def split(counter, k, prefix):
        a = sum(n for s, n in counter.items() if s >> (bits - k) == prefix and not s >> (bits - k - 1) & 1)
        return a, sum(n for s, n in counter.items() if s >> (bits - k) == prefix) - a

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    children = {c: [x for x in kept if len(x) == len(c) + 1 and x[1:] == c] for c in kept}
    rest = {c: after[c] - sum((after[x] for x in children[c]), Counter()) for c in kept}

    def weighted(c, k, prefix):
        own = kt(*split(after[c], k, prefix))
        if len(c) == depth:
            return own
        below = kt(*split(rest[c], k, prefix)) + sum(weighted(x, k, prefix) for x in children[c])
        return math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))

    def one(path, k, prefix):
        c = path[0]
        a, b = split(after[c], k, prefix)
        p = (b + 0.5) / (a + b + 1)
        if len(c) == depth:
            return p
        stop = math.exp(math.log(0.5) + kt(a, b) - weighted(c, k, prefix))
        if len(path) > 1:
            return stop * p + (1 - stop) * one(path[1:], k, prefix)
        a, b = split(rest[c], k, prefix)
        return stop * p + (1 - stop) * (b + 0.5) / (a + b + 1)

    data, total = b"\n" * depth + text + b"\n", 0.0
    for i in range(depth, len(data)):
        path = []
        for d in range(depth + 1):
            c = data[i - d : i]
            if c not in kept:
                break
            path.append(c)
        others = [b for b in range(256) if b not in at]
        free = width - len(known)
        s = at[data[i]] if data[i] in at else len(known) + others.index(data[i]) % free
        for k in range(bits):
            p = one(path, k, s >> (bits - k))
            total += math.log10(p if s >> (bits - k - 1) & 1 else 1 - p)
        if data[i] not in at:
            total -= math.log10(sum(others.index(b) % free == s - len(known) for b in others))
    return total


def test_tree_scores_by_definition(spark):
    train = [b"abab abba", b"", b"aab abab", b"ba"]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(train)], "doc_id long, text string")
    tests = ["abab", "", "b", "zz ab", "ABBA  abab"]
    ask = spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "doc_id long, text string")
    for depth, nodes in ((2, 1000), (3, 9)):
        got = {r["doc_id"]: r["score"] for r in ctw.score_texts(ask, df, depth, nodes).collect()}
        for i, t in enumerate(tests):
            assert got[i] == pytest.approx(direct_score(train, normal(t.encode(), True), depth, nodes), abs=1e-4), (depth, t)


def test_the_most_frequent_keys_fit_the_room(spark):
    import random

    rng = random.Random(6)
    counts = [rng.choice([1, 1, 1, 2, 3, 4, 7, 8, 31, 32, 33, 1000, 70_000, 70_001, 1 << 30]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(counts)), "key long, n long")
    for room in (0, 1, 20, 60, 100, 250, 299, 300, 1000):
        total, keys, least = ctw._most_frequent(df, room)
        assert (total, keys) == (sum(counts), 300) and sum(n >= least for n in counts) <= room
        lower = max((n for n in counts if n < least), default=0)
        assert not lower or lower >= 1 << 17 or 70_000 <= lower < 1 << 17 or sum(n >= lower for n in counts) > room
    assert ctw._most_frequent(df.limit(0), 5) == (0, 0, 1)


@pytest.mark.parametrize("runs", [1 << 21, 4, 0])
def test_every_context_is_a_node(spark, monkeypatch, runs):
    monkeypatch.setattr(ctw, "RUNS", runs)
    monkeypatch.setattr(ctw, "CHUNK", 5)
    train = [b"abab abba", b"", b"aab abab", b"ba", b"abab abba cab"]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(train)], "doc_id long, text string")
    tests = ["abab", "", "b", "zz ab", "ABBA  abab", "cab zzz cab"]
    ask = spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "doc_id long, text string")
    for depth in (1, 5):
        got = {r["doc_id"]: r["score"] for r in ctw.score_texts(ask, df, depth).collect()}
        for i, t in enumerate(tests):
            assert got[i] == pytest.approx(direct_score(train, normal(t.encode(), True), depth, 1 << 30), abs=1e-4), (depth, t)


@pytest.mark.parametrize("root", [1, 3])
def test_crowded_contexts_are_worked_out_by_parts(monkeypatch, root):
    import pyarrow as pa

    rng, depth = np.random.default_rng(14), 5
    buf = rng.choice(np.frombuffer(b"aab \n", np.uint8), 4000)
    key, n = np.unique(ctw.codes(buf, depth), return_counts=True)
    n[::7] = 0  # asked for, not met in training
    of = key >> np.uint64(8) & np.uint64((1 << (8 * root)) - 1)
    order = np.argsort(of, kind="stable")
    batches = [pa.record_batch([pa.array(key[order][i : i + 300].view(np.int64)), pa.array(n[order][i : i + 300])], ["key", "n"]) for i in range(0, len(key), 300)]
    symbol, share = ctw.symbols(np.unique(buf), 8)

    class Held:
        value = [(np.arange(3, dtype=np.uint64), np.full(3, 0.1), np.full(3, 0.8))]

    found = []
    for chunk in (1 << 17, 40, 3):
        monkeypatch.setattr(ctw, "CHUNK", chunk)
        up = pa.Table.from_batches(list(ctw._raise(depth, root, symbol, 3)(iter(batches)))).to_pandas().sort_values("item")
        parts = list(ctw._lower(depth, root, symbol, share, 3, Held)(iter(batches)))
        found.append((up, pa.Table.from_batches(parts).to_pandas().sort_values("key"), len(parts)))
    for up, down, _ in found[1:]:
        assert up["item"].tolist() == found[0][0]["item"].tolist() and np.allclose(up[["a", "b", "weighted"]], found[0][0][["a", "b", "weighted"]])
        assert down["key"].tolist() == found[0][1]["key"].tolist() and np.allclose(down["log"], found[0][1]["log"], atol=1e-9)
    assert found[0][2] < found[2][2]


def test_no_context_is_cut_from_a_large_tree(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(500)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")  # about 100,000 contexts
    got, whole = ({r["doc_id"]: r["score"] for r in ctw.score_texts(df, df, 6, *n).collect()} for n in ((), (1 << 30,)))
    assert got == pytest.approx(whole, abs=0.05)


def test_tree_is_a_distribution(spark):
    df = spark.createDataFrame([(1, "the thing there")], "doc_id long, text string")
    grams = df.mapInArrow(ctw._counts(2), "kind int, key long, n long").where("kind = 1").select("key", "n")
    tree = ctw.grow(grams, 2)
    for context in (b"th", b"e ", b"zz", b"\n\n"):
        code = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** tree.score(code)).sum() == pytest.approx(1.0, abs=1e-4)


def test_longer_contexts_tell_more(spark, sf):
    from skyfuse.session import table

    docs = table(spark, sf, "documents")
    scores = []
    for depth in (1, 4):
        held = ctw.score_texts(docs, docs.where(~ctw.in_fold()), depth).where(ctw.in_fold())
        scores.append(held.agg(F.sum("score")).head()[0])
    size = docs.where(ctw.in_fold()).agg(F.sum(F.octet_length("text"))).head()[0]
    assert scores[1] > 1.05 * scores[0] > 2 * size * math.log10(1 / 256)


# tokens


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as vocabularies
    import tiktoken

    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    return path, vocabularies.PATTERN, tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_tokens_are_those_of_the_library(docs, rows, none, crowded, vocabulary):
    path, pattern, library = vocabulary
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), np.array(ids, "<u4").tobytes(), (r[1] or "").encode()))
    for df in (docs, crowded):
        got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.encode(df, path, pattern).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe.encode(none, path, pattern).count() == 0


def test_appends_and_edits(vocabulary):
    import random

    v = bpe.Vocabulary(bpe.read_ranks(vocabulary[0]))
    rng = random.Random(2)
    fresh = lambda n: bytes(rng.choice(b"aethniores ,.AZ019\xc3\xa9") for _ in range(n))
    for _ in range(40):
        t = bpe.PrefixTable(v, fresh(rng.randint(0, 60)))
        for _ in range(4):
            i = rng.randint(0, len(t.data))
            j = min(len(t.data), i + rng.randint(0, 3))
            t.replace(i, j, fresh(rng.randint(0, 4)))
            t.append(fresh(rng.randint(0, 3)))
            assert t.last == bpe.PrefixTable(v, t.data).last
            assert [v.bytes_of[x] for x in t.ids()] == v.merged(t.data)
    long = bpe.PrefixTable(v, b"the thing " * 200)
    assert long.replace(5, 6, b"x") < 200


def test_token_pairs_stay_apart_as_merging_says(vocabulary):
    import random

    v = bpe.Vocabulary(bpe.read_ranks(vocabulary[0]))
    rng, ranks = random.Random(3), list(v.halves)
    for _ in range(20_000):
        a, b = rng.choice(ranks), rng.choice(ranks)
        assert v.stay_apart(a, b) == (v.merged(v.bytes_of[a] + v.bytes_of[b]) == [v.bytes_of[a], v.bytes_of[b]])


def test_caches_give_way(vocabulary, texts, monkeypatch):
    path, pattern, library = vocabulary
    monkeypatch.setattr(bpe, "GENERATION", 50)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 40)
    monkeypatch.setattr(bpe, "BATCH", 7)
    encoder = bpe.Encoder(bpe.read_ranks(path), pattern)
    for t in texts:
        assert np.frombuffer(encoder.encode(t or ""), "<u4").tolist() == library.encode_ordinary(t or "")


def test_a_run_without_a_break_takes_linear_time(vocabulary):
    import random
    import time

    path, pattern, library = vocabulary
    encoder, rng = bpe.Encoder(bpe.read_ranks(path), pattern), random.Random(4)
    run = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_000_000))
    began = time.process_time()
    ids = np.frombuffer(encoder.encode(run), "<u4").tolist()
    assert time.process_time() - began < 60
    assert encoder.decode(np.array(ids, "<u4").tobytes()) == run.encode() and len(encoder) < 10
    few = run[:3000]
    assert np.frombuffer(encoder.encode(few), "<u4").tolist() == library.encode_ordinary(few)
