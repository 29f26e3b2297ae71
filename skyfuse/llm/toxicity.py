"""Toxicity by a learned lexicon that also catches misspelled terms.

Terms are whole words and word beginnings that labelled toxic documents hold
far more often than others. A Levenshtein automaton of one edit, intersected
with the trie of the terms and made deterministic step by step as words come,
finds terms and their misspellings. Around each hit a window of words tells
quotation (quotation marks, words of reporting) from abuse (other hits close
by). A logistic regression on a document's hits gives its score."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skyfuse.llm.common import materialize, ship, table, text_slices

LABELLED_ROWS = 20_000  # about so many labelled rows at most are learned from, chosen by their ids' hash
PREFIXES = range(3, 10)
EDIT_FROM = {True: 4, False: 5}  # letters from which whole words, and beginnings of words, may have an edit
WINDOW = 8
MEMO = 150_000
QUOTES = "\"'“”„‘’«»‹›`"
STRIPPED = "".join(map(chr, range(33, 127)))
STRIPPED = "".join(c for c in STRIPPED if not c.isalpha()) + QUOTES + "…–—¿¡·"
REPORTING = frozenset("said says say quote quoted quotes called calling word words term wrote dit disait mot sagte sagt wort dijo dice palabra".split())
FEATURES = 12


def bare(token: str) -> str:
    """A lower-case token without what is no letter at its ends."""
    return token.strip(STRIPPED)


def _candidates(batches):
    """(term, label, documents): whole words end in a blank, beginnings don't."""
    for part, raw in text_slices(batches, most=8 << 20):
        labels = part.column(part.schema.get_field_index("label")).to_pylist()
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for x, label in zip(raw, labels, strict=True):
            words = {bare(w) for w in x.decode().lower().split()}
            found = {w[:k] for w in words for k in PREFIXES if len(w) >= k}
            found.update(w + " " for w in words if len(w) > 2)
            counts[int(label)].update(found)
        for label, c in counts.items():
            yield pa.record_batch([pa.array(list(c), pa.string()), pa.array([label] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["term", "label", "n"])


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> list[str]:
    """counts: term -> documents that hold it, toxic and clean. Of a beginning and
    the terms that go on from it, the beginning is kept if it tells clearly more.
    Every term that tells enough is kept, most telling first."""

    def telling(t):
        a, b = counts[t]
        odds = math.log((a + 0.5) / (toxic - a + 0.5)) - math.log((b + 0.5) / (clean - b + 0.5))
        return odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) if odds > 1.5 else 0.0

    value = {t: z for t in counts if (z := telling(t)) > 3.5}
    longer: dict[str, float] = {}
    for t, z in value.items():
        for k in range(1, len(t)):
            longer[t[:k]] = max(longer.get(t[:k], 0), z)
    own = [t for t in value if value[t] >= 1.15 * longer.get(t, 0)]
    kept: list[str] = []
    for t in sorted(own, key=lambda t: (len(t), t)):
        if not any(t.startswith(k) for k in kept):
            kept.append(t)
    return sorted(kept, key=lambda t: (-value[t], t))


class Matcher(dict):
    """Token -> (term's number, edits) or None. Terms that end in a blank are whole
    words, others are beginnings of words."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.nodes: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.begins: dict[int, int] = {}
        self.long: set[int] = set()  # nodes on the way to a term that may have an edit
        for k, term in enumerate(terms):
            at, word = 0, term.rstrip(" ")
            path = [0]
            for c in word:
                at = self.nodes[at].setdefault(c, len(self.nodes))
                if at == len(self.nodes):
                    self.nodes.append({})
                path.append(at)
            (self.whole if term.endswith(" ") else self.begins).setdefault(at, k)
            if len(word) >= EDIT_FROM[term.endswith(" ")]:
                self.long.update(path)
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.step: dict[tuple[int, str], int] = {}
        self.at_end: list = [None]
        self.on_way: list = [None]
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        for node, edits in list(items):
            if not edits:  # a letter of the term left out
                items.update((child, 1) for child in self.nodes[node].values() if child in self.long)
        items = {(n, e) for n, e in items if not (e and (n, 0) in items)}
        key = frozenset(items)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            for terms, out in ((self.whole, self.at_end), (self.begins, self.on_way)):
                hits = [(e, terms[n]) for n, e in items if n in terms and (not e or n in self.long)]
                out.append(min(hits)[::-1] if hits else None)
        return self.states[key]

    def _follow(self, state: int, c: str) -> int:
        items = set()
        for node, edits in self.sets[state]:
            child = self.nodes[node].get(c)
            if child is not None:
                items.add((child, edits))
            if not edits and node in self.long:
                items.add((node, 1))  # a letter too many
                items.update((other, 1) for other in self.nodes[node].values() if other in self.long)  # another letter
        found = self.step[state, c] = self._state(items) if items else 0
        return found

    def find(self, word: str) -> tuple[int, int] | None:
        state, best = self.start, None
        for c in word:
            got = self.step.get((state, c))
            state = self._follow(state, c) if got is None else got
            if not state:
                return best
            hit = self.on_way[state]
            if hit and (best is None or hit[1] < best[1]):
                best = hit
        hit = self.at_end[state]
        return hit if hit and (best is None or hit[1] <= best[1]) else best

    def __missing__(self, token: str):
        if len(self) >= MEMO:
            self.clear()
        found = self[token] = self.find(bare(token))
        return found


def hits_of(text: str, matcher: Matcher, telling=None) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of words, and (place, term, edits, quoted) of each hit; with telling
    (by term and edits), of those hits alone that tell something."""
    words = text.lower().split()
    found = list(map(matcher.__getitem__, words))
    if not any(found):
        return len(words), []
    out = []
    for i, hit in enumerate(found):
        if hit and (telling is None or telling[hit[0]][hit[1]]):
            w = words[i]
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            marked = w[0] in QUOTES and w.rstrip(".,;:!?")[-1:] in QUOTES
            opened = any(x[0] in QUOTES for x in words[max(0, i - WINDOW) : i]) and any(x.rstrip(".,;:!?")[-1:] in QUOTES for x in words[i : i + WINDOW])
            reported = any(bare(x) in REPORTING for x in near)
            out.append((i, hit[0], hit[1], int(marked or opened or reported)))
    return len(words), out


def densest(places: list[int], reach: int = WINDOW) -> int:
    """The most of the ascending places within `reach` of any one of them."""
    best = first = last = 0
    for p in places:
        while places[first] < p - reach:
            first += 1
        while last < len(places) and places[last] <= p + reach:
            last += 1
        best = max(best, last - first)
    return best


def features(n: int, hits: list, weight: list) -> list[float]:
    """weight[term][edits]: log ratio of the rates in toxic and clean texts. Hits of weight 0 don't count."""
    hits = [h for h in hits if weight[h[1]][h[2]] > 0]
    if not hits:
        return [0.0] * 9 + [math.log1p(n), 0.0, 0.0]
    w = [weight[t][e] for _, t, e, _ in hits]
    own = [x for x, h in zip(w, hits, strict=True) if not h[3]]
    dense = densest([h[0] for h, x in zip(hits, w, strict=True) if x > 1])
    strong = sum(x > 1 for x in w)
    return [
        1.0,
        math.log1p(sum(own)) if sum(own) > 0 else 0.0,
        math.log1p(100.0 * strong / n),
        max(own, default=0.0),
        math.log1p(sum(w) - sum(own)) if sum(w) > sum(own) else 0.0,
        math.log1p(len({h[1] for h in hits})),
        math.log1p(dense),
        math.log1p(sum(x > 2.5 for x in w)),
        math.log1p(sum(h[2] for h in hits)),
        math.log1p(n),
        math.log1p(strong) * math.log1p(n),
        math.log1p(100.0 * sum(own) / n) if sum(own) > 0 else 0.0,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, sd


def _seen(terms: list[str]):
    """Per label, how often each term is hit with 0 and 1 edits; under term -1, words."""

    def run(batches):
        matcher, counts = Matcher(terms), Counter()
        for part, raw in text_slices(batches, most=4 << 20):
            for x, label in zip(raw, part.column(part.schema.get_field_index("label")).to_pylist(), strict=True):
                words = x.decode().lower().split()
                counts[label, -1, 0] += len(words)
                counts.update((label, *hit) for hit in map(matcher.__getitem__, words) if hit)
        label, term, edits = (pa.array([k[i] for k in counts], pa.int32()) for i in range(3))
        yield pa.record_batch([label, term, edits, pa.array(list(counts.values()), pa.int64())], ["label", "term", "edits", "n"])

    return run


def _described(held):
    """(label, features) of each text."""

    def run(batches):
        m = held.value
        matcher, weight = Matcher(m["terms"]), m["weight"].tolist()
        for part, raw in text_slices(batches, most=4 << 20):
            yield pa.record_batch([part.column(part.schema.get_field_index("label")), pa.array([features(*hits_of(x.decode(), matcher, weight), weight) for x in raw], pa.list_(pa.float64()))], ["label", "x"])

    return run


def learn(labelled: DataFrame, most: int = LABELLED_ROWS) -> dict:
    """A model from (text, label) rows with labels 0 and 1. Of more than `most`
    rows a share is taken by the texts' hash; what is learned grows with that sample,
    not with the table. The driver gets candidate terms that enough toxic documents
    hold, counts by term and a dozen numbers a row of the sample."""
    ship(labelled.sparkSession)
    # one pass over the documents; what is kept of them is the bounded sample
    sample = materialize(labelled.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("label").cast("int").alias("label")))
    rows = sample.count()
    if rows > most:
        sample = sample.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(most / rows * (1 << 20)))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    model = {"terms": [], "weight": np.zeros((0, 2)), "w": np.zeros(FEATURES + 1), "mean": np.zeros(FEATURES), "sd": np.ones(FEATURES)}
    model["w"][0] = math.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -5.0
    if not toxic or not clean:
        return model
    counts = sample.mapInArrow(_candidates, "term string, label int, n long").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    few = max(3, toxic // 500)
    told = counts.where((F.col("a") >= few) & (F.col("a") * clean > F.col("b") * 3 * toxic))
    terms = choose_terms({r["term"]: (r["a"], r["b"]) for r in told.collect()}, toxic, clean)
    dealt = sample.repartition(16)
    seen, words = np.zeros((2, max(len(terms), 1), 2)), np.zeros(2)
    for r in dealt.mapInArrow(_seen(terms), "label int, term int, edits int, n long").groupBy("label", "term", "edits").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            words[r["label"]] = r["n"]
        else:
            seen[r["label"], r["term"], r["edits"]] = r["n"]
    model["terms"] = terms
    model["weight"] = np.maximum(0, np.log((seen[1] + 0.5) / (words[1] + 1)) - np.log((seen[0] + 0.5) / (words[0] + 1)))
    held = labelled.sparkSession.sparkContext.broadcast({"terms": terms, "weight": model["weight"]})
    described = dealt.mapInArrow(_described(held), "label int, x array<double>").toArrow()
    x = described["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    y = described["label"].to_numpy().astype(float)
    by_row = np.lexsort((*x.T, y))  # rows arrive in any order; sums in one order give one model
    x, y = x[by_row], y[by_row]
    model["w"], model["mean"], model["sd"] = fit_logistic(x, y)
    return model


def _score(held):
    def run(batches):
        m = held.value
        matcher, weight = Matcher(m["terms"]), m["weight"].tolist()
        for part, raw in text_slices(batches, most=4 << 20):
            x = np.array([features(*hits_of(t.decode(), matcher, weight), weight) for t in raw])
            z = m["w"][0] + ((x - m["mean"]) / m["sd"]) @ m["w"][1:]
            yield pa.record_batch([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*part.schema.names, "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (0 to 1) for every row; a column of docs named score gives way.
    Null texts count as empty, which get the score of a text without words;
    repeated rows score alike; other columns stay as they are and have no part in
    the score; an empty table gives an empty one."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    docs = docs.drop("score")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(_score(held), schema)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5


def learn_from(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> dict:
    """learn() from the documents that labels.toxic marks 0 or 1, without those of
    fold 0. Labels are cut to about `most` ids by their hash before the join, so
    the texts read for learning are bounded too."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = marks.count()
    if rows > most:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(most / rows * (1 << 20)))
    return learn(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "label"), most=2 * most)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn_from(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
