"""The pipeline against plain Python, SQL and the token library, stage after stage."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F
from test_copies import plain_set
from test_selection import base_spans, by_sql, plain_markov, plain_score

import corpus_pipeline
from skyfuse.llm import bpe, secrets, toxicity
from skyfuse.session import table


def plain_near(rows):
    """The rows of least id of each group that links of similarity 0.8 reach, by comparing all."""
    sets, root = [plain_set(r["text"]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        k = find(i)
        best[k] = r if k not in best or r["doc_id"] < best[k]["doc_id"] else best[k]
    return list(best.values())


def plain_redacted(text, model):
    out, at = "", 0
    for s, kind, e in sorted(base_spans(text) + plain_markov(text, model)):
        if s >= at:
            out += text[at:s] + f"<{secrets.KINDS[kind]}>"
        at = max(at, e)
    return out + text[at:]


def test_run_equals_the_plain_pipeline(spark, sf):
    import public_tokenizers as vocabularies
    import tiktoken

    docs = table(spark, sf, "documents")
    model = toxicity.learn_from(docs, table(spark, sf, "labels"))
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if plain_score(r["text"], model) < 0.5]
    rows = plain_near(rows)
    steps = secrets.train(secrets.labelled_samples(spark))
    rows = [r | {"text": plain_redacted(r["text"] or "", steps)} for r in rows]
    taken = {r[0]: (r[1], r[4]) for r in by_sql([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows])}
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(vocabularies.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for r in rows:
        size, words = taken[r["doc_id"]]
        ids = library.encode_ordinary(r["text"])
        row = r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()
        want += [row] * (words // size if size else 0)
    empty = {r["doc_id"] for r in rows if not taken[r["doc_id"]][0]}
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(x for x in got if x[0] not in empty) == sorted(want) and len(want) > 50


def test_stages_keep_columns_of_any_name(spark, docs, sf):
    odd = docs.select("*", *[F.lit("own").alias(c) for c in ("score", "spans", "copies", "node", "root", "size", "target", "fp", "h", "band")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns, name
        assert got.where("score <> 'own' OR spans <> 'own' OR copies <> 'own' OR root <> 'own'").count() == 0, name
        assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, stage(spark, docs, sf).collect())), name
        assert stage(spark, odd.limit(0), sf).columns == odd.columns and stage(spark, docs.limit(0), sf).count() == 0, name


def test_stages_on_odd_rows(spark, docs, rows, sf):
    n = len(rows)
    toxic = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert toxic.count() <= n and toxic.where("text IS NULL").count() == sum(r[1] is None for r in rows)
    clean = corpus_pipeline.replace_secrets(spark, docs, sf)
    assert clean.count() == n and clean.where("text IS NULL").count() == sum(r[1] is None for r in rows)
    coded = corpus_pipeline.encode_texts(spark, docs, sf)
    assert coded.count() == n and coded.where("n_tokens = 0").count() == sum(not r[1] for r in rows)


def test_run_leaves_only_its_last_table(spark, sf):
    import os

    from skyfuse.llm import common

    before = set(common._written)
    out = corpus_pipeline.run(spark, sf)
    assert out.limit(1).count() == 1
    left = [p for p in common._written if p not in before]
    assert len(left) == 1 and os.path.exists(left[0].removeprefix("file:"))
    common._remove(spark, left[0])


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"
