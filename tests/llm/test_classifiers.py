"""Toxicity and quality: held-out accuracy, and defined results at the edges."""

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import quality, toxicity
from tracewell.llm.common import held_out, labelled_sample


def test_sample_holds_no_held_out_rows(more_docs, labels):
    texts, y = labelled_sample(more_docs, labels, "toxic", 4, 2, 20, 5000)
    assert 0 < len(texts) <= 40 and set(y) == {0, 1} and max(map(len, texts)) <= 5000
    out = {r.text for r in more_docs.where(held_out(4, 2)).collect()}
    again = {r.text for r in more_docs.where(~held_out(4, 2)).collect()}
    assert all(t in again or t not in out for t in texts)


def test_quality_on_held_out_documents(more_docs, labels):
    scored = quality.quality(more_docs, labels)
    got = scored.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert got[1] > 50 and got[0] > 0.95


def test_toxicity_on_held_out_documents(spark):
    """Of the held-out toxic documents most are found, and hardly a clean one is; by labels of which some are wrong."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id")
    toxic, found, clean, alarms = judged.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.expr("toxic = 1 and predicted = 1")), F.count_if(F.col("toxic") == 0), F.count_if(F.expr("toxic = 0 and predicted = 1"))).first()
    assert toxic > 100 and found >= 0.85 * toxic and alarms <= 0.02 * clean


def _naive_toxicity(model, text):
    """The score gram by gram: passages of the lower-cased bytes, each n-gram within a word, and the most toxic passage."""
    data = (text or "").replace("\x00", " ").lower().encode()
    word = [c in b"abcdefghijklmnopqrstuvwxyz0123456789" or c >= 128 for c in data]
    padded, inside = [c if w else 32 for c, w in zip(data, word)] + [32], word + [False]
    fresh, words_, k = list(inside), [], 0
    while k < len(data):
        if word[k]:
            end = next((j for j in range(k, len(data)) if not word[j]), len(data))
            if words_ and words_[-1] == data[k:end]:
                fresh[k:end] = [False] * (end - k)
            words_.append(data[k:end])
            k = end
        else:
            k += 1
    sums, counts = {}, {}
    for n in toxicity.GRAMS:
        for at in range(len(padded) - n + 1):
            if all(fresh[at + 1 : at + n - 1]):
                h = np.uint32(padded[at])
                with np.errstate(over="ignore"):
                    for c in padded[at + 1 : at + n]:
                        h = h * np.uint32(0x01000193) ^ np.uint32(c) * np.uint32(0x9E3779B1)
                    bucket = int((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> (32 - toxicity.BUCKET_BITS)
                p = min(at // toxicity.PASSAGE, max(0, -(-len(data) // toxicity.PASSAGE) - 1))
                sums[p], counts[p] = sums.get(p, 0.0) + model.value[bucket], counts.get(p, 0) + 1
    parts = range(max(1, -(-len(data) // toxicity.PASSAGE)))
    best = max(sums.get(p, 0.0) / max(counts.get(p, 0), toxicity.LEAST) for p in parts)
    return 1 / (1 + np.exp(-(best + model.bias)))


def test_toxicity_scores_by_brute_force(more_docs):
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 3, 1 << toxicity.BUCKET_BITS), -0.5)
    texts = ["", None, "a", "ab cd", "bad bad bad words", "naïve café " * 9, "x" * 100] + [r.text for r in more_docs.where("length(text) < 900").limit(20).collect()]
    for got, t in zip([float(model.scores([t])[0]) for t in texts], texts):
        assert abs(got - _naive_toxicity(model, t)) < 1e-9, t


def test_toxicity_shares_subwords():
    rng = np.random.default_rng(0)
    plain = ["the", "and", "house", "river", "green", "walk", "window", "paper", "stone", "music"]
    make = lambda bad: " ".join([*rng.choice(plain, 40), *bad, *rng.choice(plain, 40)])
    bad = ["scoundrel", "dunderhead", "blockheaded"]
    texts = [make([rng.choice(bad)] * 2) for _ in range(60)] + [make([]) for _ in range(60)]
    m = toxicity.fit(texts, [1] * 60 + [0] * 60)
    s = m.scores([make(["scoundrel"]), make(["scoundrell"]), make(["dunderheads"]), make([]), make(["lantern"])])
    assert (s[:3] > 0.3).all() and (s[3:] < 0.3).all()
    assert s[:3].min() > s[3:].max()


def test_long_texts_are_read_whole():
    m = toxicity.fit(["good day to you"] * 30 + ["you dunderhead fool"] * 30, [0] * 30 + [1] * 30)
    filler = "good day to you " * 20_000
    a, b = m.scores([filler, filler + "you dunderhead fool"])
    assert b > a


def test_edges(edge_docs, no_docs, labels, spark):
    for fn, label in ((toxicity.toxicity, "toxic"), (quality.quality, "quality")):
        known = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
        got = fn(edge_docs, known).collect()
        assert len(got) == edge_docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert fn(no_docs, known).count() == 0
        one_sided = fn(edge_docs, known.where(f"{label} = 1")).collect()
        assert len({r.score for r in one_sided}) == 1
        assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_kept_rows_keep_their_columns(edge_docs):
    model = quality.fit(["a b c"], [1])
    kept = quality.kept(edge_docs, model, 0.0)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert quality.kept(edge_docs, model, 1.1).count() == 0


def test_attention_is_trained():
    junk, fine = "### $$$ @@@ " * 100, "A calm line of words. " * 60
    m = quality.fit([fine] * 20 + [junk] * 20, [1] * 20 + [0] * 20, steps=120)
    s = m.scores([fine, junk])
    assert s[0] > 0.9 and s[1] < 0.1
