"""Language identification, ranked search and spelling variants: SQL, brute force, held-out accuracy, edges."""

import math
import random
import re
import unicodedata
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from tests.compare import against_sql
from tests.llm.conftest import words
from tracewell.llm import language, lexical, oracles, queries, spelling
from tracewell.llm.common import held_out


def test_spelling_by_sql(spark, sf):
    got, want = against_sql(queries.op13_spelling_variants(spark, sf), oracles.spelling_sql(), sf)
    assert got == want and len(want[1]) > 100


def test_spelling_in_many_shards(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda: sorted(map(tuple, spelling.variants(docs).collect()))
    want = rows()
    for name, value in (("SHARD_WORDS", 150), ("BLOCK_WORDS", 90), ("FRONTIER", 64), ("PIECE", 50), ("HELD", 100)):
        monkeypatch.setattr(spelling, name, value)
    assert rows() == want


def _one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_automata_by_brute_force():
    r = random.Random(3)
    for letters in ("ab", "abc\xe9"):
        own = sorted({"".join(r.choice(letters) for _ in range(r.randint(5, 9))).encode("latin-1") for _ in range(300)})
        trie = spelling.Trie(own, spelling.np.ones(len(own), int))
        got = sorted((int(a), int(b)) for w, x in trie.near(spelling.matrix(own)) for a, b in zip(w, x))
        assert got == [(a, b) for a in range(len(own)) for b in range(len(own)) if _one_apart(own[a], own[b])]
        for prefix in (b"", b"a", b"abab", b"bbbbb", b"aabbaabb"):
            for w in own:  # some edit of the word, or the word, begins with the prefix
                edits = {w} | {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + j :] for k in range(len(w) + 1) for j in (0, 1) for c in (b"a", b"b", b"c", b"\xe9")}
                assert spelling.reachable(spelling.matrix([w]), prefix) == any(e.startswith(prefix) for e in edits), (w, prefix)


def test_spelling_edges(spark, edge_docs, no_docs):
    assert spelling.variants(no_docs).collect() == []
    spelling.variants(edge_docs).collect()
    word, long = "abcde", "b" * 3000
    rows = [(k, f"{word} {word.upper()}X2{long} 中{long}c \xc9t\xe9 \xe9t\xe9\xe9\xd7") for k in range(4)] + [(None, long), (5, None), (6, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r for r in spelling.variants(df).collect()}
    want = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\xc0-\xff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                want[run] = want.get(run, 0) + 1
    want = {k: v for k, v in want.items() if v >= 3}
    assert {k: r.n for k, r in got.items()} == want and long in want and "\xe9t\xe9\xe9\xd7" in want
    assert got[long].n_near == 1 and got[long].form is None and got[long].root == long


def test_chains_of_forms(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(60)] + [("a", "b")]
    got = {r.word: r.root for r in spelling.rooted(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {f"w{k}": "w60" for k in range(60)} | {"a": "b"}


def test_search_by_sql(spark, sf):
    got, want = against_sql(queries.op12_lexical_search(spark, sf), oracles.ranked_sql(), sf)
    assert got == want and len(want[1]) == 400


def _brute_ranked(docs, items, top=10):
    """Every document scored for every item, one by one."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(low))
    held = [(i, len(w), Counter(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    number, total = len(held), sum(n for _, n, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item_id, text in items:
        rows = []
        for i, n, c in held:
            m = 25 + 75 * n * number // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item_id, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(rows, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def test_search_by_brute_force(spark, edge_docs, no_docs, monkeypatch):
    """Ties, repeated rows and items, rows without ids, in one shard and in many, for one part of the items and for many."""
    r = random.Random(5)
    docs = [(k, " ".join(r.choice(["a", "b", "\xc9t\xe9", "\xe9t\xe9", "D9", "rare", "the"]) for _ in range(r.choice([1, 2, 3, 30])))) for k in range(300)]
    docs += docs[:40] + [(None, "a rare b"), (None, None), (900, ""), (901, ".,!"), (902, None)]
    items = [(1, "the rare d9"), (1, "the rare d9"), (2, "a a A b"), (3, "\xc9t\xe9 nothing"), (4, None), (5, "unknown terms"), (None, "B! rare")]
    df = spark.createDataFrame([(*x, 0, 1) for x in docs], "doc_id long, text string, score int, item int").repartition(5)
    of = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, rank int")
    rows = lambda: sorted((tuple(x) for x in lexical.ranked(df, of).collect()), key=repr)
    want = _brute_ranked(docs, items)
    assert rows() == want and len(want) == 50
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    monkeypatch.setattr(lexical, "TASK_SHARDS", 3)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 20)
    assert rows() == want
    for a, b in ((no_docs, of), (edge_docs, of.limit(0))):
        assert lexical.ranked(a, b).collect() == []
    lexical.ranked(edge_docs, of).collect()


def test_length_norms_beyond_a_long():
    n = lexical.np.array([1, 10**6], lexical.np.int64)
    assert lexical.length_norm(n, 10**12, 10**14).tolist() == [25 + 75 * x * 10**12 // 10**14 for x in (1, 10**6)]


def _symbols(text):
    out = []
    for c in (text or "").lower():
        if unicodedata.category(c)[0] in "LM":
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return out + [" "] * (bool(out) and out[-1] != " ")


def _kneser_ney(texts, order=4):
    """p(symbol | three before), by the textbook."""
    counts = {order: Counter()}
    for t in texts:
        s = [" "] * (order - 1) + _symbols(t)
        counts[order].update(tuple(s[k - order : k]) for k in range(order, len(s) + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: (lambda a, b: a / (a + 2 * b) if a and b else 0.5)(*(sum(v == x for v in c.values()) for x in (1, 2))) for k, c in counts.items()}
    totals = {k: Counter() for k in counts}
    kinds = {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            totals[k][g[:-1]] += v
            kinds[k][g[:-1]] += 1

    def p(gram, distinct):
        k = len(gram)
        if not k:
            return 1 / distinct
        lower, h = p(gram[1:], distinct), gram[:-1]
        if not totals[k][h]:
            return lower
        return max(counts[k][gram] - d[k], 0) / totals[k][h] + d[k] * kinds[k][h] / totals[k][h] * lower

    return p, set(counts[1])


def test_probabilities_by_brute_force(spark):
    rows = [(1, "the thin hen, then THE ten"), (1, "a th\xe9 in \u4e2d\u6587 \U00010400!"), (2, "der die das den den dass 12"), (2, "die die"), (1, None), (2, "...")]
    df = spark.createDataFrame([(str(a), False, b) for a, b in rows], "lang string, part boolean, text string")
    kept = language.gathered(language.counted(df))
    model = language.Model.of(kept[kept["model"] == 1])
    assert model.languages == ["1", "2"]
    naive = [_kneser_ney([t for a, t in rows if a == k]) for k in (1, 2)]
    distinct = len(naive[0][1] | naive[1][1]) + 1
    texts = ["then the den", "das th\xe9", "\u4e2dxq zz", "\U00010400", "", None, "  12 "]
    bits, n, lettered = model.entropies(texts)
    assert lettered.tolist() == [True] * 4 + [False] * 3
    for t, own, size in zip(texts, bits, n):
        s = [" "] * 3 + _symbols(t)
        assert size == len(s) - 3
        for (p, _), got in zip(naive, own):
            want = -sum(math.log2(p(tuple(s[k - 4 : k]), distinct)) for k in range(4, len(s) + 1))
            assert abs(got * max(size, 1) - want) < 1e-4
    for p, seen in naive:  # the symbols after a context, with one that no text has, sum to one
        for h in ((" ", " ", " "), ("t", "h", "e"), ("x", "q", "z")):
            assert abs(sum(p((*h, *c), distinct) for c in naive[0][1] | naive[1][1] | {("none",)}) - 1) < 1e-9


def test_long_texts_in_pieces(spark, monkeypatch):
    model = language.Model.of(language.gathered(language.counted(spark.createDataFrame([("a", False, "some words of a text"), ("b", False, "andere worte")], "lang string, part boolean, text string"))))
    texts = ["some andere worte " * 4000, "", "x", None, "words of " * 7]
    want, n, _ = model.entropies(texts)
    monkeypatch.setattr(language, "STEP", 50)
    got, again, _ = model.entropies(texts)
    assert abs(got - want).max() < 1e-9 and n.tolist() == again.tolist() == [72_000, 0, 2, 0, 63]


def test_language_of_held_out_documents(more_docs):
    got = language.languages(more_docs)
    judged = got.where("held_out").join(more_docs.select("doc_id", "lang"), "doc_id")
    right, n, sure = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.avg("score")).first()
    assert n > 200 and right > 0.97 and sure > 0.9
    assert got.where("not rejected").count() > 0.9 * more_docs.count()
    # nothing held out is learned from: other langs there change nothing
    other = more_docs.withColumn("lang", F.when(held_out(4, 2), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language.languages(other).collect())) == sorted(map(tuple, got.collect()))


def test_rejection(spark, more_docs):
    model, calibration = language.fitted(more_docs)
    r = random.Random(1)
    odd = spark.createDataFrame([(k, "".join(r.choice("qxzwkj vyp") for _ in range(300))) for k in range(20)] + [(50, "\u0442\u0435\u043a\u0441\u0442 \u043d\u0430 \u0434\u0440\u0443\u0433\u043e\u043c")], "doc_id long, text string")
    assert all(x.rejected for x in language.identified(odd, model, calibration).collect())


def test_language_edges(spark, edge_docs, no_docs):
    got = {(x.doc_id, x.lang_pred, x.held_out) for x in language.languages(edge_docs).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= {x[:2] for x in got} and all(x[1] in ("en", "de", "fr", "und") for x in got)
    assert (None, "fr", False) in got
    assert language.languages(no_docs).collect() == []
    unlabelled = language.languages(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(x.lang_pred, x.score, x.rejected) for x in unlabelled} == {("und", 0.0, True)} and len(unlabelled) == edge_docs.count()


def test_models_of_bounded_size(spark, more_docs, monkeypatch):
    """Of more runs than a model may keep the most frequent stay, and texts are still told apart."""
    monkeypatch.setattr(language, "GRAMS", 300)
    docs = more_docs.where(~held_out(4, 2))
    kept = language.gathered(language.counted(docs.select("lang", F.lit(False).alias("part"), "text")))
    assert kept.groupby(["model", "lang", "level"]).size().max() <= 300
    model = language.Model.of(kept[kept["model"] == 1])
    rows = [(r.text, r.lang) for r in more_docs.where(held_out(4, 2)).select("text", "lang").collect()]
    bits, _, _ = model.entropies([t for t, _ in rows])
    assert sum(model.languages[b.argmin()] == lang for b, (_, lang) in zip(bits, rows)) > 0.9 * len(rows)


def test_runs_beyond_the_bound_by_brute_force(spark, edge_docs, more_docs, monkeypatch):
    """Of more runs than a worker may hold none is dropped: the bits are the textbook's, however many it holds."""
    docs = more_docs.limit(60).unionByName(edge_docs.where("doc_id is null or doc_id <> 5").withColumn("doc_id", F.col("doc_id") + 10**7).select(more_docs.columns))
    judge = lambda: sorted((tuple(r) for r in language.languages(docs).collect()), key=repr)
    whole, rows = judge(), docs.withColumn("held", held_out(4, 2)).collect()
    texts = {}
    for r in rows:
        if r.lang is not None and not r.held:
            texts.setdefault(r.lang, []).append(r.text)
    naive = {k: _kneser_ney(v) for k, v in texts.items()}
    distinct = len(set().union(*[seen for _, seen in naive.values()])) + 1
    monkeypatch.setattr(language, "GRAMS", 50)
    model, calibration = language.fitted(docs)
    got = sorted((tuple(r) for r in language.identified(docs, model, calibration).collect()), key=repr)
    assert isinstance(model, language.Tables) and 0 < len(model.often.hashes) <= 50 * len(naive)
    assert [x[:3] + x[5:] for x in got] == [x[:3] + x[5:] for x in whole] and len(got) == len(rows)
    assert all(abs(a[3] - b[3]) < 1e-3 and abs((a[4] or 0) - (b[4] or 0)) < 1e-5 for a, b in zip(got, whole))
    bits = {x[0]: x[4] for x in got}
    for r in [r for r in rows if len(r.text or "") < 3000][-25:]:
        s = [" "] * 3 + _symbols(r.text)
        if any(c != " " for c in s):
            want = min(-sum(math.log2(p(tuple(s[k - 4 : k]), distinct)) for k in range(4, len(s) + 1)) for p, _ in naive.values())
            assert abs(bits[r.doc_id] * (len(s) - 3) - want) < 1e-4 * len(s)
        else:
            assert bits[r.doc_id] is None
    monkeypatch.setattr(language, "GRAMS", 0)  # every run is joined
    assert judge() == got


def test_many_languages(spark):
    """More languages than a worker can hold the runs of are no error."""
    r = random.Random(2)
    of = {k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for k in range(300)}
    docs = spark.createDataFrame([(j * 300 + k, " ".join([of[k]] * 4), f"l{k:03}") for j in range(6) for k in of], "doc_id long, text string, lang string")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1800 and sum(x.lang == x.lang_pred for x in got) >= 1780
