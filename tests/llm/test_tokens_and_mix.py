"""Token files, separator scan, mixing and the pipeline: round trips and brute force."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import against_sql
from tracewell.llm import common, files, mixing, neardup, oracles, queries, sepscan, tokenfiles
from tracewell.llm.encoding import Encoder

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoding_is_the_library_s(tokenizer, more_docs):
    texts = [r.text for r in more_docs.limit(120).collect()]
    texts += ["", None, "It's  'quoted' l'été\tDON'T 'S", "éÉé ǅ ﬁ ß ẞ İ  x\x1cy\x85z", "##a!?'re 12³ 五 x<|endoftext|>y <|ENDOFTEXT|>", "\n\n a\n", "ª µ ÷ × ÿ Ÿ"]
    flat, counts = Encoder(PATH, cache_bytes=20_000).encode(pa.array(texts))
    cut = np.split(flat, np.cumsum(counts)[:-1])
    assert [c.tolist() for c in cut] == [ids(tokenizer, t) for t in texts]


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for values in ([], [0], [255, 256, 65535, 65536, 2**40], rng.integers(0, 50_000, 5000), rng.integers(0, 200, 1500)):
        v = np.array(values, np.uint64)
        codes = tokenfiles.Codes(b"".join(tokenfiles.pack(v)))
        assert codes[np.arange(len(v))].tolist() == v.tolist()
        if len(v):  # any token by itself, in any order
            at = rng.integers(0, len(v), 50)
            assert codes[at].tolist() == v[at].tolist()


def expected(rows, tokenizer, end=2):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = [*ids(tokenizer, text), end]
        out.append((doc_id, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), start))
        start += len(own)
    return out


def test_token_output(spark, docs, edge_docs, no_docs, tokenizer, tmp_path):
    for df in (docs, edge_docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = [(r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in tokenfiles.token_output(df, PATH).collect()]
        assert sorted(got, key=repr) == sorted(expected(rows, tokenizer), key=repr)
    assert tokenfiles.token_output(no_docs, PATH).count() == 0
    # many files, several a partition: the same documents at the same places
    out = f"file://{tmp_path}/tokens"
    written = tokenfiles.write_files(docs, PATH, out, file_tokens=2000, partition_bytes=100_000)
    assert written.count() > 10 and all(files.exists(r.path) for r in written.collect())
    assert sorted(map(tuple, tokenfiles.read_files(written).collect())) == sorted(map(tuple, tokenfiles.token_output(docs, PATH).collect()))


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_separator_scan(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    stream = rng.integers(0, 6, 997).astype("<u2")
    for k, part in enumerate(np.split(stream, [100, 100, 103, 700])):
        files.write(f"file://{tmp_path}/part-{k}.bin", [part.tobytes()])
    at = np.flatnonzero(stream == 3)
    got = sepscan.scan(sepscan.listed(spark, f"file://{tmp_path}"), 3, block_tokens=block if block > 1 else 50).orderBy("doc").collect()
    assert [(r.doc, r.n_tokens) for r in got] == list(enumerate(np.diff(at, prepend=-1)))


def test_files_are_rows_of_their_writers(spark, docs, tokenizer, tmp_path, monkeypatch):
    """The stream's files come from the tasks that wrote them, in order of part and number, and a range of parts at a time is carried."""
    monkeypatch.setattr(common, "KEYS", 2)
    out = f"file://{tmp_path}/flat"
    both = sepscan.write_flat(docs.repartition(7), PATH, out, queries.SCAN_END_ID, file_tokens=3000)
    listed = both.where("path is not null").select("part", "k", "path", "n")
    stream = np.concatenate([np.frombuffer(files.read(r.path), "<u2") for r in listed.orderBy("part", "k").collect()])
    at = np.flatnonzero(stream == queries.SCAN_END_ID)
    got = sepscan.scan(listed, queries.SCAN_END_ID, block_tokens=1000).orderBy("doc").collect()
    assert [(r.doc, r.n_tokens) for r in got] == list(enumerate(np.diff(at, prepend=-1))) and len(got) == docs.count()
    again = sepscan.listed(spark, out).orderBy("part", "k").collect()
    assert [r.path.rsplit("/", 1)[1] for r in again] == [r.path.rsplit("/", 1)[1] for r in listed.orderBy("part", "k").collect()]


def test_carried_sums(spark, monkeypatch):
    monkeypatch.setattr(common, "KEYS", 3)
    rows = [(k, k * k % 7, None if k % 4 else k) for k in range(20)]
    got = common.carried(spark.createDataFrame(rows, "key long, n long, last long"), "key", {"upto": "n"}, {"seen": "last"}).orderBy("key").collect()
    for r in got:
        assert r.upto == sum(n for k, n, _ in rows if k < r.key) and r.seen == max((x for k, _, x in rows if k < r.key and x is not None), default=None)


def test_files_are_written_once(tmp_path, monkeypatch):
    """A store that doesn't rename onto a file keeps the first attempt's."""
    path = f"file://{tmp_path}/a/one.bin"
    files.write(path, [b"first"])
    store = type("Store", (), {})()
    real, at = files._of(path)
    for name in ("create_dir", "open_output_stream", "get_file_info", "delete_file"):
        setattr(store, name, getattr(real, name))

    def move(a, b):
        raise OSError("exists")

    store.move = move
    monkeypatch.setattr(files, "_of", lambda p: (store, at))
    files.write(path, [b"second"])
    assert (tmp_path / "a/one.bin").read_bytes() == b"first" and len(list((tmp_path / "a").iterdir())) == 1


def test_token_counts(spark, docs, edge_docs, no_docs, tokenizer):
    for df in (docs, edge_docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = [tuple(r) for r in sepscan.token_counts(df, PATH, queries.SCAN_END_ID).select("doc_id", "n_tokens").collect()]
        assert sorted(got, key=repr) == sorted([(d, n) for d, n, _, _ in expected(rows, tokenizer)], key=repr)
    assert sepscan.token_counts(no_docs, PATH, queries.SCAN_END_ID).count() == 0


def test_mix_by_sql(spark, sf):
    got, want = against_sql(queries.op5_source_mixing(spark, sf), oracles.mix_sql(), sf)
    assert got == want


def test_draws_decide_the_mix(spark, more_docs):
    """Another salt takes other words; whatever the draw, sources come near their targets and no document passes twice its size."""
    seen = []
    for salt in (31, 32):
        rows = mixing.mix(more_docs, salt=salt).collect()
        seen.append({r.doc_id: r.taken for r in rows})
        assert all(r.taken <= 2 * r["size"] for r in rows)
        source = {r.doc_id: r.source for r in more_docs.select("doc_id", "source").collect()}
        taken, target = {}, {}
        for r in rows:
            taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
            target[source[r.doc_id]] = r.target
        assert all(abs(taken[s] - target[s]) <= 0.2 * target[s] for s in target)
        assert abs(sum(taken.values()) - sum(target.values())) <= 0.01 * sum(target.values())
    assert seen[0] != seen[1]
    primes = (65_537, 65_539, 65_543)
    assert all(p % k for p in primes for k in range(2, 257))


def test_targets_by_iteration(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 0, "e": 50, None: 640}
    df = spark.createDataFrame([(k, s, n, 0) for k, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long, tie long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    assert got == pytest.approx(target)


def test_permutations_are_one_to_one(spark):
    df = spark.createDataFrame([(n, s) for n in (1, 2, 3, 5, 16, 97, 1000) for s in (1, 2)], "blocks long, sid long").withColumn("index", F.explode(F.expr("sequence(0L, blocks - 1)")))

    def step(name, sql):
        nonlocal df
        df = df.withColumn(name, F.expr(sql))

    mixing.permuted(step, "index", "blocks", "sid")
    g = df.groupBy("blocks", "sid").agg(F.countDistinct("block").alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi")).collect()
    assert all((r.n, r.lo, r.hi) == (r.blocks, 0, r.blocks - 1) for r in g)


def test_mix_edges(edge_docs, no_docs):
    got = mixing.mix(edge_docs).collect()
    assert len(got) == edge_docs.count() and mixing.mix(no_docs).count() == 0
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert {(r["size"], r.taken) for r in got if r.doc_id in (2, 3)} == {(0, 0)}
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(edge_docs.repartition(3)).collect()), key=repr)


def test_mixed_documents_hold_the_words_taken(docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    source = {r.doc_id: set(r.text.split()) for r in docs.collect()}
    for r in rows:
        own = [w for w in r.text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        assert len(own) == taken[r.doc_id] and set(own) <= source[r.doc_id] and r.n_chars == len(r.text)
    assert {r.doc_id for r in rows} == {k for k, v in taken.items() if v}


def test_mixed_documents_edges(edge_docs, no_docs):
    out = mixing.mixed_documents(edge_docs)
    assert out.columns == edge_docs.columns and out.where("text is null").count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf_dir = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"]
    ids_ = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a = cp.keep_quality(spark, documents, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0")
    assert a.columns == documents.columns
    assert ids_(a.join(bad, "doc_id", "left_semi")) == set() and len(ids_(good) - ids_(a)) <= 0.02 * len(ids_(good))
    b = cp.drop_near_duplicates(spark, a, sf_dir)
    classes = neardup.near_duplicates(a).select("class_id").distinct().count()
    assert b.columns == documents.columns and b.count() == classes < a.count()
    c = cp.drop_leaks(spark, b, sf_dir)
    assert c.columns == documents.columns and 0 < b.count() - c.count() < 0.1 * b.count()
    d = cp.mix_sources(spark, c, sf_dir)
    out = cp.run(spark, sf_dir)
    assert ids_(out) == ids_(d) and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
