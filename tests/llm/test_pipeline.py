"""The pipeline stage by stage on nulls, repeats, copies, an empty table and clashing columns."""

import corpus_pipeline
from tests.llm.conftest import words


def _stages(spark, docs, sf_dir):
    """Each stage's rows, on what the one before kept."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        out[name] = docs
    return out


def test_edges_of_the_whole(spark, edge_docs, no_docs, sf):
    seen = _stages(spark, edge_docs, sf)
    counts = {}
    for name, df in seen.items():
        if name != "token_output":
            assert df.columns == edge_docs.columns
        counts[name] = df.count()
    assert counts["near_duplicates"] <= counts["quality"] <= edge_docs.count()
    assert counts["token_output"] == counts["mixing"]
    assert {name: df.count() for name, df in _stages(spark, no_docs, sf).items()} == dict.fromkeys(counts, 0)


def test_copies_and_leaks_go(spark, sf, rng):
    """Of copies one stays, a leak goes, clean documents stay, each judged on its own stage's input."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(3).collect()
    clean = [words(rng, 120) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(clean)] + [(100 + k, clean[k]) for k in range(4)] + [(200, clean[5].replace(" ", "  ", 3)), (300, words(rng, 60) + " " + items[0].text + " " + words(rng, 60))]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t), None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == {*range(12), 300}
    left = corpus_pipeline.drop_leaks(spark, kept, sf)
    assert {r.doc_id for r in left.collect()} == set(range(12))
    mixed = corpus_pipeline.mix_sources(spark, left, sf)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(range(12))
