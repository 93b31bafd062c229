"""Mixing sources to target weights, with DataFrame operations only.

The words of each source form one axis (documents in a fixed pseudorandom
order), cut into blocks of ``block`` words. The mix is a row of slots in output
shards. Each shard draws its source counts multinomially, by the sources' shares
of the target, and what a source draws is what the mix takes of it: only slots
beyond twice its blocks pass to the other sources, by weight. A source's slot
r takes block permutation(r mod blocks), and slots meet blocks in a join by
(source, block index), so that no key is hot however large a source is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
P = 2147483647  # the modulus of all hashes here; products stay below 2**62
BINS = 4096
BROADCAST_SOURCES = 20_000
SLOTS_A_TASK = 500_000
GROUP = 4096


def mixed(x: str, salt: int = 0) -> str:
    """SQL of a hash of the non-negative integer x, from 0 to P - 1. It names x once, so nested hashes stay short;
    with // for div it is DuckDB's too."""
    return f"((((({x}) % {P} + {salt * 104729 % P}) % {P} * 48271 % {P}) div 7 * 69621 % {P}) div 11 * 16807 % {P})"


def _coprime(blocks: str) -> str:
    """SQL of a prime that doesn't divide blocks: three of them divide no number below 2**47."""
    return f"(case when {blocks} % 65537 <> 0 then 65537 when {blocks} % 65539 <> 0 then 65539 else 65543 end)"


def permuted(steps_of, index: str, blocks: str, key: str):
    """Columns, one after another, that map index in [0, blocks) to another index, one to one.

    An affine map, a three-round modular Feistel network on the largest a x b
    grid within ``blocks`` (the rest stays), and an affine map again. Products
    stay below 2**63 for up to 2**46 blocks.
    ``steps_of(name, sql)`` adds a column; the last one is called block.
    """
    steps_of("pa", f"({_coprime(blocks)} * {index} + {mixed(key, 11)}) % {blocks}")
    steps_of("ga", f"cast(floor(sqrt({blocks})) as bigint)")
    steps_of("gb", f"cast(floor({blocks} / ga) as bigint)")
    steps_of("lo", "pa % ga")
    steps_of("hi", "cast(floor(pa / ga) as bigint)")
    steps_of("l1", f"(lo + {mixed(f'hi + {key} * 7919', 1)}) % ga")
    steps_of("h1", f"(hi + {mixed(f'l1 + {key} * 7919', 2)}) % gb")
    steps_of("l2", f"(l1 + {mixed(f'h1 + {key} * 7919', 3)}) % ga")
    steps_of("pf", "case when pa < ga * gb then h1 * ga + l2 else pa end")
    steps_of("block", f"({_coprime(blocks)} * pf + {mixed(key, 17)}) % {blocks}")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a tie-break of every row, written once."""
    return saved(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes")


def targets(sized: DataFrame, factor: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """sid (code point order, null last), source, source_size, weight and target words of each source.

    The targets share ``factor`` of all words by weight; one that passes
    ``ceiling`` times its source's size stops there and the excess is shared
    again until none is above: target = min(ceiling * size, level * weight) with
    the one level that spends all.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    out = by_source.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("weight", weight.cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    out = out.withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    out = out.withColumn("capped", F.sum("cap").over(order)).withColumn("weighed", F.sum("weight").over(order))
    out = out.withColumn("all_size", F.sum("source_size").over(W.partitionBy())).withColumn("all_weight", F.sum("weight").over(W.partitionBy()))
    # the level if this source and those before it stop at their ceilings; a source does iff the level without it would pass its ceiling
    before = (F.lit(float(factor)) * F.col("all_size") - (F.col("capped") - F.col("cap"))) / (F.col("all_weight") - (F.col("weighed") - F.col("weight")))
    out = out.withColumn("before", before).withColumn("stops", F.col("before") * F.col("weight") >= F.col("cap"))
    out = out.withColumn("level", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("before")))).over(W.partitionBy())["before"])
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return out.select("sid", "source", "source_size", "weight", target.alias("target"))


def quotas(sources: DataFrame, block: int) -> DataFrame:
    """With the number of blocks, and of slots of the mix that the target asks for, of each source."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(2 * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(0)
    return sources.withColumn("blocks", blocks).withColumn("quota", quota)


def draws(sources: DataFrame, shard_slots: int, salt: int = 31) -> DataFrame:
    """shard, sid and n: how often each shard draws each source, multinomially (``sources`` is of quotas()). A shard has
    ``shard_slots`` slots, the last one the rest; a slot's hash, from 0 to P - 1, falls in the range of one source."""
    spark = sources.sparkSession
    n, n_sources = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    share = sources.where("quota > 0").withColumn("hi", F.sum("quota").over(W.orderBy("sid")))
    edge = lambda c: F.floor(F.col(c) / F.lit(float(max(n, 1))) * P).cast("long")
    share = share.withColumn("lo", F.col("hi") - F.col("quota")).select("sid", edge("lo").alias("from"), edge("hi").alias("to"))
    width = P // BINS + 1
    binned = share.where("to > from").withColumn("bin", F.explode(F.expr(f"sequence(`from` div {width}, (`to` - 1) div {width})")))
    binned = F.broadcast(binned) if n_sources <= BROADCAST_SOURCES else binned
    drawn = spark.range(n).select(F.expr(f"id div {shard_slots}").alias("shard"), F.expr(mixed("id", salt)).alias("u")).withColumn("bin", F.expr(f"u div {width}"))
    drawn = drawn.join(binned, "bin").where("u >= `from` and u < `to`")
    return drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))


def allotted(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """``sources`` with drawn (slots that the shards drew), kept (of those, up to twice the blocks), spare0 (where a source's
    slots beyond that begin in the row of all such), extra0 and extra (where its share of that row begins, and how many).

    The spare slots go to sources with room, by weight, none above its room: the level that spends them all is found as
    in targets(), and shares are cut at whole slots.
    """
    out = sources.join(counts.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("long"))
    out = out.withColumn("kept", F.least("drawn", 2 * F.col("blocks"))).withColumn("room", 2 * F.col("blocks") - F.col("kept"))
    by_sid, everything, order = W.orderBy("sid"), W.partitionBy(), W.orderBy(F.col("room") / F.col("weight"), "sid")
    out = out.withColumn("spare", F.sum(F.col("drawn") - F.col("kept")).over(everything))
    out = out.withColumn("spare0", F.sum(F.col("drawn") - F.col("kept")).over(by_sid) - (F.col("drawn") - F.col("kept")))
    open_weight = F.when(F.col("room") > 0, F.col("weight")).otherwise(0.0)
    out = out.withColumn("w", open_weight).withColumn("filled", F.sum("room").over(order) - F.col("room")).withColumn("left", F.sum("w").over(everything) - (F.sum("w").over(order) - F.col("w")))
    before = F.when(F.col("w") > 0, (F.col("spare") - F.col("filled")) / F.col("left"))
    out = out.withColumn("before", before).withColumn("fills", F.col("w") * F.col("before") >= F.col("room"))
    out = out.withColumn("level", F.min(F.when(~F.col("fills"), F.struct(F.col("room") / F.col("weight"), F.col("sid"), F.col("before")))).over(everything)["before"])
    share = F.when(F.col("w") == 0, 0.0).when(F.col("fills"), F.col("room").cast("double")).otherwise(F.coalesce("level", F.lit(0.0)) * F.col("w"))
    out = out.withColumn("share", share).withColumn("upto", F.round(F.sum("share").over(by_sid)).cast("long"))
    out = out.withColumn("extra0", F.coalesce(F.lag("upto").over(by_sid), F.lit(0).cast("long"))).withColumn("extra", F.least(F.col("upto") - F.col("extra0"), F.col("room")))
    return out.select(*sources.columns, "drawn", "kept", "spare0", "extra0", "extra")


def slots(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """shard, sid, rank and block of every slot of the mix (``sources`` is of allotted(), ``counts`` of draws())."""
    n = sources.agg(F.coalesce(F.sum("drawn"), F.lit(0))).first()[0]
    # a source's slots are numbered over the shards; those from kept on are spare
    ranked = counts.withColumn("first", F.sum("n").over(W.partitionBy("sid").orderBy("shard")) - F.col("n")).join(sources.select("sid", "kept", "spare0"), "sid")
    ranked = ranked.withColumn("own", F.greatest(F.lit(0), F.least(F.col("n"), F.col("kept") - F.col("first"))))
    # few rows here stand for many slots: dealt anew, or a task or two would make them all
    own = ranked.where("own > 0").repartition(n // SLOTS_A_TASK + 1, "shard", "sid").select("shard", "sid", F.explode(F.expr("sequence(first, first + own - 1)")).alias("rank"))
    spare = ranked.where("n > own").select("shard", F.explode(F.expr("sequence(spare0 + first + own - kept, spare0 + first + n - 1 - kept)")).alias("i"))
    taker = sources.where("extra > 0").select("sid", "kept", "extra0", F.explode(F.expr("sequence(extra0, extra0 + extra - 1)")).alias("i"))
    moved = taker.join(spare, "i").select("shard", "sid", (F.col("kept") + F.col("i") - F.col("extra0")).alias("rank"))
    out = own.unionByName(moved).join(sources.select("sid", "blocks"), "sid")
    out = out.withColumn("index", F.expr("rank % blocks"))

    def step(name, sql):
        nonlocal out
        out = out.withColumn(name, F.expr(sql))

    permuted(step, "index", "blocks", "sid")
    return out.select("shard", "sid", "rank", "block")


def placed(sized: DataFrame, sources: DataFrame, docs_a_bucket: int = 1024) -> DataFrame:
    """Each document's place on its source's word axis: sid, bucket, rn (together unique), start.

    A source's documents are ordered by (bucket, doc_id) with buckets of about
    ``docs_a_bucket`` documents, so that no window holds a whole source.
    """
    buckets = sized.count() // docs_a_bucket + 1
    bucket = F.expr(f"pmod({mixed(f'pmod(coalesce(doc_id, 0), {P})', 5)}, {buckets})")
    ids = sources.select("sid", F.col("source").alias("s"))
    ids = F.broadcast(ids) if sources.count() <= BROADCAST_SOURCES else ids
    out = sized.join(ids, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", bucket)
    within = W.partitionBy("sid", "bucket").orderBy("doc_id", "size", "tie")
    out = out.withColumn("rn", F.row_number().over(within)).withColumn("within", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    # what stands before a bucket: first over groups of buckets, then within each
    by_bucket = out.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).withColumn("group", F.expr(f"bucket div {GROUP}"))
    by_group = by_bucket.groupBy("sid", "group").agg(F.sum("words").alias("all"))
    by_group = by_group.withColumn("earlier", F.sum("all").over(W.partitionBy("sid").orderBy("group")) - F.col("all")).drop("all")
    by_bucket = by_bucket.withColumn("before", F.sum("words").over(W.partitionBy("sid", "group").orderBy("bucket")) - F.col("words")).join(by_group, ["sid", "group"])
    by_bucket = by_bucket.select("sid", "bucket", (F.col("before") + F.col("earlier")).alias("before"))
    return out.join(by_bucket, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def pieces(docs_placed: DataFrame, times: DataFrame, block: int) -> DataFrame:
    """sid, bucket, rn, at (first word within the document), words and times of each run of words that the mix takes."""
    runs = docs_placed.where("size > 0").select("sid", "bucket", "rn", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    runs = runs.withColumn("at", F.greatest(F.lit(0), F.col("block") * block - F.col("start")))
    runs = runs.withColumn("words", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")) - F.col("at"))
    return runs.join(times, ["sid", "block"]).select("sid", "bucket", "rn", "at", "words", "times")


def _laid_out(docs: DataFrame, block: int, shard_slots: int, factor: float, salt: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources with what they are allotted, documents on their source's word axis, and how often the mix takes each block."""
    sized = sizes(docs)
    asked = saved(quotas(targets(sized, factor), block), "mix-asked")
    counts = saved(draws(asked, shard_slots, salt), "mix-draws")
    sources = saved(allotted(asked, counts), "mix-sources")
    at = saved(placed(sized, sources), "mix-placed")
    return sources, at, slots(sources, counts).groupBy("sid", "block").agg(F.count("*").alias("times"))


def mix(docs: DataFrame, block: int = 32, shard_slots: int = 65_536, factor: float = 1.5, salt: int = 31) -> DataFrame:
    """doc_id, size, source_size, target, taken, drawn of every row of ``docs``; drawn is the number of slots that the shards
    drew of the row's source.

    Null texts and texts without words have size 0 and take 0. A null source is
    a source of its own, the last. Rows that repeat a doc_id are documents of
    their own. An empty table gives no rows. Other columns play no part. Another
    ``salt`` gives another draw. ``block`` times 2**46 must exceed the words of
    the largest source.
    """
    sources, at, times = _laid_out(docs, block, shard_slots, factor, salt)
    taken = pieces(at, times, block).groupBy("sid", "bucket", "rn").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    small = sources.select("sid", "source_size", "target", "drawn")
    out = at.join(taken, ["sid", "bucket", "rn"], "left").join(small, "sid")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "drawn")


def mixed_documents(docs: DataFrame, block: int = 32, shard_slots: int = 65_536, factor: float = 1.5, salt: int = 31) -> DataFrame:
    """The mix as documents: a row for each document of which it takes words, with those words as its text.

    Runs of words stand in their order in the document, each as often as the mix
    takes it, joined by spaces; documents that it takes no word of go, and so do
    null and wordless texts. Rows that repeat a doc_id are documents of their
    own. An empty table gives no rows. Columns as in ``docs``; n_chars, if there
    is one, is that of the new text.
    """
    columns = docs.columns
    _, at, times = _laid_out(docs, block, shard_slots, factor, salt)
    runs = pieces(at, times, block).groupBy("sid", "bucket", "rn").agg(F.sort_array(F.collect_list(F.struct("at", "words", "times"))).alias("runs"))
    keys = at.join(runs, ["sid", "bucket", "rn"]).select(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("tie").alias("k_tie"), "runs")
    # rows alike in doc_id, source and text are told apart by their number; the row's own columns stay in a struct, so none can clash
    alike = W.partitionBy("k_id", "k_source", "k_tie").orderBy("runs")
    keys = keys.withColumn("k_n", F.row_number().over(alike))
    told = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row")).withColumn("tie", F.xxhash64("row.text"))
    told = told.withColumn("m", F.row_number().over(W.partitionBy("row.doc_id", "row.source", "tie").orderBy(F.lit(1))))
    on = F.col("row.doc_id").eqNullSafe(F.col("k_id")) & F.col("row.source").eqNullSafe(F.col("k_source")) & (F.col("tie") == F.col("k_tie")) & (F.col("m") == F.col("k_n"))
    # the words are bound once; named in a lambda, they would be split anew for every run
    words = r"filter(split(row.text, '[\\x20\\x09-\\x0D]+'), w -> w != '')"
    run = "flatten(array_repeat(slice(ws, cast(r.at + 1 as int), cast(r.words as int)), cast(r.times as int)))"
    text = F.expr(f"element_at(transform(array({words}), ws -> array_join(flatten(transform(runs, r -> {run})), ' ')), 1)")
    out = told.join(keys, on)
    out = out.withColumn("text", text)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in columns])
