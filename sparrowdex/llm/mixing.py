"""Mixing sources to target weights: packed blocks, multinomial draws, pseudorandom index permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, saved, table, whole

#: Words in a block, slots in an output shard, times a source may be passed over at most.
BLOCK, SHARD, MOST = 64, 4096, 3
#: Rounds of the index permutation, documents in one prefix-sum bucket on average, strata in one range of the draws.
ROUNDS, BUCKET, RANGE = 24, 2000, 1 << 16
#: Shards in one run of a prefix sum over shards.
RUN = 1024
SEED = 20240229


def permuted(index: Column, n: Column, salt: Column, inverse: bool = False) -> Column:
    """Pseudorandom permutation of [0, n) at `index`, for any n: a swap-or-not shuffle keyed by `salt`.

    Each round pairs x with k - x (mod n) and swaps the two or not by a hash of the larger, so a round is its own inverse.
    """
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def shuffled(key: Column) -> Column:
        def step(x: Column, r: Column) -> Column:
            partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
            return F.when(F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

        return F.aggregate(rounds, index.cast("long"), step)

    # a lambda's variable: the salt is hashed once, not in each round
    return F.element_at(F.transform(F.array(F.xxhash64(salt, F.lit(SEED))), shuffled), 1)


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, source_size -> these, weight and target: the words that the mix takes from each source.

    Sources by code point, null last, weigh `weights` in turn and share all words; a target stops at MOST times its source, and the
    excess is shared by weight again until none is above. That is min(MOST * size, level * weight): with sources by
    size over weight, the level is what the sources above a source leave over their weights, once it fits under the next cap.
    One row per source: windows over all of them are small.
    """
    named = sources.withColumn("_k", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
    named = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_k") - 1, F.lit(len(weights))) + 1).cast("int")))
    named = named.withColumn("_cap", F.col("source_size") * F.lit(float(MOST))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    up = W.orderBy("_ratio", "_k")
    below = up.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = named.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
    named = named.withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    named = named.withColumn("_level", F.col("_left") / F.col("_open"))
    named = named.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_k", "_level"))).over(every)["_level"])
    level = F.coalesce(F.col("_level"), F.lit(0.0))
    return named.select("source", "source_size", "weight", F.least("_cap", level * F.col("weight")).alias("target"))


def packed(docs: DataFrame) -> DataFrame:
    """doc rows (row, source, size) -> the same with `start`, the word offset in the stream of the source, in a pseudorandom order of rows.

    A prefix sum in two levels: hash buckets of some BUCKET rows, then rows in a bucket. No source's rows meet in one task.
    """
    buckets = max(1, docs.count() // BUCKET)
    b = docs.withColumn("_b", F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(buckets)))
    at = prefix(b.groupBy("source", "_b").agg(F.sum("size").alias("_s")), ["source"], "_b", "_s", "_at")
    own = W.partitionBy("source", "_b").orderBy(F.xxhash64("row", F.lit(SEED + 1)), "row").rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return b.alias("b").join(at.alias("a"), b["source"].eqNullSafe(at["source"]) & (b["_b"] == at["_b"])).select("b.row", "b.source", "b.size", (F.col("b._own") + F.col("a._at")).alias("start"))


def plan(goal: DataFrame) -> DataFrame:
    """Per source: blocks, n_slots (output slots that it fills), last_words (what the last slot takes), first_slot.

    `passes` whole passes over the source's blocks, then as many blocks of one more pass as the rest of the target takes.
    """
    p = goal.where("source_size > 0").withColumn("_want", F.round("target").cast("long"))
    p = p.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    p = p.withColumn("passes", F.expr("_want div source_size")).withColumn("_rest", F.expr("_want % source_size"))
    p = p.withColumn("_more", F.ceil(F.col("_rest") / BLOCK).cast("long"))
    p = p.withColumn("last_words", F.when(F.col("_more") > 0, F.col("_rest") - (F.col("_more") - 1) * BLOCK).otherwise(F.lit(BLOCK)))
    p = p.withColumn("n_slots", F.col("passes") * F.col("blocks") + F.col("_more"))
    before = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(before), F.lit(0)))
    return p.select("source", "blocks", "passes", "n_slots", "last_words", "first_slot").where("n_slots > 0")


def prefix(df: DataFrame, keys: list[str], index: str, value: str, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over rows of the same keys (null is a key) with a smaller `index`. In runs of RUN indexes and then over runs, so that no key's rows meet in one task."""
    d = df.withColumn("_run", F.floor(F.col(index) / RUN))
    runs = d.groupBy(*keys, "_run").agg(F.sum(value).alias("_r"))
    runs = runs.withColumn("_before", F.coalesce(F.sum("_r").over(W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_r")
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(W.partitionBy(*keys, "_run").orderBy(index).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    on = [d[k].eqNullSafe(runs[k]) for k in keys] + [d["_run"] == runs["_run"]]
    return d.join(runs, on).select(*[d[c] for c in df.columns], (F.col("_in") + F.col("_before")).alias(name))


def draws(spark, spread: DataFrame, total: int) -> DataFrame:
    """slot, source: every output slot draws a stratum of [0, total) with replacement, and so the source whose share holds it. A shard's counts by source are a multinomial draw.

    Slots and the starts of the sources' shares meet by ranges of RANGE strata and are merged there in order.
    """
    slot = spark.range(0, total, numPartitions=max(1, min(100_000, total // (4 * RANGE)))).select(F.col("id").alias("slot"), F.pmod(F.xxhash64("id", F.lit(SEED + 2)), F.lit(total)).alias("at"))
    slot = slot.select(F.expr(f"at div {RANGE}").alias("range"), "at", "slot", F.lit(None).cast("struct<source:string>").alias("own"))
    share = spread.select(F.explode(F.expr(f"sequence(first_slot div {RANGE}, (first_slot + n_slots - 1) div {RANGE})")).alias("range"), "first_slot", F.struct("source").alias("own"))
    share = share.select("range", F.greatest(F.col("first_slot"), F.col("range") * RANGE).alias("at"), F.lit(None).cast("long").alias("slot"), "own")
    last = F.last("own", True).over(W.partitionBy("range").orderBy("at", F.col("slot").isNotNull()).rowsBetween(W.unboundedPreceding, 0))
    return slot.unionByName(share).withColumn("own", last).where("slot IS NOT NULL").select("slot", F.col("own.source").alias("source"))


def slots(spark, spread: DataFrame) -> DataFrame:
    """The output: one row per slot (shard, place, source, block, pass, words).

    Each shard draws its multinomial counts by source (see draws). A source's slots are numbered through all shards; where a source was drawn
    more often than its target takes, its last slots go to the sources that were drawn too seldom, in order. So totals meet the
    targets, and few slots are not as drawn. A slot's number in its source is sent through the source's own permutation of
    block indices, so each pass takes each block once.
    """
    total = spread.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    if not total:
        return spread.select(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("place"), "source", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("pass"), F.lit(0).cast("long").alias("words")).limit(0)
    drawn_ = saved(draws(spark, spread, total).withColumn("shard", F.expr(f"slot div {SHARD}")))
    counts = prefix(drawn_.groupBy("source", "shard").agg(F.count("*").alias("n")), ["source"], "shard", "n", "before")
    own = F.row_number().over(W.partitionBy("shard", "source").orderBy("slot"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ranked = drawn_.withColumn("own", own)
    ranked = ranked.join(counts, same(ranked, counts) & (ranked["shard"] == counts["shard"])).select(ranked["slot"], ranked["shard"], ranked["source"], (F.col("before") + F.col("own") - 1).alias("rank"))
    ranked = saved(ranked.join(spread, same(ranked, spread)).select(ranked["slot"], ranked["shard"], ranked["source"], "rank", (F.col("rank") < F.col("n_slots")).alias("kept")))
    # slots drawn too often and ranks drawn too seldom, each numbered in order: they are as many
    few = ranked.where("NOT kept")
    free = prefix(few.groupBy("shard").agg(F.count("*").alias("n")), [], "shard", "n", "before")
    free = few.join(free, "shard").select("slot", (F.col("before") + F.row_number().over(W.partitionBy("shard").orderBy("slot")) - 1).alias("i"))
    got = drawn_.groupBy("source").agg(F.count("*").alias("got"))
    short = spread.join(got, same(spread, got), "left").select(spread["source"], "first_slot", "n_slots", F.coalesce("got", F.lit(0)).alias("got")).where("got < n_slots")
    short = short.withColumn("from", F.coalesce(F.sum(F.col("n_slots") - F.col("got")).over(W.orderBy("first_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    step = RANGE
    short = short.withColumn("lo", F.explode(F.expr(f"sequence(got, n_slots - 1, {step}L)"))).repartition("source", "lo")
    short = short.withColumn("rank", F.explode(F.expr(f"sequence(lo, least(lo + {step}L, n_slots) - 1)"))).select("source", "rank", (F.col("from") + F.col("rank") - F.col("got")).alias("i"))
    filled = free.join(short.hint("shuffle_merge"), "i").select("slot", "source", "rank")
    s = ranked.where("kept").select("slot", "source", "rank").unionByName(filled)
    size = spread.select("source", "blocks", "n_slots", "last_words")
    s = s.join(size, same(s, size)).select(s["slot"], s["source"], "rank", "blocks", "n_slots", "last_words", F.expr("rank div blocks").alias("pass"))
    salt = F.concat(F.lit("b"), F.coalesce(F.col("source"), F.lit("")), F.col("pass").cast("string"))
    s = s.withColumn("block", permuted(F.expr("rank % blocks"), F.col("blocks"), salt))
    words = F.when(F.col("rank") == F.col("n_slots") - 1, F.col("last_words")).otherwise(F.lit(BLOCK))
    return s.select(F.expr(f"slot div {SHARD}").alias("shard"), F.expr(f"slot % {SHARD}").alias("place"), "source", "block", "pass", words.alias("words"))


def segments(streams: DataFrame) -> DataFrame:
    """packed rows -> one row per document and block that it has words in: row, source, size, block, lo (first word in the block), n, doc_from (first word in the document)."""
    s = streams.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")))
    lo = F.greatest(F.col("start"), F.col("block") * BLOCK)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return s.select("row", "source", "size", "block", (lo - F.col("block") * BLOCK).alias("lo"), (hi - lo).alias("n"), (lo - F.col("start")).alias("doc_from"))


def drawn(segs: DataFrame, out: DataFrame) -> DataFrame:
    """Joins blocks by index: one row per slot and document in its block, with the words `take` it takes of that document's segment."""
    key = [F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none")]
    a, b = segs.select("row", "size", "block", "lo", "n", "doc_from", *key), out.select("shard", "place", "block", "pass", "words", *key)
    # slots come from a few rows by explode, so Spark takes them for small: never broadcast them
    met = a.join(b.hint("shuffle_merge"), ["_name", "_none", "block"]).withColumn("take", F.least(F.col("n"), F.col("words") - F.col("lo")))
    return met.where("take > 0").drop("_name", "_none")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row and doc (the whole row of docs, as a struct: whatever its columns are called). `row` is a key of its own for each row, the same in each run over the same rows.

    That is (id, hash of text and source, rank among rows that have both in common). Ranks take a sort, so only tables with such rows get it.
    """
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    d = docs.select(whole(docs), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text, source, text.isNull(), source.isNull()).alias("h"))
    twins = d.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    again = F.row_number().over(W.partitionBy("id", "h").orderBy(F.xxhash64("doc"))) if twins else F.lit(1)
    return d.select(F.struct("id", "h", again.alias("again")).alias("row"), "doc")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, row (see keyed), source, size in words; written once."""
    d = keyed(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{source_col}`").cast("string").alias("source")), "id", "text", "source")
    words = F.coalesce(F.regexp_count(F.col("doc.text"), F.lit(WORD)), F.lit(0)).cast("long")
    return saved(d.select("doc.id", "row", "doc.source", words.alias("size")))


def mixed(spark, sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sizes (see sized) -> targets, document segments and output slots."""
    goal = saved(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))))
    return goal, segments(packed(sizes.select("row", "source", "size"))), slots(spark, plan(goal))


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    """All rows of documents with the words the mix takes from each.

    A null or empty text has size 0 and takes nothing; a null source is a source of its own; equal rows are packed and taken as separate rows,
    as are rows that share a doc_id or have none. Columns besides doc_id, text and source are not read. An empty table gives no rows.
    """
    sizes = sized(table(spark, sf_dir, "documents"))
    goal, segs, out = mixed(spark, sizes)
    took = drawn(segs, out).groupBy("row").agg(F.sum("take").alias("taken"))
    g = goal.alias("g")
    full = sizes.join(took, "row", "left").alias("s").join(g, F.col("s.source").eqNullSafe(F.col("g.source")), "left")
    return full.select(
        F.col("s.id").alias("doc_id"), F.col("s.size").alias("size"), F.col("g.source_size").cast("long").alias("source_size"),
        F.col("g.target").alias("target"), F.coalesce("s.taken", F.lit(0)).cast("long").alias("taken"),
    )
