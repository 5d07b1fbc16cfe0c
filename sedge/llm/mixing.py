"""Mixing sources to target weights with DataFrame functions only.

Words (the tokens here) are packed into blocks of `block_words` words, source by source. Every output shard draws how
many of its slots go to each source; a source's slots are numbered, and its slot number k takes the
block at position perm(k mod n) of the source's n blocks, where perm is a pseudorandom permutation keyed by the seed,
the source and the pass k div n. Slots and blocks then meet in a join on (source, block).

The draw: a keyed permutation of all slots deals the sources' shares out, so that shard counts are those of
independent multinomial draws per shard, given the totals over all shards (a multivariate hypergeometric law). A source's
count in a shard of S slots varies by about sqrt(S p (1 - p)), while its total is its target's number of slots, which
independent draws would miss by chance. A slot's number among its source's slots is its place in the source's share:
nothing is counted or shuffled to draw. Slots beyond twice a source's blocks are not filled, so that no document is taken
more than twice.

Sources may be many: they are numbered and their intervals summed by ranges, the water level of their targets comes from
rounds of sums of which only totals reach the driver, and slots meet the sources of their cell.

Packing needs the running number of words before each document. Documents are dealt into many buckets per source by a
hash; the running sum is taken inside buckets, and bucket totals are summed in a second, short pass, so that a source
with a third of all rows is spread like any other.

Defined results: null and wordless texts have size 0 and taken 0; a null source is a source of its own, last in order;
repeated rows count and return one by one; an empty table, or one without words, takes nothing. Everything is a
function of the rows and the seed, so that reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut

WEIGHTS = (3.0, 1.0, 2.0)
#: Words per block and slots per shard.
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
#: Slots per task when they are mapped to blocks, and tasks at most (slots are streamed, whatever their number).
TASK_SLOTS, MOST_TASKS = 200_000, 20_000
#: Rounds of a permutation of blocks, and of that of all slots: each round doubles the shifts that neighbours may take.
ROUNDS, DRAW_ROUNDS = 12, 20
#: Sources up to which their table is broadcast; more are joined by shuffles.
BROADCAST_SOURCES = 20_000
#: Cells of the slots by which they find their source: at least, and per source.
LEAST_CELLS = 1024
SOURCE_CELLS = 2
#: Wanted slots are summed as whole numbers of this unit, so that sums don't depend on their order.
UNIT = 1 << 20


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _running(rows: DataFrame, amount: str, name: str, *order: Column) -> DataFrame:
    """rows with the sum of amount over the rows before, in ranges: inside each, and shifted by one sum per range."""
    sums = rows.groupBy("range").agg(F.sum(amount).alias("here"))
    ahead = sums.select("range", F.coalesce(F.sum("here").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, inside).join(F.broadcast(ahead), "range").withColumn(name, F.col(name) + F.col("ahead")).drop("ahead")


def source_table(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Sources (source, n, docs) with number, target (shares of `share` times all sizes by repeating weights, none above `most` times its source's size), blocks, buckets and interval [slot_from, slot_to) of the permuted slots."""
    spark = sizes.sparkSession
    order = (F.col("source").isNull(), F.col("source"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(sizes.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    numbered = _running(ranged.withColumn("one", F.lit(1)), "one", "s", *order).drop("one").withColumn("s", F.col("s").cast("int"))
    numbered = cut(numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("s") % len(weights) + 1)).withColumn("limit", F.col("n") * F.lit(float(most))))
    whole = numbered.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    budget = share * (whole["n"] or 0)
    left, total, capped = budget, whole["weight"] or 0.0, -1
    # Every round caps the sources that the level overflows and raises the level for the rest.
    while True:
        over = F.lit(left) * F.col("weight") / F.lit(total) > F.col("limit") if total else F.lit(True)
        found = numbered.agg(F.count_if(over).alias("k"), F.sum(F.when(over, F.col("limit"))).alias("limit"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if found["k"] == capped or not total:
            break
        capped, left, total = found["k"], budget - (found["limit"] or 0.0), found["weight"] or 0.0
    aimed = numbered.withColumn("target", F.when(over, F.col("limit")).otherwise(F.lit(left) * F.col("weight") / F.lit(total or 1.0)))
    # A block has size / blocks words on average, so this many slots give the target.
    aimed = aimed.withColumn("n_blocks", F.ceil(F.col("n") / block_words)).withColumn("wanted", F.when(F.col("n") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("n") * UNIT)).otherwise(0).cast("bigint"))
    placed = _running(aimed, "wanted", "ahead_of", *order)
    # Rounded sums: shares of slots follow each other without gaps.
    slot_at = lambda x: F.expr(f"({x} + {UNIT // 2}) div {UNIT}")
    return cut(placed.select("source", "s", F.col("n").alias("source_size"), "target", "n_blocks", (F.floor(F.sqrt("docs")) + 1).cast("int").alias("buckets"), slot_at("ahead_of").alias("slot_from"), slot_at("ahead_of + wanted").alias("slot_to")))


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed pseudorandom permutation of 0 .. n - 1, by swap-or-not rounds."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r + 1000, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(rounds - 1).cast("bigint")), index.cast("bigint"), swap)


@dataclass
class Plan:
    """What a mix consists of: documents with their place, the targets, the slots, and the pieces of documents in blocks."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def plan(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> Plan:
    spark = docs.sparkSession
    sized = cut(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), count_words(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("h")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
    sources = source_table(sizes, weights, share, most, block_words)
    totals = sources.agg(F.count("*").alias("n"), F.coalesce(F.max("slot_to"), F.lit(0)).alias("slots")).first()
    small = F.broadcast if totals["n"] <= BROADCAST_SOURCES else lambda x: x

    slots = totals["slots"]
    # Slots and sources meet in cells of the permuted slots, as many as there are sources or more.
    width = max(1, slots // max(LEAST_CELLS, SOURCE_CELLS * totals["n"]))
    cell_of = lambda x: F.expr(f"({x}) div {width}")
    tasks = max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, slots // TASK_SLOTS))
    drawn = spark.range(0, slots, 1, tasks).select(F.expr(f"id div {shard_slots}").alias("shard"), (F.col("id") % shard_slots).alias("slot"), permuted(F.col("id"), F.lit(slots).cast("bigint"), F.lit(seed), F.lit(-1), rounds=DRAW_ROUNDS).alias("place"))
    met = sources.where("slot_to > slot_from").select("s", "n_blocks", "slot_from", "slot_to", F.explode(F.sequence(cell_of("slot_from"), cell_of("slot_to - 1"))).alias("cell"))
    drawn = drawn.withColumn("cell", cell_of("place")).join(small(met), "cell").where("slot_from <= place AND place < slot_to")
    filled = drawn.select("shard", "slot", "s", "n_blocks", (F.col("place") - F.col("slot_from")).alias("k")).where(F.col("k") < most * F.col("n_blocks"))
    block = permuted(F.pmod("k", "n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("s"), F.expr("k div n_blocks"))
    filled = filled.select("shard", "slot", "s", block.alias("block"))

    known = small(sources.select("source", "s", "buckets", "source_size", "target"))
    same = sized["source"].eqNullSafe(known["source"])
    dealt = sized.join(known, same).select("id", "size", "h", "s", "source_size", "target", F.pmod(F.xxhash64("id", "size", "h"), "buckets").alias("bucket"))
    inside = Window.partitionBy("s", "bucket").orderBy("id", "size", "h")
    placed = dealt.withColumn("row", F.row_number().over(inside)).withColumn("start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    ahead = dealt.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    ahead = ahead.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = cut(placed.join(ahead, ["s", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base"))
    first, end = F.col("start"), F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select("s", "bucket", "row", "id", "h", "start", "size", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"))
    low, high = F.greatest(first, F.col("block") * block_words), F.least(end, (F.col("block") + 1) * block_words)
    pieces = pieces.select("s", "block", "bucket", "row", "id", "h", (low - first).alias("word_from"), (high - first).alias("word_to"))
    return Plan(placed, sources, filled, pieces)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken (words of it in the mix, repeats counted)."""
    mix = plan(docs, **options)
    times = mix.slots.groupBy("s", "block").agg(F.count("*").alias("times"))
    words = mix.pieces.join(times, ["s", "block"]).groupBy("s", "bucket", "row").agg(F.sum((F.col("word_to") - F.col("word_from")) * F.col("times")).alias("taken"))
    out = mix.documents.join(words, ["s", "bucket", "row"], "left")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_blocks(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself: shard, slot, source, block and the block's text, its pieces in order joined by blanks.

    Texts are fetched by id and hash, so that repeated ids, null ones included, give every piece once.
    """
    mix = plan(docs, id_column=id_column, text=text, **options)
    words = docs.select(F.col(f"`{id_column}`").alias("id2"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({WORD})")).alias("words")).dropDuplicates(["id2", "h"])
    cutouts = mix.pieces.join(words, (mix.pieces["h"] == words["h"]) & F.col("id").eqNullSafe(F.col("id2"))).select("s", "block", "bucket", "row", F.array_join(F.slice("words", (F.col("word_from") + 1).cast("int"), (F.col("word_to") - F.col("word_from")).cast("int")), " ").alias("piece"))
    text_of = cutouts.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("bucket", "row", "piece"))).alias("parts"))
    text_of = text_of.select("s", "block", F.array_join(F.transform("parts", lambda p: p["piece"]), " ").alias("text"))
    return mix.slots.join(text_of, ["s", "block"]).join(mix.sources.select("s", "source"), "s").select("shard", "slot", "source", "block", "text")
