"""Benchmark decontamination with Spark's own functions: SimHash windows, Hamming blocks, exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of a shingle, least similarity in hundredths.
SHINGLE, LEAST = 5, 75
#: Independent fingerprints of 64 bits, and blocks of each: a window and an item that differ in fewer bits of a fingerprint than it has
#: blocks are equal in a block, so the index finds all pairs within this radius. At similarity 0.75 a bit differs with probability 0.17,
#: a block of 8 bits is then equal with 0.22, and one of the 32 with 0.9997.
FINGERPRINTS, BLOCKS = 4, 8
RADIUS = BLOCKS - 1
#: Windows begin on a grid of this share of the item's size; the exact check then tries all begins near those found.
GRID = 50
#: Rows up to which a table of numbers (at most 64 bytes a row) is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 300_000


def words_of(text: str) -> Column:
    """Lower-cased words between ASCII white space; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def once(value: Column, use) -> Column:
    """use(value) with value bound to a lambda variable, so that no rewriting of the plan evaluates it anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grams_of(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    run = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return once(words, lambda w: F.when(F.size(w) >= k, run(w)).otherwise(F.array().cast("array<bigint>")))


def fingerprints(grams: str, lanes: int) -> Column:
    """FINGERPRINTS SimHashes (array) of a bag of hashes: bit b is set if more than half of its members have it.

    The first occurrence of a hash counts as itself, a later one as a hash of it and its number. So a run of repeats doesn't
    outweigh the rest, and the weighted similarity of two bags is that of two sets. Each fingerprint hashes these anew.
    Its counters are packed in numbers with lanes bits each: bits j, j + lanes and so on are counted in number j.
    """
    unit = sum(1 << k for k in range(0, 64, lanes))
    return F.expr(
        f"""transform(array({grams}), w -> transform(
            array(if(size(array_distinct(w)) = size(w), w, transform(array(array_sort(w)),
                s -> transform(s, (x, i) -> if(i + 1 = array_position(s, x), x, xxhash64(x, i + 1 - array_position(s, x)))))[0])),
            v -> transform(sequence(1, {FINGERPRINTS}), f -> transform(
                array(aggregate(transform(v, x -> xxhash64(x, f)), array_repeat(0L, {lanes}),
                    (acc, h) -> transform(acc, (c, j) -> c + (shiftrightunsigned(h, j) & {unit}L)))),
                n -> aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(
                    (shiftrightunsigned(n[b % {lanes}], b div {lanes} * {lanes}) & {(1 << lanes) - 1}L) * 2 > size(w), shiftleft(1L, b), 0L)))[0]))[0])[0]"""
    )


def blocks(marks: str) -> Column:
    """array(struct(b, bits)) of all blocks of the fingerprints in the column marks."""
    width = 64 // BLOCKS
    at = lambda f, k: F.shiftrightunsigned(F.col(marks)[f], k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    return F.array(*[F.struct(F.lit(f * BLOCKS + k).alias("b"), at(f, k).alias("bits")) for f in range(FINGERPRINTS) for k in range(BLOCKS)])


def _small(df: DataFrame) -> DataFrame:
    """df, of numbers only, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST
) -> DataFrame:
    """Returns (id_col, item_col, similarity, first_word) for each document and item that it holds.

    A document holds an item if some window of it, of as many words as the item, has a weighted Jaccard similarity
    of at least least/100 to it: over shingles of five words (all words for a shorter item), each weighted by
    its occurrences. A document shorter than the item is one window. similarity and first_word (0-based) are the best window's, ties: the first.
    Several texts of one id are looked through one by one.

    1. Windows of an item's size are formed only in documents with enough shingles that some item of that size has, and
       only where such a shingle begins (or where the text ends): moving a window on to its first common shingle loses nothing.
       This says nothing about which item a window may match, and rules out no window that can.
    2. Windows and items get SimHash fingerprints. Those of one size meet in a block of bits (multi-index), which is certain
       within RADIUS bits of a fingerprint, and likely well beyond; items come only from there.
    3. The exact similarity decides, for all begins near the windows that met.

    Null or empty texts and items, and rows with null ids, hold nothing and are held by nothing. Repeated rows count once.
    Columns besides the four aren't read. Main path: DataFrame functions only.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    texts = texts.select("doc", F.xxhash64("text").alias("h"), "text")  # h tells texts of one id apart
    bench = items.select(F.col(item_col).alias("item"), words_of(item_text).alias("words")).where("item is not null and size(words) > 0")
    bench = bench.withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))
    sizes = sorted(r["k"] for r in bench.select("k").distinct().collect())  # 5 values at most
    out = None
    for k in sizes:
        held = _for_size(texts, bench.where(F.col("k") == k).dropDuplicates(["item", "words"]), k, least)
        out = held if out is None else out.unionByName(held)
    if out is None:
        out = texts.join(bench.select("item"), F.lit(False)).select("doc", "item", F.lit(0.0).alias("similarity"), F.lit(0).alias("first_word"))
    best = out.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("neg"))).alias("best"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("best.similarity").alias("similarity"), (-F.col("best.neg")).alias("first_word"))


def _for_size(texts: DataFrame, bench: DataFrame, k: int, least: int) -> DataFrame:
    """(doc, item, similarity, first_word) of the best windows for items whose shingles have k words."""
    items = cut(bench.select("item", grams_of(F.col("words"), k).alias("ig")).withColumn("ng", F.size("ig")).withColumn("i", F.xxhash64("ig")))
    lanes = 16 if (items.agg(F.max("ng")).first()[0] or 0) < 1 << 16 else 32  # bits of a counter; both give the same fingerprints
    copies = items.dropDuplicates(["i"]).select("i", "ng", F.explode("ig").alias("gram")).groupBy("i", "ng", "gram").agg(F.count("*").alias("copies"))
    sizes = copies.groupBy("gram", "ng").agg(F.max("copies").alias("copies"))

    # where a document has shingles of items of a size, and whether they are enough
    grams = texts.select("doc", "h", F.posexplode(grams_of(words_of("text"), k)).alias("at", "gram")).join(_small(sizes), "gram")
    grams = grams.groupBy("doc", "h", "ng", "gram").agg(F.count("*").alias("c"), F.first("copies").alias("copies"), F.collect_list("at").alias("at"))
    met = grams.groupBy("doc", "h", "ng").agg(F.sum(F.least("c", "copies")).alias("w"), F.flatten(F.collect_list("at")).alias("hits"))
    met = cut(met.where(F.col("w") * 100 >= F.col("ng") * least).select("doc", "h", "ng", "hits"))
    few = texts.join(_small(met.select("doc", "h").distinct()), ["doc", "h"], "left_semi").dropDuplicates(["doc", "h"])
    spread = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # forming windows multiplies the work, which bytes don't show
    wide = few.select("doc", "h", grams_of(words_of("text"), k).alias("dg")).join(met, ["doc", "h"]).repartition(spread, "doc", "ng")
    wide = wide.withColumn("last", F.greatest(F.lit(0), F.size("dg") - F.col("ng"))).withColumn("d", F.expr("greatest(1, cast(ng div {} as int))".format(GRID)))
    wide = cut(wide.withColumn("starts", F.expr("array_sort(array_distinct(concat(transform(hits, p -> least(p, last)), array(last))))")).drop("hits"))

    grid = "least(cast((a + d div 2) div d * d as int), last)"
    windows = wide.select("doc", "h", "ng", "dg", F.explode(F.expr(f"array_distinct(transform(starts, a -> {grid}))")).alias("g"))
    windows = windows.select("doc", "h", "ng", "g", fingerprints("slice(dg, g + 1, ng)", lanes).alias("marks"))
    left = windows.select("doc", "h", "ng", "g", F.inline(blocks("marks")))
    right = items.dropDuplicates(["i"]).select("i", "ng", fingerprints("ig", lanes).alias("marks")).select("i", "ng", F.inline(blocks("marks")))
    near = left.join(_small(cut(right)), ["ng", "b", "bits"]).groupBy("doc", "h", "ng", "i").agg(F.collect_set("g").alias("gs"))

    near = near.join(wide, ["doc", "h", "ng"]).join(items, ["i", "ng"])
    bag = "aggregate(array_distinct(ig), 0, (acc, x) -> acc + least(size(filter(ig, y -> y = x)), size(filter(w, y -> y = x))))"
    inter = f"if(size(array_distinct(w)) = size(w) or size(array_distinct(ig)) = size(ig), size(array_intersect(w, ig)), {bag})"
    share = "transform(array(slice(dg, a + 1, ng)), w -> transform(array({}), m -> m / (size(w) + ng - m))[0])[0]".format(inter)
    best = f"array_max(transform(filter(starts, a -> array_contains(gs, {grid})), a -> struct({share} as similarity, -a as neg)))"
    near = near.select("doc", "item", F.expr(best).alias("best")).where(F.col("best.similarity") * 100 >= least)
    return near.select("doc", "item", F.col("best.similarity").alias("similarity"), (-F.col("best.neg")).alias("first_word"))


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), best_similarity (null without items) for each row of docs."""
    found = contaminated(docs, items).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("best_similarity"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "best_similarity")
