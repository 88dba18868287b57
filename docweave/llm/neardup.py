"""Near-duplicate documents: tensored MinHash banding, exact verification, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop, map_texts, spread_join

#: Words of a shingle, least similarity in hundredths.
SHINGLE, LEAST = 5, 75
#: Each of the two collections has so many half keys of so many minhashes. A pair at the least similarity 0.75 agrees
#: in a half key with probability 0.42, so it shares a table key but for 2 * 0.58**20 = 0.00004 of cases.
HALVES, WIDTH = 20, 3

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = (1 << 64) - 1


def _mixed(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, np.uint64)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of text: runs of size words, or all words if fewer."""
    import xxhash

    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begins = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    k = min(size, len(words))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(joined[a:b]) for a, b in zip(begins, ends[k - 1 :], strict=False)), np.uint64, len(words) - k + 1)
    return np.unique(hashes)


def half_keys(shingles: np.ndarray, halves: int, width: int) -> np.ndarray:
    """2 * halves keys, each mixed from width minhashes and its place; the lowest bit tells the collection."""
    n = 2 * halves * width
    a, b = _mixed(n, 1)[:, None], _mixed(n, 2)[:, None]
    least = np.full(n, _MASK, np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (a * shingles[None, at : at + 1024] + b).min(axis=1))
    key = (least.reshape(2 * halves, width) * _mixed(n, 3).reshape(2 * halves, width)).sum(axis=1, dtype=np.uint64)
    key = (key ^ (key >> np.uint64(31))) * _mixed(2 * halves, 4)
    key ^= key >> np.uint64(29)
    side = (np.arange(2 * halves) >= halves).astype(np.uint64)
    return (key & np.uint64(_MASK - 1)) | side


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set."""
    import xxhash

    f = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(f[:8], "big", signed=True), int.from_bytes(f[8:], "big", signed=True)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, halves: int = HALVES, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, f1, f2, keys) for each row: f1 and f2 are a 128-bit fingerprint of the whole set."""

    def make():
        def compute(texts):
            out = {"n_shingles": [], "f1": [], "f2": [], "keys": []}
            for t in texts:
                s = shingle_set(t, shingle)
                f1, f2 = fingerprint(s)
                out["n_shingles"].append(len(s))
                out["f1"].append(f1)
                out["f2"].append(f2)
                out["keys"].append(half_keys(s, halves, width).view(np.int64) if len(s) else [])
            return out

        return compute

    return map_texts(docs, id_col, text_col, {"n_shingles": "bigint", "f1": "bigint", "f2": "bigint", "keys": "array<bigint>"}, make, binary=True)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, f1, f2, shingles array<bigint>) for each row; f1 and f2 as in signatures()."""

    def make():
        def compute(texts):
            sets = [shingle_set(t, shingle) for t in texts]
            marks = [fingerprint(s) for s in sets]
            return {"f1": [f for f, _ in marks], "f2": [f for _, f in marks], "shingles": [s.view(np.int64) for s in sets]}

        return compute

    return map_texts(docs, id_col, text_col, {"f1": "bigint", "f2": "bigint", "shingles": "array<bigint>"}, make, binary=True)


def similar(inter: Column, a: Column, b: Column, least: int) -> Column:
    return 100 * inter >= least * (a + b - inter)


def verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; pairs: a table of cut(), sets: (node, n, shingles).

    A node of many pairs is dealt to several tasks: by v the sizes and the hubs' sets are copied there, by u each set goes once a pair.
    """
    sizes = sets.select("node", "n")
    # the sizes alone already rule out most wrong pairs, before any set is moved
    near = spread_join(pairs, sizes.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v")
    near = cut(near.join(sizes.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u").where((100 * F.least("nu", "nv") >= least * F.greatest("nu", "nv"))))
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    inter = F.size(F.array_intersect("su", "sv"))
    out = cut(spread_join(near, right, "v").join(left, "u").where(similar(inter, F.col("nu"), F.col("nv"), least)).select("u", "v"))
    drop(near)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (u, v): comp is the smallest node that is reachable.

    Large-star and small-star steps, each a grouped minimum and a join, until the edges stay the same. A node of many edges
    is dealt to several tasks in the joins; the minima are combined before they are moved.
    Every step is written to the shared folder, and only a count and a checksum reach the driver.
    """
    now, last = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
        both = cut(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(spread_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        after = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        drop(now, both, large)
        now = after
    out = now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    out = cut(out)
    drop(now)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: int = LEAST, halves: int = HALVES, width: int = WIDTH
) -> DataFrame:
    """Returns (id_col, n_shingles, component_id, kept) for each row of docs.

    1. One pass over the texts makes each document's set fingerprint and two collections of half keys.
       Documents of equal sets form a class; its smallest id stands for it from here on.
    2. Tensored banding: a table key is a half key of one collection with one of the other, so 2 * halves
       half keys give halves**2 tables. Half keys that a single class has can be in no shared table key, so they go first.
    3. In each table, every class is paired with the smallest one there, and the pairs are confirmed on the full sets.
    4. Where a table holds classes that are still in different components, those classes are joined exactly: each has its
       rarest shingles as a prefix that any similar set must meet, and pairs from different components that meet are confirmed.
       No candidates are dropped, and no table's classes are paired with each other.

    Shingles are 64-bit hashes and sets are told apart by 128 bits, so two that differ count as equal with a chance of about 1e-19 a pair of shingles.
    Words are split at ASCII white space and A-Z lower-cased. Null or empty texts have no shingles and are in a
    component of their own. Rows with a null id are in no component (null, kept false). Repeated rows each get
    the same result. Of several texts under one id that all have the smallest id of their class, the one of the least fingerprint stands for
    it in links; the others are linked to equal sets only. An empty table gives an empty table. Other columns aren't read.
    Tables of steps in between are removed, but for three that the result is read from.
    """
    sig = cut(signatures(docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_body")), "_key", "_body", shingle, halves, width))
    full = sig.where("n_shingles > 0 and _key is not null")
    classes = cut(full.groupBy("f1", "f2").agg(F.min("_key").alias("node")))
    first = classes.groupBy("node").agg(F.min(F.struct("f1", "f2")).alias("f")).select("node", "f.f1", "f.f2")
    reps = full.join(first, ["f1", "f2"]).where("_key = node").select("node", "n_shingles", "keys").dropDuplicates(["node"])
    halved = reps.select("node", F.explode("keys").alias("key"))
    shared = halved.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    live = halved.join(shared, "key").groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most 2 * halves
    one, two = F.filter("keys", lambda k: k.bitwiseAND(F.lit(1)) == 0), F.filter("keys", lambda k: k.bitwiseAND(F.lit(1)) == 1)
    tables = live.select("node", one.alias("one"), two.alias("two")).where("size(one) > 0 and size(two) > 0")
    tables = cut(tables.select("node", F.explode("one").alias("one"), "two").select("node", "one", F.explode("two").alias("two")).select("node", F.xxhash64("one", "two").alias("key")))
    hubs = tables.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    stars = cut(tables.join(hubs, "key").where("node > hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct())
    nodes = stars.select(F.col("u").alias("node")).union(stars.select("v")).distinct().join(first, "node")
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("_body")).join(nodes.hint("shuffle_hash"), "node")
    sets = shingle_sets(texts.select(F.struct("node", "f1", "f2").alias("of"), "_body"), "of", "_body", shingle).where("of.f1 = f1 and of.f2 = f2")
    sets = cut(sets.select("of.node", F.size("shingles").cast("long").alias("n"), "shingles").dropDuplicates(["node"]))
    edges = verified(stars, sets, least)
    comps = components(edges)

    # classes that share a table with another component
    where = sets.select("node").join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    open_keys = tables.join(where, "node").groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
    rest = cut(tables.join(open_keys, "key").select("node").distinct().join(where, "node"))
    meets = cut(prefixes(sets.join(rest.select("node"), "node", "left_semi"), least).join(rest, "node"))
    mixed = meets.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token")
    both = meets.join(mixed, "token")
    left = both.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * 2 * least / (100 + least)) + 1)
    left = left.select("token", F.col("node").alias("u"), F.col("comp").alias("cu"), F.col("n").alias("nu"), F.col("rank").alias("ru"))
    right = both.select("token", F.col("node").alias("v"), F.col("comp").alias("cv"), F.col("n").alias("nv"), F.col("rank").alias("rv"))
    order = (F.col("nu") < F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))
    # what two sets can still share after their first common shingle must reach what the similarity asks for
    room = (1 + F.least(F.col("nu") - F.col("ru"), F.col("nv") - F.col("rv"))) * (100 + least) >= least * (F.col("nu") + F.col("nv"))
    likely = left.join(right, "token").where("cu <> cv").where(order & (100 * F.col("nu") >= least * F.col("nv")) & room)
    pairs = cut(likely.select("u", "v").distinct())
    more = verified(pairs, sets, least)
    if not more.isEmpty():
        drop(comps)
        comps = components(edges.unionByName(more))
    drop(tables, stars, sets, edges, rest, meets, pairs, more)
    named = classes.join(comps, "node", "left").select("f1", "f2", F.coalesce("comp", "node").alias("_comp"))
    out = sig.join(named, ["f1", "f2"], "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("_comp")).otherwise(F.col("_key"))
    comp = F.when(F.col("_key").isNotNull(), comp)
    return out.select(F.col("_key").alias(id_col), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("_key") == comp, F.lit(False)).alias("kept"))


def prefixes(sets: DataFrame, least: int) -> DataFrame:
    """(node, n, token, rank): of each set its n - ceil(least * n / 100) + 1 rarest shingles (ties by value).

    Two sets of at least that similarity share a shingle of both prefixes, as all are in the same order. For the
    smaller of the two, n - ceil(2 * least * n / (100 + least)) + 1 of them are enough.
    """
    tokens = sets.select("node", "n", F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("node").orderBy("df", "token")
    ranked = tokens.join(counts, "token").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least / 100) + 1).select("node", "n", "token", "rank")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.c + y.c - k)),
r(u, v) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT w.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
