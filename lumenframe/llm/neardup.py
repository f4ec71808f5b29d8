"""Near-duplicate documents by a signature-coordinate inverted join.

A document's signature holds the minimum of its shingle set under each of
COORDINATES * ROWS permutations; a pair of similarity s agrees in each with
probability s.  A coordinate is a run of ROWS of them.  Every class of equal sets
is posted under coordinate-value pairs, and collisions are counted: a pair at the
threshold has at least `least_matches` equal coordinates but for a chance of
MISS, so one with fewer is no link.

*Prefix.*  A pair with T of COORDINATES equal coordinates has one among any
COORDINATES - T + 1, so classes are posted under so many only.  *Skip.*  The
lists of the other coordinates are never merged, nor are single minima posted;
both are looked up, as signatures, for what the counted lists leave.  A posting
list is not expanded into all pairs either; the join runs in two rounds:

1. each member of a list collides with the list's first member only.  That counts
   a part of a pair's collisions, those in lists that its one side leads, so any
   such pair has its others looked up and added; pairs with enough equal
   coordinates and minima are confirmed on their full sets, and merge into
   components;
2. collisions inside of a component are skipped: only lists that still hold two
   components count, and a member leaves that has too few of them, or too few
   minima in common with members of other components.  What is left
   is joined by prefixes of the full sets: shingles found in one component only
   come first, then the rarer before the commoner, and a member is posted under
   a shingle only while enough shingles follow it to reach the threshold.  A pair
   needs that on both sides.  Copies that differ from each other a little too
   much use up their prefix on their own changes, so they are never paired,
   however many they are; and no pair that is linked is left out.  Pairs then
   pass the same lookup and confirmation.

Round 1 is a shortcut: what it does not find, round 2 does.

Edge cases: a null, empty or blank text has the empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is one shingle;
equal texts are one class, so ties and repeated rows cost nothing; rows that
share a doc_id but not a text are documents of their own; a null doc_id is
linked with nothing, has a null component and is kept; an empty table gives an
empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, stream, table
from .graph import components
from .shingles import Minima, fingerprint, shingle_set

#: Coordinates of a signature, minima of each, and the greatest chance to miss a pair at the threshold by any one count.
COORDINATES, ROWS, MISS = 28, 3, 1e-7
MINIMA = COORDINATES * ROWS


def least_matches(share: float, count: int) -> int:
    """Greatest h with P(Binomial(count, share) < h) <= MISS, 1 at least."""
    below, h = 0.0, 0
    while h < count:
        below += math.comb(count, h) * share**h * (1 - share) ** (count - h)
        if below > MISS:
            break
        h += 1
    return max(1, h)


def least_collisions(share: float) -> int:
    """Equal coordinates that a pair at the threshold has."""
    return least_matches(share**ROWS, COORDINATES)


def prefix(share: float) -> int:
    """The number of coordinates that are posted: of COORDINATES with the least number of collisions, one is always among them."""
    return COORDINATES - least_collisions(share) + 1


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tag (of the text), n_shingles, fp, sig (both null for the empty set)."""

    def run(batches):
        minima = Minima(MINIMA)
        for rows in batches:
            out = {"doc_id": rows["doc_id"], "tag": rows["tag"], "n_shingles": [], "fp": [], "sig": []}
            for text in rows["text"]:
                s = shingle_set(text, n)
                out["n_shingles"].append(len(s))
                out["fp"].append(fingerprint(s) if len(s) else None)
                out["sig"].append(minima.of(s).tobytes() if len(s) else None)
            yield out

    tagged = docs.select("doc_id", F.unhex(F.md5("text")).alias("tag"), "text")
    return stream(tagged, run, "doc_id long, tag binary, n_shingles long, fp binary, sig binary")


def _looked_up(pairs: DataFrame, reps: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) with enough equal coordinates and minima of all, those in skipped lists included."""

    collisions, least = least_collisions(share), least_matches(share, MINIMA)

    def run(batches):
        for rows in batches:
            x, y = (np.frombuffer(b"".join(rows[k]), np.uint32).reshape(-1, COORDINATES, ROWS) for k in ("sa", "sb"))
            same = x == y
            good = np.flatnonzero((same.all(axis=2).sum(axis=1) >= collisions) & (same.sum(axis=(1, 2)) >= least)).tolist()
            yield {k: [rows[k][i] for i in good] for k in ("a", "b")}

    left = reps.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = reps.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return stream(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), run, "a long, b long", 4096)


def _full_sets(nodes: DataFrame, docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """node, set (sorted distinct shingle hashes as bytes) of nodes (node, doc_id, fp)."""
    nodes = scratch.keep(nodes, "nodes")

    def sets(batches):
        for rows in batches:
            held = [shingle_set(t, n) for t in rows["text"]]
            yield {"doc_id": rows["doc_id"], "fp": [fingerprint(s) if len(s) else None for s in held], "set": [s.tobytes() for s in held]}

    # A Bloom filter of the ids, built at run time, keeps other texts out of the shuffle; any size of the other side makes it worth while.
    with _setting(docs.sparkSession, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0"):
        mine = docs.select("doc_id", "text").join(nodes.select("doc_id").where(F.col("doc_id") > F.lit(-(1 << 63))), "doc_id", "left_semi")
        # Repeated rows of a text become one before the join, which needs the same shuffle.
        held = stream(mine, sets, "doc_id long, fp binary, set binary").groupBy("doc_id", "fp").agg(F.first("set").alias("set"))
        out = scratch.keep(held.join(nodes, ["doc_id", "fp"]).select("node", "set"), "sets")
    scratch.drop(nodes)
    return out


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b), as (u, v), with den * |intersection| >= num * |union| of the full sets."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = _full_sets(ends.join(reps.select("node", "doc_id", "fp"), "node"), docs, n, scratch)

    def same(batches):
        for rows in batches:
            good = []
            for i, (x, y) in enumerate(zip(rows["sa"], rows["sb"])):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both and den * both >= num * (len(p) + len(q) - both):
                    good.append(i)
            yield {k: [rows[j][i] for i in good] for k, j in (("u", "a"), ("v", "b"))}

    left = held.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = held.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    out = scratch.keep(stream(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), same, "u long, v long", 64), "links")
    scratch.drop(held)
    return out


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """key, n: the values of a column that rows of more than one component hold, and by how many rows.

    Least and greatest component combine before the shuffle, so a value that very many hold is summed up in parts.
    """
    ends = rows.groupBy(key).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"))
    return ends.where("low <> high").select(key, "n")


def _across(posts: DataFrame, merged: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame | None:
    """Pairs (a, b) of different components that could be linked; None where there are none for sure.

    What is joined back to rows is written down first: with an aggregate right below, a join could not be split where a value is hot.
    """
    named = posts.join(merged, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    named = scratch.keep(named, "named")
    keys = scratch.keep(_mixed(named, "key"), "keys")
    lists = scratch.keep(named.join(keys.select("key"), "key"), "lists")
    scratch.drop(named)
    scratch.drop(keys)
    # Collisions with other components: a member's lists that hold one.
    share = num / den
    some = lists.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_matches(share**ROWS, prefix(share)))
    minima = F.array(*(F.xxhash64(F.substring("sig", 1 + 4 * i, 4), F.lit(i)) for i in range(MINIMA)))
    held = scratch.keep(some.drop("n").join(reps, "node"), "some")
    single = held.select("node", "comp", F.explode(minima).alias("g"))
    met = scratch.keep(_mixed(single, "g"), "minima")
    enough = single.join(met.select("g"), "g").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_matches(share, MINIMA))
    near = scratch.keep(held.join(enough.select("node"), "node", "left_semi").select("node", "comp", "doc_id", "fp", "size"), "near")
    scratch.drop(held)
    scratch.drop(met)
    if near.isEmpty():
        scratch.drop(lists)
        return None
    sets = _full_sets(near.select("node", "doc_id", "fp"), docs, n, scratch)

    def spread(batches):
        for rows in batches:
            yield {"node": rows["node"], "g": [np.frombuffer(x, np.int64).tolist() for x in rows["set"]]}

    sized = scratch.keep(lists.join(near.select("node", "size"), "node").select("key", "node", "size"), "sized")
    scratch.drop(lists)
    lows = scratch.keep(sized.groupBy("key").agg(F.min("size").alias("low")), "lows")
    smallest = sized.join(lows, "key").groupBy("node").agg(F.min("low").alias("low"))

    # Positions: shingles of one component first, then by number of holders.
    rows = stream(sets, spread, "node long, g array<long>", 64).join(near.select("node", "comp"), "node").select("node", "comp", F.explode("g").alias("g"))
    shared = scratch.keep(_mixed(rows, "g"), "shared")
    common = rows.join(shared, "g").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("common"))
    placed = near.select("node", "comp", "size").join(common, "node").join(smallest, "node")
    least = F.ceil(F.lit(num) * (F.col("size") + F.greatest("low", F.ceil(F.lit(num) * F.col("size") / F.lit(den)))) / F.lit(num + den))
    own = F.col("size") - F.size("common")
    placed = placed.withColumn("own", own).withColumn("long", (F.col("size") - least + 1 - own).cast("int")).where("long > 0")
    placed = placed.select("node", "comp", "size", "own", F.posexplode(F.expr("slice(common, 1, long)")).alias("i", "c"))
    prefixes = scratch.keep(placed.select(F.col("c.g").alias("g"), "node", "comp", "size", (F.col("size") - F.col("own") - F.col("i")).alias("rest")), "prefixes")
    met = scratch.keep(_mixed(prefixes, "g"), "met")
    prefixed = prefixes.join(met.select("g"), "g")
    x, y = (prefixed.select("g", *(F.col(c).alias(c + k) for c in ("node", "comp", "size", "rest"))) for k in "ab")
    pair = (F.col("nodea") < F.col("nodeb")) & (F.col("compa") != F.col("compb")) & (F.lit(num + den) * F.least("resta", "restb") >= F.lit(num) * (F.col("sizea") + F.col("sizeb")))
    out = scratch.keep(x.join(y, "g").where(pair).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct(), "across")
    for t in (near, sets, sized, lows, shared, prefixes, met):
        scratch.drop(t)
    return out


def _classes(docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, n_shingles, fp of every row; fp, part, component_id of every class of equal sets, part being one number for each component)."""
    share = num / den
    all_sigs = scratch.keep(signatures(docs, n), "signatures")
    some = all_sigs.where("fp is not null and doc_id is not null")
    # A class is a node; its number is fixed by being written down.
    reps = some.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"), F.first("sig").alias("sig"))
    reps = scratch.keep(reps.withColumn("node", F.monotonically_increasing_id()), "classes")
    width = 4 * ROWS
    coordinates = F.array(*(F.xxhash64(F.substring("sig", 1 + width * i, width), F.lit(i)) for i in range(prefix(share))))
    posts = reps.select("node", "doc_id", F.explode(coordinates).alias("key"))

    # A list's first member is that of the smallest doc_id: originals mostly come before their copies, which are more like them than like each other.
    low = posts.groupBy("key").agg(F.min_by("node", "doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    low = scratch.keep(low, "low")
    # Lists of one member hold no pair; only the others are written down, once for both rounds.
    posts = scratch.keep(posts.drop("doc_id").join(low, "key"), "posts")
    star = posts.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    pairs = scratch.keep(_looked_up(star, reps, share), "stars")
    links = _confirmed(pairs, reps, docs, n, num, den, scratch)
    merged = components(links, scratch)
    scratch.drop(pairs)

    rest = _across(posts.select("key", "node"), merged, reps, docs, n, num, den, scratch)
    scratch.drop(low)
    scratch.drop(posts)
    if rest is not None:
        pairs = scratch.keep(_looked_up(rest, reps, share), "rest")
        scratch.drop(rest)
        more = _confirmed(pairs, reps, docs, n, num, den, scratch)
        scratch.drop(merged)
        merged = components(links.unionByName(more), scratch)
        scratch.drop(pairs)
        scratch.drop(more)
    scratch.drop(links)

    members = scratch.keep(merged.join(reps.select("node", "doc_id", "fp"), "node"), "members")
    names = scratch.keep(members.groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    named = members.join(names, "component").select("fp", F.col("component").alias("part"), "component_id")
    alone = reps.join(merged.select("node"), "node", "left_anti").select("fp", F.col("node").alias("part"), F.col("doc_id").alias("component_id"))
    classes = scratch.keep(named.unionByName(alone), "components")
    for t in (merged, members, names, reps):
        scratch.drop(t)
    return all_sigs.drop("sig"), classes


def link(docs: DataFrame, n: int = 3, num: int = 85, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    rows, classes = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, num, den, scratch)
    some = "fp is not null and doc_id is not null"
    found = rows.where(some).join(classes, "fp").select("doc_id", "n_shingles", "component_id")
    alone = rows.where(f"not ({some})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of every group of near-duplicates, all columns as they are.

    The row of the smallest doc_id stays, and of several such the first by text
    and then by its other columns.  Rows without a doc_id and rows without a word
    all stay; so do unlike texts under one doc_id.
    """
    scratch = Scratch(docs.sparkSession, "keepone")
    rows, classes = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, num, den, scratch)
    linked = rows.where("fp is not null and doc_id is not null").join(classes, "fp")
    first = linked.groupBy("part").agg(F.min(F.struct("doc_id", "tag")).alias("least")).select("least.*")
    # Names that no column of `docs` can have.
    kept, tag, row = (f"__{n}" + "_" * max(map(len, docs.columns)) for n in ("kept", "tag", "row"))
    first = scratch.keep(first.select(F.col("doc_id").alias(kept), F.col("tag").alias(tag)), "kept")
    # As `words` has it: anything but ASCII white space is a word.
    free = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    same = (F.col("doc_id").cast("long") == F.col(kept)) & (F.unhex(F.md5("text")) == F.col(tag))
    chosen = docs.where(~free).join(first, same, "left_semi")
    # Only repeated rows are left to choose from, and a limit of one a group is kept before the shuffle too.
    order = Window.partitionBy("doc_id", F.md5("text")).orderBy(*(F.col(c).cast("string") for c in docs.columns))
    one = chosen.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row)
    return one.unionByName(docs.where(free))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
), z AS (SELECT doc_id, coalesce(len(sh), 0) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
rare AS (SELECT doc_id, g FROM u),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM rare x JOIN rare y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * c >= 85 * (za.n + zb.n - c)
), two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(doc_id, t) AS (SELECT doc_id, doc_id FROM z UNION SELECT r.doc_id, two.b FROM r JOIN two ON two.a = r.t) SELECT * FROM r
), comp AS (SELECT doc_id, min(t) AS component_id FROM reach GROUP BY 1)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, comp.component_id, z.doc_id = comp.component_id AS kept FROM z JOIN comp USING (doc_id)
"""
