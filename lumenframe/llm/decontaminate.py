"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the similarity of their sets says
little; what counts is containment, the share of an item's shingles that the
document holds.  An item is sketched by the shingles that are least under
each of several permutations; each such shingle lies in the document with a
probability of just the containment.  Items are partitioned by size, and each
partition has its own number of permutations and its own least number of hits,
set so that an item at the threshold is missed with a chance below MISS.  One
pass over the documents looks all shingles of a document up in an inverted
table of sketch values, counts hits for each item, and confirms the candidates
by exact containment on the full sets.

Items come in blocks of a bounded number of shingles, so what is broadcast is
bounded; each block is one pass.  Documents are never shuffled.

Edge cases: a null or blank document holds nothing; a null or blank item is in
nothing; an item with fewer words than a shingle is one shingle of its own
length and is looked for at that length; repeated items with one id count as
one item each; a null item id is ignored; documents of any length are read
whole; an empty table on either side gives no matches; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick_rows, stream, table
from .shingles import Minima, shingle_hashes, words

#: Shingle length, and the least containment as a fraction.
WORDS, SHARE = 5, (4, 5)
#: Permutations by size of the item (up to so many shingles), and the greatest chance to miss an item at the threshold.
PARTITIONS = ((8, 24), (32, 32), (128, 48), (1 << 62, 64))
MISS = 1e-7
#: Bytes of items that one pass may broadcast.
BLOCK_BYTES = 16_000_000
#: Low bits of a hash that the first filter looks at.
FILTER_BITS = 22


def least_hits(permutations: int, share: float) -> int:
    """Greatest h with P(Binomial(permutations, share) < h) <= MISS, 1 at least."""
    total, h = 0.0, 0
    while h < permutations:
        total += math.comb(permutations, h) * share**h * (1 - share) ** (permutations - h)
        if total > MISS:
            break
        h += 1
    return max(1, h)


class Index:
    """The inverted table of one block of items."""

    def __init__(self, items: list[tuple[int, str]], n: int = WORDS, share: tuple[int, int] = SHARE):
        self.n, self.share = n, share
        self.ids, self.sets, self.least = [], [], []
        values, owners = [], []
        self.widths = set()
        for ident, text in items:
            tokens = words(text)
            if not tokens:
                continue
            s = np.unique(shingle_hashes(tokens, n))
            permutations = next(p for most, p in PARTITIONS if len(s) <= most)
            low = Minima(permutations, seed=11).of(s)
            keys = (s >> np.uint64(32)).astype(np.uint32)
            m = Minima(permutations, seed=11)
            picked = np.array([np.flatnonzero(((keys ^ m.flip[i]) * m.times[i]) == low[i])[0] for i in range(permutations)])
            values.append(s[picked])
            owners.append(np.full(permutations, len(self.ids)))
            self.widths.add(min(n, len(tokens)))
            self.ids.append(ident)
            self.sets.append(s)
            self.least.append(least_hits(permutations, share[0] / share[1]))
        v = np.concatenate(values) if values else np.empty(0, np.uint64)
        order = np.argsort(v, kind="stable")
        self.values, starts = np.unique(v[order], return_index=True)
        self.owners = np.concatenate(owners)[order] if values else np.empty(0, np.int64)
        self.starts = np.append(starts, len(v))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.values & np.uint64((1 << FILTER_BITS) - 1)] = True
        self.need = np.array(self.least, np.int64)

    def held(self, text: str | None) -> list[tuple[int, float]]:
        """(item, containment) of the items that a text holds."""
        if not text or not self.ids:
            return []
        tokens = words(text)
        own = [shingle_hashes(tokens, w, short=False) for w in self.widths]
        own = np.concatenate(own) if own else np.empty(0, np.uint64)
        near = own[self.filter[own & np.uint64((1 << FILTER_BITS) - 1)]]
        if not len(near):
            return []
        near = np.unique(near)
        at = np.minimum(np.searchsorted(self.values, near), len(self.values) - 1)
        at = at[self.values[at] == near]
        if not len(at):
            return []
        hits = np.bincount(np.concatenate([self.owners[self.starts[i] : self.starts[i + 1]] for i in at.tolist()]), minlength=len(self.ids))
        out = []
        all_ = None
        for i in np.flatnonzero(hits >= self.need).tolist():
            all_ = np.unique(own) if all_ is None else all_
            both = len(np.intersect1d(self.sets[i], all_, assume_unique=True))
            if both * self.share[1] >= self.share[0] * len(self.sets[i]):
                out.append((self.ids[i], both / len(self.sets[i])))
        return out


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The usable items, in blocks of about BLOCK_BYTES."""
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 512 + 8 * F.size(F.split("text", " ")))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i) for i in range(blocks)]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, containment: one row for each item that a document holds."""
    out = None
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(sorted(tuple(r) for r in block.collect()))

        def run(batches, shared=shared):
            index = Index(shared.value)
            for rows in batches:
                found = [(d, *h) for d, t in zip(rows["doc_id"], rows["text"]) for h in index.held(t)]
                yield {"doc_id": [f[0] for f in found], "item_id": [f[1] for f in found], "containment": [f[2] for f in found]}

        part = stream(docs.select("doc_id", "text"), run, "doc_id long, item_id long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, all columns as they are."""
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(sorted(tuple(r) for r in block.collect()))

        def start(shared=shared):
            index = Index(shared.value)
            return lambda texts: [not index.held(t) for t in texts]

        docs = pick_rows(docs, text, start)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_items, item_ids (ascending, comma-joined) of the documents that hold benchmark items."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("i"))
    return found.select("doc_id", F.size("i").cast("long").alias("n_items"), F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("item_ids"))


OP7_SQL = r"""
WITH texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM texts
), widths AS (
  -- An item of fewer than five words is one shingle of its own length.
  SELECT DISTINCT least(5, len(ws)) AS k FROM w WHERE side = 1 AND len(ws) > 0
), s AS (
  SELECT DISTINCT side, id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS g
  FROM w JOIN widths ON side = 0 OR k = least(5, len(ws))
), z AS (SELECT id, count(*) AS n FROM s WHERE side = 1 GROUP BY 1),
hit AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS c FROM s d JOIN s b ON d.side = 0 AND b.side = 1 AND d.k = b.k AND d.g = b.g GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids
FROM hit JOIN z ON z.id = hit.item_id WHERE 5 * c >= 4 * n GROUP BY 1
"""
