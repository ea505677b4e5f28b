"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size of their shingle sets. Each partition has its own number of hashes; under each hash an
item is represented by its least shingle. The share of these that occur in a document estimates how much of the item the
document contains, whatever the document's length. Items with enough hits are verified on full sets.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm._shared import chunks, fresh, mix, record, shingle_sets, small_batches, windows, words

WORDS = 5
#: Benchmark text that one pass over the documents looks for; more is looked for in more passes.
MAX_BLOCK_CHARS = 8_000_000

FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])


def hashes_for(n: int) -> int:
    """How many hashes the size partition of sets of n shingles uses: 16, and 2 more for each doubling beyond 16."""
    return min(n, 16 + 2 * max(0, int(np.log2(max(n, 1))) - 4))


def needed(n: int, percent: int) -> int:
    """Hits below which an item of n shingles is passed over; a contained item has fewer with a chance under 1e-8."""
    m = hashes_for(n)
    return -(-n * percent // 100) if m == n else max(1, int(m * percent / 100 - 6.5 * (m * percent * (100 - percent)) ** 0.5 / 100))


class Index:
    def __init__(self, ids: list[int], sets: list[np.ndarray], sizes: list[int], percent: int):
        """sizes: the words of a shingle of each item, WORDS or the length of a shorter item."""
        self.ids, self.sets, self.sizes, self.percent = ids, sets, sizes, percent
        self.short = sorted({k for k in sizes if k != WORDS})
        pairs = []
        for i, s in enumerate(sets):
            m = hashes_for(len(s))
            chosen = s if m == len(s) else np.unique([s[mix(s ^ np.uint64(1000 + k)).argmin()] for k in range(m)])
            pairs.append(np.stack([chosen, np.full(len(chosen), i, np.uint64)]))
        both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.uint64)
        both = both[:, np.argsort(both[0], kind="stable")]
        self.keys, self.first = np.unique(both[0], return_index=True)
        self.first = np.append(self.first, both.shape[1])
        self.items = both[1].astype(np.int64)
        # several hashes may choose the same shingle
        self.need = np.array([min(needed(len(s), percent), p.shape[1]) for s, p in zip(sets, pairs, strict=True)])

    def search(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that a document with these sorted distinct shingles contains."""
        if not len(self.keys) or not len(shingles):
            return []
        at = np.searchsorted(shingles, self.keys) if len(self.keys) < len(shingles) else None
        if at is not None:
            hit = np.flatnonzero(shingles[np.minimum(at, len(shingles) - 1)] == self.keys)
        else:
            to = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
            hit = to[self.keys[to] == shingles]
        if not len(hit):
            return []
        items, hits = np.unique(np.concatenate([self.items[self.first[k] : self.first[k + 1]] for k in hit.tolist()]), return_counts=True)
        out = []
        for i in items[hits >= self.need[items]].tolist():
            s = self.sets[i]
            n = int((shingles[np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)] == s).sum())
            if 100 * n >= self.percent * len(s):
                out.append((i, n))
        return out


def _index(items: list[tuple[int, str]], percent: int) -> Index:
    w = words(pa.array([t for _, t in items], pa.string()), fold=True)
    n, sets = w.count().tolist(), shingle_sets(w, WORDS)
    ids, kept, sizes = [], [], []
    for i, (item, text) in enumerate(items):
        if n[i]:
            ids.append(item)
            sizes.append(min(n[i], WORDS))
            kept.append(sets[i] if n[i] >= WORDS else windows(words(pa.array([text]), fold=True), n[i])[0])
    return Index(ids, kept, sizes, percent)


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared and n_item (distinct shingles) of each document that holds percent of an item's shingles.

    Shingles are 5 lower-cased words; an item of fewer words is looked for as one run of words. Items or documents that are
    null or wordless match nothing. Rows without an id take no part; repeated rows come out once. Other columns are
    ignored. The index goes to all tasks: it holds at most MAX_BLOCK_CHARS of benchmark text or so, and a larger
    benchmark is searched for block by block, with one pass over the documents for each.
    """
    small_batches(docs.sparkSession)
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // MAX_BLOCK_CHARS) or 1
    out = None
    for k in range(blocks):
        index = docs.sparkSession.sparkContext.broadcast(_index([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()], percent))

        def run(batches, index=index):
            ix = index.value
            for b in chunks(batches, "text"):
                ids, found = b.column("doc_id").to_pylist(), []
                w = words(b.column("text"), fold=True)
                h, at = windows(w, WORDS)
                cut = np.searchsorted(at, w.first)
                extra = [(*windows(w, n),) for n in ix.short]
                cuts = [np.searchsorted(a, w.first) for _, a in extra]
                for i, (lo, hi) in enumerate(itertools.pairwise(cut.tolist())):
                    s = [h[lo:hi]] + [x[c[i] : c[i + 1]] for (x, _), c in zip(extra, cuts, strict=True)]
                    found += [(ids[i], ix.ids[item], n, len(ix.sets[item])) for item, n in ix.search(np.unique(np.concatenate(s)))]
                yield record(FOUND, *(zip(*found, strict=True) if found else [[]] * 4))

        part = docs.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long")
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80, doc_id: str = "doc_id") -> DataFrame:
    """docs without the documents that contaminated() finds; all others and all columns stay, whatever their names.

    Of repeated rows of a doc_id all go if one holds an item. Rows without doc_id, and null or wordless texts, stay.
    """
    key = fresh("_found", docs)
    found = contaminated(docs, benchmark, percent, doc_id=doc_id).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(found, docs[doc_id].cast("long") == found[key], "left_anti")
