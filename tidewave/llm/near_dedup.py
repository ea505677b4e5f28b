"""MinHash near-dedup with SetSketch registers.

A register holds the exponentially spaced, truncated minimum of one hash over a document's shingles, so registers of two
sets merge by maximum and agree about as often as the sets overlap. Documents that agree on all registers of a band are
candidates; the share of larger, equal and smaller registers gives a likelihood estimate of their similarity; what
comes near the threshold is verified on full shingle sets.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm._shared import Scratch, chunks, mix, record, shingle_sets, signed, words
from tidewave.llm.components import connected_components
from tidewave.llm.marks import marked, marks

BANDS, ROWS = 40, 5
BASE, RATE = 1.02, 20.0
REGISTERS = BANDS * ROWS
BLOCK = 512
#: Bytes of shingle sets in a block of documents whose pairs are verified together.
SET_BYTES = 16 << 20
#: The bands of each round: before the last one, in which all that is left is verified, of each document only the best
#: candidate is. Few bands bring most groups together, with little that is sent.
ROUNDS = (4, BANDS, BANDS)

_MULT = np.random.default_rng(77).integers(1, 2**63, REGISTERS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(78).integers(0, 2**63, REGISTERS, dtype=np.uint64)[:, None]


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes; sketches of a union are the maxima of the sketches."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[None, at : at + 2048] * _MULT + _ADD).min(axis=1))
    x = np.maximum(-np.log1p(-(low.astype(np.float64) / 2.0**64).clip(0, 1 - 2**-53)) / RATE, 1e-300)
    return np.floor(1 - np.log(x) / np.log(BASE)).clip(0, 65535).astype(np.uint16)


def estimate(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of most likelihood, given how many of a's registers lie above and below b's, and both set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    equal = REGISTERS - above - below

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return above * np.log(np.maximum(up, 1e-12)) + below * np.log(np.maximum(down, 1e-12)) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = hi - (hi - lo) * 0.6180339887498949, lo + (hi - lo) * 0.6180339887498949
        left = likelihood(a) > likelihood(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


@functools.cache
def _least(percent: int) -> float:
    """The least share of equal registers that is verified: a pair at the threshold has fewer of them less often, by exact
    binomial tails, than it shares no band."""
    s, tail, k = percent / 100, 0.0, 0
    while (tail := tail + math.comb(REGISTERS, k) * s**k * (1 - s) ** (REGISTERS - k)) <= (1 - s**ROWS) ** BANDS:
        k += 1
    return k / REGISTERS


def _near(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs, one per row, may reach the threshold: by their sizes, by their equal registers, then by likelihood."""
    ok = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    at = np.flatnonzero(ok)
    at = at[(a[at] == b[at]).sum(axis=1) >= (_least(percent) - 0.02) * REGISTERS]
    x, y = a[at], b[at]
    ok[:] = False
    ok[at] = estimate((x > y).sum(axis=1), (x < y).sum(axis=1), n_a[at].astype(float), n_b[at].astype(float)) >= _least(percent)
    return ok


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("regs", pa.binary())])
BUCKETS = pa.schema([("bucket", pa.int64()), ("band", pa.int32()), ("doc_id", pa.int64())])
SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("regs", pa.binary()), ("shingles", pa.binary())])
SAME = ["n", "sig1", "sig2"]


def _ddl(s: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int64(): 'long', pa.int32(): 'int', pa.binary(): 'binary'})[f.type]}" for f in s)


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two sums of a set of hashes, that tell sets of one size apart."""
    return (int(signed(mix(s ^ np.uint64(1)).sum(keepdims=True))[0]), int(signed(np.bitwise_xor.reduce(mix(s ^ np.uint64(2)), keepdims=True))[0])) if len(s) else (0, 0)


def _sketch(batches):
    for b in chunks(batches, "text"):
        sets = shingle_sets(words(b.column("text"), fold=True))
        sums = [_sums(s) for s in sets]
        yield record(SKETCH, b.column("doc_id"), [len(s) for s in sets], [x for x, _ in sums], [y for _, y in sums], [registers(s).tobytes() if len(s) else b"" for s in sets])


def _buckets(batches):
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(part.num_rows, BANDS, ROWS).astype(np.uint64)
            h = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((part.num_rows, 1), np.uint64)
            for k in range(ROWS):
                h = mix(h * np.uint64(65599) + regs[:, :, k])
            yield record(BUCKETS, signed(h.ravel()), np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows), np.repeat(np.asarray(part.column("doc_id")), BANDS))


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def _filter_pairs(percent: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                ok = _near(_regs(b.column("regs_a").to_pylist()), _regs(b.column("regs_b").to_pylist()), np.asarray(b.column("n_a")), np.asarray(b.column("n_b")), percent)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                # both are sorted and distinct
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


PAIRS_AT_ONCE = 20_000


def _cross(percent: int, best: bool):
    """Pairs of a bucket, or of two of its blocks, that lie in different components and may be near.

    best: of each document only the pair with the most equal registers, with their number. Else all, packed by the blocks
    (verify_i, verify_j) of documents that they are verified in. Batches come sorted by bucket, i, j. A run has 2 * BLOCK rows or so, and is carried over the end of a batch.
    """

    def evaluate(rows: pa.Table, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        verify = np.asarray(rows.column("verify")).astype(np.int64)
        x, y = (np.concatenate(p) for p in zip(*pairs, strict=True))
        regs, n, ids = _regs(rows.column("regs").to_pylist()), np.asarray(rows.column("n")), np.asarray(rows.column("doc_id"))
        band = np.asarray(rows.column("band"))[x]
        found = []
        for at in range(0, len(x), PAIRS_AT_ONCE):
            i, j = x[at : at + PAIRS_AT_ONCE], y[at : at + PAIRS_AT_ONCE]
            # a pair that shares several buckets is looked at in the first of them
            first = (regs[i] == regs[j]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[at : at + PAIRS_AT_ONCE]
            i, j = i[first], j[first]
            ok = _near(regs[i], regs[j], n[i], n[j], percent)
            i, j = i[ok], j[ok]
            found.append((i, j, (regs[i] == regs[j]).sum(axis=1)))
        a, b, equal = (np.concatenate(p) for p in zip(*found, strict=True))
        if not best:
            at = np.stack([np.minimum(verify[a], verify[b]), np.maximum(verify[a], verify[b])])
            order = np.lexsort(at[::-1])
            at, both = at[:, order], np.stack([ids[a], ids[b]], axis=1)[order]
            cuts = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(axis=0)]) if len(a) else np.zeros(0, int)
            packed = [x.astype(np.int64).tobytes() for x in np.split(both, cuts[1:])] if len(a) else []
            return pa.RecordBatch.from_arrays([pa.array(at[0, cuts]), pa.array(at[1, cuts]), pa.array(packed, pa.binary())], ["verify_i", "verify_j", "pairs"])
        a, b = ids[a], ids[b]
        if len(a):
            who = np.r_[a, b]
            order = np.lexsort((-np.r_[equal, equal], who))
            keep = np.unique(order[np.r_[True, who[order][1:] != who[order][:-1]]] % len(a))
            a, b, equal = a[keep], b[keep], equal[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(equal.astype(np.int64))], ["a", "b", "equal"])

    def handle(rows: pa.Table):
        keys = np.stack([np.asarray(rows.column(c)).astype(np.int64) for c in ("bucket", "i", "j")])
        cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])
        comp, block = np.asarray(rows.column("component")), np.asarray(rows.column("block"))
        pairs, size = [], 0
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if keys[1, lo] == keys[2, lo]:
                x, y = np.triu_indices(hi - lo, 1)
            else:
                left, right = np.flatnonzero(block[lo:hi] == keys[1, lo]), np.flatnonzero(block[lo:hi] == keys[2, lo])
                x, y = np.repeat(left, len(right)), np.tile(right, len(left))
            x, y = x + lo, y + lo
            apart = comp[x] != comp[y]
            if apart.any():
                pairs.append((x[apart], y[apart]))
                size += int(apart.sum())
            if size > PAIRS_AT_ONCE:
                yield evaluate(rows, pairs)
                pairs, size = [], 0
        if pairs:
            yield evaluate(rows, pairs)

    def run(batches):
        carried = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([b])])
            keys = np.stack([np.asarray(t.column(c)).astype(np.int64) for c in ("bucket", "i", "j")])
            last = int(np.flatnonzero((keys == keys[:, -1:]).all(axis=0))[0])
            if last:
                yield from handle(t.slice(0, last).combine_chunks())
            carried = t.slice(last).combine_chunks()
        if carried is not None:
            yield from handle(carried)

    return run


def _unpacked(batches):
    for b in batches:
        for x in b.column("pairs"):
            p = np.sort(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b"])


def _verified(crossed: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the packed pairs that reach the threshold on full sets; a document's set is sent once for each other block."""
    met = crossed.select("verify_i", "verify_j").distinct()
    ends = met.select(F.col("verify_i").cast("int").alias("verify"), F.col("verify_i").alias("i"), F.col("verify_j").alias("j"))
    ends = ends.union(met.where("verify_i <> verify_j").select(F.col("verify_j").cast("int"), "verify_i", "verify_j"))
    sets = members.join(ends, "verify").select("i", "j", "doc_id", "shingles")

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = {d: np.frombuffer(x, np.uint64) for d, x in zip(right.doc_id.tolist(), right.shingles, strict=True)}
        pairs = np.unique(np.sort(np.frombuffer(b"".join(left.pairs), np.int64).reshape(-1, 2), axis=1), axis=0)
        ok = []
        for a, b in pairs.tolist():
            x, y = sorted((of[a], of[b]), key=len)
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.DataFrame(pairs[np.array(ok, bool)], columns=["a", "b"])

    return crossed.groupBy("verify_i", "verify_j").cogroup(sets.groupBy("i", "j")).applyInPandas(check, "a long, b long")


def _joined(comps: DataFrame, links: DataFrame, s: Scratch, k: int) -> DataFrame:
    """comps (node, component), in which a document without links may be missing, after links (a, b) between documents."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    e = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    edges = e.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    roots = s.save(connected_components(edges, s, f"cc-{k}"), f"roots-{k}").withColumnRenamed("component", "root")
    known = comps.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    alone = roots.join(comps, "node", "left_anti").select("node", F.col("root").alias("component"))
    return s.save(known.unionByName(alone), f"comps-{k}")


#: Numbers beyond the largest doc_id that further sets of an id may need.
ROOM = 1 << 60


def _further_sets(sketches: DataFrame, s: Scratch) -> DataFrame | None:
    """(doc_id, n, sig1, sig2, own) of all but the first set of the ids that have several: own is a number that no id has."""
    some = sketches.where("n > 0")
    ends = some.groupBy("doc_id").agg(F.min(F.struct(*SAME)).alias("first"), F.max(F.struct(*SAME)).alias("last"))
    several = s.save(ends.where("first <> last").select("doc_id", "first"), "several")
    if several.isEmpty():
        return None
    top = sketches.agg(F.max("doc_id")).first()[0]
    if top > 2**63 - 1 - ROOM:
        raise ValueError(f"doc_id {top} is too large, as some ids have several texts")
    further = some.join(several, "doc_id").where(F.struct(*SAME) != F.col("first")).select("doc_id", *SAME).distinct()
    return s.save(further.withColumn("own", F.lit(top + 1) + F.monotonically_increasing_id()), "further")


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| of their sets of lower-cased 5-word shingles (fewer
    words: the whole sequence). Null or wordless texts have empty sets and stand alone. Ties need no rule. Rows with a
    null doc_id are left out. Rows that share a doc_id are one document: each set of theirs has its links, all these reach
    one another in whatever order the rows come, and one row comes back, with the largest n_shingles. Other columns are
    ignored. Identical sets are joined first. Then each bucket's members are verified against its
    smallest member. Of buckets whose members are still in different components, each document's best candidate in another
    component is verified and components are joined, over few bands and then over all; and after that every pair that still lies between
    components, in blocks of bounded size, so that no link is lost and large groups don't become all pairs.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "near")
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = s.save(source.mapInArrow(_sketch, _ddl(SKETCH)), "sketch")
    further = _further_sets(sketches, s)

    def told_apart(df: DataFrame) -> DataFrame:
        """df with the number that a set goes by in place of doc_id, which is kept as id."""
        if further is None:
            return df.withColumn("id", F.col("doc_id"))
        return df.join(further, ["doc_id", *SAME], "left").withColumns({"id": F.col("doc_id"), "doc_id": F.coalesce("own", "doc_id")}).drop("own")

    sketches = told_apart(sketches)
    reps = s.save(sketches.where("n > 0").groupBy(*SAME).agg(F.min_by(F.struct("doc_id", "regs"), "doc_id").alias("r")).select(*SAME, "r.doc_id", "r.regs"), "reps")
    exploded = s.save(reps.select("doc_id", "regs").mapInArrow(_buckets, _ddl(BUCKETS)), "exploded")
    shared = exploded.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    buckets = s.save(exploded.join(shared, "bucket"), "buckets")
    s.drop("exploded")
    of_marks = buckets.select("doc_id")
    if further is not None:
        of_marks = of_marks.union(further.select("doc_id"))
    bits = marks(of_marks)

    def sets(batches):
        for b in chunks(batches, "text"):
            got = shingle_sets(words(b.column("text"), fold=True))
            at = [i for i, x in enumerate(got) if len(x)]
            yield record(SETS, b.column("doc_id").take(pa.array(at, pa.int64())), [len(got[i]) for i in at], *zip(*[_sums(got[i]) for i in at], strict=True) if at else ([], []), [registers(got[i]).tobytes() for i in at], [got[i].tobytes() for i in at])

    full = s.save(told_apart(marked(source, "doc_id", bits, then=sets, schema=_ddl(SETS))).dropDuplicates(["doc_id"]).select("doc_id", "n", "regs", "shingles"), "sets")
    light = full.select("doc_id", "n", "regs")

    def confirmed(pairs: DataFrame, name: str, filtered: bool) -> DataFrame:
        if not filtered:
            a, b = (light.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("regs").alias(f"regs_{k}")) for k in "ab")
            pairs = s.save(pairs.join(a, "a").join(b, "b").mapInArrow(_filter_pairs(percent), "a long, b long"), f"{name}-near")
        a, b = (full.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
        return s.save(pairs.join(a, "a").join(b, "b").mapInArrow(_verify(percent), "a long, b long"), f"{name}-links")

    low = confirmed(buckets.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct(), "low", False)
    if further is not None:  # the sets of an id belong together, each with the first document that has the same
        sets_of = sketches.join(further.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").where("n > 0").select("id", *SAME).distinct()
        own = sets_of.join(reps.select(*SAME, F.col("doc_id").alias("b")), SAME)
        low = low.union(own.join(own.groupBy("id").agg(F.min("b").alias("a")), "id").select("a", "b"))
    comps = s.save(connected_components(low, s, "cc-low"), "comps-low")
    key = ["bucket", "i", "j"]
    for k, bands in enumerate(ROUNDS):
        last = k == len(ROUNDS) - 1
        own = buckets.where(F.col("band") < bands).join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        own = s.save(own, f"own-{k}")
        several = own.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("size")).where("c0 <> c1").drop("c0", "c1")
        mixed = s.save(own.join(several, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), f"mixed-{k}")
        s.drop(f"own-{k}")
        if mixed.isEmpty():
            continue
        mixed = mixed.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).join(light, "doc_id")
        pair = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        members = full.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n", "shingles")
        blocks = 1
        if last:
            size = members.agg(F.count("*").alias("docs"), F.sum("n").alias("n")).first()
            blocks = max(1, -(-size.docs // BLOCK), -(-8 * (size.n or 0) // SET_BYTES))
        verify = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("verify")
        pair = pair.select(*key, "band", "block", "doc_id", "n", "component", "regs", verify).repartition(*key).sortWithinPartitions(*key)
        if last:
            crossed = s.save(pair.mapInArrow(_cross(percent, False), "verify_i long, verify_j long, pairs binary"), f"crossed-{k}")
            # where two blocks have fewer pairs than documents, sending the sets of each pair is less
            many = crossed.groupBy("verify_i", "verify_j").agg((F.sum(F.octet_length("pairs")) >= 16 * 2 * BLOCK).alias("many"))
            crossed = s.save(crossed.join(many, ["verify_i", "verify_j"]), "crossed")
            few = confirmed(crossed.where("not many").select("pairs").mapInArrow(_unpacked, "a long, b long"), f"rest-{k}-few", True)
            links = few.union(s.save(_verified(crossed.where("many").drop("many"), members.select("doc_id", "shingles", verify), percent), f"rest-{k}-many"))
        else:
            crossed = s.save(pair.mapInArrow(_cross(percent, True), "a long, b long, equal long"), f"crossed-{k}")
            ends = crossed.select(F.col("a").alias("d"), "a", "b", "equal").union(crossed.select("b", "a", "b", "equal"))
            links = confirmed(ends.groupBy("d").agg(F.max(F.struct("equal", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), f"rest-{k}", True)
        comps = _joined(comps, links, s, k)
        s.drop(f"mixed-{k}", f"crossed-{k}", "crossed", *[f"rest-{k}-{x}" for x in ("links", "few-links", "many")])
    s.drop("buckets", "sets", "low-near")
    of_rep = reps.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(*SAME, F.coalesce("component", "doc_id").alias("component"))
    # a component's smallest number is an id: a further set is joined with the first of its id, which has a smaller one
    found = sketches.select("id", *SAME).join(of_rep, SAME, "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return found.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
