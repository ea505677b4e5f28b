"""Spelling variants: words at one inserted, deleted or replaced letter, from forward and reversed sorted dictionaries.

Of two such words the half that the edit is not in is the same in both. So the dictionary is laid out twice: by the first
half of each word, where words that share it stand together, and reversed, by the second half. A block of one shared half
has the words of m and m + 1 letters whose edit lies in the other half. A block with too many pairs is divided: by the
quarter in front of or behind the edit in addition, and so on down to a single place, where the alphabet bounds it. Each
pair is looked for only in the block where its edit lies, at the first place where the words differ; no pair is found twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm._shared import Scratch, chunks, small_batches

#: Pairs of a block over which it is divided further.
LARGEST = 1 << 14
#: Words that a task counts before it sends their counts on.
COUNTED = 200_000
PAIRS_AT_ONCE = 1 << 17


def one_letter_lost(doc_id: int | None, word: str, every: int = 199) -> str:
    """word without one letter, if the checksum of `<doc_id>:<word>` is a multiple of every (a null id is written as nothing)."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, letters: str = r"A-Za-zÀ-ÿ", shortest: int = 6, fewest: int = 5, lost_every: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n) of the words of at least `shortest` letters that all texts together have at least `fewest` times.

    Words are maximal runs of the given letters, with A-Z as a-z. lost_every: if not 0, words lose a letter by
    one_letter_lost, in all of a text alike. Null and empty texts have none, repeated rows count as often, other columns are
    ignored. Tasks count before they send: a word in every text is sent a few times a task.
    """
    pattern = re.compile(f"[{letters}]{{{shortest},}}")

    def count(batches):
        total: dict[str, int] = {}

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in chunks(batches, "_text"):
            for i, t in zip(b.column("_doc").to_pylist(), b.column("_text"), strict=True):
                if not t.is_valid:
                    continue
                for w, n in Counter(pattern.findall(t.as_buffer().to_pybytes().lower().decode())).items():
                    w = one_letter_lost(i, w, lost_every) if lost_every else w
                    if len(w) >= shortest:
                        total[w] = total.get(w, 0) + n
            if len(total) > COUNTED:
                yield sent()
                total = {}
        yield sent()

    small_batches(docs.sparkSession)
    counted = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


KEY = ["m", "lo", "hi", "head", "tail"]


def _blocks(words: DataFrame) -> DataFrame:
    """The columns of words, and of each window [lo, hi) of places of the edit that windows has, the key of its block.

    m is the length of the shorter word of a pair. Words of a block share the lo letters in front of the window (head) and
    the m - hi behind it (tail); middle is what is between.
    """
    size = F.length("word")
    back = F.col("m") - F.col("hi")
    return words.withColumns(
        {
            "head": F.substring("word", F.lit(1), F.col("lo")),
            "tail": F.substring("word", size - back + 1, back),
            "middle": F.substring("word", F.col("lo") + 1, size - F.col("lo") - back),
        }
    )


def _divided(words: DataFrame, start, end) -> DataFrame:
    """words with a row for either half of the window [start, end)."""
    cut = F.floor((start + end) / 2).cast("int")
    left, right = F.struct(start.alias("lo"), cut.alias("hi")), F.struct(cut.alias("lo"), end.alias("hi"))
    halves = F.when(cut > start, F.array(left, right)).otherwise(F.array(right))
    return words.withColumn("_w", F.explode(halves)).withColumns({"lo": F.col("_w.lo"), "hi": F.col("_w.hi")}).drop("_w")


def _letters(middle: list[str], width: int) -> np.ndarray:
    """The code points of the middles, a row each, with zeros behind."""
    out = np.zeros((len(middle), width + 1), np.uint32)
    size = np.array([len(x) for x in middle])
    flat = np.frombuffer("".join(middle).encode("utf-32-le"), np.uint32)
    out[np.repeat(np.arange(len(middle)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _near(letters: np.ndarray, longer: np.ndarray, last: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of middles, i of a shorter word, are one edit apart that lies in the window."""
    a, b = letters[i], letters[j]
    equal = a == b
    out = (~equal).sum(axis=1) == 1
    at = np.flatnonzero(longer[j])
    if len(at):
        # the letter put in is the first where the words differ: what follows is moved by one
        k = np.where(equal[at].all(axis=1), a.shape[1], (~equal[at]).argmax(axis=1))
        moved = a[at, :-1] == b[at, 1:]
        rest = (moved | (np.arange(moved.shape[1])[None, :] < k[:, None])).all(axis=1)
        out[at] = rest & ((k < width[i[at]]) | last[i[at]])
    return out


def _pairs(batches):
    """(word, n, near, near_n) both ways of the pairs of each block. Rows come sorted by block, the shorter words first."""

    def found(t: pa.Table):
        t = t.combine_chunks()
        word, n, middle = t.column("word").to_pylist(), np.asarray(t.column("n")), t.column("middle").to_pylist()
        longer, m, lo, hi = (np.asarray(t.column(c)) for c in ("longer", "m", "lo", "hi"))
        block = np.asarray(t.column("block_no"))
        ends = np.searchsorted(block, block, side="right")
        longer = longer.astype(bool)
        many = np.where(longer, 0, ends - np.arange(len(word)) - 1)
        total = np.r_[0, np.cumsum(many)]
        widest = max((len(x) for x in middle), default=0)
        letters = _letters(middle, widest)
        most = max(1, min(PAIRS_AT_ONCE, (PAIRS_AT_ONCE * 64) // (widest + 1)))
        at = 0
        while at < len(word):
            till = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
            i = np.repeat(np.arange(at, till), many[at:till])
            j = i + 1 + np.arange(len(i)) - (total[i] - total[at])
            at = till
            ok = _near(letters, longer, hi == m, hi - lo, i, j) if len(i) else np.zeros(0, bool)
            i, j = i[ok], j[ok]
            if len(i):
                w = pa.array(word, pa.string())
                a, b = np.r_[i, j], np.r_[j, i]
                yield pa.RecordBatch.from_arrays([w.take(pa.array(a)), pa.array(n[a]), w.take(pa.array(b)), pa.array(n[b])], names=["word", "n", "near", "near_n"])

    carried, no = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([b])])
        keys = [t.column(c).to_pylist() for c in KEY]
        rows = list(zip(*keys, strict=True))
        new = np.array([True] + [x != y for x, y in zip(rows[1:], rows[:-1], strict=True)])
        t = t.drop_columns(["block_no"]) if "block_no" in t.column_names else t
        t = t.append_column("block_no", pa.array(np.cumsum(new)))
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield from found(t.slice(0, cut))
        carried = t.slice(cut).drop_columns(["block_no"])
    if carried is not None:
        yield from found(carried.append_column("block_no", pa.array(np.zeros(carried.num_rows, np.int64))))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, near, near_n) of all pairs of different words (word, n) at one edit, both ways, each once.

    words has each word once; an empty table gives an empty one. Words may have any length and letters; one letter has no
    half and is compared with all of one and two letters, which the alphabet bounds.
    """
    m = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = words.select("word", "n", m.alias("m")).where("m >= 0").withColumn("longer", F.length("word") > F.col("m"))
    rows = scratch.save(_blocks(_divided(rows, F.lit(0), F.col("m"))), "dictionary")
    parts, k = [], 0
    while True:
        short, long = F.sum((~F.col("longer")).cast("long")), F.sum(F.col("longer").cast("long"))
        blocks = rows.groupBy(*KEY).agg(short.alias("short"), long.alias("long"))
        large = scratch.save(blocks.where((F.col("short") * (F.col("short") / 2 + F.col("long")) > LARGEST) & (F.col("hi") - F.col("lo") > 1)).select(*KEY), f"large-{k}")
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(large, KEY, "left_anti"))
        finer = rows.join(large, KEY, "left_semi").select("word", "n", "m", "longer", "lo", "hi")
        rows = scratch.save(_blocks(_divided(finer, F.col("lo"), F.col("hi"))), f"dictionary-{k}")
        k += 1
    out = None
    for rows in parts:
        laid = rows.select(*KEY, "longer", "word", "n", "middle").repartition(*KEY).sortWithinPartitions(*KEY, "longer", "word")
        pairs = laid.mapInArrow(_pairs, "word string, n long, near string, near_n long")
        out = pairs if out is None else out.union(pairs)
    return out


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the words (word, n).

    n_near: how many words are one edit away. form: the near word of the largest n (ties: the smallest in code-point order),
    if its n is at least ratio times that of the word, else null; form_n its n. root: where following forms ends, the word
    itself if it has none; n grows at each step, so there are few. Each word must come once, with an n of 1 or more; an
    empty table gives an empty one, and other columns are left out.
    """
    s = Scratch(words.sparkSession, "spelling")
    words = s.save(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, s)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    far = -F.col("best.n") >= ratio * F.col("n")
    out = s.save(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.n")).alias("form_n")), "forms")
    hops, k = s.save(out.where("form is not null").select("word", F.col("form").alias("root")), "hops"), 0
    while True:
        # each pass doubles the steps that are followed at once
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = s.save(hops.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"hops-{k}")
        k, hops = k + 1, then.select("word", "root")
        if then.where("moved").isEmpty():
            break
    return out.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
