"""Exact length histogram of token counts, and what its suffix sums answer for every context limit."""

from __future__ import annotations

import base64
import functools
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm._shared import Scratch, chunks, small_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public tokenizer cuts a text before it merges bytes (a fixed value of the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths whose sums are taken together.
SPAN = 128


@functools.lru_cache(maxsize=2)
def _encoding(lines: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text: str = "text", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, docs): how many rows of docs have how many tokens in each task's share.

    A null text has none, like an empty one. Every row counts, repeated or not. Only text is looked at.
    """
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        seen = Counter()
        for b in chunks(batches, "text"):
            encode = _encoding(lines.value, pattern).encode_ordinary
            seen.update(len(encode(t)) if t else 0 for t in b.column("text").to_pylist())
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(seen), pa.int64()), "docs": pa.array(list(seen.values()), pa.int64())})

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "n_tokens long, docs long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs, with the suffix sums from it on.

    docs; docs_ge and tokens_ge of documents with so many tokens or more; total_docs and total_tokens; truncated_tokens:
    what is left if every document is cut to this length; quantile: the share of documents of this length or less.
    No rows for no documents. Lengths are counted once and kept as a table; sums are taken within spans of lengths first,
    so only one row a span meets in one task.
    """
    counted = Scratch(lengths.sparkSession, "lengths").save(lengths.groupBy("n_tokens").agg(F.sum("docs").alias("docs")), "histogram")
    h = counted.withColumn("span", F.expr(f"n_tokens div {SPAN}"))
    spans = h.groupBy("span").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    spans = spans.select("span", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"], F.sum("d").over(all_).alias("total_docs"), F.sum("t").over(all_).alias("total_tokens"))
    own = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(spans, "span").select(
        "n_tokens",
        "docs",
        (F.sum("docs").over(own) + F.col("d_above")).alias("docs_ge"),
        (F.sum(F.col("docs") * F.col("n_tokens")).over(own) + F.col("t_above")).alias("tokens_ge"),
        "total_docs",
        "total_tokens",
    )
    return out.withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).withColumn(
        "quantile", (F.col("total_docs") - F.col("docs_ge") + F.col("docs")) / F.col("total_docs")
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: docs_over it, tokens_kept of all documents cut to it. Exact for limits between lengths too."""
    asked = histogram.sparkSession.createDataFrame([(x,) for x in sorted(set(limits))], "context long")
    longer = F.col("n_tokens") > F.col("context")
    parts = histogram.select("n_tokens", "docs").join(F.broadcast(asked))
    return parts.groupBy("context").agg(
        F.sum(F.when(longer, F.col("docs")).otherwise(0)).alias("docs_over"), F.sum(F.least("n_tokens", "context") * F.col("docs")).alias("tokens_kept")
    )


def at_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share in (0, 1] the least length that so many of the documents don't exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    return histogram.join(F.broadcast(asked), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
