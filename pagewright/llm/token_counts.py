"""Exact token counts of a corpus for every context limit, from a histogram of encoded lengths.

Each whole text is encoded once, in the scan; what leaves a task is its histogram (length -> documents).
Suffix sums over the merged histogram answer, for every limit, how many documents and tokens are over it, how
many tokens remain when longer texts are truncated to it, and every quantile of length.  The sums go over
ranges of lengths first and then within each range, so that no window spans all lengths.

Public byte-level BPE ranks; text that spells a special token is ordinary text.

Defined results: null and empty texts have length 0; repeated rows all count; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

RANGE = 256
_made: dict = {}


def encoder(path: str | None = None):
    """The tokenizer of a rank file (default: byte_bpe_50k), once a process."""
    if path not in _made:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[path]


def _histogram(path: str | None):
    def run(batches):
        encode = encoder(path).encode_ordinary
        found: Counter = Counter()
        for batch in batches:
            found.update(len(encode(t)) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["length", "docs"])

    return run


def histogram(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """length (tokens of a document), docs (how many have it)."""
    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_histogram(tokenizer), "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def limits(lengths: DataFrame) -> DataFrame:
    """Per length L of a histogram: docs, tokens (of documents of that length), docs_over, tokens_over (longer than
    L), docs_upto (documents of at most L) and quantile (their share)."""
    h = lengths.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / RANGE).alias("part"))
    parts = h.groupBy("part").agg(F.sum("docs").alias("pd"), F.sum("tokens").alias("pt"))
    # ranges of ranges, to keep the outer window short as well
    outer = parts.withColumn("top", F.floor(F.col("part") / RANGE))
    tops = outer.groupBy("top").agg(F.sum("pd").alias("td"), F.sum("pt").alias("tt"))
    behind = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    all_tops = Window.partitionBy(F.lit(0)).orderBy("top")
    tops = tops.select("top", F.coalesce(F.sum("td").over(behind(all_tops)), F.lit(0)).alias("td"), F.coalesce(F.sum("tt").over(behind(all_tops)), F.lit(0)).alias("tt"), F.sum("td").over(Window.partitionBy(F.lit(0))).alias("n"))
    in_top = Window.partitionBy("top").orderBy("part")
    outer = outer.select("part", "top", F.coalesce(F.sum("pd").over(behind(in_top)), F.lit(0)).alias("pd"), F.coalesce(F.sum("pt").over(behind(in_top)), F.lit(0)).alias("pt")).join(tops, "top")
    in_part = Window.partitionBy("part").orderBy("length")
    h = h.withColumn("hd", F.coalesce(F.sum("docs").over(behind(in_part)), F.lit(0))).withColumn("ht", F.coalesce(F.sum("tokens").over(behind(in_part)), F.lit(0))).join(outer, "part")
    over = F.col("hd") + F.col("pd") + F.col("td")
    out = h.select("length", "docs", "tokens", over.alias("docs_over"), (F.col("ht") + F.col("pt") + F.col("tt")).alias("tokens_over"), "n")
    return out.select("length", "docs", "tokens", "docs_over", "tokens_over", (F.col("n") - F.col("docs_over")).alias("docs_upto"), ((F.col("n") - F.col("docs_over")) / F.col("n")).alias("quantile"))


def token_counts(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """The answers of `limits`, and truncated_total (tokens of the corpus when every text is cut to that length).

    A limit between two rows truncates to truncated_total + (limit - length) * docs_over of the lower one.
    """
    from .shared import written

    h = written(histogram(docs, tokenizer, text))
    total = h.agg(F.sum(F.col("length") * F.col("docs"))).first()[0] or 0
    return limits(h).withColumn("truncated_total", F.lit(total) - F.col("tokens_over") + F.col("length") * F.col("docs_over"))
