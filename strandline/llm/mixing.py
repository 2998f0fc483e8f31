"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix takes the golden-ratio point frac(i * phi) and maps it
through the cumulative weights to a source, so every stretch of the mix holds
each source close to its share. The documents of a source are shuffled (anew
for each repeat) and cut into blocks of equal token mass; the n-th slot of a
source takes its n-th block.

Size of the mix: the largest at which no source with documents needs more than
its tokens times max_repeats (shares of sources without documents go to the
others in proportion). A larger size can be asked for; sources that run out
then fall short, and the report shows it.

Scale: running totals over a source that holds a third of all rows are taken
in two steps (totals of hash ranges, then inside a range), so no task orders a
whole source. Only per-source totals (one row per target) reach the driver.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, once

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the split pattern that belongs to this vocabulary (fixed value)
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 512
#: hash ranges per source and repeat
RANGES = 1024
PHI = 0.6180339887498949


def source_key(c: Column) -> Column:
    """One spelling per source: trimmed, lower case, underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Adds n_tokens of the text (null counts 0)."""

    sc = docs.sparkSession.sparkContext
    sc.addFile(vocabulary)  # executors need no copy of their own
    name = os.path.basename(vocabulary)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for f in frames:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "n_tokens": n})

    return docs.select("doc_id", "source", "text").mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def _running(df: DataFrame, group: list[str], order: list[str], amount: str, name: str, ranges: Column) -> DataFrame:
    """Adds the sum of ``amount`` before the row, in ``order`` within
    ``group``; ``ranges`` is monotone in the first order column."""
    r = df.withColumn("__r", ranges)
    per = r.groupBy(*group, "__r").agg(F.sum(amount).alias("__s"))
    w = Window.partitionBy(*group).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__s").over(w), F.lit(0))).drop("__s")
    inner = Window.partitionBy(*group, "__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        r.join(per, [*group, "__r"])
        .withColumn(name, F.col("__before") + F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .drop("__r", "__before")
    )


def source_sizes(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: source, target_share, max_repeats, n_docs, tokens.
    ``docs`` has doc_id, source and n_tokens."""
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL").dropDuplicates(["source"])
    have = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    return t.join(have, "source", "left").na.fill({"n_docs": 0, "tokens": 0, "target_share": 0.0, "max_repeats": 1})


def counted_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens), each document once, sources in one
    spelling. Documents without source or id belong to no target."""
    rows = once(documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").filter("doc_id IS NOT NULL AND source IS NOT NULL"), "doc_id")
    return count_tokens(rows, vocabulary)


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 11) -> DataFrame:
    """The mix: slot, source, doc_id, repeat_no, n_tokens.

    A document appears at most max_repeats times (once per repeat_no). Empty
    tables give no rows; documents of sources without a target are left out;
    texts without tokens take part with size 0; equal shuffle keys go by
    doc_id.
    """
    spark = docs.sparkSession
    docs = docs.filter("n_tokens > 0")
    sizes = [r for r in source_sizes(docs, targets).orderBy("source").collect() if r.tokens > 0 and r.target_share > 0 and r.max_repeats > 0]
    empty = spark.createDataFrame([], "slot bigint, source string, doc_id bigint, repeat_no int, n_tokens bigint")
    if not sizes:
        return empty
    weight = sum(r.target_share for r in sizes)
    share = {r.source: r.target_share / weight for r in sizes}
    most = min(r.tokens * r.max_repeats / share[r.source] for r in sizes)
    total = int(most if total_tokens is None else total_tokens)
    n_slots = max(1, total // block_tokens)
    need = F.create_map(*[x for r in sizes for x in (F.lit(r.source), F.lit(int(min(r.max_repeats, -(-total * share[r.source] // r.tokens)))))])
    # shuffled blocks of each source; a repeat starts where the one before ended
    rep = docs.withColumn("__n", need[F.col("source")]).filter("__n > 0")
    rep = rep.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    rep = rep.withColumn("__h", F.xxhash64("doc_id", "repeat_no", F.lit(seed)))
    rng = F.floor((F.col("__h").cast("double") / 2.0**64 + 0.5) * RANGES).cast("int") + F.col("repeat_no") * RANGES
    placed = _running(rep, ["source"], ["__h", "doc_id"], "n_tokens", "__at", rng)
    blocks = placed.withColumn("__block", F.floor(F.col("__at") / block_tokens).cast("bigint"))
    # slots: golden-ratio points through the cumulative weights
    point = F.pmod(F.col("id") * F.lit(PHI) + F.lit(0.5), F.lit(1.0))
    case, acc = None, 0.0
    for r in sizes[:-1]:
        acc += share[r.source]
        case = F.when(point < acc, r.source) if case is None else case.when(point < acc, r.source)
    source = case.otherwise(sizes[-1].source) if case is not None else F.lit(sizes[-1].source)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), source.alias("source"), F.lit(1).alias("one"))
    slots = _running(slots, ["source"], ["slot"], "one", "__block", F.floor(F.col("slot") / 65_536).cast("int")).drop("one")
    return slots.join(blocks, ["source", "__block"]).select("slot", "source", "doc_id", F.col("repeat_no").cast("int"), "n_tokens")


def mix_report(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per target source: what there was and what share was reached."""
    docs = cut(docs)
    got = mix(docs, targets, total_tokens, block_tokens)
    per = got.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count(F.lit(1)).alias("mix_docs"), F.max("repeat_no").alias("most_repeats"))
    rows = source_sizes(docs, targets).join(per, "source", "left").na.fill({"mix_tokens": 0, "mix_docs": 0, "most_repeats": 0})
    total = rows.agg(F.sum("mix_tokens").alias("__t"))
    return rows.crossJoin(F.broadcast(total)).select(  # one row
        "source", "target_share", "max_repeats", "n_docs", F.col("tokens").alias("available_tokens"), "mix_docs", "mix_tokens", "most_repeats",
        F.round(F.when(F.col("__t") > 0, F.col("mix_tokens") / F.col("__t")).otherwise(0.0), 6).alias("actual_share"),
    )
