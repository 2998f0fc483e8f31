"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def terms(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Inverted index rows (doc, term, tf) of lower-case words."""
    t = df.select(F.col(doc).alias("doc"), F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9_]+)"), 1)).alias("term"))
    return t.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(word)


def bm25(docs: DataFrame, doc: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score): BM25 of every document that holds a query term. Lengths
    and term frequencies are counted inside the row, so no word is shuffled;
    only one row of totals is."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9_]+)"), 1)
    query = list(dict.fromkeys(query))
    d = docs.select(F.col(doc).alias("doc"), words.alias("w"))
    d = d.select("doc", F.size("w").alias("len"), F.filter("w", lambda x: x.isin(*query)).alias("w"))
    d = d.select("doc", "len", *[F.size(F.filter("w", _equals(q))).alias(f"tf{i}") for i, q in enumerate(query)])
    stat = d.agg(F.count_if(F.col("len") > 0).alias("n"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    j = d.filter(sum((F.col(f"tf{i}") for i in range(len(query))), F.lit(0)) > 0).crossJoin(F.broadcast(stat))  # one row
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg"))
    parts = []
    for i in range(len(query)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        parts.append(F.when(tf > 0, F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + norm)).otherwise(0.0))
    return j.select("doc", F.round(sum(parts, F.lit(0.0)), 6).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return dot / (norm(a) * norm(b))


#: rows of a block of vectors and of a block of queries
VECTOR_BLOCK, QUERY_BLOCK = 65_536, 2_048


def top_similar(vectors: DataFrame, queries: DataFrame, k: int, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact top-k by cosine: (query, id, score, rank), scores rounded to 6
    places, ties by smaller id, never the query itself.

    Both sides (id, embedding) are cut into blocks of bounded size; a task
    multiplies one block of queries with one block of vectors and keeps k per
    query. Null vectors and ids take no part; nothing reaches the driver but
    the two counts.
    """
    ok = F.col("id").isNotNull() & F.col("embedding").isNotNull()
    v, q = vectors.filter(ok).select("id", "embedding"), queries.filter(ok).select("id", "embedding")
    n_v, n_q = (max(1, -(-x.count() // size)) for x, size in ((v, vector_block), (q, query_block)))
    cell = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("__v", cell(n_v)).withColumn("__q", every(n_q))
    q = q.withColumn("__q", cell(n_q)).withColumn("__v", every(n_v))

    def best(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})]
        if len(qs) and len(vs):
            unit = lambda s: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(np.stack(s.to_numpy()).astype(np.float64))
            x, y, ids = unit(qs["embedding"]), unit(vs["embedding"]), vs["id"].to_numpy(np.int64)
            for s in range(0, len(x), 64):
                score = np.round(x[s : s + 64] @ y.T, 6) + 0.0
                for row, me in zip(score, qs["id"].to_numpy(np.int64)[s : s + 64]):
                    row[ids == me] = -np.inf
                    least = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
                    top = np.nonzero(row >= least)[0]
                    top = top[np.lexsort((ids[top], -row[top]))][:k]
                    top = top[np.isfinite(row[top])]
                    out.append(pd.DataFrame({"query": me, "id": ids[top], "score": row[top]}))
        return pd.concat(out)

    s = q.groupBy("__q", "__v").cogroup(v.groupBy("__q", "__v")).applyInPandas(best, "query bigint, id bigint, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rrf(lists: list[DataFrame], by: list[str] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (*by, id, rank) lists: sum of 1 / (k + rank)."""
    key = [*(by or []), "id"]
    every = lists[0].select(*key, "rank")
    for x in lists[1:]:
        every = every.union(x.select(*key, "rank"))
    return every.groupBy(*key).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 8).alias("score"))


def ranked(df: DataFrame, score: str, ident: str, n: int) -> DataFrame:
    """The n best rows as (id, rank): a top-n first, then numbers."""
    top = df.orderBy(F.col(score).desc(), ident).limit(n)
    return top.select(F.col(ident).alias("id"), F.row_number().over(Window.orderBy(F.col(score).desc(), ident)).alias("rank"))  # n rows


def fuzzy(name: Column, query: str) -> Column:
    """1 for equal names, .8 if one holds the other, else .5 times the share
    of query words it holds."""
    n, q = F.lower(F.trim(name)), query.lower().strip()
    words = q.split()
    share = sum((F.array_contains(F.split(n, r"\s+"), w).cast("int") for w in words), F.lit(0)) / F.lit(float(len(words) or 1))
    return F.when(n == q, 1.0).when(n.contains(q) | (F.lit(q).contains(n) & (n != "")), 0.8).otherwise(F.round(share * 0.5, 6))
