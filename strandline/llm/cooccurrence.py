"""Items that appear together: blocked Gram matrix over baskets.

Baskets become rows of a binary sparse matrix X (baskets x items), cut into
record blocks and item blocks. A task holds one record block of one pair of
item blocks and returns the non-zero entries of the sparse product X_i' X_j;
partial products are summed over record blocks and compared with the expected
marginals.

Exact pruning before anything is paired: n_ab <= min(n_a, n_b), so an item in
fewer than ``min_count`` baskets has no pair; and n_ab * T >= lift * n_a * n_b
with n_ab <= min(n_a, n_b) needs max(n_a, n_b) <= T / lift.

Scale: a task sees about ``entry_block`` entries (places of an item in a basket)
of two blocks of about ``item_block`` items, whatever the size of a group or of
one basket. A basket travels once per pair of item blocks it touches. The
baskets are read and cleaned once and kept in a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, once, tasks

ENTRY_BLOCK = 200_000
ITEM_BLOCK = 2_048
#: entries and cells of the accumulator held at once while blocks are multiplied
CHUNK = 2_000_000


def clean_path(p: Column) -> Column:
    """A path without a leading ./ and with forward slashes."""
    return F.regexp_replace(F.regexp_replace(p, r"\\", "/"), r"^\./", "")


def change_baskets(change_sets: DataFrame) -> DataFrame:
    """(grp, basket, item): the distinct cleaned paths of modified and added
    of each change set, sets delivered twice once. Null paths are left out;
    null or empty arrays hold nothing."""
    empty = F.array().cast("array<string>")
    rows = once(change_sets.select("change_set_id", "project_id", "modified", "added"), "change_set_id")
    paths = F.concat(F.coalesce("modified", empty), F.coalesce("added", empty))
    cleaned = F.array_distinct(F.transform(F.filter(paths, lambda p: p.isNotNull()), clean_path))
    return rows.select(F.col("project_id").alias("grp"), F.col("change_set_id").alias("basket"), cleaned.alias("items"))


def _gram(i_rows: np.ndarray, i_items: np.ndarray, j_rows: np.ndarray, j_items: np.ndarray, n_rows: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-zero entries (a, b, count) of the sparse product X_i' X_j; of one
    block with itself only a < b. Entries are (basket, item) numbers from 0; the
    j side is sorted by basket.

    Row by row of X_i' (an item and its baskets), the rows of X_j it selects are
    added up in a dense accumulator; as many rows at a time as fit in CHUNK.
    """
    n_i, n_j = int(i_items.max(initial=-1)) + 1, int(j_items.max(initial=-1)) + 1
    o = np.argsort(i_items, kind="stable")
    rows, items = i_rows[o], i_items[o]
    at_i = np.searchsorted(items, np.arange(n_i + 1))
    at_j = np.searchsorted(j_rows, np.arange(n_rows + 1))
    size = np.diff(at_j)[rows]
    work = np.append(0, np.cumsum(size))[at_i]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    s = 0
    while s < n_i and n_j:
        e = int(np.searchsorted(work, work[s] + CHUNK, "right")) - 1
        e = min(max(e, s + 1), s + max(1, CHUNK // n_j), n_i)
        r, ln = rows[at_i[s] : at_i[e]], size[at_i[s] : at_i[e]]
        if ln.sum():
            k = np.arange(ln.sum()) + np.repeat(at_j[r] - (np.cumsum(ln) - ln), ln)
            row = np.repeat(items[at_i[s] : at_i[e]] - s, ln)
            acc = np.bincount(row * n_j + j_items[k], minlength=(e - s) * n_j)
            nz = np.nonzero(acc)[0]
            x, y = nz // n_j + s, nz % n_j
            keep = x < y if same else slice(None)
            out.append((x[keep], y[keep], acc[nz][keep]))
        s = e
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*out))  # type: ignore[return-value]


def _block_product(pdf: pd.DataFrame) -> pd.DataFrame:
    bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    _, row = np.unique(pdf["basket"].to_numpy(), return_inverse=True)
    item, blk = pdf["item"].to_numpy(dtype=object).astype(str), pdf["blk"].to_numpy()
    n_rows = int(row.max()) + 1

    def side(b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, local = np.unique(item[blk == b], return_inverse=True)
        o = np.lexsort((local, row[blk == b]))
        return row[blk == b][o], local[o], names

    ri, ii, ni = side(bi)
    rj, ij, nj = (ri, ii, ni) if bi == bj else side(bj)
    x, y, n = _gram(ri, ii, rj, ij, n_rows, bi == bj)
    a, b = (ni[x], nj[y]) if len(n) else (np.empty(0, dtype=object), np.empty(0, dtype=object))
    swap = a > b
    return pd.DataFrame({"grp": pdf["grp"].iloc[0], "a": np.where(swap, b, a), "b": np.where(swap, a, b), "n": n})


def pairs_together(
    baskets: DataFrame,
    min_count: int = 4,
    min_lift: float = 2.0,
    entry_block: int = ENTRY_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """grp, item_a < item_b, n_ab, n_a, n_b, n_baskets, lift of every pair with
    n_ab >= min_count and n_ab * T >= min_lift * n_a * n_b.

    ``baskets`` has grp (string, null groups are kept as a group), basket
    (bigint) and items (array of distinct strings). T counts the baskets of
    the group that hold any item. Empty tables, empty baskets and baskets of
    one item give no pair.
    """
    held = cut(baskets.filter(F.size("items") > 0))
    total = held.groupBy("grp").agg(F.count(F.lit(1)).alias("t"))
    item_n = held.select("grp", F.explode("items").alias("item")).groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n"))
    # one row per group: bounded by the number of groups, AQE decides on a broadcast
    kept = (
        item_n.filter(F.col("n") >= min_count)
        .join(total.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g")))
        .filter(F.col("n") * min_lift <= F.col("t"))
        .drop("g")
    )
    kept = cut(kept)
    blocks = kept.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / item_block).alias("nb"), F.ceil(F.sum("n") / entry_block).alias("nr"))
    rows = held.select("grp", "basket", F.explode("items").alias("item"))
    rows = rows.join(kept.select(F.col("grp").alias("g"), F.col("item").alias("i")), F.col("grp").eqNullSafe(F.col("g")) & (F.col("item") == F.col("i")), "left_semi")
    rows = (
        rows.join(blocks.select(F.col("grp").alias("g"), "nb", "nr"), F.col("grp").eqNullSafe(F.col("g")))
        .withColumn("blk", F.pmod(F.xxhash64("item"), F.col("nb")).cast("int"))
        .withColumn("rb", F.pmod(F.xxhash64("basket"), F.col("nr")).cast("int"))
    )
    packed = rows.groupBy("grp", "rb", "basket").agg(F.collect_list(F.struct("blk", "item")).alias("x")).filter(F.size("x") > 1)
    bs = F.array_sort(F.array_distinct(F.transform("x", lambda e: e["blk"])))
    packed = packed.withColumn("bs", bs)
    pairs = F.flatten(
        F.transform("bs", lambda p: F.transform(F.filter("bs", lambda q: q >= p), lambda q: F.struct(p.alias("bi"), q.alias("bj"))))
    )
    routed = (
        packed.withColumn("p", F.explode(pairs))
        .select(
            "grp", "rb", "basket", F.col("p.bi").alias("bi"), F.col("p.bj").alias("bj"),
            F.filter("x", lambda e: (e["blk"] == F.col("p.bi")) | (e["blk"] == F.col("p.bj"))).alias("x"),
        )
        .filter(F.size("x") > 1)
    )
    flat = routed.select("grp", "rb", "basket", "bi", "bj", F.inline("x"))
    key = ["grp", "rb", "bi", "bj"]
    parts = flat.repartition(tasks(flat.sparkSession), *key).groupBy(*key).applyInPandas(_block_product, "grp string, a string, b string, n bigint")
    pair = parts.groupBy("grp", "a", "b").agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    na = kept.select(F.col("grp").alias("ga"), F.col("item").alias("ia"), F.col("n").alias("n_a"), F.col("t").alias("n_baskets"))
    nb = kept.select(F.col("grp").alias("gb"), F.col("item").alias("ib"), F.col("n").alias("n_b"))
    return (
        pair.join(na, F.col("grp").eqNullSafe(F.col("ga")) & (F.col("a") == F.col("ia")))
        .join(nb, F.col("grp").eqNullSafe(F.col("gb")) & (F.col("b") == F.col("ib")))
        .filter(F.col("n_ab") * F.col("n_baskets") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
        .select(
            "grp", F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", "n_baskets",
            (F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        )
    )
