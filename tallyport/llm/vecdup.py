"""Near-duplicate vectors by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyport.llm.common import connected_components, store

PROJECTIONS, WINDOW, MISS, SIDE = 48, 1.5, 1e-7, 2048


def least_count(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair exactly at the threshold fails to reach with probability ``miss`` at most.

    Such a pair's difference along a Gaussian direction is normal with its distance as deviation; ``window`` is
    the half-width in those deviations, so each projection collides with probability erf(window / sqrt 2).
    """
    p, below = erf(window / sqrt(2)), 0.0
    for n in range(projections + 1):
        below += comb(projections, n) * p**n * (1 - p) ** (projections - n)
        if below > miss:
            return n
    return projections


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def link_blocks(x: np.ndarray, y: np.ndarray, directions: np.ndarray, least: int, cosine: float, same: bool):
    """Links ``(i, j)`` between the unit rows of x and y (i < j if they are the same block).

    Projections are sorted; for each x row the y rows in its window are a run of the sorted order, counted for
    all pairs with one running sum per projection. Pairs with ``least`` collisions are verified in doubles.
    """
    px, py = x @ directions, y @ directions
    half = WINDOW * sqrt(2 - 2 * cosine)
    out_i, out_j = [], []
    order = np.argsort(py, axis=0, kind="stable")
    sorted_y = np.ascontiguousarray(np.take_along_axis(py, order, axis=0).T)
    place = np.empty(sorted_y.shape, np.int32)
    np.put_along_axis(place, order.T, np.arange(len(y), dtype=np.int32)[None, :], axis=1)
    for at in range(0, len(x), 512):
        rows = px[at : at + 512]
        count = np.zeros((len(rows), len(y)), np.uint8)
        for d in range(directions.shape[1]):
            lo, hi = np.searchsorted(sorted_y[d], rows[:, d] - half), np.searchsorted(sorted_y[d], rows[:, d] + half, "right")
            count += (place[d] - lo[:, None].astype(np.int32)).view(np.uint32) < (hi - lo)[:, None].astype(np.uint32)
        i, j = np.nonzero(count >= least)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 200_000):
            a, b = i[part : part + 200_000], j[part : part + 200_000]
            ok = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
            out_i.append(a[ok])
            out_j.append(b[ok])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: links by cosine >= ``cosine`` within a label.

    Equal vectors of a label form a class first; a class works once and its copies count in ``n_links``. The
    classes of a label (and dimension) are dealt by hash into blocks of about SIDE rows; each pair of blocks is
    one bounded task that counts window collisions, verifies, and returns linear output: link counts and, for
    the components, one edge from each class to the least class it reaches there. A hot label only has more
    blocks. A pair at the threshold is missed with probability MISS at most.

    Null, empty or zero vectors, vectors with null or non-finite components and rows with a null label link with
    nothing and keep themselves. Rows of a repeated id are rows of their own: they link if their vectors do, and each is
    returned with what it reaches itself. Rows with a null id are returned with a null component and take no part. Other columns
    are ignored; an empty table gives an empty result.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size("v") > 0) & finite, F.lit(False))
    # -0.0 equals 0.0 but hashes apart: adding 0.0 makes them the same
    rows = rows.withColumn("cls", F.when(ok, F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string")))), 256)))
    rows = store(rows, "vectors")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = store(classes.withColumns({"dim": F.size("v"), "name": F.xxhash64("cls")}), "classes")
    groups = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("blocks"))
    least = least_count()

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, p, q = int(key[1]), key[2], key[3]
        pdf = pdf.sort_values(["rep", "name"], kind="stable")
        x = np.stack(pdf["v"].to_numpy())
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        directions = np.random.default_rng(dim).standard_normal((dim, PROJECTIONS))
        left = np.flatnonzero(pdf["block"].to_numpy() == p)
        right = left if p == q else np.flatnonzero(pdf["block"].to_numpy() == q)
        if not len(left) or not len(right):
            return pd.DataFrame({"cls": pd.Series([], dtype=object), "rep": pd.Series([], dtype="int64"), "name": pd.Series([], dtype="int64"), "links": pd.Series([], dtype="int64"), "to": pd.Series([], dtype="int64"), "to_name": pd.Series([], dtype="int64")})
        i, j = link_blocks(x[left], x[right], directions, least, cosine, p == q)
        i, j = left[i], right[j]
        copies = pdf["copies"].to_numpy()
        links = np.bincount(i, copies[j], len(pdf)) + np.bincount(j, copies[i], len(pdf))
        hit = np.flatnonzero(links)
        rep, name, to = pdf["rep"].to_numpy(), pdf["name"].to_numpy(), _smallest(len(pdf), i, j)[hit]
        return pd.DataFrame({"cls": pdf["cls"].to_numpy()[hit], "rep": rep[hit], "name": name[hit], "links": links[hit].astype(np.int64), "to": rep[to], "to_name": name[to]})

    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = classes.join(groups, ["label", "dim"]).withColumn("block", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    found = store(dealt.groupBy("label", "dim", "p", "q").applyInPandas(work, "cls string, rep long, name long, links long, to long, to_name long"), "links")
    node = lambda rep, name: F.struct(F.col(rep).alias("rep"), F.col(name).alias("name"))
    parts = connected_components(found.select(node("rep", "name").alias("a"), node("to", "to_name").alias("b")))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    info = classes.select("cls", "rep", "name", "copies").join(counts, "cls", "left").join(parts, (F.col("rep") == F.col("node.rep")) & (F.col("name") == F.col("node.name")), "left")
    info = info.select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component.rep", "rep").alias("component"))
    out = rows.select("vec_id", "cls").join(info, "cls", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


OP8_SQL = """
with recursive r as (select row_number() over () as rid, * from embeddings),
v as (
  select rid, vec_id, label, cast(embedding as double[]) as e from r
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.rid as a, b.rid as b from v a join v b on a.label = b.label and a.rid <> b.rid and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (
  select rid as node, vec_id as root from v union select l.b, h.root from reach h join links l on l.a = h.node),
least as (select node, min(root) as root from reach group by node),
counts as (select a as rid, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(root, vec_id) as component_id, coalesce(coalesce(root, vec_id) = vec_id, false) as kept
from r left join counts using (rid) left join least on node = rid
"""
