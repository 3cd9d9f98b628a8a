"""Exact top-k search by integer inner product over a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows in an index segment and queries in a block, on average. Both bound a task's memory.
SEGMENT, BLOCK = 32768, 256


def quantise(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); beyond +-2^62, which leaves no room in 63 bits, they stay there."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * vectors.astype(np.float64)), -(2.0**62), 2.0**62).astype(np.int64)


def build_slices(q: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit slices ``(dim, bits, words)`` of ``q - q.min()``, rows along the bits of the words; and the minimum."""
    low = int(q.min())
    y = q.astype(np.uint64) - np.uint64(low % 2**64)
    bits = max(1, int(y.max()).bit_length())
    words = -(-len(q) // 64)
    out = np.zeros((q.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64), low


def add_slices(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Adds bitmaps: ``columns[c]`` is ``(n, words)`` of weight 2^c. Returns one bitmap per bit of the sums.

    Carry-save: a full adder turns three bitmaps of a weight into one of it and one of the next, for all triples
    at once, until each weight has one bitmap.
    """
    out, carry, c = [], [], 0
    while c < len(columns) or carry:
        have = [columns[c]] if c < len(columns) and len(columns[c]) else []
        rows = np.concatenate(have + carry) if have or carry else None
        carry, c = [], c + 1
        if rows is None:
            out.append(None)
            continue
        while len(rows) > 1:
            n = len(rows) // 3 * 3
            if n:
                x, y, z = rows[0:n:3], rows[1:n:3], rows[2:n:3]
                half = x ^ y
                carry.append((x & y) | (half & z))
                rows = np.concatenate([half ^ z, rows[n:]])
            else:
                carry.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        out.append(rows[0])
    return out


def _positions(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    if most is not None and len(words) > most:
        words = words[:most]
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, b = np.nonzero(bits)
    return (words[r] * 64 + b)[:most]


def top_rows(sums: list[np.ndarray], live: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest sums among ``live`` rows, ties to the lower position.

    From the most significant slice downward: rows surely in, rows still level. The boundary's level rows are
    equal in every slice, so the lowest positions among them are exact.
    """
    sure, level = np.zeros_like(live), live
    for s in reversed(sums):
        if s is None:
            continue
        ones = level & s
        n = int(np.bitwise_count(sure).sum() + np.bitwise_count(ones).sum())
        if n > k:
            level = ones
        else:
            sure, level = sure | ones, level & ~s
            if n == k:
                return _positions(sure)
    first = _positions(sure)
    return np.concatenate([first, _positions(level, k - len(first))])


def search_segment(slices: np.ndarray, low: int, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """For each query its k best rows of one segment: ``(query_id, vec_id, high, low)`` arrays, the score being high * 2^62
    + low, exactly. ``ids`` ascend."""
    dim, bits, words = slices.shape
    all_live = np.zeros(words * 64, np.uint8)
    all_live[: len(ids)] = 1
    all_live = np.packbits(all_live, bitorder="little").view(np.uint64)
    ones = (1 << bits) - 1
    found = []
    for q, own in zip(queries, query_ids):
        q = q.tolist()
        live, at, end = all_live, int(np.searchsorted(ids, own)), int(np.searchsorted(ids, own, "right"))
        if at < end:
            live = all_live.copy()
            np.bitwise_and.at(live, np.arange(at, end) >> 6, ~(np.uint64(1) << (np.arange(at, end) & 63).astype(np.uint64)))
        # |q_d| * y_d, where y_d is the stored slice or, for a negative component, its complement: all terms >= 0
        base, columns = 0, [[] for _ in range(bits + max(abs(v) for v in q).bit_length() + 1)]
        for d, v in enumerate(q):
            base += v * low + (v * ones if v < 0 else 0)
            size, part = abs(v), None
            for j in range(size.bit_length()):
                if size >> j & 1:
                    part = (~slices[d] if v < 0 else slices[d]) if part is None else part
                    for b in range(bits):
                        columns[j + b].append(part[b])
        sums = add_slices([np.array(c) if c else np.empty((0, words), np.uint64) for c in columns])
        rows = top_rows(sums, live, k)
        wide = len(sums) > 61 or abs(base) >= 2**61
        score = np.full(len(rows), base, object if wide else np.int64)
        for c, s in enumerate(sums):
            if s is not None:
                bit = ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
                score += bit.astype(object) << c if wide else bit << c
        found.append((np.full(len(rows), own), ids[rows], (score >> 62).astype(np.int64), (score & (2**62 - 1)).astype(np.int64)))
    return [np.concatenate(x) for x in zip(*found)]


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest integer inner product with each query.

    Components become floor(scale * x), x as double; beyond +-2^62 they stay there. Scores are added up and ranked exactly,
    however large; one that doesn't fit in 63 bits is returned as the nearest number that does. Queries are the rows where ``is_query`` (a Column over ``id_col``) holds; candidates are all
    rows of the same dimension with another id; ties go to the smaller id. Rows are dealt by hash into segments of
    about SEGMENT rows, each bit-sliced once. A segment stays in its task, and the query blocks of about BLOCK rows
    stream past it (a stated query set against all rows, in blocks); only where there are fewer segments than cores
    is a segment sent to several tasks, which share the blocks. Segments return k rows a query, and a window with
    partial limits keeps the best k.

    Vectors that are null, empty or hold null or non-finite components and rows with a null id take no part. Rows of
    a repeated id are rows of their own: each is a candidate, and each query row adds its candidates to those of its
    id. Fewer than k candidates: all of them. Other columns are ignored; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull())
    rows = rows.where(good).withColumn("dim", F.size("v"))
    n, n_asked = vectors.agg(F.count(F.lit(1)), F.count_if(is_query(F.col(id_col).cast("long")))).first()
    segments, blocks = max(1, -(-n // SEGMENT)), max(1, -(-n_asked // BLOCK))
    shares = max(1, min(blocks, spark.sparkContext.defaultParallelism // segments))
    schema = "dim int, segment long, share long, block long, low long, ids binary, data binary"

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        slices, low = build_slices(quantise(np.stack(pdf["v"].to_numpy()), scale))
        share = np.arange(shares)
        return pd.DataFrame({"dim": slices.shape[0], "segment": pdf["segment"].iloc[0], "share": share, "block": -1, "low": low, "ids": pdf["id"].to_numpy(np.int64).tobytes(), "data": slices.tobytes()}, index=share)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        q = quantise(np.stack(pdf["v"].to_numpy()), scale)
        return pd.DataFrame({"dim": [q.shape[1]], "share": [pdf["block"].iloc[0] % shares], "block": [pdf["block"].iloc[0]], "low": [0], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "data": [q.tobytes()]})

    built = rows.withColumn("segment", F.pmod(F.xxhash64("id", "v"), F.lit(segments))).groupBy("dim", "segment").applyInPandas(index, schema)
    asked = rows.where(is_query(F.col("id"))).withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(7)), F.lit(blocks)))
    packed = asked.groupBy("dim", "block").applyInPandas(block, "dim int, share long, block long, low long, ids binary, data binary")
    packed = packed.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(segments - 1).cast("long")))).select(*built.columns)

    def search(batches):
        held = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                if r.block < 0:  # a segment comes before its query blocks
                    held = (r.dim, r.segment, r.share), np.frombuffer(r.data, np.uint64).reshape(r.dim, -1, -(-len(ids) // 64)), r.low, ids
                elif held is not None and held[0] == (r.dim, r.segment, r.share):
                    a, b, c, d = search_segment(*held[1:], np.frombuffer(r.data, np.int64).reshape(len(ids), -1), ids, k)
                    yield pd.DataFrame({"query_id": a, "vec_id": b, "high": c, "low": d})

    dealt = built.unionByName(packed).repartition(max(1, min(segments * shares, 8 * spark.sparkContext.defaultParallelism)), "dim", "segment", "share")
    hits = dealt.sortWithinPartitions("dim", "segment", "share", "block").mapInPandas(search, "query_id long, vec_id long, high long, low long")
    best = W.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    score = F.when(F.col("high") > 1, 2**63 - 1).when(F.col("high") < -2, -(2**63)).otherwise(F.shiftleft("high", 62).bitwiseOR(F.col("low")))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.cast("long").alias("score"))


OP1_SQL = """
with v as (
  select vec_id as id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.id as query_id, b.id as vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.id % 20 = 0 and a.id <> b.id and len(a.q) = len(b.q)),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 20
"""
