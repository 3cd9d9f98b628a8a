"""Near-duplicate documents: SetSketch registers, banded candidates, joint likelihood, exact verification."""

from __future__ import annotations

import hashlib
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyport.llm.common import connected_components, handing_back, store

#: Registers of a sketch, the base of their exponential scale, rows of a band and bands.
REGISTERS, BASE, ROWS, BANDS = 256, 1.001, 8, 64
#: An estimate so far under the threshold (in similarity) rules a pair out; about four deviations.
SLACK = 0.12
#: Bytes of the fine sketch, and how far under the threshold the joint estimate of both sketches rules a pair out:
#: four deviations again.
FINE, FINE_SLACK = 1024, 0.045
#: Members of a block when a bucket is compared inside.
SIDE = 1024

_U = np.uint64
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | _U(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_FINE_MUL = (_rng.integers(0, 1 << 32, FINE, dtype=np.uint64) | _U(1)).astype(np.uint32)
_FINE_ADD = _rng.integers(0, 1 << 32, FINE, dtype=np.uint64).astype(np.uint32)
#: Two partitions of the registers into bands of ROWS.
_BAND = np.concatenate([_rng.permutation(REGISTERS).reshape(-1, ROWS) for _ in range(BANDS * ROWS // REGISTERS)])
_SALT = _rng.integers(1, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of a UTF-8 text.

    A-Z are lowered; words lie between the six ASCII white-space characters. A text of fewer words is one
    shingle; one without words has none.
    """
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def sketch(s: np.ndarray) -> np.ndarray:
    """REGISTERS truncated minima on an exponential scale: floor(1 - log_BASE(min)), of one value per shingle.

    The registers of a union are the larger ones of its parts, so sketches of parts merge.
    """
    h = (s >> _U(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        np.minimum(least, (h[at : at + 512, None] * _MUL + _ADD).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0)
    return np.clip(np.floor(1 - np.log(x) / log(BASE)), 0, 65535).astype(np.uint16)


def fine_sketch(s: np.ndarray) -> np.ndarray:
    """FINE more minima, each hashed to a byte: equal with the similarity's chance, or by accident (1 in 256)."""
    h = (s >> _U(32)).astype(np.uint32)
    least = np.full(FINE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 128):
        np.minimum(least, (h[at : at + 128, None] * _FINE_MUL + _FINE_ADD).min(axis=0), out=least)
    return (_mix(least.astype(np.uint64)) >> _U(56)).astype(np.uint8)


def estimate(d_equal: np.ndarray, d_first: np.ndarray, n_first: np.ndarray, n_second: np.ndarray) -> np.ndarray:
    """Similarity of two sets by joint likelihood of their registers, given how many are equal, how many are
    larger in the first, and the sets' sizes: the best point of a grid of 200."""
    grid = np.linspace(0.005, 1, 200)
    u, v = n_first / (n_first + n_second), n_second / (n_first + n_second)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / log(BASE)
    first, second = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    equal = np.clip(1 - first - second, 1e-12, 1)
    d_second = REGISTERS - d_equal - d_first
    ll = d_equal[:, None] * np.log(equal) + d_first[:, None] * np.log(first) + d_second[:, None] * np.log(second)
    # no similarity is above the ratio of the sizes
    ll[grid[None, :] > (np.minimum(n_first, n_second) / np.maximum(n_first, n_second))[:, None] + 0.005] = -np.inf
    return grid[np.argmax(ll, axis=1)]


def _name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("regs", pa.binary())])


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, cls, regs``: set size, a 128-bit name of the set and its sketch (both null if empty)."""

    def run(batches):
        for batch in batches:
            n, cls, regs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                cls.append(_name(s) if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip((n, cls, regs), list(_PROFILE)[1:]))], schema=_PROFILE)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(handing_back(run), "doc_id long, n long, cls binary, regs binary")


def _keys(regs: np.ndarray) -> np.ndarray:
    """The bucket of each sketch in each band."""
    keys, regs = np.zeros((len(regs), BANDS), np.uint64), regs.astype(np.uint64)
    for b in range(BANDS):
        keys[:, b] = _mix((regs[:, _BAND[b]] * _SALT[b, :ROWS]).sum(axis=1, dtype=np.uint64) + _SALT[b, ROWS])
    return keys


def _bands(reps: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                keys = _keys(regs)
                ids = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], schema=schema)

    return reps.select("rep", "regs").mapInArrow(handing_back(run), "key long, rep long")


_LINK = "a long, b long"


def _estimated(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate doesn't rule them out."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                p = batch.slice(at, 2048).to_pydict()
                x, y = (np.frombuffer(b"".join(p[k]), np.uint16).reshape(-1, REGISTERS) for k in ("r_a", "r_b"))
                j = estimate((x == y).sum(axis=1), (x > y).sum(axis=1), np.array(p["n_a"], float), np.array(p["n_b"], float))
                ok = np.flatnonzero(j >= least)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(p[k], np.int64)[ok]) for k in "ab"], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, _LINK)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("s").alias(f"s_{x}"))

    def run(batches):
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "s_a", "s_b"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, _LINK)


def _inside(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, score``: pairs of different components in one bucket that the estimates of both sketches allow.

    ``members``: key, rep, component, size (the bucket's). Buckets are cut into blocks of about SIDE, and each two
    blocks meet in one bounded task. A pair that shares several buckets is returned in the first of them.
    """
    least, fine_least = percent / 100 - SLACK, percent / 100 - FINE_SLACK

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = key[1], key[2]
        regs = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(-1, REGISTERS)
        band = int(np.argmax(_keys(regs[:1])[0].view(np.int64) == key[0]))
        fine = np.frombuffer(b"".join(pdf["fine"]), np.uint8).reshape(-1, FINE)
        comp, rep, n, block = (pdf[c].to_numpy() for c in ("component", "rep", "n", "block"))
        left = np.flatnonzero(block == p)
        right = left if p == q else np.flatnonzero(block == q)
        out = [np.empty((0, 3))]
        for i in left:
            js = right[(comp[right] != comp[i]) & ((rep[right] > rep[i]) if p == q else True)]
            js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
            if not len(js):
                continue
            equal = (regs[js] == regs[i]).sum(axis=1)
            js, equal = js[equal >= REGISTERS * (least - 0.05)], equal[equal >= REGISTERS * (least - 0.05)]
            if len(js):
                j = estimate(equal, (regs[i] > regs[js]).sum(axis=1), np.full(len(js), float(n[i])), n[js].astype(float))
                shared = (regs[js][:, _BAND] == regs[i][_BAND]).all(axis=2)
                ok = (j >= least) & ((np.argmax(shared, axis=1) == band) | ~shared[:, band])
                js, j = js[ok], j[ok]
                same = ((fine[js] == fine[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                j = (REGISTERS * j + FINE * same) / (REGISTERS + FINE)
                ok = j >= fine_least
                out.append(np.stack([np.full(ok.sum(), i), js[ok], j[ok]], axis=1))
        found = np.concatenate(out)
        i, j = found[:, 0].astype(int), found[:, 1].astype(int)
        return pd.DataFrame({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j]), "score": found[:, 2]})

    blocks = members.withColumn("blocks", F.ceil(F.col("size") / SIDE).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).select("key", "p", "q", "block", "rep", "component")
    blocks = blocks.join(reps, "rep").join(sets.select("rep", "fine"), "rep")
    return blocks.groupBy("key", "p", "q").applyInPandas(run, "a long, b long, score double").distinct()


def _apart(full: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``classes`` with a ``rep`` of its own for each, and the links (a, b) between the classes of one doc_id.

    Only a doc_id with several texts needs work: of the classes that share their least doc_id, one keeps it and the
    others get numbers above all doc_ids. They are linked with it, so no such number is a component's least.
    """
    several = full.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("doc_id")
    if several.isEmpty():
        return classes, classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    first = classes.groupBy("doc_id").agg(F.min("cls").alias("_first"))
    top = classes.agg(F.max("doc_id")).first()[0]
    others = classes.join(first, "doc_id").where(F.col("cls") != F.col("_first")).select("cls")
    others = store(others.withColumn("_rep", F.monotonically_increasing_id() + (top + 1)), "others")
    classes = store(classes.join(others, "cls", "left").withColumn("rep", F.coalesce("_rep", "rep")).drop("_rep"), "classes")
    own = full.join(several, "doc_id").select("doc_id", "cls").distinct().join(classes.select("cls", "rep"), "cls")
    least = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return classes, own.join(least, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Documents link if 100 * |A and B| >= ``percent`` * |A or B| for their sets of distinct word shingles.

    1. One pass gives each text its set's size, name and SetSketch. Equal sets are one class, whose least doc_id
       works for all; a hot class is pre-aggregated.
    2. BANDS bands of ROWS registers hash to buckets. Buckets of one member go.
    3. Each member is first compared with one partner, the least centre over its buckets, which joins most
       groups of copies in linear work; pairs pass the joint estimate, then the full sets decide.
    4. Buckets that still hold several components are compared inside, between components only, by a finer sketch
       too. Of the pairs that it allows, the full sets decide first on the best of each two components, then on
       all that still lie between components. So the components are those of all links whose documents share a
       bucket; at a similarity of 0.8 a pair shares none in about 3 of 100,000
       cases, at 0.85 in fewer than one in a million.

    Null texts and texts without words have size 0, no links, and keep themselves. A null doc_id takes no part: it is
    returned with a null component and kept false. Rows of one doc_id are one document, which links whatever any of its
    texts links; repeated rows are all returned, each with its own text's size. Other columns are ignored; an
    empty table gives an empty result.
    """
    least = percent / 100 - SLACK
    profile = store(profiles(docs, words), "profiles")
    full = profile.where("cls is not null and doc_id is not null")
    classes = full.groupBy("cls").agg(F.min(F.struct("doc_id", "n", "regs")).alias("m"))
    classes = store(classes.select("cls", F.col("m.doc_id").alias("doc_id"), F.col("m.doc_id").alias("rep"), F.col("m.n").alias("n"), F.col("m.regs").alias("regs")), "classes")
    classes, own = _apart(full, classes)
    reps = classes.select("rep", "n", "regs")
    keys = _bands(reps)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("centre")).where("size > 1")
    members = store(keys.join(shared, "key"), "members")
    some = classes.join(members.select("rep").distinct(), "rep", "left_semi")

    def sets_of(batches):
        for batch in batches:
            s = [shingles(t, words) for t in batch.column(1).to_pylist()]
            columns = [pa.array([_name(x) if len(x) else None for x in s], pa.binary()), pa.array([x.tobytes() for x in s], pa.binary()), pa.array([fine_sketch(x).tobytes() for x in s], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "s", "fine"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(some.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(handing_back(sets_of), "cls binary, s binary, fine binary").join(some.select("cls", "rep"), "cls").dropDuplicates(["cls"])
    sets = store(sets.select("rep", "s", "fine"), "sets")

    tree = members.where("rep != centre").groupBy("rep").agg(F.min("centre").alias("a")).select("a", F.col("rep").alias("b"))
    links = store(_verified(_estimated(tree, reps, least), sets, percent).union(own), "pairs")
    parts = store(connected_components(links), "parts")
    labels = members.join(parts, members["rep"] == parts["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = labels.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    pairs = store(_inside(labels.join(mixed.select("key", "size"), "key"), reps, sets, percent), "pairs")
    for only_best in (True, False):
        of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        between = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        between = between.withColumns({"c_a": F.coalesce("c_a", "a"), "c_b": F.coalesce("c_b", "b")}).where("c_a != c_b")
        if only_best:
            ends = [F.least("c_a", "c_b").alias("x"), F.greatest("c_a", "c_b").alias("y")]
            between = between.groupBy(*ends).agg(F.max(F.struct("score", "a", "b")).alias("m")).select("m.a", "m.b")
            first = between = store(between, "pairs")
        else:
            between = between.join(first, ["a", "b"], "left_anti")
        found = store(_verified(between.select("a", "b"), sets, percent), "pairs")
        if not found.isEmpty():
            links = links.unionByName(found)
            parts = store(connected_components(links), "parts")
    named = classes.select("cls", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component"))
    out = profile.join(named, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


OP6_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
                 else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
e as (select doc_id, unnest(s) as x from s),
c as (select doc_id, len(s) as n from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from p join c x on x.doc_id = a join c y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
reach as (select doc_id as node, doc_id as root from documents union select l.b, r.root from reach r join links l on l.a = r.node)
select node as doc_id, any_value(c.n) as n_shingles, min(root) as component_id, min(root) = node as kept
from reach join c on c.doc_id = node group by node
"""
