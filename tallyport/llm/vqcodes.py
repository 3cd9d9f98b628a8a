"""Vector code compression: product codes whose codebooks are fitted by Lloyd rounds over partition-local heaps."""

from __future__ import annotations

import hashlib
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyport.llm.common import discard, handing_back, store

#: Parts a vector is cut into, entries of a part's codebook, rounds, and components in a block (which bounds a task).
PARTS, ENTRIES, ROUNDS, BLOCK = 16, 64, 2, 1 << 18
#: Sums travel as limbs of 32 bits, so that no sum overflows.
LIMBS = 5

_STATE = "dim int, n long, kind string, ids array<long>, labels array<string>, data binary, entry binary, slack binary, at binary, sums binary"
_SUMS = "dim int, part int, entry int, place int, n long, " + ", ".join(f"l{i} long" for i in range(LIMBS))


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where each part starts and ends: equal parts if ``parts`` divides ``dim``, else they differ by one."""
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def quantise(v: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x), exact for every x that a float can hold (doubles beyond +-2^128 stay there): in the smallest
    integers that hold it, or as Python's integers."""
    v = np.clip(v, -(2.0**128), 2.0**128)
    most = float(np.abs(v).max()) if v.size else 0.0
    if most * scale < 2**62:
        q = np.floor(v * scale).astype(np.int64)
        kind = next(k for k in (np.int16, np.int32, np.int64) if most * scale < np.iinfo(k).max)
        return q.astype(kind)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else floor(x * scale) for x in v.ravel()]
    return np.array(exact, object).reshape(v.shape)


def _bound(x: np.ndarray) -> int:
    return max(map(abs, (int(x.min()), int(x.max())))) if x.size else 0


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of c: in doubles while these hold every term exactly, then
    in 63 bits, then in Python's integers."""
    span = x.shape[1] * (2 * max(_bound(x), _bound(c))) ** 2
    if span < 2**53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    kind = np.int64 if span < 2**63 else object
    x, c = x.astype(kind), c.astype(kind)
    out = np.zeros((len(x), len(c)), kind)
    for j in range(x.shape[1]):
        step = x[:, j][:, None] - c[:, j][None]
        out += step * step
    return out


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties to the lower index) and its slack: the distance of the next entry less that of its
    own, less a margin for rounding. Between the two bounds there is no other entry; a single entry has endless slack."""
    entry, slack = np.zeros(len(x), np.uint8), np.full(len(x), np.inf)
    for at in range(0, len(x), 4096):
        d = distances(x[at : at + 4096], c)
        best = d.argmin(1)
        entry[at : at + 4096] = best
        if d.shape[1] > 1:
            two = np.sort(d, axis=1)[:, :2].astype(np.float64) if d.dtype == object else np.partition(d, 1, axis=1)[:, :2].astype(np.float64)
            near, far = np.sqrt(two[:, 0]), np.sqrt(two[:, 1])
            slack[at : at + 4096] = far - near - 1e-9 * (far + near)
    return entry, slack


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much a round can take from the slack of each entry's parts: the entry's own move and the largest of the others."""
    step = (new.astype(object) - old.astype(object)) if old.size else np.zeros(old.shape)
    moved = np.sqrt((step * step).sum(1).astype(np.float64)) * (1 + 1e-9)
    others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(len(moved))])
    return moved + others


def _dump(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "text", ",".join(map(str, x.ravel())).encode()
    return x.dtype.name, x.tobytes()


def _load(kind: str, raw: bytes, rows: int) -> np.ndarray:
    if kind != "text":
        x = np.frombuffer(raw, kind)
    else:
        x = np.array([int(t) for t in raw.decode().split(",")] if raw else [], object)
    return x.reshape(rows, -1) if rows else x.reshape(0, 0)


class Block:
    """Vectors of one dimension with the heaps of their parts.

    Part p's heaps are one ascending array per entry (which has the heap property, so everything up to a bound is its
    front): ``at[p]`` lists the rows by entry and then by key, ``slack[p]`` their keys. A key is the slack at the time of
    the scan plus the drift that its entry's heap had gathered by then; it is violated once the heap's drift reaches it.
    """

    def __init__(self, dim, ids, labels, data, entry=None, slack=None, at=None):
        self.dim, self.ids, self.labels, self.data = dim, ids, labels, data
        self.entry, self.slack, self.at = entry, slack, at

    def start(self, books: list[np.ndarray]) -> None:
        n = len(self.data)
        self.entry, self.slack, self.at = np.zeros((PARTS, n), np.uint8), np.zeros((PARTS, n)), np.zeros((PARTS, n), np.int32)
        for p, (a, b) in enumerate(cuts(self.dim)):
            self.entry[p], keys = scan(self.data[:, a:b], books[p])
            self._order(p, np.arange(n), keys)

    def _order(self, p: int, rows: np.ndarray, keys: np.ndarray) -> None:
        by = np.lexsort((keys, self.entry[p][rows]))
        self.at[p], self.slack[p] = rows[by], keys[by]

    def update(self, p: int, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pops the parts whose key the gathered ``drift`` of their heap has reached, scans them again and pushes them
        back; returns the rows that changed their entry, and the entries they had."""
        a, b = cuts(self.dim)[p]
        ends = np.cumsum(np.bincount(self.entry[p], minlength=len(book)))
        fronts = [slice(s, s + int(np.searchsorted(self.slack[p][s:e], drift[j], "right"))) for j, (s, e) in enumerate(zip([0, *ends[:-1]], ends))]
        popped = np.concatenate([np.arange(f.start, f.stop) for f in fronts])
        rows = self.at[p][popped]
        if not len(rows):
            return rows, np.zeros(0, np.uint8)
        had = self.entry[p][rows].copy()
        self.entry[p][rows], fresh = scan(self.data[rows, a:b], book)
        keys = self.slack[p].copy()
        keys[popped] = fresh + drift[self.entry[p][rows]]
        self._order(p, self.at[p].copy(), keys)
        moved = had != self.entry[p][rows]
        return rows[moved], had[moved]

    def batch(self, sums: "_Sums") -> pa.RecordBatch:
        kind, data = _dump(self.data)
        row = (self.dim, len(self.data), kind, self.ids, self.labels, data, self.entry.tobytes(), self.slack.tobytes(), self.at.tobytes(), sums.packed())
        types = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 5]
        names = ["dim", "n", "kind", "ids", "labels", "data", "entry", "slack", "at", "sums"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    @classmethod
    def read(cls, row: dict) -> "Block":
        n = row["n"]
        shaped = lambda c, t: np.frombuffer(row[c], t).reshape(PARTS, n).copy()
        return cls(row["dim"], row["ids"], row["labels"], _load(row["kind"], row["data"], n), shaped("entry", np.uint8), shaped("slack", np.float64), shaped("at", np.int32))


def _blocks(batches):
    """Blocks of one dimension each from batches of (id, label, v)."""
    waiting: dict[int, list] = {}

    def made(dim):
        ids, labels, vectors = zip(*waiting.pop(dim))
        return Block(dim, sum(ids, []), sum(labels, []), quantise(np.concatenate(vectors)))

    for batch in batches:
        ids, labels, v = (batch.column(i) for i in range(3))
        dims, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(dims) - dims
        for dim in np.unique(dims).tolist():
            step = max(1, BLOCK // max(dim, PARTS))
            rows = np.flatnonzero(dims == dim)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                x = flat[starts[some][:, None] + np.arange(dim)].reshape(len(some), dim)
                waiting.setdefault(dim, []).append((ids.take(pa.array(some)).to_pylist(), labels.take(pa.array(some)).to_pylist(), x))
                if sum(len(w[0]) for w in waiting[dim]) >= step:
                    yield made(dim)
    for dim in list(waiting):
        yield made(dim)


class _Sums:
    """Sums and counts of components by (dim, part, entry), as exact integers."""

    def __init__(self):
        self.sums: dict = {}

    def add(self, dim: int, p: int, entries: np.ndarray, x: np.ndarray, sign: int) -> None:
        for j in np.unique(entries):
            mine = x[entries == j]
            total = [int(t) * sign for t in (mine.sum(0) if mine.dtype == object else mine.astype(np.int64).sum(0) if _bound(mine) * len(mine) < 2**62 else mine.astype(object).sum(0))]
            now = self.sums.setdefault((dim, p, int(j)), [0, [0] * x.shape[1]])
            now[0] += sign * len(mine)
            now[1] = [s + t for s, t in zip(now[1], total)]

    def packed(self) -> bytes:
        """The sums as an Arrow stream of rows of ``_SUMS``."""
        rows = []
        for (dim, p, j), (n, total) in self.sums.items():
            for place, t in enumerate(total):
                limbs = [(t >> (32 * i)) & 0xFFFFFFFF for i in range(LIMBS - 1)] + [t >> (32 * (LIMBS - 1))]
                rows.append((dim, p, j, place, n, *limbs))
        names = [c.split()[0] for c in _SUMS.split(", ")]
        types = [pa.int32()] * 4 + [pa.int64()] * (1 + LIMBS)
        columns = list(zip(*rows)) or [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()


def _unpacked(batches):
    for batch in batches:
        for raw in batch.column(0):
            yield from pa.ipc.open_stream(raw.as_buffer())


def _gathered(state: DataFrame) -> dict:
    """``(dim, part, entry) -> (n, sums)``: 64 entries' components a dimension, whatever the table's size."""
    sums, out = state.select("sums").mapInArrow(_unpacked, _SUMS), {}
    total = sums.groupBy("dim", "part", "entry", "place").agg(F.sum("n").alias("n"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)])
    for r in total.collect():
        n, places = out.setdefault((r.dim, r.part, r.entry), [r.n, {}])
        places[r.place] = sum(r[f"l{i}"] << (32 * i) for i in range(LIMBS))
    return {k: (n, [places[i] for i in range(len(places))]) for k, (n, places) in out.items()}


def first_books(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """By dimension, each part's first codebook: the part of the ENTRIES smallest ids, ascending; equal ids in the order
    of their vectors, null ids last."""
    books = {}
    for dim in [r[0] for r in rows.select(F.size("v")).distinct().collect()]:
        first = rows.where(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
        q = quantise(np.array([r.v for r in first], np.float64).reshape(len(first), dim))
        books[dim] = [q[:, a:b].astype(object) for a, b in cuts(dim)]
    return books


def _narrow(books: dict) -> dict:
    """Codebooks in 63 bits where they fit."""
    return {d: [b.astype(np.int64) if _bound(b) < 2**62 else b for b in parts] for d, parts in books.items()}


def books_digest(books: list[np.ndarray]) -> str:
    """Hex SHA-256 of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def _scanned(books: dict):
    """Tasks of the first round: blocks are cut, every part is scanned, all parts' sums go out."""

    def run(batches):
        for block in _blocks(batches):
            sums = _Sums()
            block.start(books[block.dim])
            for p, (a, b) in enumerate(cuts(block.dim)):
                sums.add(block.dim, p, block.entry[p], block.data[:, a:b], 1)
            yield block.batch(sums)

    return run


def _updated(books: dict, drift: dict):
    """Tasks of a later round: heaps are popped up to the drift, the moved parts' sums go out."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, sums = Block.read(batch.slice(i, 1).to_pylist()[0]), _Sums()
                for p, (a, b) in enumerate(cuts(block.dim)):
                    rows, had = block.update(p, books[block.dim][p], drift[block.dim][p])
                    x = block.data[rows, a:b]
                    sums.add(block.dim, p, had, x, -1)
                    sums.add(block.dim, p, block.entry[p][rows], x, 1)
                yield block.batch(sums)

    return run


def _coded(books: dict):
    """Tasks that turn blocks back into rows: codes, and each row's exact squared distance to its entries."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.read(batch.slice(i, 1).to_pylist()[0])
                n, error = len(block.data), 0
                for p, (a, b) in enumerate(cuts(block.dim)):
                    own = books[block.dim][p][block.entry[p]]
                    exact = object if (2 * max(_bound(block.data[:, a:b]), _bound(own))) ** 2 * max(1, block.dim) >= 2**63 else np.int64
                    step = block.data[:, a:b].astype(exact) - own.astype(exact)
                    error = error + (step * step).sum(1) if step.size else error + np.zeros(n, np.int64)
                code = [block.entry[:, r].tobytes() for r in range(n)]
                error = [min(int(e), 2**63 - 1) for e in error]
                arrays = [pa.array(block.ids, pa.int64()), pa.array(block.labels, pa.string()), pa.array([block.dim] * n, pa.int32()), pa.array(code, pa.binary()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "dim", "code", "error"])

    return run


def fit_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, dict]:
    """``(rows, books)``: rows ``vec_id, label, dim, code, error`` of every usable vector, ``code`` one byte a part, and
    the final codebooks by dimension: a list of PARTS integer arrays (entries, components).

    Components become floor(256 * x), exactly (those of doubles beyond +-2^128, which no float reaches, stay there); each part has its own codebook, which ROUNDS rounds fit: every part to
    its nearest entry (squared Euclidean distance, ties to the lower index), then each entry to the floor of its parts'
    mean; entries without parts stay. The vectors are cut into blocks where they lie, without a shuffle. A block
    keeps its heaps from round to round in a stage table, so any task can go on with it: after a round only the parts
    whose bounds the gathered drift has reached are popped and scanned again, and only parts that moved change the
    sums. The driver holds codebooks, 64 entries a dimension, and nothing that grows with the rows.

    Vectors that are null or hold null or non-finite components are dropped. Rows of a repeated or null id are rows of
    their own. Vectors of another dimension have codebooks of their own; a dimension that 16 doesn't divide is cut into
    parts that differ by one component, some empty below 16 (code 0, error 0). Fewer than 64 vectors give as many
    entries. Errors over 63 bits read 2^63 - 1. Labels are returned as text. Other columns are ignored; an empty table
    gives no rows.
    """
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(good)
    books = first_books(rows)
    drift = {d: [np.zeros(len(b)) for b in parts] for d, parts in books.items()}
    held: dict = {}
    state = store(rows.mapInArrow(handing_back(_scanned(_narrow(books))), _STATE), "codes")
    for _ in range(ROUNDS):
        for key, (n, total) in _gathered(state).items():
            had = held.get(key, (0, [0] * len(total)))
            held[key] = had[0] + n, [a + b for a, b in zip(had[1], total)]
        for d, parts in books.items():
            for p, old in enumerate(parts):
                new = old.copy()
                for j in range(len(old)):
                    n, total = held.get((d, p, j), (0, []))
                    if n:
                        new[j] = [t // n for t in total]
                drift[d][p] = drift[d][p] + drifts(old, new)
                parts[p] = new
        after = store(state.mapInArrow(handing_back(_updated(_narrow(books), drift)), _STATE), "codes")
        discard(state)
        state = after
    final = _narrow(books)
    out = store(state.mapInArrow(handing_back(_coded(final)), "vec_id long, label string, dim int, code binary, error long"), "coded")
    discard(state)
    return out, final


def with_label_errors(coded: DataFrame, salts: int = 32) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of an equal label, nulls together, up to 2^63 - 1.

    Labels' totals are sent once to each of ``salts`` shares of their rows, so a hot label isn't one task's.
    """
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(28,0)")).cast("decimal(38,0)"), most).cast("long")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    sums = sums.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = coded.withColumn("_mine", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(salts)).cast("int"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_mine") == F.col("_share"))).drop("_label", "_share", "_mine")


def codes_with_errors(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of the usable vectors, the code as hex digits."""
    coded, books = fit_codes(vectors)
    digest = F.coalesce(*[F.when(F.col("dim") == d, books_digest(b)) for d, b in books.items()], F.lit(None).cast("string"))
    return with_label_errors(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    return f"""
  select vec_id, p, arg_min(j, (d, j)) as j, min(d) as d
  from (select x.vec_id, x.p, c.j, list_sum(list_transform(list_zip(x.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from parts x join {book} c using (p))
  group by vec_id, p"""


def _moved(book: str, given: str) -> str:
    return f"""
  select c.p, c.j, coalesce(m.q, c.q) as q from {book} c left join (
    select p, j, list(cast(floor(s / n) as bigint) order by i) as q
    from (select a.p, a.j, i, sum(q[i]) as s, count(*) as n from {given} a join parts using (vec_id, p), (select unnest(range(1, 1000)) as i) where i <= len(q) group by a.p, a.j, i)
    group by p, j) m using (p, j)"""


OP13_SQL = f"""
with v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (
  select vec_id, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] as q from v, (select unnest(range(16)) as p)),
book0 as (select p, row_number() over (partition by p order by vec_id) - 1 as j, q from parts join (select vec_id from v order by vec_id limit 64) using (vec_id)),
near0 as ({_assigned("book0")}),
book1 as ({_moved("book0", "near0")}),
near1 as ({_assigned("book1")}),
book2 as ({_moved("book1", "near1")}),
near2 as ({_assigned("book2")}),
coded as (select vec_id, string_agg(printf('%02x', j), '' order by p) as code, cast(sum(d) as bigint) as error from near2 group by vec_id),
labelled as (select label, cast(sum(error) as bigint) as label_error from coded join v using (vec_id) group by label),
digest as (select sha256(string_agg(array_to_string(q, ','), ',' order by p, j)) as codebooks_sha256 from book2)
select vec_id, code, error, label_error, codebooks_sha256
from coded join v using (vec_id) join labelled l on v.label is not distinct from l.label, digest
"""
