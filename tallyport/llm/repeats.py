"""Removal of repeated byte strings: a depth-limited radix sort of the corpus's suffixes, sparse in its first pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyport.llm.common import handing_back, store

#: Depth of the sort in bytes, depth of its first digit, and bytes that a task looks at together.
DEPTH, DIGIT, CHUNK = 100, 32, 1 << 20
#: Rows that a task gathers before it combines equal ones.
GATHER = 1 << 20
_TIE = 7  # low bits of a digit that break ties by position: 2^7 covers a window's places

#: What a suffix's place holds, from its highest bits: where it starts, a flag for ties, what became of it, and how many
#: of the suffixes that follow each other from there on are meant, those left of the middle and all.
_AT, _TIED, _KIND, _LEFT = 24, 20, 16, 8
REPEATED, OPEN = 1, 2

_SUFFIX = ["digit", "rest", "doc", "h", "place", "sides"]
_SUFFIXES = ", ".join(f"{c} long" for c in _SUFFIX)


class Digits:
    """Fingerprints of byte runs, all of a buffer's from one running sum: a run's bytes, mapped to random 64-bit values,
    weigh odd powers modulo 2^64."""

    def __init__(self, seed: int, most: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, np.uint64)
        base = int(rng.integers(0, 2**63)) * 2 + 1
        inverse = pow(base, -1, 2**64)
        self.up, self.down = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(most, b, np.uint64)], dtype=np.uint64) for b in (base, inverse))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.down[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.up[start])


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of 64-bit values stirred, one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row: two running minima that restart at every ``width``."""
    n = len(x) - width + 1
    most = np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)
    rows = np.concatenate([x, most]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _table(columns: list[np.ndarray], names: list[str] = _SUFFIX) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64, copy=False)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, one after another, and where each ends (with a leading zero)."""
    raw = column.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _chunks(data: np.ndarray, ends: np.ndarray):
    """``first, bytes, owner``: pieces of the batch with the text that owns each suffix, -1 if it is too short. Pieces
    overlap, so that each suffix lies in one piece to its full depth."""
    for at in range(0, len(data) - DEPTH + 1, CHUNK):
        piece = data[at : at + CHUNK + DEPTH - 1]
        starts = np.arange(at, at + len(piece) - DEPTH + 1)
        owner = np.searchsorted(ends[1:], starts, "right")
        owner[starts + DEPTH > ends[1:][owner]] = -1
        yield at, piece, owner


def sparse_suffixes(piece: np.ndarray, owner: np.ndarray, one: Digits, two: Digits):
    """Runs of suffixes of a piece that share their least digit: ``start, count, left, tied, digit, rest, sides``.

    A suffix's first DIGIT-byte strings, as far as they lie in its DEPTH bytes, have fingerprints; the least is its first
    digit, wherever it stands, so equal suffixes have equal first digits, and neighbours mostly the same one. ``rest`` is
    the fingerprint of all bytes of the run's suffixes with the digit's place among them. ``sides`` are two more digits of
    32 bits, around the first one to the left and to the right: a suffix with at least half of its other bytes to the
    left (the run's first ``left`` ones) holds all bytes of the left one, any other those of the right one. ``tied`` tells
    that the least digit stands at several places, so that its place needn't be the same in equal suffixes.
    """
    width, reach = DEPTH - DIGIT + 1, (DEPTH - DIGIT) // 2
    sums, more = one.sums(piece), two.sums(piece)
    at = np.arange(len(piece) - DIGIT + 1)
    low, tie = np.uint64((1 << _TIE) - 1), at.astype(np.uint64) & np.uint64((1 << _TIE) - 1)
    key = one.of(sums, at, at + DIGIT) & ~low
    least = sliding_least(key | tie, width)
    s = np.arange(len(least))
    found = lambda bits: s + ((bits.astype(np.int64) - s) & ((1 << _TIE) - 1))
    place = found(least & low)
    other = found(low - (sliding_least(key | (low - tie), width) & low))
    new = np.ones(len(s), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(s)))
    tied = np.logical_or.reduceat(other != place, start) if len(start) else np.zeros(0, bool)
    good = owner[start] >= 0
    start, count, tied = start[good], count[good], tied[good]
    mark = place[start]
    digit = mixed(least[start] >> np.uint64(_TIE))
    rest = mixed(two.of(more, start, start + count - 1 + DEPTH) + (mark - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    left = np.clip(mark - reach - start + 1, 0, count)
    before = two.of(more, np.maximum(mark - reach, 0), mark + DIGIT) >> np.uint64(32)
    behind = two.of(more, mark, np.minimum(mark + DIGIT + reach, len(piece))) >> np.uint64(32)
    return start, count, left, tied, digit, rest, (before << np.uint64(32)) | behind


def combined(rows: list[np.ndarray]) -> list[np.ndarray]:
    """A task's rows (columns as ``_SUFFIX``) with one row left of those of equal digit and rest: the first by place. The
    later ones are repeats, whatever other tasks hold, and leave their group."""
    digit, rest, doc, h, place, sides = rows
    both = digit ^ mixed(rest)
    order = np.argsort(both, kind="stable")
    again = both[order][1:] == both[order][:-1]
    if not again.any():
        return rows
    at = order[np.append(again, False) | np.insert(again, 0, False)]
    at = at[np.lexsort((place[at], h[at], doc[at], rest[at], digit[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (digit[at][1:] != digit[at][:-1]) | (rest[at][1:] != rest[at][:-1])
    first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    same = (doc[at] == doc[first]) & (h[at] == h[first]) & (place[at] == place[first])
    later, place, digit = at[~same], place.copy(), digit.copy()
    place[later] |= REPEATED << _KIND
    digit[later] = mixed(place[later].astype(np.uint64) + doc[later].astype(np.uint64))
    keep = np.ones(len(digit), bool)
    keep[at[same & ~new]] = False
    return [c[keep] for c in (digit, rest, doc, h, place, sides)]


def _gathering(found):
    """``found`` (batch -> column lists) with a task's rows combined, some GATHER at a time."""

    def run(batches):
        rows, n = [], 0
        for batch in batches:
            for columns in found(batch):
                rows.append(columns)
                n += len(columns[0])
                if n >= GATHER:
                    yield _table(combined([np.concatenate(c) for c in zip(*rows)]))
                    rows, n = [], 0
        if n:
            yield _table(combined([np.concatenate(c) for c in zip(*rows)]))

    return run


def _first_pass():
    one, two = Digits(1, CHUNK + DEPTH), Digits(2, CHUNK + DEPTH)

    def found(batch):
        doc, h = (batch.column(i).to_numpy() for i in range(2))
        data, ends = _texts(batch.column(2))
        for at, piece, owner in _chunks(data, ends):
            start, count, left, tied, digit, rest, sides = sparse_suffixes(piece, owner, one, two)
            text = owner[start]
            place = (at + start - ends[text] << _AT) | (tied.astype(np.int64) << _TIED) | (left << _LEFT) | count
            yield digit, rest, doc[text], h[text], place, sides

    return _gathering(found)


def _last_pass():
    """Every suffix that the earlier passes left open, with the fingerprint of its DEPTH bytes."""
    one, two = Digits(3, CHUNK + DEPTH), Digits(4, CHUNK + DEPTH)

    def found(batch):
        doc, h = (batch.column(i).to_numpy() for i in range(2))
        data, ends = _texts(batch.column(2))
        spans = batch.column(3)
        places, owner = spans.flatten().to_numpy(), np.repeat(np.arange(len(doc)), spans.value_lengths().to_numpy())
        first, count = ends[owner] + (places >> _AT), places & 0xFF
        text = np.repeat(owner, count)
        s = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        s, at = np.unique(s, return_index=True)
        text = text[at]
        for at in range(0, len(data) - DEPTH + 1, CHUNK):
            a, b = np.searchsorted(s, (at, at + CHUNK))
            if a < b:
                piece, mine, own = data[at : at + CHUNK + DEPTH - 1], s[a:b] - at, text[a:b]
                digit, rest = (d.of(d.sums(piece), mine, mine + DEPTH) for d in (one, two))
                yield digit, rest, doc[own], h[own], (s[a:b] - ends[own] << _AT) | 1, np.zeros(b - a, np.int64)

    return _gathering(found)


def _resolved(batches):
    """Sorted rows -> those that are repeats, and those left open: the first rows of rests that share a digit."""
    held, known, told = None, False, False  # the first row of the last run; is its digit open, has the row been told
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(len(_SUFFIX))]
        done = (rows[4] >> _KIND & 3) == REPEATED
        if done.any():
            yield _table([c[done] for c in rows])
            rows = [c[~done] for c in rows]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.insert(c, 0, x) for c, x in zip(rows, held)]
        digit, rest, doc, h, place, sides = rows
        group, run = np.ones(len(digit), bool), np.ones(len(digit), bool)
        group[1:] = digit[1:] != digit[:-1]
        run[1:] = group[1:] | (rest[1:] != rest[:-1])
        first = np.maximum.accumulate(np.where(run, np.arange(len(digit)), 0))
        later = ~run & ((doc != doc[first]) | (h != h[first]) | (place != place[first]))
        number = np.cumsum(group) - 1
        runs = np.bincount(number, run)
        runs[0] += known
        opened = run & ((runs[number] > 1) | ((place >> _TIED & 1) == 1))
        opened[0] &= not told
        kind = np.where(later, REPEATED, OPEN) << _KIND
        some = later | opened
        told = bool(opened[first[-1]]) or (told and first[-1] == 0)
        held, known = [c[first[-1]] for c in rows], bool(runs[-1] > 1)
        if some.any():
            yield _table([digit[some], rest[some], doc[some], h[some], place[some] | kind[some], sides[some]])


def _pass(rows: DataFrame) -> DataFrame:
    """One pass: rows dealt by their digit, sorted, and resolved as they stream by."""
    return rows.repartition("digit").sortWithinPartitions(*_SUFFIX[:5]).mapInArrow(_resolved, _SUFFIXES)


def _kind() -> Column:
    return F.shiftright("place", _KIND).bitwiseAND(F.lit(3))


def _still_open(marks: DataFrame) -> DataFrame:
    """``doc, h, place`` of the suffixes that a second pass leaves open: those whose next digit, to the side that they
    reach into, stands in several runs; tied ones pass."""
    some = marks.where(_kind() == OPEN)
    tied = F.shiftright("place", _TIED).bitwiseAND(F.lit(1)) == 1
    count, left = F.col("place").bitwiseAND(F.lit(0xFF)), F.shiftright("place", _LEFT).bitwiseAND(F.lit(0xFF))
    at = F.shiftright("place", _AT)
    span = lambda start, n: F.shiftleft(start, _AT).bitwiseOR(n)
    half = lambda side, value, start, n: F.struct(F.xxhash64("digit", F.lit(side), value).alias("key"), span(start, n).alias("place"), n.alias("n"))
    two = F.array(half(0, F.shiftrightunsigned("sides", 32), at, left), half(1, F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)), at + left, count - left))
    halves = some.where(~tied).select("doc", "h", F.explode(two).alias("x")).select("doc", "h", "x.*").where("n > 0")
    shared = halves.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    return halves.join(shared, "key").select("doc", "h", "place").unionByName(some.where(tied).select("doc", "h", span(at, count).alias("place")))


def _spans(rows: DataFrame) -> DataFrame:
    """Each text's places in one row; they are fewer than its bytes."""
    return rows.groupBy(F.col("doc").alias("_doc"), F.col("h").alias("_h")).agg(F.collect_list("place").alias("places"))


def _cut(batches):
    """Texts with the places of their repeats -> what stays of them, and the removed runs."""
    before = None
    for batch in batches:
        doc, h = (batch.column(i).to_numpy() for i in range(2))
        data, ends = _texts(batch.column(2))
        spans = batch.column(3)
        owner = np.repeat(np.arange(len(doc)), spans.value_lengths().to_numpy())
        places = spans.flatten().to_numpy()
        first = ends[owner] + (places >> _AT)
        last = first + (places & 0xFF) - 1 + DEPTH
        # a further row of one id and text repeats the row before it from end to end
        pairs = np.stack([doc, h], 1)
        copy = np.zeros(len(doc), bool)
        copy[1:] = (pairs[1:] == pairs[:-1]).all(1)
        if len(doc):
            copy[0] = before is not None and bool((pairs[0] == before).all())
            before = pairs[-1].copy()
        whole = np.flatnonzero(copy & (np.diff(ends) >= DEPTH))
        first, last, owner = (np.concatenate(x) for x in ((first, ends[whole]), (last, ends[whole + 1]), (owner, whole)))
        order = np.argsort(first, kind="stable")
        first, last, owner = first[order], last[order], owner[order]
        reach = np.maximum.accumulate(last) if len(last) else last
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] > reach[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        a, b, own = first[start], reach[np.append(start[1:], len(first)) - 1] if len(start) else first, owner[start]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[a] += 1
        np.subtract.at(edge, b, 1)
        keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
        left = np.concatenate([[0], np.cumsum(keep)])[ends]
        kept = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[keep])]).cast(pa.binary())
        n = np.bincount(own, minlength=len(doc))
        runs = pa.StructArray.from_arrays([pa.array(a - ends[own]), pa.array(b - ends[own])], ["start", "end"])
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), runs)
        size = np.diff(ends)
        arrays = [batch.column(4), pa.array(size), pa.array(size - np.diff(left)), pa.array(n.astype(np.int64)), runs, kept]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def _forget_shuffles(spark) -> None:
    """Lets Spark's cleaner remove the files of shuffles that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept`` for every row of ``docs`` (doc_id, text): what stays of each
    text's bytes once every byte is removed that a DEPTH-byte string covers which also starts earlier.

    Earlier means a smaller doc_id, or an earlier start in the same text; strings never cross texts, and all are judged
    on the input. ``spans`` are the removed runs (start, end), ``kept`` the other bytes.

    The suffixes of all texts are sorted through DEPTH bytes only, digit by digit from the first, and a suffix leaves
    the sort once its digits are its own. Shuffling each suffix would take many times the corpus, so neighbours that
    share their first digit travel as one run (:func:`sparse_suffixes`), about 3 in 100 suffixes. First pass: runs by
    digit; runs equal in all bytes stay together, the first is kept and the others are repeats from end to end; a run
    alone with its digit is unique, unless its digit stands in it more than once, as in periodic text: then it stays open.
    Second pass: the next bytes on both sides. Last pass: the suffixes of runs still open,
    one by one; equal groups at full depth are the repeated strings. Digits are fingerprints: in all, 120 bits or more
    decide that two strings are equal. Every task combines its own rows first, so copies of one string cost a group one
    row a task; groups stream by in sorted order, whatever their size.

    Null text is empty; texts under DEPTH bytes have no such string. Null ids come after all others. Rows that share an
    id are ordered by a hash of their text; of equal rows one counts as first. Other columns are ignored; an empty table
    gives no rows. ``docs`` is read several times and must give the same rows each time.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    single = (ids[0] or 0) <= 1 and not ids[1]
    h = F.lit(0).cast("long") if single else F.xxhash64(text)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), h.alias("h"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = keyed.select("doc", "h", "text").mapInArrow(handing_back(_first_pass()), _SUFFIXES)
    marks = store(_pass(rows).select("digit", "doc", "h", "place", "sides"), "suffixes")
    _forget_shuffles(spark)
    opened = _spans(_still_open(marks))
    texts = keyed.join(opened, (F.col("doc") == F.col("_doc")) & (F.col("h") == F.col("_h"))).select("doc", "h", "text", "places")
    last = store(_pass(texts.mapInArrow(handing_back(_last_pass()), _SUFFIXES)).where(_kind() == REPEATED).select("doc", "h", "place"), "repeats")
    _forget_shuffles(spark)
    spans = _spans(marks.where(_kind() == REPEATED).select("doc", "h", "place").unionByName(last))
    none = F.array().cast("array<bigint>")
    joined = keyed.join(spans, (F.col("doc") == F.col("_doc")) & (F.col("h") == F.col("_h")), "left").select("doc", "h", "text", F.coalesce("places", none).alias("places"), "doc_id")
    if not single:
        joined = joined.repartition("doc", "h").sortWithinPartitions("doc", "h")
    return joined.mapInArrow(handing_back(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")


OP12_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, s, array_slice(b, s + 1, s + 100) as x from (select doc_id, b, unnest(range(0, n - 99)) as s from d where n >= 100)),
firsts as (select x, min((doc_id, s)) as first from w group by x),
later as (select doc_id, s from w join firsts using (x) where (doc_id, s) <> first),
breaks as (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 100 then 0 else 1 end as fresh from later),
numbered as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as r from breaks),
runs as (select doc_id, r, min(s) as a, max(s) + 100 as z from numbered group by doc_id, r),
edges as (
  select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as left_from, lead(a) over (partition by doc_id order by a) as after from runs),
pieces as (
  select doc_id, left_from as f, a as t from edges union all select e.doc_id, e.z, d.n from edges e join d using (doc_id) where after is null),
kept as (select p.doc_id, unhex(string_agg(case when t > f then hex(array_slice(b, f + 1, t)) else '' end, '' order by f)) as b from pieces p join d using (doc_id) group by p.doc_id),
cut as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans from runs group by doc_id)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(case when n_removed is null then d.b else kept.b end) as kept_sha256
from d left join cut using (doc_id) left join kept using (doc_id)
"""
