import hashlib
import random
from itertools import permutations
from math import floor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyport.llm import audit, repeats, vqcodes

DOCS = "doc_id long, text string, source string, mask string, part string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], DOCS).repartition(3)


def test_filter_audit(spark):
    rng = random.Random(1)
    long = lambda: " ".join("w%d" % rng.randrange(90) for _ in range(rng.randint(45, 120)))
    rows = [(i, long() + rng.choice(["", "", "#", " ABCDEFGHIJKL" * 3]), rng.choice(["a", "b", None, ""])) for i in range(80)]
    rows += [(100 + i, rows[i % 7][1], "a") for i in range(20)] + [(200, None, "a"), (201, "", None), (202, " \x0b\x1f ", "b"), (203, "é漢🙂 " * 60, "b"), (204, "Z" * 50000, "a"), (None, rows[0][1], "b"), (None, "alone", "b"), (rows[3][0], rows[3][1], "a")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 110, 2)] + [(4, 1, False), (999, 1, True), (None, 1, True), (8, None, None)]
    got = audit.audit_filters(_docs(spark, rows), spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in labels], "doc_id long, quality int, toxic int"))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t and d is not None}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    fails, want = [], {}
    for d, t, s in rows:
        t = t or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        e = first.get(t) is not None and d != first[t]
        fails.append((s or "", d, [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), e]))
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for p, d, f in fails if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                at = "ABCDE".index(letter)
                here = [x for x in left if x[1][at]]
                left = [x for x in left if not x[1][at]]
                redundant, unique = sum(x[1][at] for x in gone), sum(f[at] and sum(f) == 1 for p, _, f in fails if p == part)
                want[part, order, step] = [len(left), len(here), redundant, unique, sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)]
                gone += here
    shapley = {}
    for (part, order, step), w in want.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + w[1]
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert list(r[3:9]) == want[r.part, r.filter_order, r.step] and r.shapley == shapley[r.part, r.filter_order[r.step - 1]]
    empty = audit.audit_filters(_docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0


def _lloyd(rows):
    """Plain codes of rows (id, label, vector), all of one dimension, in Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    q = [[floor(256 * x) if abs(x) < 2.0**53 else 256 * int(x) for x in v] for _, _, v in rows]
    dim = len(q[0])
    cut = [(p * dim // 16, (p + 1) * dim // 16) for p in range(16)]
    books = [[x[a:b] for x in q[:64]] for a, b in cut]
    near = lambda x, book: min((sum((s - t) ** 2 for s, t in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(2):
        for p, (a, b) in enumerate(cut):
            mine = [(near(x[a:b], books[p])[1], x[a:b]) for x in q]
            for j in range(len(books[p])):
                got = [x for k, x in mine if k == j]
                if got:
                    books[p][j] = [sum(c) // len(got) for c in zip(*got)]
    out = []
    for (i, label, _), x in zip(rows, q):
        best = [near(x[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        out.append((i, label, "".join("%02x" % j for _, j in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("dim, scale", [(64, 0.3), (32, 1e6), (16, 1e15), (20, 1.0), (5, 1.0)])
def test_vector_codes(spark, dim, scale):
    rng = np.random.default_rng(dim)
    v = (rng.standard_normal((150, dim)) * scale).astype(np.float32).astype(float)
    v[40:60] = v[3]  # repeated vectors: tied entries
    rows = [(i, i % 3 if i % 7 else None, v[i].tolist()) for i in range(150)] + [(5, 1, v[9].tolist()), (None, 1, v[8].tolist())]
    bad = [(900, 1, None), (901, 1, [None] * dim), (902, 1, [float("nan")] * dim), (903, 1, [float("inf")] * dim)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, label int, embedding array<float>, code string").repartition(5)
    want, digest = _lloyd(rows)
    most = 2**63 - 1
    totals = {}
    for _, label, _, e in want:
        totals[label] = totals.get(label, 0) + min(e, most)
    want = sorted(((i, c, min(e, most), min(totals[label], most), digest) for i, label, c, e in want), key=repr)
    assert sorted((tuple(r) for r in vqcodes.codes_with_errors(df).collect()), key=repr) == want


def test_vector_codes_of_few_and_mixed_rows(spark):
    schema = "vec_id long, label string, embedding array<double>"
    one = vqcodes.codes_with_errors(spark.createDataFrame([(1, "a", [1e300] * 16), (2, None, [-1e300] * 16), (3, None, [0.5] * 3), (4, "a", [])], schema)).collect()
    assert {r.vec_id: (r.code, r.error) for r in one} == {1: ("00" * 16, 0), 2: ("01" * 16, 0), 3: ("00" * 16, 0), 4: ("00" * 16, 0)}
    assert vqcodes.codes_with_errors(spark.createDataFrame([], schema)).count() == 0


def test_heaps_pop_less_than_all(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(-5000, 5000, (8, 64))
    x = (centres[rng.integers(0, 8, 2000)] + rng.integers(-3, 4, (2000, 64))).astype(np.int16)
    block = vqcodes.Block(64, list(range(2000)), ["a"] * 2000, x)
    books = [centres[:, a:b] + 2 for a, b in vqcodes.cuts(64)]
    block.start(books)
    seen = []
    scan = vqcodes.scan
    monkeypatch.setattr(vqcodes, "scan", lambda x, c: seen.append(len(x)) or scan(x, c))
    for p, (a, b) in enumerate(vqcodes.cuts(64)):
        block.update(p, centres[:, a:b], vqcodes.drifts(books[p], centres[:, a:b]))
        assert (block.entry[p] == vqcodes.distances(x[:, a:b], centres[:, a:b]).argmin(1)).all()
        keys = [block.slack[p][block.entry[p][block.at[p]] == j] for j in range(8)]
        assert all((np.diff(k) >= 0).all() for k in keys)
    assert sum(seen) < 2000 * 16 / 10


def _cut(rows):
    """Plain removal for rows (id, text) with distinct (id, text) orders."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            x = b[s : s + 100]
            if x in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(x)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def _repeat_rows(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    passage, line = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(25))
    rows = []
    for i in range(120):
        t = " ".join(word() for _ in range(rng.randint(1, 120)))
        if rng.random() < 0.5:
            t += passage[rng.randint(0, 60) :][: rng.randint(90, 300)] + word()
        if rng.random() < 0.3:
            t = line + t + line
        rows.append((i, t))
    rows += [(200 + i, rows[5][1]) for i in range(10)] + [(300, None), (301, ""), (302, "x" * 99), (303, "x" * 100), (304, "x" * 500), (305, "ab, " * 300), (306, ("line of fifty bytes or so, repeated for ever \n") * 40), (307, "abc" * 40000 + passage), (308, "漢字🙂" * 60)]
    return rows


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_repeats(spark, monkeypatch, chunk):
    rows = _repeat_rows(random.Random(chunk))
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, kept string, places int").repartition(7)
    if chunk == 300:  # the classes of a task, as tasks would run them with other limits
        monkeypatch.setattr(repeats, "CHUNK", 997)
        data, ends = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8), np.cumsum([0] + [len((t or "").encode()) for _, t in rows])
        covered = np.zeros(len(data), int)
        one, two = repeats.Digits(1, 997 + 100), repeats.Digits(2, 997 + 100)
        for at, piece, owner in repeats._chunks(data, ends):
            start, count, left, *_ = repeats.sparse_suffixes(piece, owner, one, two)
            assert (left <= count).all() and (count <= 69).all()
            for s, n in zip(start, count):
                covered[at + s : at + s + n] += 1
        whole = np.concatenate([np.arange(a, max(a, b - 99)) for a, b in zip(ends, ends[1:])])
        assert covered.sum() == len(whole) and (covered[whole] == 1).all()
        return
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect())
    assert got == _cut(rows)
    con = duckdb.connect()
    documents = df.select("doc_id", "text").toArrow()  # noqa: F841
    small = con.sql(repeats.OP12_SQL.replace("from documents", "from documents where doc_id <> 307")).fetchall()
    want = [(i, n, m, k, hashlib.sha256(b).hexdigest()) for i, n, m, k, b in _cut([r for r in rows if r[0] != 307])]
    assert sorted(small) == want


def test_repeats_of_repeated_and_null_ids(spark):
    a, b, c = "first text " * 12, "second words " * 14, "other things entirely, all of them new and long enough to have a string of one hundred bytes in it, once"
    rows = [(1, a), (1, a), (2, c), (2, b), (3, b), (None, c), (None, c), (None, "short"), (4, None), (1, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(df).collect()]
    one = _cut([(0, a)])[0][2]
    assert sorted(x[2] for x in got if x[0] == 1) == sorted([one, len(a), 0])
    assert sorted(x[2] for x in got if x[0] == 2) == sorted([0, _cut([(0, b)])[0][2]]) and [x[2] for x in got if x[0] == 3] == [len(b)]
    assert sorted(x[2] for x in got if x[0] is None) == [0, len(c), len(c)]
    assert repeats.remove_repeats(df.limit(0)).count() == 0
