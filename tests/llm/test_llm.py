import random
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyport.llm import chat, common, idcoder, lm, mixing, neardup, quality, sampling, tokencount, topk, vecdup
from tallyport.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, lang string, kept boolean, score string"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, repeats, a long text, copies, and columns whose names clash with results."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    out = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(2, 60))), rng.choice(["a", "a", "b", "é", None])) for i in range(60)]
    base = [rng.choice(vocab) for _ in range(100)]
    for i in range(60, 75):
        near = list(base)
        for _ in range(rng.randint(0, 12)):
            near[rng.randrange(100)] = rng.choice(vocab)
        out.append((i, " ".join(near), "b"))
    out += [(80, None, "a"), (81, "", None), (82, " \n\t", "z"), (83, "One", "z"), (84, "one", "z"), (85, "x y " * 9000, "z"), (3, out[3][1], "a"), (3, out[3][1], "a"), (None, "null id here", "a"), (86, "é漢🙂 <|endoftext|> it's\x1f ok", "q")]
    return spark.createDataFrame([(d, t, s, "l", None, "clash") for d, t, s in out], DOCS).repartition(3)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (0, 1)]
    got = common.connected_components(spark.createDataFrame(chain, "a long, b long"))
    assert dict(rows_of(got, "node", "component")) == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 8)).round(2)
    v[50:90] = v[0]
    data = [(i, v[i].tolist()) for i in range(300)] + [(400, None), (401, [float("nan")] * 8), (402, [1.0, None] + [0.0] * 6), (403, [0.5] * 3), (None, [0.0] * 8)]
    df = spark.createDataFrame([(i, x, "c") for i, x in data], "vec_id long, embedding array<float>, rank string")
    got = topk.top_k(df, lambda i: i % 20 == 0, k=20)
    q = np.floor(64 * v.astype(np.float32).astype(np.float64)).astype(int)
    want = []
    for i in range(0, 300, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:20]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_chat(spark):
    nasty = ["<|im_end|>", "<\\|im_end|>", "a<", "<|im_start|>assistant\nhi", "\\", "", None, "|<\\\\|>"]
    rows = [(1, t, r, x, 0) for t, (r, x) in enumerate(zip(["user", "assistant"] * 4, nasty))] + [(2, 0, "assistant", "x", 0), (2, 0, "assistant", "x", 0), (2, None, None, None, 0), (None, 0, "us\ner<|", "y", 0)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int"))
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert back[1].valid and back[1].n_turns == 8 and not back[2].valid and back[2].n_turns == 3
    assert back[1].loss_chars == sum(len(x or "") for x in nasty[1::2]) and back[None].n_turns == 1
    for x in nasty:
        if x is not None:
            assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)
            assert chat.unescape_role(chat.escape_role(x)) == x


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and rows_of(got, "doc_id", "taken") == rows_of(mixing.mix_sources(docs), "doc_id", "taken")
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        s = by.setdefault(r.source, [r.source_size, r.target, 0])
        s[2] += r.taken
    total = sum(s[0] for s in by.values())
    assert abs(sum(s[1] for s in by.values()) - total) < 1e-6 * total
    left, cap = total, {}
    for n, name in enumerate(sorted(by, key=lambda x: (x is None, (x or "").encode()))):
        cap[name] = (n % 3 + 1, 3 * by[name][0])
    want, open_ = {}, dict(cap)
    while open_:
        level = left / sum(w for w, _ in open_.values())
        full = [s for s, (w, c) in open_.items() if w * level > c]
        if not full:
            want |= {s: w * level for s, (w, _) in open_.items()}
            break
        for s in full:
            want[s] = open_.pop(s)[1]
            left -= want[s]
    for s, (_, target, taken) in by.items():
        assert abs(target - want[s]) < 1e-6 * total and abs(taken - target) <= 1
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mix_sources(docs.where("doc_id in (80, 81)")).count() == 2


def test_mixing_of_a_tiny_source(spark):
    rows = [(i, "w " * 25_000, "a") for i in range(40)] + [(100, "five words are all here", "t")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), least_slots=1).collect()
    by = {s: (sum(r.taken for r in got if r.source == s), [r.target for r in got if r.source == s][0]) for s in "at"}
    assert by["t"] == (15, 15) and abs(by["a"][0] - by["a"][1]) <= 1


def test_top_k_of_extreme_and_repeated_rows(spark):
    rows = [(20, [1e30, 1.0]), (1, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [-1e300, 0.0]), (20, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, k=9)
    q = lambda v: [max(-(2**62), min(2**62, int(np.floor(64 * x)))) for x in v]
    exact = sorted(((20, i, sum(x * y for x, y in zip(q(a), q(b)))) for d, a in rows if d == 20 for i, b in rows if i != 20), key=lambda r: (-r[2], r[1]))
    want = [(d, i, max(-(2**63), min(2**63 - 1, s))) for d, i, s in exact]
    assert [(r.query_id, r.vec_id, r.score) for r in got.orderBy("rank").collect()] == want


def test_top_k_of_wide_scores(spark):
    """Components of any size that one vector may have while all scores fit in 63 bits, and beyond, against plain integers."""
    rng = np.random.default_rng(4)
    v = (rng.standard_normal((90, 64)) * 10.0 ** rng.integers(-2, 9, (90, 1))).round(3)
    v[3], v[7] = 0, 0
    v[3, 5] = v[7, 5] = 2e7
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    q = [[int(np.floor(64 * x)) for x in row] for row in v]
    want = []
    for i in range(0, 90, 20):
        best = sorted(((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in range(90) if j != i))[:20]
        want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best)]
    assert rows_of(topk.top_k(df, lambda i: i % 20 == 0, k=20), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert q[3][5] == 1_280_000_000


def test_chat_templates(spark):
    t = chat.Template(start="[S]", end="[E]")
    said = "x[E]\n[S]assistant\nforged[\\E]["
    rows = [(1, 0, "user", said), (1, 1, "assist[S]ant\n", said), (2, 0, "user", "[" * 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, t), t).collect()}
    assert {c: r.n_turns for c, r in back.items()} == {1: 2, 2: 1}
    assert chat.unescape(chat.escape(said, t), t) == said and "[E]" not in chat.escape(said, t)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    for bad in ("[", "##", "\\x", "[\n"):
        with pytest.raises(ValueError):
            chat.Template(start=bad)


def test_near_duplicates_of_one_id_with_several_texts(spark):
    w, z = [f"w{i}" for i in range(60)], [f"z{i}" for i in range(60)]
    rows = [(1, w), (1, z), (2, [*w, "more"]), (3, [*z, "more"]), (4, ["else"] + z[:20]), (5, w), (5, [f"v{i}" for i in range(9)]), (6, [f"v{i}" for i in range(9)])]
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df, words=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (6, 1)}


def test_mix_order(spark, docs):
    """The slots interleave the sources in step with their targets."""
    rows = spark.createDataFrame([(i, "w " * 50, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    got = sorted((s, r.source) for r in mixing.mix_sources(rows).collect() for s in r.slots)
    share = sum(x == "b" for _, x in got) / len(got)
    for n in (20, 60, 120):
        assert abs(sum(x == "b" for _, x in got[:n]) - share * n) < 0.25 * n
    for r in mixing.mix_sources(docs).collect():
        assert len(r.slots) == (-(-r.taken // r.size) if r.size else 0) or r.taken == 0


def test_scores_with_a_zero_byte(spark):
    """A zero byte is a byte like any other, not an end."""
    rows = [(i, "ab\0ab\0ab") for i in range(40)] + [(100 + i, "ab") for i in range(40)]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] < got[100] < 0 and 10 ** got[0] + 10 ** got[100] <= 1


def test_segmentations(spark, docs):
    path = tokenizer_path("piece_bpe_32k.model")
    got = sampling.decode_ids(sampling.sample_segmentations(docs, path, k=3), path).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ways = {}
    for r in got:
        assert r.decoded == text[r.doc_id]
        ways.setdefault(r.doc_id, []).append((r.sample, tuple(r.ids), r.perturbed, r.log_prob))
    for d, w in ways.items():
        assert len({x[1] for x in w}) == len({x[0] for x in w}) and all(x[3] <= 1e-9 for x in w)
        order = sorted(set((x[0], x[2]) for x in w))
        assert [v for _, v in order] == sorted((v for _, v in order), reverse=True)
    assert {len(set(w)) for d, w in ways.items() if d in (80, 81)} == {1} and set(ways) == set(text)
    once = sampling.sample_segmentations(docs, path, k=3, decoded=True)
    assert sorted(map(repr, once.select(got[0].__fields__).collect())) == sorted(map(repr, got))


def test_lattice_against_enumeration():
    """All segmentations of short words from the vocabulary file alone: their weights, and what the library decodes."""
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def ways(text):
        if not text:
            return [((), 1.0)]
        return [((pieces[text[:n]], *ids), (2 + min(-sp.get_score(pieces[text[:n]]), sp.vocab_size())) ** -0.5 * w) for n in range(1, len(text) + 1) if text[:n] in pieces for ids, w in ways(text[n:])]

    lat = sampling.lattices(path, 0.5)
    for word in ("the", "tree", "é a", "stone"):
        want = {}
        for part in word.split(" "):
            ways_of = ways(sampling.SPACE + part)
            total = sum(w for _, w in ways_of)
            want = {(*a, *b): x * w / total for a, x in (want or {(): 1.0}).items() for b, w in ways_of}
        k = min(len(want), 40)
        got = sampling.sample([word], np.array([4]), k, lat, 2)[0]
        assert len({tuple(x["ids"]) for x in got}) == k
        for x in got:
            assert abs(np.exp(x["log_prob"]) - want[tuple(x["ids"].tolist())]) < 1e-9 and sp.decode(x["ids"].tolist()) == word
        if len(want) <= 40:  # all of them: nothing is left open
            assert abs(sum(np.exp(x["log_prob"]) for x in got) - 1) < 1e-9 and {x["log_inclusion"] for x in got} == {0.0}


def test_segmentations_of_long_words_and_empty_tables(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    word = "".join(random.Random(5).choice("abcdefgh") for _ in range(30_000))
    rows = spark.createDataFrame([(1, word), (2, f"a {word[:900]} b")], "doc_id long, text string")
    assert [r.decoded for r in sampling.sample_segmentations(rows, path, decoded=True).orderBy("doc_id").collect()] == [word] * 2 + [f"a {word[:900]} b"] * 2
    assert sampling.sample_segmentations(rows.limit(0), path).count() == 0


def test_segmentations_in_bounded_memory(spark):
    """A task's memory depends neither on how many words its texts hold nor on how they are dealt into batches."""
    made = random.Random(3)
    texts = [" ".join("".join(made.choices("abcdefghijklmnoprstu", k=made.randint(3, 9))) for _ in range(4_000)) for _ in range(50)]

    class Docs:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    run = sampling.sample_segmentations(Docs(), tokenizer_path("piece_bpe_32k.model"))
    rows = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], names=["doc_id", "text"])
    got = []
    for batches in ([rows], [rows.slice(i, 7) for i in range(0, 50, 7)]):
        tracemalloc.start()
        kept = [[*zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), [hash(tuple(x)) for x in b.column(2).to_pylist()])] for b in run(iter(batches))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 150e6
        got.append(sorted(x for b in kept for x in b))
    assert len(got[0]) == 100 and got[0] == got[1]


def test_sampling_law():
    lat = sampling.lattices(tokenizer_path("piece_bpe_32k.model"), 0.5)
    first, second, logp, n = Counter(), Counter(), {}, 4000
    for xs in sampling.sample(["the"] * n, np.arange(n), 2, lat, 11):
        first[tuple(xs[0]["ids"])] += 1
        second[tuple(xs[0]["ids"]), tuple(xs[1]["ids"])] += 1
        logp.update((tuple(x["ids"]), x["log_prob"]) for x in xs)
    p = {s: np.exp(v) for s, v in logp.items()}
    assert sum(p.values()) <= 1 + 1e-9 and sum(abs(first[s] / n - q) for s, q in p.items()) / 2 < 0.03
    assert sum(abs(second[a, b] / n - p[a] * p[b] / (1 - p[a])) for a in p for b in p if a != b) / 2 < 0.05


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(tk.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect()), key=repr)
    assert rows_of(tokencount.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    odd = ["aaaaaaa aaaa'sll", "x\x1cy \x85z\xa0q", "ΑΣ ΌΣΟΣ İ ẞ", "é ́x ﬁ ½ ²3", "a" * 3000, "<|ENDOFTEXT|><|startoftext|>'s", "👩‍👩‍👧 ​x　y"]
    assert tokencount.count_texts(odd, path) == [len(tk.encode(x, add_special_tokens=False).ids) for x in odd]


def brute_sets(rows, words):
    out = {}
    for r in rows:
        w = [x for x in (r.text or "").encode().lower().split()]
        n = min(words, len(w))
        out[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicate_texts(spark, docs, words):
    named = docs.where("doc_id is not null")
    sets = brute_sets(named.collect(), words)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = neardup.near_duplicates(docs, words).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    for j in (0.3, 0.6, 0.8, 0.9):
        pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
        both = int(2000 * 2 * j / (1 + j))
        a, b = np.sort(pool[:2000]), np.sort(pool[2000 - both : 4000 - both])
        x, y = neardup.sketch(a), neardup.sketch(b)
        assert (np.maximum(neardup.sketch(a[:900]), neardup.sketch(a[900:])) == x).all()
        got = neardup.estimate(np.array([(x == y).sum()]), np.array([(x > y).sum()]), np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(got - j) < 0.12


def test_quality(spark, docs):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "sea", "is", "calm", "and", "wide"]) for _ in range(30)) + "."
    data = [(i, good() if i % 2 else good().upper() + "!!! $$$", i % 2) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (7, 0), (999, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = quality.score_documents(df, model).withColumn("held_out", common.fold() == 0).collect()
    right = [r.predicted == r.doc_id % 2 for r in got if r.held_out]
    assert len(right) > 40 and np.mean(right) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    odd = quality.score_documents(docs, model)
    assert odd.count() == docs.count() and odd.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in odd.collect())
    assert quality.fit(df, labels.limit(0)).score(b"x") == 0.5


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((120, 16))
    v[60:110] = v[10] + rng.standard_normal((50, 16)) * 0.25
    v[110:115] = v[5]
    v[116] = 3 * v[5]
    label = [int(x) for x in rng.integers(0, 2, 120)]
    extra = [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("inf")] * 16, 0), (203, v[5].tolist(), None), (204, [1.0] * 3, 0)]
    rows = [(i, v[i].tolist(), label[i]) for i in range(120)] + extra
    got = {r.vec_id: r for r in vecdup.near_duplicates(spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, cls string")).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    same = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(120, dtype=bool)
    root = list(range(120))
    for _ in range(120):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(same[i]))]) for i in range(120)]
    for i in range(120):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (same[i].sum(), root[i], root[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(200, 205))


@pytest.mark.parametrize("n", [1, 700, 1300])
def test_vector_links_at_the_threshold(n):
    """Pairs just above and below the threshold, against all dot products; blocks of other than 512 rows too."""
    rng = np.random.default_rng(n)
    x, away = rng.standard_normal((2, n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away -= np.einsum("ij,ij->i", away, x)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    c = rng.uniform(0.925, 0.94, n)[:, None]
    y = c * x + np.sqrt(1 - c * c) * away
    directions = np.random.default_rng(64).standard_normal((64, vecdup.PROJECTIONS))
    i, j = vecdup.link_blocks(x, y, directions, vecdup.least_count(), 0.93, False)
    want = np.argwhere(x @ y.T >= 0.93)
    assert sorted(zip(i.tolist(), j.tolist())) == [tuple(p) for p in want.tolist()]
    both = np.concatenate([x, y])
    i, j = vecdup.link_blocks(both, both, directions, vecdup.least_count(), 0.93, True)
    assert sorted(zip(i.tolist(), j.tolist())) == [tuple(p) for p in np.argwhere(np.triu(both @ both.T >= 0.93, 1)).tolist()]


def test_lm(spark, docs):
    rows = docs.collect()
    held = lambda r: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1
    c, n_docs = Counter(), 0
    for r in rows:
        if not held(r):
            c.update((r.text or "").encode().lower().split())
            n_docs += 1
    total, kinds = sum(c.values()) + n_docs, len(c) + 1
    want = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        base = sum(log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w) + log10((n_docs + 0.5) / (total + 0.5 * (kinds + 1)))
        want.append((r.doc_id, held(r), len(w) + 1, sum(c[x] > 0 for x in w) + 1, total, round(base, 6)))
    lm_words, lm.WORDS = lm.WORDS, 20  # most words go by the join
    got = lm.score_documents(docs).collect()
    lm.WORDS = lm_words
    assert sorted(((*(r[:5]), round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got) and lm.score_documents(docs.limit(0)).count() == 0


def test_trie_is_a_distribution():
    texts = [b"abracadabra", b"banana bandana", b"cab"]
    flat, at, _ = lm._lay(texts)
    keys, n = np.unique(lm._grams(flat, at), return_counts=True)
    levels = []
    for k in range(lm.ORDER + 1):
        key, inverse = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        levels.append((key, np.bincount(inverse, n)))
    trie = lm.build_trie(levels)
    p = 10 ** trie.log10.astype(np.float64)
    p[:, -1] *= 256 - (p.shape[1] - 1)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert trie.score([b"banana"])[0] > trie.score([b"zzzzzz"])[0]


def test_lm_keeps_every_context(spark):
    rng = random.Random(9)
    letters = [bytes([x]).decode() for x in range(33, 127) if not 65 <= x <= 90]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(150)]
    texts = ["".join(rng.choices(letters, k=900)) if i % 3 else "".join(rng.choices("abcd ", k=900)) for i in range(150)]
    texts = [t + "\x7f" * 3 if h else t for t, h in zip(texts, held)]  # a byte that training never sees
    raw = [t.encode().lower() for t in texts]
    flat, at, _ = lm._lay([t for t, h in zip(raw, held) if not h])
    keys, n = np.unique(lm._grams(flat, at), return_counts=True)
    levels = []
    for k in range(lm.ORDER + 1):
        key, inverse = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        levels.append((key, np.bincount(inverse, n)))
    assert all(len(np.unique(key >> np.uint64(8))) > lm.CONTEXTS for key, _ in levels[4:])
    want = lm.build_trie(levels).score(raw)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score_documents(df).collect()}
    assert np.allclose([got[i] for i in range(150)], want, rtol=0, atol=1e-3)


def test_lm_scores_do_not_depend_on_the_broadcast_tables(spark, docs):
    """Whatever the broadcast trie and the frequent grams hold, the joins give the rest."""
    before, scores = (lm.CONTEXTS, lm.GRAMS, lm.WORDS), []
    for lm.CONTEXTS, lm.GRAMS, lm.WORDS in ((1 << 16, 0, 10), (0, 0, 0), (3, 40, 5), (50, 1 << 20, 9)):
        scores.append(sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known), r.score, r.base_score) for r in lm.score_documents(docs).collect()))
    lm.CONTEXTS, lm.GRAMS, lm.WORDS = before
    for other in scores[1:]:
        assert [x[0] for x in other] == [x[0] for x in scores[0]]
        assert np.allclose([x[1:] for x in other], [x[1:] for x in scores[0]], rtol=1e-6, atol=1e-4)


def test_id_blocks():
    rng = np.random.default_rng(0)
    for n in (0, 1, 4096, 4097, 9000):
        ids = rng.integers(0, 50257, n).astype(np.uint32)
        ids[::2] = 5
        data = idcoder.encode_ids(ids)
        assert (idcoder.decode_ids(data) == ids).all()
    wide = rng.integers(0, 2**32 - 1, 500).astype(np.uint32)
    assert (idcoder.decode_ids(idcoder.encode_ids(wide, 4)) == wide).all()
    broken = bytearray(data)
    broken[60] ^= 1
    with pytest.raises(ValueError):
        idcoder.decode_ids(bytes(broken))


def test_id_blocks_are_small():
    rng = np.random.default_rng(1)
    text = rng.zipf(1.3, 120_000) % 3000
    ids = np.concatenate([text, text[:40_000], text[20_000:90_000]]).astype(np.uint32)
    data = idcoder.encode_ids(ids)
    assert (idcoder.decode_ids(data) == ids).all() and len(data) < len(zlib.compress(ids.astype("<u2").tobytes()))
    many = rng.permutation(1 << 20).astype(np.uint32) * 4096  # coded as halves
    assert (idcoder.decode_ids(idcoder.encode_ids(many[:600_000])) == many[:600_000]).all()
    with pytest.raises(ValueError):
        idcoder.encode_ids(many, 2)
    for cut in (5, 40, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            idcoder.decode_ids(data[:cut])


def test_id_blocks_of_wide_and_narrow_tables():
    """The coder's numbers have 32 bits up to a table of 2^20, and 64 beyond; a lane of rare symbols takes several words a step."""
    rng = np.random.default_rng(3)
    for symbols, kind in ((3, np.int32), (1 << 18, np.int32), (1 << 19, np.int64)):
        ids = np.concatenate([rng.permutation(symbols), np.zeros(5000, np.int64), rng.integers(0, symbols, 3000)]).astype(np.uint32)
        freq, bits = idcoder._table(ids)[2:]
        assert idcoder._Mixer(2, freq, bits).kind is kind
        assert (idcoder.decode_ids(idcoder.encode_ids(ids)) == ids).all()


def test_ids_ask_for_each_word_once():
    """Over all batches the library's model gets a word once, by itself, and no batch of encodings is built for words."""

    class Counting:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, word):
            self.asked.append(word)
            return self.model.tokenize(word)

    e = idcoder.Encoder(tokenizer_path("byte_bpe_50k.json"))
    e.model = counting = Counting(e.model)
    for texts in (["so it is, it is", "it is so"], ["is it so? it's"]):
        ids, _ = e.encode(pa.array(texts))
        assert ids.tolist() == [i for x in texts for i in e.whole.encode(x, add_special_tokens=False).ids]
    assert sorted(counting.asked) == sorted({"so", "Ġit", "Ġis", ",", "it", "Ġso", "is", "?", "'s"})


def test_known_pieces_are_found_by_hash(monkeypatch):
    """A lookup makes no table of all pieces; pieces of one hash are told apart, and slices are hashed as what they show."""
    pieces = pa.array(["", "a", "b", "ab", "ba", "x" * 5000, "x" * 9096, "é", *map(str, range(20000))], pa.string())
    assert len(set(idcoder._hashes(pieces).tolist())) > 0.999 * len(pieces)
    assert (idcoder._hashes(pieces.slice(2, 17)) == idcoder._hashes(pieces)[2:19]).all()
    monkeypatch.setattr(idcoder.pc, "index_in", None)
    own = idcoder._hashes
    for hashes in (own, lambda p: own(p) & np.uint64(0xFFF << 52), lambda p: np.zeros(len(p), np.uint64)):
        monkeypatch.setattr(idcoder, "_hashes", hashes)
        known, parts, at = idcoder._Known(), (pieces.slice(0, 8), pieces.slice(8)), 0
        for part in parts:
            where, h = known.find(part)
            assert (where == -1).all()
            known.add(part, np.arange(at, at + len(part)), h)
            at += len(part)
        where, _ = known.find(pieces)
        right = where == np.arange(len(pieces))
        assert (right | (where == -1)).all() and right.sum() == len(set(hashes(pieces).tolist()))


def test_ids_of_odd_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tk, rng = Tokenizer.from_file(path), random.Random(1)
    letters = "abéßĀɏɐªº²½ÿ1'.! \t\n\xa0é　<|>\x85\x1c"
    odd = ["", "  a", " a  b ", "é漢🙂 <|endoftext|> it's\x1f ok", "it's 'll don't1234 !!! <|endoftext|>x", "tab\t tab \t x\r\n  z", "\0 \x7f\x01", "\uffff b", "٣٤ 1٣", "\u180e \u180eb", " " * 50, "x" * 5000]
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert idcoder.encode_texts(odd, path) == [np.array(tk.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd]


def test_id_files_of_one_id(spark):
    """Many rows of one id are dealt to several tasks, and an empty table stays empty."""
    path = tokenizer_path("byte_bpe_50k.json")
    one = spark.createDataFrame([(5, f"row {i} of one id") for i in range(400)], "doc_id long, text string")
    table = idcoder.write_ids(one, path, partitions=4)
    assert table.select("part").distinct().count() > 1
    got = idcoder.read_ids(table).orderBy("start").collect()
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    assert idcoder.token_id_files(one.limit(0), path).count() == 0


def test_id_files(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tk, start, want = Tokenizer.from_file(path), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*tk.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(idcoder.token_id_files(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = ["tree", "river", "stone", "light", "wind", "cloud", "grass", "sand"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, line(40) + ".", "en", f"s{i % 3}", 0) for i in range(150)] + [(i, line(40).upper() + "!!!", "en", "s0", 0) for i in range(150, 200)]
    rows += [(200 + i, rows[i][1], "en", "s1", 0) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.classify(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(150), *range(200, 210)}
    unique = corpus_pipeline.dedup(spark, kept, str(tmp_path))
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == list(range(150))
    mixed = corpus_pipeline.mix(spark, unique, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() > 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.sample for r in got} == {0, 1} and {r.doc_id for r in got} == {r.doc_id for r in mixed.collect()}


def test_pipeline_stages_on_odd_rows(spark, docs, tmp_path):
    """Nulls, empties, repeats, clashing columns and empty tables, stage by stage."""
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    kept = corpus_pipeline.classify(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and set(rows_of(kept, *docs.columns)) <= set(rows_of(docs, *docs.columns))
    rows = docs.union(spark.createDataFrame([(7, "another text of this id", "z", "l", True, "x"), (None, "", None, None, None, None)], DOCS))
    once, again = (sorted(map(repr, corpus_pipeline.dedup(spark, rows.repartition(n), "").collect())) for n in (2, 3))
    ids = [r.doc_id for r in corpus_pipeline.dedup(spark, rows, "").collect()]
    assert once == again and len(set(ids) - {None}) == len([i for i in ids if i is not None]) and ids.count(None) == 2
    mixed = [r.doc_id for r in corpus_pipeline.mix(spark, rows, "").collect()]
    times = Counter(r.doc_id for r in rows.collect())
    assert all(n <= 3 * times[d] for d, n in Counter(mixed).items()) and not {80, 81, 82} & set(mixed)
    assert {r.doc_id for r in corpus_pipeline.segment(spark, docs, "").collect()} == {r.doc_id for r in docs.collect()}


def test_classifier_against_plain_python():
    """Scores are the softmax of the averaged vectors, written out, and held-out rows are told apart."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["tree", "river", "stone", "light"]) for _ in range(30)) + "." for _ in range(200)] + ["BUY!!! now " * rng.randint(3, 9) for _ in range(200)]
    raw, labels = [t.encode() for t in texts], np.array([1] * 200 + [0] * 200)
    model = quality.train(raw[::2], labels[::2])
    for t in raw[1::40] + [b"", b" "]:
        f = quality.features(t)
        mean = sum((model.vectors[i].astype(float) for i in f), np.zeros(quality.DIM)) / max(1, len(f))
        z = mean @ model.out.astype(float) + model.bias
        assert abs(model.score(t) - np.exp(z[1]) / np.exp(z).sum()) < 1e-4
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in zip(raw[1::2], labels[1::2])]) > 0.97


def test_features_of_many_texts_are_those_of_each():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é漢🙂 \n\t=") for _ in range(rng.randint(0, 40))).encode() for _ in range(60)] + [b"", b" ", b"x", b"same same same", "漢字".encode()]
    f, whose = quality.feature_rows(texts)
    for i, t in enumerate(texts):
        assert sorted(f[whose == i]) == sorted(quality.features(t))
    # grams are of characters: two characters of three bytes each have one pair, one word and no gram of four
    assert len(quality.features("漢字".encode())) == 2 and len(quality.features("漢字漢字".encode())) == 1 + 3 + 1
    model = quality.train(texts, np.arange(len(texts)) % 2)
    assert np.allclose(model.scores(texts), [model.score(t) for t in texts])
