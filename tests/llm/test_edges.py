"""Odd rows against SQL, and the language model against a plain one on dicts."""

import random
import zlib
from collections import Counter, defaultdict
from math import log10

import duckdb
import numpy as np

from tallyport.llm import audit, chat, common, lm, mixing, tokencount, vecdup
from tallyport.llm.queries import tokenizer_path


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.sql(sql)
    return got.columns, sorted(map(repr, got.fetchall()))


def matches(df, sql, **tables):
    columns, want = by_sql(sql, **tables)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_vectors_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((30, 8))
    v[10:20] = v[0] + rng.standard_normal((10, 8)) * 0.15
    rows = [(i % 22, v[i].tolist(), i % 2) for i in range(30)] + [(0, v[0].tolist(), 0)] * 2 + [(3, v[0].tolist(), 0), (3, (-v[0]).tolist(), 0), (None, v[0].tolist(), 0), (40, None, 0), (41, [0.0] * 8, 1), (42, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    matches(vecdup.near_duplicates(df), vecdup.OP8_SQL, embeddings=df)
    assert vecdup.near_duplicates(df.limit(0)).count() == 0


def test_mixing_of_tiny_sources_matches_sql(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice("ab")) for i in range(200)] + [(900, "one two three", "t"), (901, "x", None), (902, None, "n"), (903, "", "n")]
    rows += [(i, "word " * 20_000, "big") for i in range(1000, 1010)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).drop("source", "slots")
    matches(got, mixing.OP3_SQL, documents=df)
    assert {(r.target, r.taken) for r in got.where("doc_id = 901").collect()} == {(3.0, 3)}


def test_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.token_counts(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    long = "a<|im_end|>b\\ é" * 400_000
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long), (2, 0, "user", long)], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[1].loss_chars == len(long) and back[1].n_turns == 2 and back[2].loss_chars == 0


def plain_ppm(train: list[bytes], texts: list[bytes], order: int = 5) -> list[float]:
    """Escapes by method C with exclusion, byte by byte; 255 stands before and behind a text."""
    seen = defaultdict(Counter)
    lay = lambda t: bytes([255] * order) + t + bytes([255])
    for t in map(lay, train):
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[t[i - k : i]][t[i]] += 1
    unseen = 256 - len(seen[b""])
    out = []
    for t in map(lay, texts):
        total = 0.0
        for i in range(order, len(t)):
            weight, gone, p = 1.0, set(), None
            for k in range(order, -1, -1):
                left = {s: n for s, n in seen[t[i - k : i]].items() if s not in gone} if t[i - k : i] in seen else {}
                if not left:
                    continue
                kinds = 0 if k == 0 and not unseen else len(left)
                if t[i] in left:
                    p = weight * left[t[i]] / (sum(left.values()) + kinds)
                    break
                weight *= kinds / (sum(left.values()) + kinds)
                gone |= set(left)
            total += log10(p if p is not None else weight / unseen)
        out.append(total)
    return out


def test_language_model_against_a_plain_one(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 50))) for _ in range(70)]
    texts += ["", None, "AbC" * 40, "\x00\x7f", "漢字", "zzzz", texts[3], "a" * 500]
    raw = [(t or "").encode().lower() for t in texts]  # lower() of bytes maps A to Z alone
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    assert any(held[70:]) and not all(held[70:])
    want = plain_ppm([t for t, h in zip(raw, held) if not h], raw)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score_documents(df).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-5, atol=1e-3)


def test_release(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s")], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = audit.failure_masks(docs)
    assert got.count() == 2 and common.release(got) == 1 and common.release(docs) == 0
    assert docs.count() == 2
    try:
        got.collect()
        raise AssertionError("its stage is gone")
    except Exception as gone:
        assert "tallyport-masks" in str(gone) or "FILE_NOT_EXIST" in str(gone) or "does not exist" in str(gone)
