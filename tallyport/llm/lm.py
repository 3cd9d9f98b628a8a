"""Language-model scores: prediction by partial matching over bytes, and a word unigram base."""

from __future__ import annotations

from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyport.llm.common import Index, fold, handing_back, store

#: Longest context; how many contexts of each length the broadcast trie holds whole, and how many grams and words the
#: broadcast tables hold, all by frequency. Whatever they lack is scored by a join with the full counts.
ORDER, CONTEXTS, GRAMS, WORDS = 5, 1 << 13, 1 << 20, 200_000
#: Distinct entries that a task gathers before it hands them on, and bytes of text it works on at once.
HELD, CHUNK = 2_000_000, 2_000_000
_U = np.uint64
_END = b"\xff"


def _lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each behind ORDER marks and before one (its end), a byte that UTF-8 never has; the
    positions that are coded; how many each text has."""
    flat = np.frombuffer(b"".join(_END * ORDER + t + _END for t in texts), np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    coded = np.ones(len(flat), bool)
    starts = np.cumsum(n + ORDER) - (n + ORDER)
    for i in range(ORDER):
        coded[starts + i] = False
    return flat, np.flatnonzero(coded), n


def _grams(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER bytes before each position and the byte there, as one number."""
    wide, code = flat.astype(np.uint64), np.zeros(len(at), np.uint64)
    for i in range(ORDER, -1, -1):
        code = code << _U(8) | wide[at - i]
    return code


def _groups(texts: list[bytes]):
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= CHUNK:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


def gather_counts(docs: DataFrame) -> DataFrame:
    """``kind, key, n`` over all of ``docs``: word counts (kind 0, by hash) and byte grams (kind 1).

    Each task adds up what it reads, handing on after HELD distinct entries; one shuffle of partial counts follows.
    """
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def merge(parts):
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        uniq, inverse = np.unique(keys, return_inverse=True)
        return [(uniq, np.bincount(inverse, n).astype(np.int64))]

    def rows(kind, parts):
        for key, n in merge(parts) if parts else []:
            for at in range(0, len(key), 100_000):
                k = key[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + 100_000])], schema=schema)

    def run(batches):
        held: list[list] = [[], []]
        for batch in batches:
            texts = [t.lower() for t in batch.column(0).to_pylist()]
            for a, b in _groups(texts):
                part = texts[a:b]
                words = _hashes([w for t in part for w in t.split()])
                flat, at, _ = _lay(part)
                for kind, x in enumerate((words, _grams(flat, at).view(np.int64))):
                    held[kind].append(np.unique(x, return_counts=True))
                    size = sum(len(p[0]) for p in held[kind])
                    if size > HELD:
                        held[kind] = merge(held[kind])
                        if len(held[kind][0][0]) > HELD // 2:
                            yield from rows(kind, held[kind])
                            held[kind] = []
        for kind in (0, 1):
            yield from rows(kind, held[kind])

    part = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(handing_back(run), "kind int, key long, n long")
    return part.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """A byte-context trie, flattened: for each order the contexts it keeps, where their rows start, and
    log10 probabilities of all symbols for each context. ``column`` maps a byte to its symbol; the last symbol
    stands for any byte that training never saw. ``whole`` says that no context was left out. ``grams`` and
    ``gram_log10`` hold frequent grams of contexts that the trie need not keep."""

    contexts: list[Index]
    first_row: list[int]
    log10: np.ndarray
    column: np.ndarray
    whole: bool = True
    grams: Index | None = None
    gram_log10: np.ndarray | None = None

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end: every byte in its longest kept context."""
        return self.score_kept(texts)[0]

    def score_kept(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The same; of a trie that isn't whole, without the bytes whose gram and whose ORDER bytes before aren't kept,
        and each text's grams of those bytes."""
        flat, at, n = _lay(texts)
        code = _grams(flat, at)
        p, open_ = np.zeros(len(code)), np.arange(len(code))
        if self.grams is not None:
            place = self.grams.find(code)
            hit = place >= 0
            p[hit] = self.gram_log10[place[hit]]
            open_ = np.flatnonzero(~hit)
        context, symbol = code[open_] >> _U(8), self.column[(code[open_] & _U(255)).astype(np.int64)]
        row = np.zeros(len(open_), np.int64)
        left = np.arange(len(open_))
        for k in range(ORDER, 0, -1):
            place = self.contexts[k].find(context[left] & _U((1 << 8 * k) - 1))
            hit = place >= 0
            row[left[hit]] = place[hit] + self.first_row[k]
            left = left[~hit]
            if k == ORDER and not self.whole:
                break
        else:
            left = left[:0]
        p[open_] = self.log10[row, symbol]
        rest = open_[left]
        p[rest] = 0
        ends = np.cumsum(n)
        return np.add.reduceat(p, ends - n), np.split(code[rest].view(np.int64), np.searchsorted(rest, ends[:-1]))


def build_trie(levels: list[tuple[np.ndarray, np.ndarray]], whole: bool = True) -> Trie:
    """``levels[k]``: sorted (context << 8 | symbol) keys of order k and their counts.

    Escapes follow method C (as many escapes as distinct symbols); a symbol that a longer context has seen is
    excluded from the shorter ones. Each kept context's whole distribution is worked out here once, so scoring is
    a lookup. Contexts whose suffix isn't kept go, so every suffix of a kept context is kept.
    """
    seen = np.unique((levels[0][0] & _U(255)).astype(np.int64))
    symbols = len(seen) + 1
    column = np.full(256, symbols - 1, np.int64)
    column[seen] = np.arange(len(seen))
    contexts, counts = [np.zeros(1, np.uint64)], []
    for k, (keys, n) in enumerate(levels):
        if k:
            own = np.unique(keys >> _U(8))
            own = own[np.isin(own & _U((1 << 8 * (k - 1)) - 1), contexts[k - 1])]
            contexts.append(own)
        place = np.minimum(np.searchsorted(contexts[k], keys >> _U(8)), max(0, len(contexts[k]) - 1))
        table = np.zeros((len(contexts[k]), symbols), np.float32)
        if len(contexts[k]):
            ok = contexts[k][place] == keys >> _U(8)
            table[place[ok], column[(keys[ok] & _U(255)).astype(np.int64)]] = n[ok]
        counts.append(table)
    unseen = 256 - len(seen)
    first_row = np.cumsum([0, *map(len, contexts)])[:-1].tolist()
    out = np.empty((sum(map(len, contexts)), symbols), np.float32)  # filled in place: it is the driver's largest array
    for k, own in enumerate(contexts):
        for at in range(0, len(own), 2048):
            part = own[at : at + 2048]
            p, free = np.zeros((len(part), symbols)), np.ones((len(part), symbols), bool)
            weight = np.ones(len(part))
            for j in range(k, -1, -1):
                node = np.searchsorted(contexts[j], part & _U((1 << 8 * j) - 1))
                c = counts[j][node] * free
                total, kinds = c.sum(axis=1, dtype=np.float64), (c > 0).sum(axis=1).astype(np.float64)
                if j == 0 and not unseen:
                    kinds = np.zeros(len(part))
                some = total > 0
                p[some] += (weight[some] / (total + kinds)[some])[:, None] * c[some]
                weight[some] *= (kinds / np.where(some, total + kinds, 1))[some]
                free &= c == 0
            p[:, -1] = weight / unseen if unseen else 1.0
            # what the shorter contexts have no symbol left for stays unused; the rest can't be zero but by rounding
            out[first_row[k] + at : first_row[k] + at + len(part)] = np.log10(np.maximum(p, 1e-30))
    return Trie([Index(c) for c in contexts], first_row, out, column, whole)


def store_levels(grams: DataFrame) -> list[DataFrame]:
    """``context, key, n, total, kinds`` of every order: all counts, with the sum and the number of symbols of their
    context, from the longest grams, which cover all positions of all training texts."""
    levels = []
    for k in range(ORDER, -1, -1):
        if levels:
            key = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")
            grams = levels[0].select(key, "n").groupBy("key").agg(F.sum("n").alias("n"))
        own = W.partitionBy("context")
        level = grams.withColumn("context", F.shiftright("key", 8)).withColumns({"total": F.sum("n").over(own), "kinds": F.count(F.lit(1)).over(own)})
        levels.insert(0, store(level.select("context", "key", "n", "total", "kinds"), f"order{k}"))
    return levels


def most_frequent(rows: DataFrame, by: str, most: int, each: Column | None = None) -> tuple[DataFrame, bool]:
    """The rows of the largest ``by``, as many as ``most`` holds (a row counts ``each``, else 1), and whether these are
    all. The bound lies at a quarter power of two, found from the number of rows between each two; nothing is sorted."""
    step = F.floor(4 * F.log2(by)).cast("int")
    found = rows.groupBy(step.alias("step")).agg(F.sum(F.lit(1.0) if each is None else each).alias("rows")).collect()
    held, least = 0, None
    for at, n in sorted(found, reverse=True):
        held += round(n)
        if held > most:
            return rows.where(step >= least) if least is not None else rows.limit(0), False
        least = at
    return rows, True


def collect_levels(levels: list[DataFrame], contexts: int | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """The counts that the broadcast trie holds of every order, those of the ``contexts`` (CONTEXTS) most frequent
    contexts (orders 0 to 2 have 65,536 at most), which bounds the result; and whether these are all."""
    out, whole = [], True
    for k, level in enumerate(levels):
        if 8 * k > 16:
            # a context has as many rows as symbols
            level, every = most_frequent(level, "total", CONTEXTS if contexts is None else contexts, 1 / F.col("kinds"))
            whole = whole and every
        got = level.select("key", "n").toArrow()
        keys, n = got["key"].to_numpy().astype(np.uint64), got["n"].to_numpy()
        order = np.argsort(keys)
        out.append((keys[order], n[order]))
    return out, whole


def score_grams(levels: list[DataFrame], grams: DataFrame) -> DataFrame:
    """``key, p``: log10 probabilities of ``grams`` that no training text has, each in its longest context of any
    count, by the rules of :func:`build_trie`.

    From order 0 up, a gram has its count (null if its context hasn't seen it), ``q`` (log10 of its share of the
    context's escapes, if not seen) and ``p`` (in this context). A context's symbols are its suffix's too, so what they
    exclude there is a number of the context: the suffix's counts of them. Orders 0 and 1 and the contexts of
    order 2 have at most 65,536 rows and are broadcast, so no join deals many grams to one key.
    """
    unseen = 256 - levels[0].count()
    low = lambda c, k: F.col(c).bitwiseAND(F.lit((1 << 8 * k) - 1))
    out = grams.select("key", F.lit(None).cast("long").alias("n"), F.lit(-log10(max(unseen, 1))).alias("q"), F.lit(-log10(256)).alias("p"))
    for k, level in enumerate(levels):
        if k:
            # what the suffix has left without the context's symbols: the sum of counts and the number of symbols
            below = levels[k - 1].select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("total").alias("_total"), F.col("kinds").alias("_kinds"))
            own = level.withColumn("_key", low("key", k)).join(F.broadcast(below) if k < 3 else below, "_key").groupBy("context")
            kinds = F.max("_kinds") - F.max("kinds") if k > 1 or unseen else F.lit(0)
            own = own.agg(F.max("total").alias("total"), F.max("kinds").alias("kinds"), (F.max("_total") - F.sum("_n")).alias("left"), kinds.alias("new"))
        else:
            # order 0 escapes only to bytes that training never saw
            own = level.select("context", "total", (F.col("kinds") if unseen else F.lit(0)).alias("kinds"), F.lit(0).alias("left"), F.lit(0).alias("new")).distinct()
        seen = level.select(F.col("key").alias("_gram"), F.col("n").alias("_has"))
        out = out.withColumns({"context": F.shiftright(low("key", k + 1), 8), "_gram": low("key", k + 1)})
        out = out.join(F.broadcast(own) if k < 3 else own, "context", "left").join(F.broadcast(seen) if k < 2 else seen, "_gram", "left")
        per = F.log10(F.col("left") + F.col("new"))
        q = F.when(F.col("left") == 0, F.col("q")).when(F.col("n").isNotNull(), F.log10("n") - per).otherwise(F.log10("new") - per + F.col("q"))
        p = F.coalesce(F.log10("_has"), F.log10("kinds") + q) - F.log10(F.col("total") + F.col("kinds"))
        out = out.select("key", F.col("_has").alias("n"), q.alias("q"), F.when(F.col("total").isNull(), F.col("p")).otherwise(p).alias("p"))
    return out.select("key", "p")


def score_documents(docs: DataFrame, folds: int = 5, hold: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Texts whose fold isn't ``hold`` are learnt from. ``score`` is the byte model's log10 probability of the text
    (A-Z lowered, UTF-8) and its end; ``base_score`` is the smoothed unigram's over words and one end token.

    One pass gathers counts over all training texts; one pass scores all texts. Of fixed size, so broadcast, are the
    byte trie of the most frequent contexts of each length (CONTEXTS), the most frequent grams of the longest contexts
    (GRAMS) and the most frequent words (WORDS). Every other word of a document, and every byte that neither the grams nor
    the trie's contexts cover, goes through a join with the full counts, so both scores are exact for any
    vocabulary and any number of contexts.

    Null texts count as empty and score their end alone; a null id folds like empty text; repeated rows each count and
    each score. Without training texts the byte model is uniform. Other columns are ignored; empty stays empty.
    """
    sc = docs.sparkSession.sparkContext
    held = (fold("doc_id", folds) == hold).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held)
    counts = store(gather_counts(rows.where(~F.col("held_out"))), "counts")
    words = counts.where("kind = 0").select("key", "n")
    ends = rows.where(~F.col("held_out")).count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, v_all = total + ends, distinct + (ends > 0)
    top = most_frequent(words, "n", WORDS)[0].toArrow()
    levels = store_levels(counts.where("kind = 1").select("key", "n"))
    kept, whole = collect_levels(levels)
    trie = build_trie(kept, whole)
    del kept
    known = (F.log10("n") - F.log10(F.col("total") + F.col("kinds"))).alias("p")
    if not whole:
        frequent = most_frequent(levels[ORDER], "n", GRAMS)[0].select("key", known.cast("float")).toArrow()
        trie.grams, trie.gram_log10 = Index(frequent["key"].to_numpy().view(np.uint64)), frequent["p"].to_numpy()
        del frequent
    model = sc.broadcast((trie, Index(top["key"].to_numpy().view(np.uint64)), top["n"].to_numpy(), ends))
    del trie, top
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        trie, keys, n, ends = model.value
        logs = np.log10(n + 0.5)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t.lower() for t in batch.column(1).to_pylist()]
            for a, b in _groups(texts):
                out: dict[str, list] = {k: [] for k in ("n_tokens", "known", "logs", "rare", "times")}
                for t in texts[a:b]:
                    w = _hashes(t.split())
                    known, mass, rare = int(ends > 0), float(np.log10(ends + 0.5)), w
                    if len(w):
                        place = keys.find(w.view(np.uint64))
                        hit = place >= 0
                        known += int(hit.sum())
                        mass += float(logs[place[hit]].sum())
                        rare = w[~hit]
                    rare, times = np.unique(rare, return_counts=True)
                    for k, v in zip(out, (len(w) + 1, known, mass, rare, times)):
                        out[k].append(v)
                size = b - a
                score, grams = trie.score_kept(texts[a:b])
                columns = [pa.array(np.arange(row, row + size)), batch.column(0).slice(a, size), batch.column(2).slice(a, size), *(pa.array(out[k], pa.int64()) for k in ("n_tokens", "known")), pa.array(out["logs"]), pa.array(score), *(pa.array(out[k], pa.list_(pa.int64())) for k in ("rare", "times")), pa.array(grams, pa.list_(pa.int64()))]
                row += size
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    scored = store(rows.select("doc_id", text, "held_out").mapInArrow(handing_back(run), "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<long>, times array<long>, grams array<long>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    rare = rare.join(words, "key", "left").select(
        "row", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("rare_known"),
        (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"), F.lit(0.0).alias("rare_score"))
    if not whole:
        need = scored.select("row", "held_out", F.explode("grams").alias("key"))
        new = need.where("held_out").select("key").distinct().join(levels[ORDER], "key", "left_anti")
        p = levels[ORDER].select("key", known).union(score_grams(levels, new))
        rare = rare.union(need.join(p, "key").select("row", F.lit(0), F.lit(0.0), "p"))
    rare = rare.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("rare_known", "rare_logs", "rare_score")))
    per_token = float(np.log10(n_all + 0.5 * (v_all + 1)))
    out = scored.drop("rare", "times", "grams").join(rare, "row", "left")
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
