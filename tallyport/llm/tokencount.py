"""Token counts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyport.llm.common import Index

#: What the pattern library of the tokenizer file calls white space (the Unicode property).
SPACE = r"\t-\r \x85\xa0  -     　"
_ODD = re.compile(r"[\x1c-\x1f]")
_PIECES = re.compile(rf"[^{SPACE}]+")
#: Entries that the cache of piece counts may hold, and the longest piece it takes.
CACHE, LONGEST = 1_000_000, 128
_NONE = np.iinfo(np.int32).max


class MergeTable:
    """Merges of a byte-level BPE file with word-end symbols, as arrays in rank order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab, self.size = model["vocab"], len(model["vocab"]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.pairs = Index(keys)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        letters = self._byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + self.suffix] for x in letters], np.int32)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"^\s", f"^{SPACE}"))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")

    @staticmethod
    def _byte_letters() -> list[str]:
        """The printable stand-in of each byte: itself, or the next free code point from 256 on."""
        out, free = [], 256
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
                out.append(chr(b))
            else:
                out.append(chr(free))
                free += 1
        return out

    def pretokens(self, piece: str) -> list[str]:
        """The words of a piece of ordinary text: NFC, lower case letter by letter, then the file's pattern."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        return self.words.findall(piece.lower())

    def _ranks(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each position; none at the end of a sequence."""
        after = np.minimum(at + 1, len(ids) - 1)
        key = ids[at].astype(np.int64) * self.size + ids[after]
        rank = self.pairs.find(key.astype(np.uint64))  # merges stand in rank order
        return np.where((rank >= 0) & (owner[at] == owner[after]) & (at < after), rank, _NONE)

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token.

        All symbols lie in one flat array. Each round finds every sequence's pair of lowest rank and applies all
        its occurrences in all sequences at once (in a run like aaa the first, third, ... pair); sequences
        without a pair leave with their length.
        """
        raw = [p.encode("utf-8") for p in pretokens]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        counts = np.zeros(len(raw), np.int64)
        if not size.sum():
            return counts
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[flat]
        owner = np.repeat(np.arange(len(raw)), size)
        ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        ids[ends] = self.last[flat[ends]]
        rank = self._ranks(ids, owner, np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            counts[owner[starts[done]]] = length[done]
            where = np.flatnonzero((rank == np.repeat(best, length)) & (rank != _NONE))
            if len(where) > 1:
                first = np.append(True, (np.diff(where) != 1) | (owner[where[1:]] != owner[where[:-1]]))
                run = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - run) % 2 == 0]
            ids[where] = self.made[rank[where]]
            keep = np.repeat(~done, length)
            keep[where + 1] = False
            place = np.cumsum(keep)[where] - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            changed = np.concatenate([place, place[place > 0] - 1])
            rank[changed] = self._ranks(ids, owner, changed)
        return counts


@lru_cache(maxsize=4)
def _table(path: str) -> MergeTable:
    return MergeTable(path)


_cache: dict[str, dict[str, int]] = {}


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text. Pieces between white space are independent, so each is counted once and kept."""
    table, cache = _table(path), _cache.setdefault(path, {})
    if len(cache) > CACHE:
        cache.clear()
    pieces = [t.split() if not _ODD.search(t) else _PIECES.findall(t) for t in texts]
    missing = list(set().union(*pieces) - cache.keys()) if pieces else []
    found = {}
    for at in range(0, len(missing), 100_000):
        part, words, owner = missing[at : at + 100_000], [], []
        base = np.zeros(len(part), np.int64)
        for i, piece in enumerate(part):
            ordinary = [piece]
            if table.special.search(piece):
                base[i] = len(table.special.findall(piece))
                ordinary = table.special.split(piece)
            for text in ordinary:
                got = table.pretokens(text)
                words += got
                owner += [i] * len(got)
        distinct = list(dict.fromkeys(words))
        counts = dict(zip(distinct, table.count(distinct).tolist()))
        total = base + np.bincount(np.array(owner, np.int64), np.array([counts[w] for w in words], np.float64), len(part)).astype(np.int64)
        found.update(zip(part, total.tolist()))
    short = {k: v for k, v in found.items() if len(k) <= LONGEST}
    cache.update(short)
    if len(short) == len(found):
        return [sum(map(cache.__getitem__, p)) for p in pieces]
    return [sum(cache[x] if x in cache else found[x] for x in p) for p in pieces]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chars: int = 2_000_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, as the tokenizer file's library counts.

    The file must be a byte-level BPE with a Split pattern and, optionally, word-end symbols; its special strings
    count as one token each inside texts. Null text counts as empty (0 bytes, 0 tokens). Texts are counted in
    groups of about ``chars`` characters; a longer one is a group of its own. Repeated rows and null ids are
    returned as they are; other columns are ignored; an empty table stays empty. One narrow pass, no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), []
            at = 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= chars:
                    size += len(texts[to])
                    to += 1
                n += count_texts(texts[at:to], path)
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
