"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyport.llm.common import handing_back, store

#: Ids in a block, and blocks in a group, which are coded side by side.
BLOCK, LANES = 2048, 4096
#: Bits of a context's hash, of a mixing weight, and of the weights' learning rate; steps prepared at once when coding.
SLOTS, WEIGHT, RATE, AHEAD = 11, 10, 4, 64
#: More distinct ids than this in a group are coded as halves of 16 bits.
MOST = 1 << 19
_GROUP = struct.Struct("<4sBBHIIIII")  # magic, halves, bits of the order-0 total, 0, ids, symbols, table's bytes, its crc32, blocks
_BLOCK = struct.Struct("<III")  # ids, crc32 of the ids, payload bytes
_LEAST, _MASK = np.int64(1 << 32), np.int64((1 << 32) - 1)
#: At a block's start, the chance (of 2^16) that an order's guess is right, by how often it has held (0: no guess).
_PRIOR2, _PRIOR1 = np.array([0, 16000, 40000, 58000]), np.array([0, 6000, 20000, 40000])


class _Mixer:
    """The predictions of all lanes. P(x) = w2 [x = guess 2] + w1 [x = guess 1] + (1 - w2 - w1) P0(x).

    An order-2 and an order-1 context (hashed places of a lane's own tables) each guess the symbol that followed
    last, with a count of 1 to 3 of how often it has held. The weights are adaptive too, kept by both counts; ``P0`` is
    the group's order-0 table. Rows 0 and 1 of the arrays below are order 2 and order 1. Numbers have 32 bits where they
    fit, and places the width that numpy takes them in, so that it casts few.
    """

    def __init__(self, lanes: int, freq: np.ndarray, bits: int):
        self.lanes, self.none, self.bits = lanes, len(freq), bits
        self.kind = np.int32 if bits + WEIGHT < 31 else np.int64
        self.table = np.full(2 * lanes << SLOTS, self.none << 2, np.int32)
        second = np.repeat(_PRIOR2, 4)
        first = np.tile(_PRIOR1, 4) * (65536 - second) // 65536
        self.weights = np.concatenate([np.tile(second, lanes), np.tile(first, lanes)]).astype(np.int32)
        lane = np.arange(lanes)
        self.base = np.stack([lane << SLOTS, (lane + lanes) << SLOTS])
        self.own = np.stack([lane << 4, (lane + lanes) << 4])
        self.cum = np.concatenate([[0], np.cumsum(freq)]).astype(self.kind)
        self.freq = np.append(freq, 0).astype(self.kind)

    def places(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Places in the table of the contexts (p2, p1) and (p1), uint32, along the last axis."""
        h = (p1 * np.uint32(0x9E3779B1) + p2 * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOTS)
        out = np.empty((2, *p1.shape), np.intp)
        out[0], out[1] = h, p1 & np.uint32((1 << SLOTS) - 1)
        out += self.base[:, : p1.shape[-1]].reshape(2, *[1] * (p1.ndim - 1), -1)
        return out

    def guess(self, at: np.ndarray) -> None:
        m = at.shape[1]
        e = self.table.take(at)
        self.at, self.count, self.guessed = at, e & 3, e >> 2
        self.state = (self.count[0] << 2 | self.count[1]) + self.own[:, :m]
        self.w = self.weights.take(self.state)
        a = ((self.w * 1023) >> 16).astype(self.kind, copy=False)
        self.rest = 1024 - a[0] - a[1]
        self.part = a << self.bits

    def interval(self, x: np.ndarray, cum: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where x starts among 2^(bits + WEIGHT), and its size; sets ``hit``."""
        self.hit = self.guessed == x
        start, size = (self.guessed < x) * self.part, self.hit * self.part
        return self.rest * cum + start[0] + start[1], self.rest * freq + size[0] + size[1]

    def learn(self, entry: np.ndarray) -> None:
        """``entry``: 4 x + 1 for each lane's symbol x."""
        hit = self.hit
        put = entry + hit * ((self.count > 1) + np.int8(1))
        hit[1] &= ~hit[0]
        w = self.w + (((hit.astype(np.int32) << 16) - self.w) >> RATE)
        for i in (0, 1):
            self.table[self.at[i]] = put[i]
            self.weights[self.state[i]] = w[i]


def _live(sizes: np.ndarray, t: int) -> int:
    """Lanes with more than t symbols; only the last may be short."""
    return len(sizes) - (t >= sizes[-1])


def _put(sym: np.ndarray, sizes: np.ndarray, freq: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``sym`` (step, lane) side by side: words (lane, place) and how many each lane has.

    A range coder of 48 bits with 16-bit words. Carries are left standing in the words, and added at the end.
    """
    n, lanes = sym.shape
    mix, scale = _Mixer(lanes, freq, bits), np.int64(bits + WEIGHT)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    room = 2 * n + 8
    flat, row = np.zeros(lanes * room, np.int32), np.arange(lanes, dtype=np.int64) * room
    pos = row.copy()
    before = np.full((2, lanes), mix.none, np.uint32)
    for t in range(n):
        if t % AHEAD == 0:
            near = sym[t : t + AHEAD]
            ext = np.concatenate([before, near.astype(np.uint32)])
            before = ext[-2:]
            at, cum, freqs, entry = mix.places(ext[1:-1], ext[:-2]), mix.cum.take(near), mix.freq.take(near), (near << 2) + 1
        i, m = t % AHEAD, _live(sizes, t)
        mix.guess(at[:, i, :m])
        start, size = mix.interval(near[i, :m], cum[i, :m], freqs[i, :m])
        lo, sp, to = low[:m], span[:m], pos[:m]
        step = sp >> scale
        lo += start * step
        np.multiply(size, step, out=sp)
        flat[to] = lo >> 32
        short = sp < _LEAST
        np.copyto(lo, (lo & _MASK) << 16, where=short)
        np.copyto(sp, sp << 16, where=short)
        to += short
        few = np.flatnonzero(sp < _LEAST)  # the lanes whose symbol was rare
        while len(few):
            low_, span_ = lo[few], sp[few] << 16
            flat[to[few]] = low_ >> 32
            lo[few], sp[few] = (low_ & _MASK) << 16, span_
            to[few] += 1
            few = few[span_ < _LEAST]
        mix.learn(entry[i, :m])
    for _ in range(3):
        flat[pos] = low >> 32
        low = (low & _MASK) << 16
        pos += 1
    length = pos - row
    words = flat.reshape(lanes, room)[:, : int(length.max())]
    while (words > 0xFFFF).any():
        over = words >> 16
        words &= 0xFFFF
        words[:, :-1] += over[:, 1:]
    return words.astype("<u2"), length


def _get(words: np.ndarray, sizes: np.ndarray, freq: np.ndarray, bits: int) -> np.ndarray:
    """The symbols (step, lane) of :func:`_put`. Broken words give wrong symbols, never another error."""
    lanes, n = len(sizes), int(sizes[0])
    mix, scale = _Mixer(lanes, freq, bits), np.int64(bits + WEIGHT)
    top = float((1 << int(scale)) - 1)
    symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    flat, row = words.ravel(), np.arange(lanes, dtype=np.int64) * words.shape[1]
    code = sum(flat[row + i].astype(np.int64) << 16 * (2 - i) for i in range(3))
    span, pos = np.full(lanes, 1 << 48, np.int64), row + 3
    out = np.zeros((n, lanes), np.int32)
    p1 = p2 = np.full(lanes, mix.none, np.uint32)
    for t in range(n):
        m = _live(sizes, t)
        mix.guess(mix.places(p1[:m], p2[:m]))
        c, sp, to, g = code[:m], span[:m], pos[:m], mix.guessed
        step = sp >> scale
        # doubles divide exactly here and below: no dividend has more than 48 bits, so no quotient rounds up to an integer
        v = np.maximum(np.minimum(c / step, top), 0).astype(mix.kind)
        # each guess's interval, to which both orders' parts belong if they agree
        other = mix.part[::-1]
        starts = mix.rest * mix.cum.take(g) + (g[::-1] < g) * other
        widths = mix.rest * mix.freq.take(g) + mix.part + (g[0] == g[1]) * other
        past = v >= starts + widths
        beyond = past * mix.part
        before = beyond[0] + beyond[1]
        x = symbol.take(((v - before) / mix.rest).astype(np.intp), mode="clip")
        start, size = mix.rest * mix.cum.take(x) + before, mix.rest * mix.freq.take(x)
        inside = mix.hit = (v >= starts) > past
        for i in (1, 0):
            np.copyto(x, g[i], where=inside[i])
            np.copyto(start, starts[i], where=inside[i])
            np.copyto(size, widths[i], where=inside[i])
        out[t, :m] = x
        c -= start * step
        np.multiply(size, step, out=sp)
        short = sp < _LEAST
        np.copyto(c, (c << 16) | flat.take(to, mode="clip"), where=short)
        np.copyto(sp, sp << 16, where=short)
        to += short
        few = np.flatnonzero(sp < _LEAST)
        while len(few):
            span_ = sp[few] << 16
            c[few], sp[few] = (c[few] << 16) | flat.take(to[few], mode="clip"), span_
            to[few] += 1
            few = few[span_ < _LEAST]
        mix.learn((x << 2) + 1)
        p2, p1 = p1, x.astype(np.uint32)
    return out


def _table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The distinct ids, each id's place among them, their order-0 frequencies and the bits of these's sum."""
    top = int(ids.max())
    if top < 1 << 22:
        count = np.bincount(ids)
        symbols = np.flatnonzero(count)
        rank = np.zeros(len(count), np.int32)
        rank[symbols] = np.arange(len(symbols), dtype=np.int32)
        count, place = count[symbols], rank[ids]
    else:
        symbols, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    bits = max(16, len(symbols).bit_length() + 1)
    freq = 1 + count * ((1 << bits) - len(symbols)) // len(ids)
    freq[np.argmax(freq)] += (1 << bits) - int(freq.sum())
    return symbols, place.astype(np.int32, copy=False), freq, bits


def _encode_group(ids: np.ndarray) -> bytes:
    sizes = np.full(-(-len(ids) // BLOCK), BLOCK)
    sizes[-1] = len(ids) - BLOCK * (len(sizes) - 1)
    checks = [zlib.crc32(ids[n * BLOCK : (n + 1) * BLOCK].astype("<u4").tobytes()) for n in range(len(sizes))]
    symbols, place, freq, bits = _table(ids)
    halves = len(symbols) > MOST
    if halves:
        symbols, place, freq, bits = _table(np.stack([ids >> 16, ids & 0xFFFF], axis=1).ravel())
    each = BLOCK << halves
    sym = np.zeros(len(sizes) * min(each, len(place)), np.int32)
    sym[: len(place)] = place
    words, length = _put(np.ascontiguousarray(sym.reshape(len(sizes), -1).T), sizes << int(halves), freq, bits)
    table = zlib.compress(np.concatenate([np.diff(symbols, prepend=0), freq]).astype("<u4").tobytes())
    out = [_GROUP.pack(b"TLG2", halves, bits, 0, len(ids), len(symbols), len(table), zlib.crc32(table), len(sizes)), table]
    for n, size in enumerate(sizes.tolist()):
        payload = words[n, : length[n]].tobytes()
        out += [_BLOCK.pack(size, checks[n], len(payload)), payload]
    return b"".join(out)


def encode_ids(ids: np.ndarray, width: int = 4) -> bytes:
    """Groups of about BLOCK * LANES ids (below 2^(8 * width)), each with its order-0 table and its blocks.

    A block of at most BLOCK ids starts from a fresh model and has its own checksum; it needs the group's table
    (checksummed too) but no other block.
    """
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and width < 4 and int(ids.max()) >> 8 * width:
        raise ValueError(f"ids of more than {width} bytes")
    groups = max(1, round(len(ids) / (BLOCK * LANES)))
    step = max(1, -(-len(ids) // groups // BLOCK)) * BLOCK
    return b"".join(_encode_group(ids[at : at + step]) for at in range(0, len(ids), step))


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of :func:`encode_ids`; raises ValueError if a header, a table or a checksum is wrong."""
    at, out = 0, [np.empty(0, np.uint32)]
    while at < len(data):
        if at + _GROUP.size > len(data):
            raise ValueError("cut off")
        magic, halves, bits, _, n_ids, n_symbols, size, crc, n_blocks = _GROUP.unpack_from(data, at)
        at += _GROUP.size
        packed = data[at : at + size]
        at += size
        if magic != b"TLG2" or zlib.crc32(packed) != crc:
            raise ValueError("not a group of ids, or its table is wrong")
        table = np.frombuffer(zlib.decompress(packed), "<u4")
        symbols, freq = np.cumsum(table[:n_symbols], dtype=np.uint32), table[n_symbols:].astype(np.int64)
        if len(freq) != n_symbols or int(freq.sum()) != 1 << bits or n_blocks != -(-n_ids // BLOCK):
            raise ValueError("the table of a group of ids is wrong")
        blocks = []
        for n in range(n_blocks):
            if at + _BLOCK.size > len(data):
                raise ValueError("cut off")
            size, check, length = _BLOCK.unpack_from(data, at)
            at += _BLOCK.size
            if size != min(BLOCK, n_ids - n * BLOCK) or at + length > len(data):
                raise ValueError("the header of a block of ids is wrong")
            blocks.append((check, np.frombuffer(data, "<u2", length // 2, at)))
            at += length
        sizes = np.full(n_blocks, BLOCK)
        sizes[-1] = n_ids - BLOCK * (n_blocks - 1)
        words = np.zeros((n_blocks, max(len(b[1]) for b in blocks) + 4), np.uint16)
        for n, (_, payload) in enumerate(blocks):
            words[n, : len(payload)] = payload
        got = symbols[_get(words, sizes << int(halves), freq, bits).T.ravel()[: n_ids << halves]]
        ids = got[::2] << 16 | got[1::2] if halves else got
        for n, (check, _) in enumerate(blocks):
            if zlib.crc32(ids[n * BLOCK : (n + 1) * BLOCK].astype("<u4").tobytes()) != check:
                raise ValueError("checksum of a block of ids is wrong")
        out.append(ids)
    return np.concatenate(out)


#: Pieces and words that a worker keeps with their ids, and the bytes that these may have, before it starts afresh;
#: bytes of text that it works on at once.
CACHE, BYTES, CHUNK = 2_000_000, 40_000_000, 8_000_000
#: A space that no visible character follows, as Arrow's pattern library writes it, and where a text may be cut.
_ODD = r" [\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}]| $"
_CUT = re.compile(" (?=[^\\s᠎])")
#: Letters, numbers and white space up to U+024F, which no Unicode version changes any more, and the byte-level
#: pattern over them.
_UPTO = 0x250
_L, _N = (re.escape("".join(chr(c) for c in range(_UPTO) if unicodedata.category(chr(c))[0] == k)) for k in "LN")
_S = "\t-\r \x85\xa0"
_LATIN = re.compile("[\0-\u024f]*")
#: Stands between pieces, and between words for a byte that UTF-8 never has; no piece of letters up to U+024F has it.
_MARK = "\uffff"
_PATTERN = re.compile(f"{_MARK}|'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}{_MARK}]+|[{_S}]+(?![^{_S}{_MARK}])|[{_S}]+")
#: The byte-level stand-in of each byte: itself if it is printable, else the next free code point from 256 on.
_FREE = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_LETTERS = np.arange(256, dtype="<u2")
_LETTERS[_FREE] = 256 + np.arange(len(_FREE))
_LETTERS[255] = ord(_MARK)


def _joined(texts: pa.StringArray, between: str) -> bytes:
    """UTF-8 of texts one behind another: Arrow joins them, and none becomes a Python string."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), between)[0].as_buffer().to_pybytes()


_POWERS = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def _hashes(pieces: pa.StringArray) -> np.ndarray:
    """64-bit hashes of strings, by their bytes and places."""
    out = np.zeros(len(pieces), np.uint64)
    data = pieces.buffers()[2] if len(pieces) else None
    if data is None:
        return out
    data = np.frombuffer(data, np.uint8)
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    for i in range(0, len(pieces), 1 << 15):
        end = ends[i : i + (1 << 15) + 1]
        size = np.diff(end)
        place = np.arange(end[0], end[-1], dtype=np.int32) - np.repeat(end[:-1], size)
        total = np.zeros(len(place) + 1, np.uint64)
        np.cumsum(_POWERS[place & 4095] * (data[end[0] : end[-1]] + np.uint64(1)), out=total[1:])
        out[i : i + len(size)] = total[end[1:] - end[0]] - total[end[:-1] - end[0]]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


class _Known:
    """Distinct pieces and where their ids are. They are found by hash in a table that grows with them, for Arrow's
    ``index_in`` makes one of all pieces with each call; what is found is compared, so that of pieces with one hash one is
    known, and the others are encoded whenever they come."""

    def __init__(self):
        self.pieces, self.where, self.hash = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.uint64)
        self.table = np.full(1 << 12, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.table).bit_length())).astype(np.intp)

    def find(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of pieces are, -1 for one that isn't known, and the pieces' hashes."""
        h = _hashes(pieces)
        at = np.full(len(pieces), -1)
        left, slot = np.arange(len(pieces) if len(self.where) else 0), self._slot(h)
        while len(left):
            got = self.table[slot]
            same = (got >= 0) & (self.hash[got] == h[left])
            at[left[same]] = got[same]
            on = (got >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & (len(self.table) - 1)
        found = np.flatnonzero(at >= 0)
        equal = pc.equal(self.pieces.take(pa.array(at[found])), pieces.take(pa.array(found))).to_numpy(zero_copy_only=False)
        at[found[~equal]] = -1
        return np.append(self.where, -1)[at], h

    def add(self, pieces: pa.StringArray, where: np.ndarray, h: np.ndarray) -> None:
        first = len(self.where)
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.where, self.hash = np.concatenate([self.where, where]), np.concatenate([self.hash, h])
        if 2 * len(self.where) > len(self.table):
            self.table = np.full(1 << (4 * len(self.where)).bit_length(), -1, np.int32)
            first = 0
        left = np.arange(first, len(self.where), dtype=np.int32)
        slot = self._slot(self.hash[first:])
        while len(left):
            free = np.flatnonzero(self.table[slot] < 0)
            self.table[slot[free]] = left[free]  # of several for one place, one stays
            missed = self.hash[self.table[slot]] != self.hash[left]  # of several with one hash, too
            left, slot = left[missed], (slot[missed] + 1) & (len(self.table) - 1)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, of a byte-level BPE file without a normalizer.

    The byte-level pattern never joins anything across a space before a visible character, other than by giving
    that space to what follows. So texts are cut there, Arrow finds a batch's distinct pieces, and the library
    encodes each once. Pieces up to U+024F go to the library's model as the words that the pattern makes of them, each
    word once; all others, and those with what may be a special string, go to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model  # which takes words, without a pattern of its own
        vocabulary = self.whole.get_vocab()
        self.letters = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.letters[list(vocabulary.values())] = list(map(len, vocabulary))
        special = "|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values())
        self.beyond = r"[^\x00-\x{24f}]" + (special and "|" + special)
        self.reset()

    def reset(self) -> None:
        #: pieces at a text's start, pieces behind a space, and words, with their places in the arrays below
        self.known = [_Known() for _ in range(3)]
        self.n, self.n_ids = 0, 0
        self.start, self.count, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds pieces, given by their ids one behind another; returns their places."""
        for name, at, values in (("count", self.n, counts), ("start", self.n, self.n_ids + np.cumsum(counts) - counts), ("ids", self.n_ids, ids)):
            held = getattr(self, name)
            if at + len(values) > len(held):
                held = np.concatenate([held[:at], np.empty(max(len(values), len(held) // 2), held.dtype)])
                setattr(self, name, held)
            held[at : at + len(values)] = values
        places = np.arange(self.n, self.n + len(counts))
        self.n, self.n_ids = self.n + len(counts), self.n_ids + len(ids)
        return places

    def _places(self, pieces: pa.StringArray, kind: int) -> np.ndarray:
        """The places of distinct pieces; those that are new are encoded."""
        places, h = self.known[kind].find(pieces)
        missing = places < 0
        if missing.any():
            new = pieces.filter(pa.array(missing))
            places[missing] = self._encode_words(new) if kind == 2 else self._encode(new, " " * kind)
            self.known[kind].add(new, places[missing], h[missing])
        return places

    def _encode(self, pieces: pa.StringArray, before: str) -> np.ndarray:
        """Places of new pieces, each with ``before`` before it."""
        beyond = pc.match_substring_regex(pieces, self.beyond)
        places = np.empty(len(pieces), np.int64)
        odd = pieces.filter(beyond).to_pylist()
        if odd:
            got = self.whole.encode_batch_fast([before + p for p in odd], add_special_tokens=False)
            ids = [np.array(e.ids, np.uint32) for e in got]
            places[beyond.to_numpy(zero_copy_only=False)] = self._keep(np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
        plain = pieces.filter(pc.invert(beyond))
        if len(plain):
            words = pa.array(_PATTERN.findall(before + _joined(plain, _MARK + before).decode() + _MARK), pa.string()).dictionary_encode()
            code, mark = words.indices.to_numpy(), words.dictionary.index(_MARK).as_py()
            keep = np.arange(len(words.dictionary)) != mark
            place = np.full(len(keep), -1)
            place[keep] = self._places(words.dictionary.filter(pa.array(keep)), 2)
            n = np.append(self.count, 0)[place[code]] * (code != mark)
            counts = np.diff(np.cumsum(n)[code == mark], prepend=0)
            places[~beyond.to_numpy(zero_copy_only=False)] = self._keep(self._gather(self.start[place[code]], n, self.ids), counts)
        return places

    def _encode_words(self, words: pa.StringArray) -> np.ndarray:
        """Places of new words as the pattern makes them, each of which the library's model encodes."""
        raw = _joined(words, _MARK).replace(_MARK.encode(), b"\xff")
        flat = _LETTERS[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le").split(_MARK)
        ids = np.array([t.id for tokens in map(self.model.tokenize, flat) for t in tokens], np.uint32)
        # a token's letters are its bytes, and no token goes beyond its word
        upto, ends = np.cumsum(self.letters[ids]), np.cumsum(pc.binary_length(words).to_numpy())
        counts = np.diff(np.searchsorted(upto, ends, "right"), prepend=0)
        if not len(ids) or upto[-1] != ends[-1] or (upto[np.cumsum(counts) - 1] != ends).any():
            raise ValueError("the vocabulary lacks a byte")
        return self._keep(ids, counts)

    def _gather(self, first: np.ndarray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def encode(self, texts: pa.StringArray, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text behind another with ``tail`` at its end, and how many each has."""
        if self.n > CACHE or self.n_ids * 4 + sum(k.pieces.nbytes for k in self.known) > BYTES:
            self.reset()
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        parts = []
        if not odd.all():
            parts.append((np.flatnonzero(~odd), pc.split_pattern(texts.filter(pa.array(~odd)), " ")))
        if odd.any():
            parts.append((np.flatnonzero(odd), pa.array([_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))))
        end = self._keep(np.asarray(tail, np.uint32), np.array([len(tail)])) if tail is not None else np.empty(0, np.int64)
        ids, starts, counts = [], np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        for who, lists in parts:
            pieces, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
            places = np.empty(len(pieces), np.int64)
            leads = np.zeros(len(pieces), bool)
            leads[offsets[:-1]] = True
            for kind, part in enumerate((leads, ~leads)):
                coded = pieces.filter(pa.array(part)).dictionary_encode()
                if len(coded):
                    places[part] = self._places(coded.dictionary, kind)[coded.indices.to_numpy()]
            if len(end):
                more = np.full(len(places) + len(who), end[0])
                more[np.arange(len(places)) + np.repeat(np.arange(len(who)), np.diff(offsets))] = places
                places, offsets = more, offsets + np.arange(len(offsets))
            n = self.count[places]
            counts[who] = np.add.reduceat(n, offsets[:-1])
            starts[who] = sum(map(len, ids)) + np.cumsum(counts[who]) - counts[who]
            ids.append(self._gather(self.start[places], n, self.ids))
        return (ids[0] if len(ids) == 1 else self._gather(starts, counts, np.concatenate(ids))), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian 32-bit integers, as the tokenizers library gives them."""
    ids, counts = encoder(path).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    return [ids[b - n : b].astype("<u4").tobytes() for b, n in zip(ends.tolist(), counts.tolist())]


_FILE = "part int, seq long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"
#: Bytes of text that a partition takes on average, at most.
SHARE = 64_000_000


def write_ids(docs: DataFrame, path: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Encodes every whole text, adds ``end_id`` to each, and writes the ids in ascending doc_id order.

    Returns the written table, one row a group of whole documents: ``part, seq`` (order in the file), ``n_ids``,
    the documents with their lengths, and ``data``, the group's blocks. Texts are dealt by ranges of doc_id and a
    hash of the text, so that one id's many rows don't share a task; the number of ranges follows the bytes of text. A
    group closes at about BLOCK * LANES ids, so a task's memory is bounded by that and one text. The table is plain
    Parquet in the shared folder: any storage that Spark writes to will do, and a lost executor's group is
    written again by a retry.
    """
    spark = docs.sparkSession
    target = BLOCK * LANES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))
    rows = rows.withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").withColumn("part", F.spark_partition_id())
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])
    end = np.array([end_id], np.uint32)

    def run(batches):
        seq, n_held, part, docs_, lengths, held = 0, 0, 0, [], [], []
        own = encoder(path)

        def group():
            flat = [pa.concat_arrays(docs_), pa.array(np.concatenate(lengths))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in flat]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([n_held], pa.int64()), *lists, pa.array([encode_ids(np.concatenate(held))], pa.binary())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
                ids, counts = own.encode(batch.column(1).slice(at, to - at), end)
                docs_.append(batch.column(0).slice(at, to - at))
                lengths.append(counts)
                held.append(ids)
                n_held += len(ids)
                at = to
                if n_held >= target:
                    yield group()
                    seq, n_held, docs_, lengths, held = seq + 1, 0, [], [], []
        if docs_:
            yield group()

    return store(dealt.select("doc_id", "text", "part").mapInArrow(handing_back(run), _FILE), "ids")


def read_ids(table: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the blocks of :func:`write_ids` alone.

    Groups decode independently; ``start`` adds the counts of the groups before (a running sum in each part, and
    one over the parts' totals) to the place in the group.
    """
    sizes = table.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(parts.select("part", "base"), "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("group_start"))
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, docs, lengths = (batch.column(c)[i].as_py() for c in (0, 1, 3, 4))
                raw = memoryview(decode_ids(batch.column(5)[i].as_py()).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                if int(ends[-1]) * 4 != len(raw):
                    raise ValueError("the ids don't fill the documents")
                at = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([part] * len(docs), [seq] * len(docs), docs, at, lengths, crc), schema)], schema=schema)

    rows = table.mapInArrow(handing_back(run), "part int, seq long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    # a fixed strategy: a change of plan while the rows are dealt out would decode them all again
    return rows.join(starts.hint("merge"), ["part", "seq"]).select("doc_id", (F.col("group_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_id_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) and reads them back: one row per row of ``docs``.

    Null text counts as empty (the end id alone); null ids come first; rows of an equal id go by a hash of their
    text. Other columns are ignored; an empty table gives an empty result.
    """
    return read_ids(write_ids(docs, path, end_id))
