"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement."""

from __future__ import annotations

import re
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyport.llm.common import Index, handing_back

SPACE = "▁"
#: Lattice nodes that a task keeps before it starts afresh, characters of texts and of new words that it works on at
#: once, and walks so few that they are walked one by one.
NODES, CHUNK, NEW, FEW = 1_000_000, 500_000, 125_000, 8
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Texts that a cut at each space doesn't turn into words, as Arrow's pattern library writes it.
_ODD = f"  |^ | $|{SPACE}|^$"
_U = np.uint64
_PRIME = _U(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _state(x: np.ndarray, *parts) -> np.ndarray:
    for p in parts:
        x = _mix((x ^ np.asarray(p).astype(np.uint64)) * _U(0x9E3779B97F4A7C15) + _U(1))
    return x


def _draw(state: np.ndarray) -> np.ndarray:
    return ((state >> _U(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def _uniform(*parts) -> np.ndarray:
    """Numbers in (0, 1) that depend on the parts alone: the row's key, the sample, the word, the step."""
    return _draw(_state(np.zeros(1, np.uint64), *parts))


class Lattices:
    """Segmentation lattices of distinct words, in flat arrays that grow as words come.

    A node is a place in a word; its edges are the pieces that start there (a character that is no piece has one
    edge of byte pieces). Pieces weigh (2 + rank)^-power, their rank being the model's negative score, or the vocabulary's
    size if that is less (as for pieces that the model has without a merge). Backward
    sums turn weights into ``p``, the probability that a segmentation that reaches a node goes on by an edge.
    """

    def __init__(self, path: str, power: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n, self.power = sp.vocab_size(), power
        self.bytes_id = np.full(256, sp.unk_id(), np.int32)
        plain = []
        self.spelling: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[1:-1], 16)
                self.bytes_id[b] = i
                self.spelling[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append(i)
                self.spelling[i] = sp.id_to_piece(i).encode()
        text = [sp.id_to_piece(i) for i in plain]
        self.longest = max(map(len, text))
        # all beginnings of pieces, so that a search stops where no piece goes on
        starts: dict[int, str] = {}
        piece_of: dict[int, int] = {}
        for j, t in enumerate(text):
            h = 0
            for i, ch in enumerate(t):
                h = (h * int(_PRIME) + ord(ch) + 1) % 2**64
                if starts.setdefault(h, t[: i + 1]) != t[: i + 1]:
                    raise ValueError("two pieces or their beginnings share a hash")
            piece_of[h] = j
        self.starts = Index(np.array(list(starts), np.uint64))
        self.piece_of = np.array([piece_of.get(h, -1) for h in starts], np.int32)
        self.ids = np.array(plain, np.int32)
        rank = np.minimum(-np.array([sp.get_score(i) for i in plain]), n)
        self.weight = np.zeros(n)
        self.weight[self.ids] = -power * np.log(2.0 + rank)
        self.byte_weight = -power * np.log(2.0 + n)
        self.short = int(690 / max(1.0, -4 * self.byte_weight))  # characters whose weights' product is no less than e^-690
        self.vocabulary = n
        # characters that an id covers, and spellings with the mark read as a space
        self.length = np.ones(n, np.int32)
        self.length[self.ids] = list(map(len, text))
        read = [b.replace(SPACE.encode(), b" ") for b in self.spelling]
        self.spelt = np.frombuffer(b"".join(read), np.uint8)
        self.spelt_n = np.fromiter(map(len, read), np.int64, n)
        self.spelt_at = np.cumsum(self.spelt_n) - self.spelt_n
        self.reset()

    def reset(self) -> None:
        #: words, without the mark that each starts with, and their first nodes
        self.words, self.at = pa.array([], pa.string()), np.empty(0, np.int64)
        self.nodes = self.edges = 0
        self.first = np.zeros(1, np.int32)  # first edge of each node, and the end
        self.p = np.empty(0)
        self.upto = np.empty(0, np.float32)  # probability of the node's edges up to this one
        self.token = np.empty(0, np.int32)  # piece id, or -1 - character of a byte fall-back

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held, size = getattr(self, name), at + len(values)
        if size > len(held):
            held = np.concatenate([held[:at], np.empty(max(size, 5 * len(held) // 4) - at, held.dtype)])
            setattr(self, name, held)
        held[at:size] = values

    def to(self, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The nodes that edges lead to from their nodes."""
        token = self.token[edge]
        return node + np.where(token < 0, 1, self.length[np.maximum(token, 0)])

    def nodes_of(self, words: pa.StringArray) -> np.ndarray:
        """The first node of each word (given without its first mark), with lattices for those that are new."""
        if self.nodes > NODES:
            self.reset()
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        place = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy()
        nodes, missing = np.append(self.at, -1)[place], place < 0
        if missing.any():
            new = distinct.filter(pa.array(missing))
            found = np.empty(len(new), np.int64)
            size = pc.utf8_length(new).to_numpy()
            long = np.flatnonzero(size >= self.short)
            if len(long):
                found[long] = self._add(new.take(pa.array(long)), False)
            short = np.flatnonzero(size < self.short)
            for part in np.split(short, np.flatnonzero(np.diff(np.cumsum(size[short], dtype=np.int64) // NEW)) + 1):
                if len(part):
                    found[part] = self._add(new.take(pa.array(part)), True)
            nodes[missing] = found
            self.words, self.at = pa.concat_arrays([self.words, new]), np.concatenate([self.at, found])
        return nodes[coded.indices.to_numpy()]

    def _add(self, words: pa.StringArray, plain: bool) -> np.ndarray:
        """Lattices for new words, and their first nodes; ``plain`` weights (of words whose weights' product can't
        vanish) are summed as they are, others by their logs, which differs by rounding alone."""
        size = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], pc.binary_join_element_wise(SPACE, words, "")), "")[0].as_py()
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        start = np.cumsum(size) - size
        end_of = np.repeat((start + size).astype(np.int32), size)  # of the word, for each character
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        sources, tokens = [], []
        for length in range(1, self.longest + 1):
            at = at[at + length <= end_of[at]]
            if not len(at):
                break
            h[at] = h[at] * _PRIME + chars[at + length - 1] + _U(1)
            place = self.starts.find(h[at])
            piece = np.where(place >= 0, self.piece_of[place], -1)
            hit = piece >= 0
            if length == 1:
                odd = at[~hit]
                sources.append(odd.astype(np.int32))
                tokens.append(-1 - chars[odd].astype(np.int32))
            sources.append(at[hit].astype(np.int32))
            tokens.append(self.ids[piece[hit]])
            at = at[place >= 0]
        del at, h, place, piece, hit
        source, token = np.concatenate(sources), np.concatenate(tokens)
        del sources, tokens
        order = np.argsort(source, kind="stable")  # shorter pieces came first
        source, token = source[order], token[order]
        del order
        to = (source + np.where(token < 0, 1, self.length[np.maximum(token, 0)])).astype(np.int32)
        weight = self.weight[np.maximum(token, 0)]
        odd = np.flatnonzero(token < 0)
        code = -1 - token[odd]
        weight[odd] = self.byte_weight * (1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF))
        first = np.searchsorted(source, np.arange(len(chars) + 1))
        # a character's node is its place plus the number of words before it: each word has one node more, its end
        left = end_of - np.arange(len(chars))
        # the summed weights of all ways on to the word's end (or their log); an end's place is the next word's first
        total = np.zeros(len(chars) + 1)
        last = to == end_of[source]
        if plain:
            weight = np.exp(weight)
        few = not plain and len(words) < FEW
        by_left = np.argsort(left, kind="stable") if not few else np.empty(0, np.int64)
        cuts = np.searchsorted(left[by_left], np.arange(1, int(left.max()) + 2)) if not few else [0]
        if few:
            self._total(total, first.tolist(), to.tolist(), weight.tolist(), last.tolist())
        for d in range(len(cuts) - 1):
            nodes = by_left[cuts[d] : cuts[d + 1]]
            n = first[nodes + 1] - first[nodes]
            edge = np.repeat(first[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            seg = np.cumsum(n) - n
            if plain:
                total[nodes] = np.add.reduceat(weight[edge] * np.where(last[edge], 1.0, total[to[edge]]), seg)
                continue
            v = weight[edge] + np.where(last[edge], 0.0, total[to[edge]])
            top = np.maximum.reduceat(v, seg)
            total[nodes] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, n)), seg))
        if plain:
            p = weight * np.where(last, 1.0, total[to]) / total[source]
        else:
            p = np.exp(weight + np.where(last, 0.0, total[to]) - total[source])
        n = first[1:] - first[:-1]
        # summed within each node alone, so that it doesn't depend on which words came along
        upto, more = p.copy(), first[:-1]
        for r in range(1, int(n.max())):
            more, n = more[n > r], n[n > r]
            upto[more + r] += upto[more + r - 1]
        upto[first[1:] - 1] = 1.0
        base, edges = self.nodes, self.edges
        node_first = np.insert(first[:-1], start + size, first[start + size])  # an end node has no edges
        self._put("first", base, np.append(node_first + edges, edges + len(p)))
        self._put("p", edges, p)
        self._put("upto", edges, upto)
        self._put("token", edges, token)
        self.nodes, self.edges = base + len(node_first), edges + len(p)
        return base + start + np.arange(len(words))

    @staticmethod
    def _total(total: np.ndarray, first: list, to: list, weight: list, last: list) -> None:
        """The backward sums' logs node by node: for few long words, whose steps would have next to nothing to do at once."""
        held = total.tolist()
        for node in range(len(first) - 2, -1, -1):
            edges = range(first[node], first[node + 1])
            v = [weight[e] + (0.0 if last[e] else held[to[e]]) for e in edges]
            top = max(v)
            held[node] = top + log(sum([exp(x - top) for x in v]))
        total[:] = held

    def walk(self, node: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Samples a way from each node to its word's end: the edges in order, the node that each starts from, and
        each walk's number of edges. ``state`` seeds each walk."""
        node, live, steps, count = node.copy(), np.arange(len(node)), [], np.zeros(len(node), np.int64)
        alone = {}
        while True:
            here = node[live]
            edge = self.first[here]
            going = edge < self.first[here + 1]
            live, here, edge = live[going], here[going], edge[going]
            if len(live) < FEW:
                alone = {i: self._walk_on(int(node[i]), state[i], len(steps)) for i in live.tolist()}
                break
            u = _draw(_state(state[live], len(steps)))
            open_ = np.flatnonzero(self.upto[edge] <= u)
            while len(open_):
                edge[open_] += 1
                open_ = open_[self.upto[edge[open_]] <= u[open_]]
            steps.append((live, edge, here))
            count[live] += 1
            node[live] = self.to(here, edge)
        for i, (more, _) in alone.items():
            count[i] += len(more)
        offset = np.cumsum(count) - count
        out, source = np.empty((2, int(count.sum())), np.int32)
        for t, (who, edge, here) in enumerate(steps):
            at = offset[who] + t
            out[at], source[at] = edge, here
        for i, (more, here) in alone.items():
            end = offset[i] + count[i]
            out[end - len(more) : end], source[end - len(more) : end] = more, here
        return out, source, count

    def _walk_on(self, node: int, state: np.uint64, step: int) -> tuple[list[int], list[int]]:
        """The rest of one walk from its ``step`` on: the same edges as :meth:`walk` would take, and their nodes."""
        edges, nodes, draws = [], [], iter(())
        while True:
            edge, end = int(self.first[node]), int(self.first[node + 1])
            if edge == end:
                return edges, nodes
            u = next(draws, None)
            if u is None:
                draws = iter(_draw(_state(np.full(256, state), np.arange(step + len(edges), step + len(edges) + 256))).tolist())
                u = next(draws)
            while self.upto[edge] <= u:
                edge += 1
            edges.append(edge)
            nodes.append(node)
            token = int(self.token[edge])
            node += 1 if token < 0 else int(self.length[token])

    def tokens(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of edges, and how many ids each edge has."""
        token = self.token[edges]
        odd = np.flatnonzero(token < 0)
        n = np.ones(len(token), np.int64)
        if not len(odd):
            return token, n
        raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in token[odd].tolist()]
        n[odd] = [len(r) for r in raw]
        out = np.repeat(token, n)
        at = np.cumsum(n) - n
        for i, r in zip(at[odd].tolist(), raw):
            out[i : i + len(r)] = self.bytes_id[np.frombuffer(r, np.uint8)]
        return out, n

    def decode_all(self, ids: np.ndarray, n: np.ndarray) -> pa.StringArray:
        """The texts of runs of ids, of n ids each: as :meth:`decode`, for ids that were encoded from text."""
        size = self.spelt_n[ids]
        place = np.repeat(self.spelt_at[ids] - (np.cumsum(size) - size), size)
        place += np.arange(len(place))
        data, ends = self.spelt[place], np.cumsum(size)
        to = np.append(0, ends)[np.cumsum(n)]
        starts = np.append(0, to[:-1])
        lead = starts[(to > starts) & (data[np.minimum(starts, max(0, len(data) - 1))] == 32)] if len(data) else []
        keep = np.ones(len(data), bool)
        keep[lead] = False
        to = to - np.searchsorted(lead, to, "left") if len(lead) else to
        offsets = np.append(0, to).astype(np.int32)
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes()))

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids: pieces and bytes joined, the mark read as a space, the first space taken off."""
        text = b"".join(map(self.spelling.__getitem__, ids)).replace(SPACE.encode(), b" ")
        return text[1:] if text[:1] == b" " else text


@lru_cache(maxsize=2)
def lattices(path: str, power: float) -> Lattices:
    return Lattices(path, power)


def _segments(values: np.ndarray, n: np.ndarray, func, empty):
    """func.reduceat over consecutive runs of lengths n, with ``empty`` for runs of none."""
    out = np.full(len(n), empty, values.dtype if len(values) else float)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = func.reduceat(values, (np.cumsum(n) - n)[some])
    return out


def _words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts, without the space mark that each starts with, and how many each text has."""
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    if not odd.any():
        lists = pc.split_pattern(texts, " ")
    else:
        split = [t.split(" ") if not o else [w[1:] for w in _WORDS.findall(SPACE + t.replace(" ", SPACE))] if t else [] for t, o in zip(texts.to_pylist(), odd.tolist())]
        lists = pa.array(split, pa.list_(pa.string()))
    return lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)


def rounds(texts: pa.StringArray, keys: np.ndarray, k: int, lat: Lattices, seed: int) -> tuple[list[dict], np.ndarray]:
    """For each text its k best segmentations by perturbed log-probability, best first, all distinct: one entry a
    rank, with the texts that have it (``docs``), their ``ids`` one behind another, how many each has (``n``),
    ``log_prob`` and ``value``; and each text's largest value left open.

    Best-first (A-star) search over the tree of segmentations, whose exact bound for a subtree is its largest
    perturbed log-probability: the root's is a standard Gumbel; the best path below a node keeps its parent's value, and every
    other subtree along that path has a Gumbel at its log-mass, cut off at that value. So a popped subtree needs
    one sampled path and one number for each place where it could have gone another way, all vectorised over the
    texts. The largest value left open after k pops is the threshold of the inclusion scores.
    """
    words, n_words = _words_of(texts)
    base = lat.nodes_of(words)
    word_end = np.cumsum(n_words)
    docs = len(texts)
    keys = keys.astype(np.uint64)
    out: list[dict] = []
    # each round's paths: ``edge``, its ``node`` and ``word``, and the logs of the chances ``before`` it, one text behind
    # another; and the open places (``free``) from ``branch`` on, where the path left an earlier one
    paths: list[dict] = []
    value = -np.log(-np.log(_uniform(seed, keys, 0, 2**40)))
    took = np.ones(docs, bool)
    for s in range(k + 1):
        if s:
            # the largest open subtree of each text, over the paths found so far
            best, where = np.full(docs, -np.inf), np.full((docs, 2), -1)
            for r, path in enumerate(paths):
                top = -np.logaddexp(-path["value"], -_segments(path["free"], path["open"], np.maximum, -np.inf))
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                for d in better.tolist():
                    a = path["open_at"][d]
                    where[d] = r, int(np.argmax(path["free"][a : a + path["open"][d]]))
            value, took = best, best > -np.inf
        if s == k:
            break
        # each path: a prefix of an earlier one, another edge at the branch, then sampled steps to the end
        taken = np.flatnonzero(took)
        chance = _uniform(seed, keys, s, 2**41)
        none = np.empty(0, np.int32)
        heads: dict[int, tuple] = {}
        begin, extra = np.zeros(docs, np.int64), np.full(docs, -1)
        for d in taken.tolist() if s else ():
            r, i = where[d].tolist()
            path = paths[r]
            path["free"][path["open_at"][d] + i] = -np.inf
            barred = path["barred"].get(d, set()) if i == 0 else set()  # the branch itself has ways barred before
            a = path["at"][d]
            i += a + path["branch"][d]
            barred = {int(path["edge"][i])} | barred
            node = int(path["node"][i])
            ways = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in barred]
            run = np.cumsum(lat.p[ways])
            u = float(chance[d]) * run[-1]
            edge = ways[min(int(np.searchsorted(run, u, "right")), len(ways) - 1)]
            heads[d] = (path["edge"][a:i], path["node"][a:i], path["word"][a:i], path["before"][a:i], float(path["before"][i]), edge, node, barred)
            begin[d] = path["word"][i]
            extra[d] = lat.to(np.array([node]), np.array([edge]))[0]
        if s == 0:
            starts, doc_of, word_of = base, np.repeat(np.arange(docs), n_words), np.arange(len(base)) - np.repeat(word_end - n_words, n_words)
        else:
            left = np.where(took, n_words - begin, 0)
            doc_of = np.repeat(np.arange(docs), left)
            word_of = np.arange(len(doc_of)) - np.repeat(np.cumsum(left) - left, left) + begin[doc_of]
            starts = base[(word_end - n_words)[doc_of] + word_of]
            cut = word_of == begin[doc_of]
            starts[cut] = extra[doc_of[cut]]
        drawn = _state(np.zeros(1, np.uint64), seed, keys, s)
        edges, nodes, count = lat.walk(starts, _state(drawn[doc_of], word_of))
        per_doc = np.bincount(np.repeat(doc_of, count), minlength=docs)
        edge_word = np.repeat(word_of.astype(np.int32), count)
        if s:  # the branch edge goes before each text's sampled steps
            spot = (np.cumsum(per_doc) - per_doc)[taken]
            edges, nodes, edge_word = (np.insert(x, spot, [v[d] if isinstance(v, np.ndarray) else heads[d][v] for d in taken.tolist()]) for x, v in ((edges, 5), (nodes, 6), (edge_word, begin)))
            per_doc = per_doc + took
        # from the branch on: chances, their running sum, and the mass of the other ways at each place
        owner = np.repeat(np.arange(docs), per_doc)
        at = np.cumsum(per_doc) - per_doc
        p = lat.p[edges]
        steps, before, total = np.log(p), np.empty(len(p)), np.zeros(docs)
        for d in np.flatnonzero(per_doc).tolist():  # each text's own sums, whatever its batch
            a, b = at[d], at[d] + per_doc[d]
            run = np.cumsum(np.append(heads[d][4] if s else 0.0, steps[a:b]))
            before[a:b], total[d] = run[:-1], run[-1]
        other, ways = 1 - p, lat.first[nodes + 1] - lat.first[nodes] - 1
        for d in taken.tolist() if s else ():
            other[at[d]] -= sum(float(lat.p[e]) for e in heads[d][7])
            ways[at[d]] -= len(heads[d][7])
        with np.errstate(divide="ignore"):
            mass = np.where(ways > 0, before + np.log(np.maximum(other, 1e-300)), -np.inf)
        head_n = np.zeros(docs, np.int64)
        for d, h in heads.items():
            head_n[d] = len(h[0])
        place = np.arange(len(edges)) - at[owner] + head_n[owner]
        # the Gumbels before they are cut off at the path's value, which keeps their order within the path
        free = mass - np.log(-np.log(_draw(_state(_state(drawn, 2**42)[owner], place))))
        if s:
            pieces = [[], [], [], []]
            for d in taken.tolist():
                tail = slice(at[d], at[d] + per_doc[d])
                for into, head, rest in zip(pieces, heads[d], (edges, nodes, edge_word, before)):
                    into += (head, rest[tail])
            edge, node, word, logs = (np.concatenate([none, *x]) if i < 3 else np.concatenate([np.empty(0), *x]) for i, x in enumerate(pieces))
        else:
            edge, node, word, logs = edges, nodes, edge_word, before
        n = per_doc + head_n
        paths.append({"edge": edge, "node": node, "word": word, "before": logs, "at": np.cumsum(n) - n, "free": free, "open": per_doc, "open_at": at, "value": value, "branch": head_n, "barred": {d: h[7] for d, h in heads.items()}})
        ids, n_ids = lat.tokens(edge)
        of_doc = np.cumsum(np.append(0, n_ids))[np.cumsum(np.append(0, n))]
        out.append({"docs": taken, "ids": ids, "n": np.diff(of_doc)[taken], "log_prob": total[taken], "value": value[taken]})
    return out, value


def _log_inclusion(log_prob: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The log of the chance that a perturbed log-probability beats the threshold; 0 if nothing was left open."""
    x = log_prob - threshold
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        out = np.where(x > -30, np.log(-np.expm1(-np.exp(np.minimum(x, 700.0)))), x)
    return np.where(np.isfinite(threshold), out, 0.0)


def sample(texts: list[str], keys: np.ndarray, k: int, lat: Lattices, seed: int) -> list[list[dict]]:
    """The results of :func:`rounds` by text: each one's segmentations with ids, log_prob, value and log_inclusion."""
    out: list[list[dict]] = [[] for _ in texts]
    got, threshold = rounds(pa.array(texts, pa.string()), keys, k, lat, seed)
    for s, r in enumerate(got):
        inclusion, ends = _log_inclusion(r["log_prob"], threshold[r["docs"]]), np.cumsum(r["n"])
        for i, d in enumerate(r["docs"].tolist()):
            out[d].append({"sample": s, "ids": r["ids"][ends[i] - r["n"][i] : ends[i]], "log_prob": float(r["log_prob"][i]), "value": float(r["value"][i]), "log_inclusion": float(inclusion[i])})
    return out


_SAMPLES = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())])
_SAMPLES_DDL = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"


def sample_segmentations(docs: DataFrame, path: str, k: int = 2, power: float = 0.5, seed: int = 1, decoded: bool = False) -> DataFrame:
    """``doc_id, sample, ids, log_prob, perturbed, log_inclusion``: k distinct segmentations of every whole text.

    Drawn without replacement from the lattice of all segmentations into the model's pieces, in falling order of
    perturbed log-probability; ``log_inclusion`` is the log of the chance that a segmentation of that probability
    beats the threshold (Horvitz-Thompson weights are its inverse). A text with fewer than k segmentations gives
    all it has. Everything is seeded by the row's doc_id (null: 0), so neither batches, partitions nor retries change
    it; equal rows of equal id give equal samples.

    With ``decoded``, another column of that name holds the text decoded from each row's ids, as :func:`decode_ids`
    gives it, but without sending the ids through a second Python worker.

    Null and empty texts have one segmentation, without ids. The lattice of a text is the chain of the lattices of
    its words (a run of space marks with what follows), since no piece crosses there. Other columns are ignored;
    an empty table stays empty. One narrow pass, no shuffle; texts are worked on in groups of CHUNK characters.
    """

    schema = _SAMPLES.append(pa.field("decoded", pa.string())) if decoded else _SAMPLES

    def run(batches):
        lat = lattices(path, power)
        try:
            for batch in batches:
                size = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(), dtype=np.int64)
                at = 0
                while at < batch.num_rows:
                    to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
                    ids = batch.column(0).slice(at, to - at)
                    got, threshold = rounds(batch.column(1).slice(at, to - at), np.array(ids.fill_null(0).to_numpy()), k, lat, seed)
                    for s, r in enumerate(got):
                        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(r["n"])).astype(np.int32)), pa.array(r["ids"].astype(np.int32)))
                        columns = [ids.take(pa.array(r["docs"])), pa.array(np.full(len(r["docs"]), s, np.int32)), lists]
                        columns += [pa.array(x) for x in (r["log_prob"], r["value"], _log_inclusion(r["log_prob"], threshold[r["docs"]]))]
                        if decoded:
                            columns.append(lat.decode_all(r["ids"], r["n"]))
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    at = to
        finally:
            lat.reset()  # a worker lives on after its task; the words' lattices needn't

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(handing_back(run), _SAMPLES_DDL + ", decoded string" * decoded)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``: the text of each row's ids (null and empty ids: empty text).

    It equals the encoded text, but for U+2581, the model's space mark, which reads as a space.
    """

    @F.pandas_udf("string")
    def text(ids):
        lat = lattices(path, 1.0)
        return ids.map(lambda x: "" if x is None else lat.decode(x.tolist()).decode("utf-8", "replace"))

    return rows.withColumn(text_col, text(F.col(ids_col)))
