"""SentencePiece sampling without replacement by perturbed A-star search.

A text's lattice has an arc for every vocabulary piece at every place. The file
holds merge ranks and no probabilities, so a piece of rank r (by score) weighs
-log(r + 1); a character outside the vocabulary becomes its byte pieces.
Backward sums give the mass of every suffix. The search keeps sets of partial
segmentations in a queue under Gumbel-perturbed log-probabilities: the first
segmentation is drawn along the lattice and takes the root's value; all that
leave it at some place stay in the queue as one entry, whose value is a Gumbel
of their mass below that of their parent. The entry that leaves the queue draws
its place by mass, goes on along the lattice from there with its value, and
puts back two entries: what else left the old segmentation, and what leaves the
new one behind that place. So segmentations come in falling perturbed value, an
exact sample without replacement, and the (k+1)-th value is the threshold from
which inclusion scores follow.

No piece spans a word start, so the lattice is a chain of words. A worker keeps
the lattices of words seen in flat arrays, with an alias table for each place,
and takes one step of all words of many texts at a time. Random numbers are
seeded by the row's key and counted by sample, word and step: what a row gets
does not depend on the rows beside it.

Edge cases: a null or empty text has one segmentation without pieces, with
inclusion 1; a text with fewer segmentations than asked gives all of them, with
inclusion 1; repeated rows give the same samples; keys may be null; an output
column whose name a key has gets an underscore before it.
"""

from __future__ import annotations

import heapq
import random
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, expm1, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.textstats import text_of
from loomgraph.plans.storage import fresh, table

MODEL, SAMPLES, SEED = "piece_bpe_32k.model", 4, 42
SPACE = "▁"
#: Arcs of lattices that a worker keeps; past it they are built anew.
CACHE_ARCS = 4_000_000
#: Characters sampled at a time, and words that take a step at once.
GROUP_CHARS, GROUP_WORDS = 300_000, 200_000
#: Bits of a code point in a key of the trie.
_CODE_BITS = 21
#: Bits of a place's number of arcs.
_WIDTH_BITS, _WIDTH = 8, 255

_STEP, _WORDS, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_FACTOR = np.uint64(6364136223846793005)
_S30, _S27, _S31, _S11 = (np.uint64(x) for x in (30, 27, 31, 11))


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


class _Flat:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: type):
        self.data, self.n = np.empty(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            held = self.data
            self.data = np.empty(max(end, 2 * len(held)), held.dtype)
            self.data[: self.n] = held[: self.n]
        self.data[self.n : end] = values
        self.n = end


class _Index(dict):
    """Numbers words as they come and lists those that are new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


def _aliases(shares: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Alias tables of places with ``width`` arcs each: what a slot keeps for itself, and the slot that has its rest."""
    keep, other = np.ones(len(shares)), np.zeros(len(shares), np.int64)
    first = width.cumsum() - width
    rows = np.flatnonzero(width > 1)
    rows = rows[np.argsort(-width[rows], kind="stable")]
    lo = 0
    while lo < len(rows):
        # Rows of one table have over half as many arcs as its first.
        hi = min(lo + GROUP_WORDS, int(np.searchsorted(-width[rows], -(width[rows[lo]] // 2))))
        part, lo = rows[lo:hi], hi
        w, at = width[part], first[part]
        slots = np.arange(int(w[0]))
        inside = slots < w[:, None]
        least = np.where(inside, shares[np.where(inside, at[:, None] + slots, 0)] * w[:, None], inf)
        most = np.where(inside, least, -inf)
        for turn in range(1, int(w[0])):
            n = int(np.searchsorted(-w, -turn))  # places of more arcs than turns so far
            r = np.arange(n)
            poor, rich = least[:n].argmin(1), most[:n].argmax(1)
            got, apart = least[r, poor], poor != rich
            keep[at[:n] + poor] = np.where(apart, got, 1.0)
            other[at[:n] + poor] = rich
            left = most[r, rich] - (1 - got)
            least[r, poor], most[r, poor] = inf, -inf
            r, rich, left = r[apart], rich[apart], left[apart]
            least[r, rich] = most[r, rich] = left
    return keep, other


def _below(loc: float, bound: float, u: float) -> float:
    """A Gumbel at ``loc`` below ``bound``, by the uniform number ``u``."""
    gap = loc - bound
    return loc - (log(exp(gap) - log(u)) if gap < 700 else gap)


class _Search:
    """The queue of one text: entries of segmentations that leave a known one."""

    def __init__(self, words: np.ndarray, key: int):
        self.words, self.key = words, key
        draw = random.Random(key).random
        self.uniform: Callable[[], float] = lambda: max(draw(), 1e-300)
        self.queue: list[tuple] = []
        self.count = 0
        self.found: list[tuple[float, float, np.ndarray]] = []
        #: Of the segmentation under way: value, arcs before the walk, place it left at, arcs not to take there.
        self.value, self.head, self.left_at, self.barred = -log(-log(self.uniform())), np.empty(0, np.int32), -1, ()

    def push(self, arcs: np.ndarray, masses: np.ndarray, barred: dict, below: float) -> None:
        total = float(masses.sum())
        if total > 0:
            self.count += 1
            heapq.heappush(self.queue, (-_below(log(total), below, self.uniform()), self.count, arcs, masses, barred))

    def leave(self, m: "PieceModel") -> tuple[int, int]:
        """Take the best entry and its place; gives the lattice place to go on from and the next word."""
        value, _, arcs, masses, barred = heapq.heappop(self.queue)
        cum = masses.cumsum()
        at = min(int(cum.searchsorted(self.uniform() * cum[-1], "right")), len(cum) - 1)
        while masses[at] <= 0:
            at -= 1
        masses[at] = 0.0
        self.push(arcs, masses, barred, -value)
        gone = barred.get(at, (int(arcs[at]),))
        open_, weight = m.siblings(int(arcs[at]), gone)
        u, c = self.uniform() * sum(weight), 0
        while c < len(open_) - 1 and u >= weight[c]:
            u -= weight[c]
            c += 1
        self.value, self.left_at, self.barred = -value, at, (*gone, open_[c])
        self.head = np.append(arcs[:at], np.int32(open_[c]))
        return int(m.next.data[open_[c]]), int((m.next.data[arcs[:at]] < 0).sum()) + 1

    def arrive(self, m: "PieceModel", tail: np.ndarray) -> None:
        """The walk has ended: note the segmentation, queue what leaves it."""
        arcs = np.concatenate([self.head, tail]) if len(self.head) else tail
        share = m.share.data[arcs]
        so_far = share.cumsum()
        seen = int((-so_far).searchsorted(745.0)) + 1  # places after these have no mass in double precision
        share = share[: max(seen, self.left_at + 1)]
        before = so_far[: len(share)] - share
        masses = np.exp(before) * -np.expm1(share)
        barred = {}
        if self.left_at >= 0:
            masses[: self.left_at] = 0.0
            masses[self.left_at] = exp(before[self.left_at]) * sum(m.siblings(int(arcs[self.left_at]), self.barred)[1])
            barred[self.left_at] = self.barred
        self.found.append((self.value, float(so_far[-1]) if len(arcs) else 0.0, arcs))
        self.push(arcs, masses, barred, self.value)


@lru_cache(maxsize=4)
def model(name: str) -> "PieceModel":
    return PieceModel(name)


class PieceModel:
    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = sp.get_piece_size()
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        usual.sort(key=lambda i: (-sp.get_score(i), i))
        pieces = {sp.id_to_piece(i): (i, -log(r + 1)) for r, i in enumerate(usual, 1)}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans a word start")
        self._number(pieces)
        #: What no longer piece holds stands alone.
        joined = "".join(map(re.escape, sorted({c for p in pieces if len(p) > 1 for c in p} - {SPACE})))
        self.cut = re.compile(f"{SPACE}+[{joined}]*|[{joined}]+|[^{SPACE}{joined}]").findall
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_cost = -log(len(usual) + 2)
        self.unknown = sp.unk_id()
        self.text = np.empty(n, object)
        for i in range(n):
            self.text[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
            if sp.is_control(i):
                self.text[i] = b""
        self.text[self.unknown] = sp.decode([self.unknown]).encode()
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        #: The model puts a space before a text, which decoding takes away.
        self.prefix = sp.normalize("a").startswith(SPACE)
        self._clear()

    def _number(self, pieces: dict[str, tuple[int, float]]) -> None:
        """A trie as a hash table: the state before and a letter give a slot with the state after."""
        held: list[tuple[int, str]] = []
        level = {"": 0}
        prefixes = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        for n in range(1, max(map(len, pieces)) + 1):
            now = sorted((level[p[:-1]] << _CODE_BITS | ord(p[-1]), p) for p in prefixes if len(p) == n)
            level = {p: len(held) + i for i, (_, p) in enumerate(now, 1)}
            held += now
        bits = len(held).bit_length() + 3
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_state = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        places = ((np.array([k for k, _ in held], np.uint64) * _STEP) >> self.shift).tolist()
        for state, ((k, _), at) in enumerate(zip(held, places), 1):
            while self.slot_key[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            self.slot_key[at], self.slot_state[at] = k, state
        self.piece_id = np.array([-1, *(pieces.get(p, (-1,))[0] for _, p in held)], np.int64)
        self.piece_weight = np.array([0.0, *(pieces[p][1] if p in pieces else 0.0 for _, p in held)])

    def _step(self, key: np.ndarray) -> np.ndarray:
        """The states that keys lead to, 0 for none."""
        at = ((key.astype(np.uint64) * _STEP) >> self.shift).astype(np.int64)
        held = self.slot_key[at]
        state = np.where(held == key, self.slot_state[at], 0)
        lost = np.flatnonzero((held != key) & (held >= 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & (len(self.slot_key) - 1)
            held = self.slot_key[at[lost]]
            state[lost] = np.where(held == key[lost], self.slot_state[at[lost]], 0)
            lost = lost[(held != key[lost]) & (held >= 0)]
        return state

    def _clear(self) -> None:
        self.index = _Index()
        # of words: first place
        self.start = _Flat(np.int64)
        # of places: first arc and number of arcs in one number
        self.link = _Flat(np.int64)
        # of arcs: alias table, place after it (-1: word end) and its link (0), own place, log-share, first id and number of ids
        self.after = _Flat(np.int64)
        self.keep, self.alias, self.next, self.home, self.share = _Flat(np.float64), _Flat(np.int32), _Flat(np.int32), _Flat(np.int32), _Flat(np.float64)
        self.id_first, self.id_size, self.ids = _Flat(np.int32), _Flat(np.int32), _Flat(np.int32)
        self.ids.extend(np.arange(len(self.text)))
        self.spelt: dict[int, tuple[int, int]] = {}

    def lattice(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """The arcs at each place of a word: end, ids, log of the share of the place's mass."""
        place, places = int(self.words([word], normal=False)[0][0]), []
        while place >= 0:  # the first arc of a place is one letter long
            places.append(place)
            place = int(self.next.data[self.link.data[place] >> _WIDTH_BITS])
        number = {-1: len(word)} | {p: i for i, p in enumerate(places)}
        out = []
        for p in places:
            arcs, _ = self.siblings(int(self.link.data[p] >> _WIDTH_BITS), ())
            out.append([(number[int(self.next.data[a])], tuple(self.ids_of(np.array([a])).tolist()), float(self.share.data[a])) for a in arcs])
        return out

    def _spelt(self, code: int) -> tuple[int, int]:
        """Where the ids of a character outside the vocabulary are, and how many."""
        if code not in self.spelt:
            ids = [self.bytes[b] for b in chr(code).encode("utf-8", "replace")] if self.bytes else [self.unknown]
            self.spelt[code] = (ids[0] if len(ids) == 1 else self.ids.n, len(ids))
            if len(ids) > 1:
                self.ids.extend(np.array(ids))
        return self.spelt[code]

    def _learn(self, words: list[str]) -> None:
        """Append the lattices of words: one letter further along the pieces for all places at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        n, base = len(code), self.link.n
        start = lengths.cumsum() - lengths
        dist = np.repeat(start + lengths, lengths) - np.arange(n)
        # Places are numbered by their distance from the ends of their words.
        order = np.argsort(dist.astype(np.int16) if lengths.max() < 1 << 15 else dist, kind="stable")
        number = np.full(n + 1, -1)
        number[order] = np.arange(n)
        widths = np.zeros(n, np.int64)
        found = []

        def arcs_found(at: np.ndarray, span: int, weight: np.ndarray, first: np.ndarray, size: np.ndarray | int) -> None:
            home = number[at]
            found.append((home, widths[home], np.where(dist[at] > span, number[at + span], -1), weight, first, size))
            widths[home] += 1

        at, state, span = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            state = self._step((state << _CODE_BITS) | code[at + span])
            hit = state > 0
            at, state, span = at[hit], state[hit], span + 1
            ids = self.piece_id[state]
            full = ids >= 0
            arcs_found(at[full], span, self.piece_weight[state[full]], ids[full], 1)
            if span == 1:
                others = np.flatnonzero(widths[number[:n]] == 0)
                letters, which = np.unique(code[others], return_inverse=True)
                spelt = np.array([self._spelt(int(c)) for c in letters], np.int64).reshape(-1, 2)[which]
                arcs_found(others, 1, self.byte_cost * spelt[:, 1], spelt[:, 0], spelt[:, 1])
            on = dist[at] > span
            at, state = at[on], state[on]
        first = widths.cumsum() - widths
        total = int(widths.sum())
        nexts, weights, first_id, sizes = np.empty(total, np.int64), np.empty(total), np.empty(total, np.int64), np.empty(total, np.int64)
        for home, rank, *values in found:
            to = first[home] + rank
            nexts[to], weights[to], first_id[to], sizes[to] = values
        # Backward sums, over all places that are equally far from the ends of their words at once.
        mass, share = np.zeros(n + 1), np.zeros(total)
        cuts = np.concatenate([[0], np.bincount(dist)[1:].cumsum()])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            w, at = widths[lo:hi], first[lo:hi]
            arcs = slice(int(at[0]), int(at[-1] + w[-1]))
            terms = weights[arcs] + mass[nexts[arcs]]
            top = np.maximum.reduceat(terms, at - at[0])
            mass[lo:hi] = top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, w)), at - at[0]))
            share[arcs] = np.where(np.repeat(w, w) > 1, np.minimum(terms - np.repeat(mass[lo:hi], w), 0.0), 0.0)
        keep, other = _aliases(np.exp(share), widths)
        first += self.keep.n
        link = np.append(first << _WIDTH_BITS | widths, 0)
        home = np.repeat(np.arange(n), widths)
        for to, new in (
            (self.start, number[start] + base), (self.link, link[:-1]), (self.after, link[nexts]), (self.keep, keep), (self.alias, first[home] + other),
            (self.next, np.where(nexts < 0, -1, nexts + base)), (self.home, home + base), (self.share, share),
            (self.id_first, first_id), (self.id_size, sizes),
        ):
            to.extend(new)

    def siblings(self, arc: int, gone: tuple[int, ...]) -> tuple[list[int], list[float]]:
        """The arcs at ``arc``'s place that are not in ``gone``, and their shares."""
        link = int(self.link.data[self.home.data[arc]])
        lo = link >> _WIDTH_BITS
        open_ = [a for a in range(lo, lo + (link & _WIDTH)) if a not in gone]
        return open_, [exp(self.share.data[a]) for a in open_]

    def normal(self, text: str) -> str:
        return self.sp.normalize(text)

    def words(self, texts: list[str], normal: bool = True) -> list[np.ndarray]:
        """The first places of the words of each text."""
        if self.keep.n > CACHE_ARCS:
            self._clear()
        numbers = [list(map(self.index.__getitem__, self.cut(self.normal(t) if normal else t))) for t in texts]
        if self.index.new:
            self._learn(self.index.new)
            self.index.new = []
        return [self.start.data[np.array(w, np.int64)] for w in numbers]

    def walk(self, at: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs drawn from the places ``at`` to the ends of their words, and how many each."""
        if len(at) > GROUP_WORDS:
            parts = [self.walk(at[i : i + GROUP_WORDS], seeds[i : i + GROUP_WORDS]) for i in range(0, len(at), GROUP_WORDS)]
            return np.concatenate([a for a, _ in parts]), np.concatenate([n for _, n in parts])
        counts, taken = np.zeros(len(at), np.int64), []
        who = np.flatnonzero(at >= 0)
        at, seeds = self.link.data[at[who]], seeds[who]
        while len(who):
            seeds = seeds * _FACTOR + _STEP  # a linear congruential generator a word, from a mixed seed
            x = (seeds >> _S11).astype(np.float64)
            x *= 2.0**-53
            x *= at & _WIDTH
            slot = x.astype(np.int64)
            arc = (at >> _WIDTH_BITS) + slot
            arc = np.where(x - slot < self.keep.data[arc], arc, self.alias.data[arc])
            taken.append((who, arc))
            counts[who] += 1
            at = self.after.data[arc]
            on = np.flatnonzero(at)
            who, at, seeds = who[on], at[on], seeds[on]
        starts = counts.cumsum() - counts
        out = np.empty(int(counts.sum()), np.int32)
        for step, (who, arc) in enumerate(taken):
            out[starts[who] + step] = arc
        return out, counts

    def _advance(self, searches: list[_Search], goes: list[tuple[int, int]], turn: int) -> None:
        """Walk every search from its (place, next word) to the end of its text."""
        at, seeds = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        ends = [0]
        keys = _mixed(np.array([s.key for s in searches], np.uint64) + np.array([turn + 1], np.uint64) * _STEP)
        for s, key, (place, word) in zip(searches, keys, goes):
            at += [np.array([place]), s.words[word:]]
            numbers = np.arange(word, len(s.words) + 1, dtype=np.uint64)
            seeds.append(_mixed(key + numbers * _WORDS))
            ends.append(ends[-1] + len(numbers))
        arcs, counts = self.walk(np.concatenate(at), np.concatenate(seeds))
        cut = np.concatenate([[0], counts.cumsum()])[ends]
        for i, s in enumerate(searches):
            s.arrive(self, arcs[cut[i] : cut[i + 1]])

    def sample_all(self, texts: list[str], k: int, keys: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k distinct (ids, log-probability, perturbed value, inclusion score)."""
        searches = [_Search(w, key & 0xFFFFFFFFFFFFFFFF) for w, key in zip(self.words(texts), keys)]
        if searches and k > 0:
            self._advance(searches, [(-1, 0)] * len(searches), 0)
        for turn in range(1, k):
            on = [s for s in searches if s.queue]
            if on:
                self._advance(on, [s.leave(self) for s in on], turn)
        out = []
        for s in searches:
            bound = -s.queue[0][0] if s.queue else -inf
            out.append([(self.ids_of(arcs), p, value, 1.0 if bound == -inf else -expm1(-exp(min(p - bound, 700.0)))) for value, p, arcs in s.found])
        return out

    def sample(self, text: str, k: int, key: int) -> list[tuple[list[int], float, float, float]]:
        return [(ids.tolist(), p, value, inclusion) for ids, p, value, inclusion in self.sample_all([text], k, [key])[0]]

    def ids_of(self, arcs: np.ndarray) -> np.ndarray:
        first = self.id_first.data[arcs]
        if not len(arcs) or first.max() < len(self.text):
            return first  # one id each
        sizes = self.id_size.data[arcs]
        ends = sizes.cumsum()
        return self.ids.data[np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the pieces, in UTF-8."""
        text = b"".join(self.text[ids].tolist())
        return text[1:] if self.prefix and text.startswith(b" ") else text


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, chars = 0, 0
    for i, t in enumerate(texts):
        if i > first and chars + len(t) > GROUP_CHARS:
            yield first, i
            first, chars = i, 0
        chars += len(t)
    if texts:
        yield first, len(texts)


def sample_pieces(df: DataFrame, keys: list[str], text: str, k: int = SAMPLES, seed: int = SEED, name: str = MODEL, digests: bool = False) -> DataFrame:
    """A row per sampled segmentation: keys, sample (from 1), log_prob, perturbed, inclusion, ids, decoded.

    ``digests``: n_pieces, ids_crc32 (of little-endian 32-bit ids) and
    decoded_crc32 (of UTF-8) take the place of ids and decoded, so that the
    samples themselves need not leave the worker.
    """
    own = df.select(*keys)
    results = [("sample", "int"), ("log_prob", "double"), ("perturbed", "double"), ("inclusion", "double")]
    results += [("n_pieces", "int"), ("ids_crc32", "bigint"), ("decoded_crc32", "bigint")] if digests else [("ids", "array<int>"), ("decoded", "string")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), *(f"`{fresh(c, own)}` {t}" for c, t in results)])
    names = [*own.columns, *(fresh(c, own) for c, _ in results)]
    width = len(own.columns)

    def rows(m: PieceModel, b: pa.RecordBatch, texts: list[str], hashes: list[int]) -> pa.RecordBatch:
        at, sample, log_prob, perturbed, inclusion, ids, decoded = ([] for _ in range(7))
        for r, found in enumerate(m.sample_all(texts, k, hashes)):
            for i, (own_ids, p, value, score) in enumerate(found, 1):
                at.append(r)
                sample.append(i)
                log_prob.append(p)
                perturbed.append(value)
                inclusion.append(score)
                ids.append(own_ids)
                decoded.append(m.decode(own_ids))
        columns = [pa.array(sample, pa.int32()), pa.array(log_prob, pa.float64()), pa.array(perturbed, pa.float64()), pa.array(inclusion, pa.float64())]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        if digests:
            columns += [pa.array(sizes), pa.array([zlib.crc32(x.astype("<u4", copy=False).data) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in decoded], pa.int64())]
        else:
            ends = np.concatenate([[0], sizes.cumsum()]).astype(np.int32)
            columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids]))), pa.array(decoded, pa.binary()).cast(pa.string())]
        taken = [c.take(pa.array(at, pa.int64())) for c in b.columns[:width]]
        return pa.RecordBatch.from_arrays([*taken, *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for b in batches:
            texts, hashes = b.column(width + 1).to_pylist(), b.column(width).to_pylist()
            for first, last in _groups(texts):
                yield rows(m, b.slice(first, last - first), texts[first:last], hashes[first:last])

    columns = [F.col(f"`{c}`") for c in own.columns]
    return df.select(*columns, F.xxhash64(F.lit(seed), *columns).alias(fresh("_hash", own)), text_of(text).alias(fresh("_text", own))).mapInArrow(run, schema)


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every text of ``documents`` (by doc_id) and every turn of ``conversations`` (by conv_id and turn)."""
    docs = sample_pieces(table(spark, sf_dir, "documents"), ["doc_id"], "text", digests=True)
    turns = sample_pieces(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", digests=True)
    found = docs.unionByName(turns, allowMissingColumns=True)
    return found.select("doc_id", "conv_id", "turn", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", "decoded_crc32")
