"""SentencePiece encoding and decoding (operator 4): sampled segmentations without replacement.

All ways to write a text in pieces form a lattice.  A segmentation has the
probability of its pieces' product; pieces get Zipf probabilities by their rank
in the model.  Space marks, and characters that no piece has, cut the lattice
of a text into units; a forward pass over the distinct units of many texts
gives exact masses, and with them the choice at each place.  A place has about
two pieces that end there, so the lattice holds these alone, place by place.

The k segmentations with the greatest Gumbel-perturbed log-probabilities are a
sample without replacement.  They are found by a best-first (A*) search over
sets of segmentations: a set is bounded by the greatest perturbed value in it,
drawn from its exact mass, so the first k taken are the k best.  Taking one
splits its set by where the others leave its path.  The next bound is the
threshold from which inclusion scores follow.  All randomness is a hash of the
row's key.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import textkit as K
from strataline.llm.shared import table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
_MARK = 0x2581  # the model's space mark
_LITERAL = 0x110001  # stands for a space mark that the text itself has
_LATTICE_BYTES = 1 << 21  # texts whose distinct units share one lattice
_WALK_BYTES = 1 << 19  # of these, the texts that are sampled together
_NONE, _BYTES = 65535, 65534
_U64 = 0xFFFFFFFFFFFFFFFF
_LONG = 2_048  # a unit of more characters is taken in lanes of so many, all lanes together
_MATCHED = 1 << 17  # places whose pieces are looked up together
_NEARLY_ONE = -1e-6  # log-probability of steps above which the rest is summed from its own terms


class PieceModel:
    """Pieces, their log-probabilities and bytes, read from a SentencePiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        ids = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = np.array([min(-sp.get_score(i), n) if sp.get_score(i) < 0 else n for i in range(n)], float)
        self.logp = -np.log(rank + 1) - np.log((1 / (rank + 1)).sum())
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.step_logp = np.full(1 << 16, -np.inf)
        self.step_logp[:n] = self.logp.astype(np.float32)
        self.step_logp[_BYTES] = 0.0  # a character in bytes is a unit of one way
        self.bytes_of = [names[i].replace(chr(_MARK), " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([b])
        self.byte_at = np.concatenate([[0], np.cumsum([len(x) for x in self.bytes_of])])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.longest = max(len(names[i]) for i in ids)
        # every suffix of a piece, read from its end, so that a search stops where no piece goes on
        of = {names[i][::-1]: i for i in ids}
        suffixes = sorted({x[:k] for x in of for k in range(1, len(x) + 1)})
        points = np.frombuffer("".join(suffixes).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in suffixes])
        starts = np.concatenate([[0], ends[:-1]])
        key = np.zeros(len(suffixes), np.uint64)
        for k in range(self.longest):
            on = np.flatnonzero(starts + k < ends)
            key[on] = _longer(key[on], K.mix(points[starts[on] + k].astype(np.uint64)))
        self.table = K.HashTable(key)
        self.piece_of = np.array([of.get(x, _NONE) for x in suffixes], np.uint16)
        single = np.zeros(0x110002, bool)
        single[[ord(names[i]) for i in ids if len(names[i]) == 1]] = True
        self.single = single

    def decode(self, ids) -> str:
        """The text of pieces; the space that encoding puts first is taken away."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        return raw[1:].decode("utf-8", "replace")

    def spelt(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many pieces, and where the bytes of each run ids[.. ends[k]] end."""
        size = self.byte_at[ids + 1] - self.byte_at[ids]
        stop = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.byte_at[ids] - stop[:-1], size) + np.arange(stop[-1])
        return self.all_bytes[at], stop[ends]


def _longer(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Keys of strings with one more character."""
    return key * np.uint64(0x9E3779B97F4A7C15) + code


class Lattice:
    """The units of many texts, with the choice probabilities at each place of the distinct ones."""

    def __init__(self, model: PieceModel, texts: list[str]):
        self.model = model
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        self.points = points = np.frombuffer("".join("▁" + t.replace("▁", "\U0010ffff").replace(" ", "▁") for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        if len(points):
            self._restore_literals(texts, sizes)
        bounds = np.r_[0, np.cumsum(sizes)]
        n = len(points)
        known = model.single[points]
        start = np.zeros(n + 1, bool)
        start[bounds] = True
        if n:
            mark = points == _MARK
            start[1:n] |= mark[1:] & ~mark[:-1]
            start[:n] |= ~known
            start[1 : n + 1] |= ~known
        at = np.flatnonzero(start)
        self.first, self.size = at[:-1], np.diff(at)
        self.owner = np.searchsorted(bounds, self.first, side="right") - 1
        self.codes = K.mix(points.astype(np.uint64))
        names = K.span_hash(K.prefix_sums(self.codes), self.first, self.first + self.size)
        _, which, row = np.unique(names, return_index=True, return_inverse=True)
        order = np.argsort(-self.size[which], kind="stable")  # the longest first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.row = place[row] if len(row) else row
        self._forward(self.first[which][order], self.size[which][order], known)
        del self.codes

    def _restore_literals(self, texts: list[str], sizes: np.ndarray) -> None:
        at = 0
        for t, size in zip(texts, sizes.tolist()):
            if t and ("▁" in t or "\U0010ffff" in t):
                raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                self.points[at + 1 + np.flatnonzero(raw == _MARK)] = _LITERAL
            at += size

    def _forward(self, first: np.ndarray, size: np.ndarray, known: np.ndarray) -> None:
        """Entries, masses and shares of the distinct units, the longest of which come first.

        States (places of distinct units) are numbered unit by unit for units of
        more than _LONG characters, and behind these by their distance from the
        unit's start, then by unit.  An entry is a piece that ends at a state;
        those of a state lie together, the shortest first.
        """
        self.long = long_ = int(np.searchsorted(-size, -_LONG))
        self.base = np.concatenate([[0], np.cumsum(size[:long_] + 1)])
        short = size[long_:]
        counts = np.searchsorted(-short, -np.arange(int(short.max(initial=-1)) + 1), side="right")
        self.level = level = self.base[-1] + np.concatenate([[0], np.cumsum(counts)])
        states = int(level[-1])
        self.entry = np.zeros(states + 1, np.int64)  # the first entry of each state
        found = []
        for unit in range(long_):
            for lo in range(1, int(size[unit]) + 1, _MATCHED):
                place = np.arange(lo, min(int(size[unit]) + 1, lo + _MATCHED))
                found.append(self._match(int(self.base[unit]) + lo, first[unit] + place - 1, place, known))
        for lo in range(int(level[1]) if len(short) else states, states, _MATCHED):
            state = np.arange(lo, min(states, lo + _MATCHED))
            place = np.searchsorted(level, state, side="right") - 1
            found.append(self._match(lo, first[state - level[place] + long_] + place - 1, place, known))
        self.piece, self.length = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.uint16)] * 2
        del found
        np.cumsum(self.entry, out=self.entry)
        self.mass = np.zeros(states)
        self.choice = np.empty(len(self.piece), np.float32)
        for unit in range(long_):
            self._forward_long(int(self.base[unit]), int(size[unit]))
        held, since = [], int(level[1]) if len(short) else states
        for e in range(1, len(level) - 1):
            held.append(self._settle(e))
            if e == len(level) - 2 or self.entry[level[e + 1]] - self.entry[since] >= _MATCHED:
                self._share(since, int(level[e + 1]), np.concatenate(held))
                held, since = [], int(level[e + 1])

    def _match(self, state: int, at: np.ndarray, place: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces, and their lengths, that end with characters `at`, the last before places `place` of units; their states follow one another from `state`."""
        model = self.model
        ending = np.full((len(at), model.longest), _NONE, np.uint16)
        whole = known[at]
        live = np.flatnonzero(whole)
        key = np.zeros(len(live), np.uint64)
        for k in range(model.longest):
            key = _longer(key, self.codes[at[live] - k])
            found = model.table.find(key)
            on = np.flatnonzero(found >= 0)
            live, key = live[on], key[on]
            ending[live, k] = model.piece_of[found[on]]
            on = np.flatnonzero(place[live] > k + 1)
            live, key = live[on], key[on]
            if not len(live):
                break
        ending[np.flatnonzero(~whole), 0] = _BYTES
        ending = ending.ravel()
        flat = np.flatnonzero(ending != _NONE)
        row = flat // model.longest
        self.entry[state + 1 : state + 1 + len(at)] = np.bincount(row, minlength=len(at))
        return ending[flat], (flat - row * model.longest + 1).astype(np.min_scalar_type(model.longest))

    def _settle(self, e: int) -> np.ndarray:
        """Masses of the states at distance `e`, when those before are known; the weights of their entries."""
        lo, hi = self.level[e], self.level[e + 1]
        part = slice(self.entry[lo], self.entry[hi])
        at = self.entry[lo:hi] - self.entry[lo]
        unit = np.repeat(np.arange(hi - lo), np.diff(self.entry[lo : hi + 1]))
        before = self.level[np.maximum(e - np.arange(self.model.longest + 1), 0)]
        logs = self.model.step_logp[self.piece[part]] + self.mass[before[self.length[part]] + unit]
        top = np.maximum.reduceat(logs, at)
        logs -= top[unit]
        p = np.exp(logs, out=logs)
        self.mass[lo:hi] = top + np.log(np.add.reduceat(p, at))
        return p

    def _share(self, lo: int, hi: int, p: np.ndarray) -> None:
        """Rising shares, up to one, of the entries of states [lo, hi), from their weights."""
        at, left = self.entry[lo:hi] - self.entry[lo], np.diff(self.entry[lo : hi + 1])
        last, sizes = at + left - 1, left
        while True:
            on = np.flatnonzero(left > 1)
            if not len(on):
                break
            at, left = at[on] + 1, left[on] - 1
            p[at] += p[at - 1]
        self.choice[self.entry[lo] : self.entry[hi]] = p / np.repeat(p[last], sizes)

    def _forward_long(self, base: int, size: int) -> None:
        """The forward pass of one long unit, cut into lanes that advance together.

        Each lane first finds how the masses at its end follow from those of the
        `longest` places at its start; one scan over the lanes gives the masses at
        all starts, and with them the lanes are run once more.
        """
        longest = self.model.longest
        lanes = -(-size // _LONG)
        step = np.full((lanes * _LONG, longest), -np.inf, np.float32)
        for lo, hi in _stretches(1, size + 1):
            part = slice(self.entry[base + lo], self.entry[base + hi])
            place = np.repeat(np.arange(lo, hi), np.diff(self.entry[base + lo : base + hi + 1]))
            step[place - 1, self.length[part] - 1] = self.model.step_logp[self.piece[part]]
        step = step.reshape(lanes, _LONG, longest)
        window = np.broadcast_to(np.eye(longest), (lanes, longest, longest)).copy()  # lane, start place, place behind
        scale = np.zeros((lanes, longest))
        full = lanes - 1  # the last lane has no follower
        for t in range(_LONG if full else 0):
            new = np.einsum("nk,njk->nj", np.exp(step[:full, t].astype(np.float64)), window[:full])
            window[:full, :, 1:] = window[:full, :, :-1].copy()
            window[:full, :, 0] = new
            if t % 8 == 7:
                top = window[:full].max(axis=2)
                top[top == 0] = 1
                window[:full] /= top[:, :, None]
                scale[:full] += np.log(top)
        behind = np.full((lanes, longest), -np.inf)
        behind[0, 0] = 0
        with np.errstate(divide="ignore"):
            for k in range(full):
                behind[k + 1] = np.logaddexp.reduce((behind[k] + scale[k])[:, None] + np.log(window[k]), axis=0)
        masses = np.full((lanes, _LONG + longest), -np.inf)
        masses[:, longest - 1 :: -1] = behind
        for t in range(_LONG):
            part = step[:, t] + masses[:, t : t + longest][:, ::-1]
            top = part.max(axis=1)
            top[np.isneginf(top)] = 0
            with np.errstate(divide="ignore"):
                masses[:, t + longest] = top + np.log(np.exp(part - top[:, None]).sum(axis=1))
        self.mass[base + 1 : base + size + 1] = masses[:, longest:].ravel()[:size]
        for lo, hi in _stretches(1, size + 1):
            part = slice(self.entry[base + lo], self.entry[base + hi])
            state = np.repeat(np.arange(base + lo, base + hi), np.diff(self.entry[base + lo : base + hi + 1]))
            self._share(base + lo, base + hi, np.exp(self.model.step_logp[self.piece[part]] + self.mass[state - self.length[part]] - self.mass[state]))

    def state(self, unit: int, place: int) -> int:
        """The state of a place of a unit."""
        row = int(self.row[unit])
        return int(self.base[row]) + place if row < self.long else int(self.level[place]) + row - self.long

    def state_logs(self, unit: int, place: int) -> tuple[int, np.ndarray]:
        """The first entry of a place and the log-probabilities of all its entries, from the masses themselves."""
        state = self.state(unit, place)
        part = slice(int(self.entry[state]), int(self.entry[state + 1]))
        if self.piece[part.start] == _BYTES:
            return part.start, np.zeros(1)
        length, row = self.length[part].astype(np.int64), int(self.row[unit])
        before = state - length if row < self.long else self.level[place - length] + row - self.long
        return part.start, self.model.step_logp[self.piece[part]] + self.mass[before] - self.mass[state]

    def walk(self, lane: np.ndarray, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled paths from place `at` of units `lane` to their starts: (lane, place, entry, log p), lane by lane."""
        row = self.row[lane]
        steps = np.zeros(len(lane), np.int64)
        found = []  # of each turn: the lanes, their steps so far, the places, entries and log-probabilities
        for k in np.flatnonzero(row < self.long).tolist():
            place, entry, logs = self._walk_long(int(self.base[row[k]]), int(at[k]), seed[k])
            steps[k] = len(place)
            found.append((np.full(len(place), k), np.arange(len(place)), place, entry, logs))
        here = np.flatnonzero((row >= self.long) & (at > 0))
        place, row, seed = at[here], row[here] - self.long, seed[here]
        state = self.level[place] + row
        mass, turn = self.mass[state], 0
        few = place.max(initial=0) < len(_PLACES)
        while len(here):
            entry = self._draw(state, _uniform(seed ^ (_PLACES[place] if few else _place_noise(place))))
            left = place - self.length[entry]
            state = self.level[left] + row
            before = self.mass[state]
            found.append((here, turn, place, entry, self._step_logs(entry, before, mass)))
            turn += 1
            on = np.flatnonzero(left > 0)
            steps[here[left == 0]] = turn
            here, place, row, seed, state, mass = here[on], left[on], row[on], seed[on], state[on], before[on]
        stop = np.cumsum(steps)
        total = int(stop[-1]) if len(stop) else 0
        places, entries, logs = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
        begin = stop - steps
        for lanes, turn, *values in found:
            to = begin[lanes] + turn
            places[to], entries[to], logs[to] = values
        return np.repeat(lane, steps), places, entries, logs

    def _draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The first entry of each state whose share is above u; shares rise to one, and u is below it."""
        entry = self.entry[state]
        more = np.flatnonzero(self.choice[entry] <= u)
        while len(more):
            at = entry[more] + 1
            entry[more] = at
            more = more[self.choice[at] <= u[more]]
        return entry

    def _step_logs(self, entry: np.ndarray, before: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Log-probabilities of entries, from the masses of the places where they start and end."""
        piece = self.piece[entry]
        out = self.model.step_logp[piece]
        out += before
        out -= mass
        return np.minimum(out, 0.0, out=out)

    def _walk_long(self, floor: int, at: int, seed: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same walk through one long unit: the draws of all its places at once, then the places met."""
        drawn = np.zeros(at + 1, np.int64)
        for lo, hi in _stretches(1, at + 1):
            place = np.arange(lo, hi)
            drawn[lo:hi] = self._draw(floor + place, _uniform(seed ^ _place_noise(place)))
        back, met = self.length[drawn].tolist(), []
        while at > 0:
            met.append(at)
            at -= back[at]
        place = np.array(met, np.int64)
        entry = drawn[place]
        return place, entry, self._step_logs(entry, self.mass[floor + place - self.length[entry]], self.mass[floor + place])


def _stretches(first: int, last: int):
    """Cuts of the range [first, last)."""
    return ((lo, min(last, lo + (1 << 16))) for lo in range(first, last, 1 << 16))


def _place_noise(place: np.ndarray) -> np.ndarray:
    return K.mix(place.astype(np.uint64) + np.uint64(0x51ED27))


_PLACES = _place_noise(np.arange(_LONG + 1))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (K.mix(h) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Path:
    """One segmentation of a text: its steps unit by unit, each unit from its end."""

    __slots__ = ("lane", "place", "entry", "logs", "before")

    def __init__(self, lane, place, entry, logs):
        self.lane, self.place, self.entry, self.logs = lane, place, entry, logs
        self.before = np.zeros(len(logs) + 1)
        np.cumsum(logs, out=self.before[1:])


def _gumbel(u: float) -> float:
    return -math.log(-math.log(max(u, 1e-300)))


class Search:
    """Best-first search over the segmentations of one text."""

    __slots__ = ("seed", "draws", "heap", "best")

    def __init__(self, seed: int):
        self.seed, self.draws, self.heap, self.best = seed, 0, [], []

    def uniform(self) -> float:
        self.draws += 1
        h = (self.seed ^ (self.draws * 0x9E3779B97F4A7C15)) & _U64
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _U64
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _U64
        return ((h ^ (h >> 31)) >> 11) * 2.0**-53

    def put(self, bound: float, log_mass: float, node: tuple) -> None:
        """A set of segmentations with the greatest perturbed value in it, at most `bound`."""
        a, b = -bound, -(log_mass + _gumbel(self.uniform()))
        value = -(max(a, b) + math.log1p(math.exp(-abs(a - b))))
        heapq.heappush(self.heap, (-value, self.draws, node))

    def open_range(self, lattice: Lattice, bound: float, path: Path, a: int, b: int) -> None:
        """Segmentations that leave `path` first at a step in [a, b)."""
        if a < b:
            gone = float(path.before[b] - path.before[a])
            mass = float(path.before[a]) + math.log(-math.expm1(gone)) if gone < _NEARLY_ONE else _log_sum(self.leaving(lattice, path, a, b))
            if mass > -math.inf:
                self.put(bound, mass, ("range", path, a, b))

    def leaving(self, lattice: Lattice, path: Path, a: int, b: int) -> np.ndarray:
        """Log-mass of the segmentations that leave `path` at each step of [a, b), from the terms of the other entries."""
        out = np.empty(b - a)
        for t in range(a, b):
            first, logs = lattice.state_logs(int(path.lane[t]), int(path.place[t]))
            logs[int(path.entry[t]) - first] = -np.inf
            out[t - a] = _log_sum(logs)
        return out + path.before[a] + np.concatenate([[0.0], np.cumsum(path.logs[a : b - 1])])

    def open_step(self, lattice: Lattice, bound: float, path: Path, t: int, without: tuple) -> None:
        """Segmentations that leave `path` at step t by an entry not in `without`, which counts from the place's first."""
        _, logs = lattice.state_logs(int(path.lane[t]), int(path.place[t]))
        logs[list(without)] = -np.inf
        rest = _log_sum(logs)
        if rest > -math.inf:
            self.put(bound, float(path.before[t]) + rest, ("step", path, t, without))

    def pick(self, logs: np.ndarray) -> int:
        """A place drawn by its weight, given as a logarithm."""
        return self.pick_weight(np.exp(logs - logs.max()))

    def pick_weight(self, weights: np.ndarray) -> int:
        total = np.cumsum(weights)
        k = int(np.searchsorted(total, self.uniform() * total[-1], side="right"))
        return k if k < len(total) else int(np.searchsorted(total, total[-1]))

    def take(self, lattice: Lattice) -> tuple | None:
        """The best set left: its bound, and how its best member leaves a known path (path, step, entry, log p)."""
        if not self.heap:
            return None
        value, _, node = heapq.heappop(self.heap)
        bound, path, without = -value, node[1], None
        if node[0] == "range":
            a, b = node[2], node[3]
            if path.before[b] - path.before[a] < _NEARLY_ONE:
                # what leaves after a fall of exp(-45) is beyond the precision of the sum
                near = a + max(1, int(np.searchsorted(-path.before[a : a + 4096], 45 - path.before[a]))) if path.before[min(b, a + 4096)] < path.before[a] - 45 else b
                near = min(near, b)
                t = a + self.pick_weight(np.exp(path.before[a:near] - path.before[a]) * -np.expm1(path.logs[a:near]))
            else:
                t = a + self.pick(self.leaving(lattice, path, a, b))
            self.open_range(lattice, bound, path, a, t)
            self.open_range(lattice, bound, path, t + 1, b)
        else:
            t, without = node[2], node[3]
        first, logs = lattice.state_logs(int(path.lane[t]), int(path.place[t]))
        without = without or (int(path.entry[t]) - first,)
        open_ = logs.copy()
        open_[list(without)] = -np.inf
        k = self.pick(open_)
        self.open_step(lattice, bound, path, t, (*without, k))
        return bound, path, t, first + k, min(float(logs[k]), 0.0)


def _log_sum(logs: np.ndarray) -> float:
    top = float(logs.max())
    return top if top == -math.inf else top + math.log(float(np.exp(logs - top).sum()))


def sample_texts(lattice: Lattice, first: int, last: int, seeds: np.ndarray, samples: int) -> list[Search]:
    """The `samples` best perturbed segmentations of the texts [first, last), fewer where a text has fewer.

    Each search ends with best = [(perturbed value, path)] in falling order.
    """
    spans = np.searchsorted(lattice.owner, np.arange(first, last + 1))
    own = np.arange(spans[0], spans[-1])
    number = (own - spans[lattice.owner[own] - first]).astype(np.uint64)
    lane_seed = K.mix(seeds[lattice.owner[own] - first] + number * np.uint64(0xD6E8FEB86659FD93))
    searches = [Search(int(s)) for s in seeds]
    pending = [(d, 0.0, None, 0, own[spans[d] - spans[0] : spans[d + 1] - spans[0]], lattice.size[spans[d] : spans[d + 1]]) for d in range(last - first) if spans[d] < spans[d + 1]]
    for turn in range(samples):
        if not pending:
            break
        lanes, places = np.concatenate([x[4] for x in pending]), np.concatenate([x[5] for x in pending])
        salt = np.uint64(turn * 0xA0761D6478BD642F & _U64)
        lane, place, entry, logs = lattice.walk(lanes, places, lane_seed[lanes - spans[0]] + salt)
        cuts = np.searchsorted(lane, spans)
        for d, bound, head, keep, _, _ in pending:
            part = slice(cuts[d], cuts[d + 1])
            search = searches[d]
            tail = (lane[part], place[part], entry[part], logs[part])
            if head is None:
                path, bound = Path(*tail), _gumbel(search.uniform())
            else:
                old, t, left_by, logp = head
                step = ((old.lane[t],), (old.place[t],), (left_by,), (logp,))
                path = Path(*(np.concatenate([x[:t], y, z]) for x, y, z in zip((old.lane, old.place, old.entry, old.logs), step, tail)))
            search.best.append((bound, path))
            search.open_range(lattice, bound, path, keep, len(path.logs))
        following = []
        for d, *_ in pending if turn + 1 < samples else ():
            got = searches[d].take(lattice)
            if got is not None:
                bound, path, t, left_by, logp = got
                unit = int(path.lane[t])
                left = int(path.place[t]) - int(lattice.length[left_by])
                following.append((d, bound, (path, t, left_by, logp), t + 1, np.arange(unit, spans[d + 1]), np.concatenate([[left], lattice.size[unit + 1 : spans[d + 1]]])))
        pending = following
    return searches


def path_ids(lattice: Lattice, paths: list[Path]) -> list[np.ndarray]:
    """Piece ids of each path in text order."""
    ids, ends = flat_ids(lattice, paths)
    return np.split(ids, ends[:-1])


def flat_ids(lattice: Lattice, paths: list[Path]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all paths in text order, and where each path ends; characters without a piece give their bytes' ids."""
    sizes = [len(p.lane) for p in paths]
    if not sum(sizes):
        return np.zeros(0, np.int32), np.zeros(len(paths), np.int64)
    lane, entry = (np.concatenate([getattr(p, x) for p in paths]) for x in ("lane", "entry"))
    new = np.ones(len(lane), bool)
    new[1:] = lane[1:] != lane[:-1]
    cuts = np.cumsum(sizes)
    new[cuts[cuts < len(lane)]] = True
    at = np.flatnonzero(new)
    size = np.diff(at, append=len(lane))
    order = np.repeat(2 * at + size - 1, size) - np.arange(len(lane))  # each unit's steps turned round
    ids = lattice.piece[entry[order]].astype(np.int32)
    odd = np.flatnonzero(ids == _BYTES)
    if len(odd):
        counts = np.ones(len(ids), np.int64)
        raw = []
        for k, point in zip(odd.tolist(), lattice.points[lattice.first[lane[order[odd]]]].tolist()):
            bytes_ = chr(_MARK if point == _LITERAL else point).encode("utf-8", "surrogatepass")
            counts[k] = len(bytes_)
            raw.append(bytes_)
        total = np.concatenate([[0], np.cumsum(counts)])
        spread = np.repeat(ids, counts)
        spread[np.repeat(ids == _BYTES, counts)] = lattice.model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ids, cuts = spread, total[cuts]
    return ids, cuts


def log_inclusion(log_p: float, threshold: float | None) -> float:
    """Log-probability that a segmentation is perturbed above the threshold; 0 without one."""
    if threshold is None:
        return 0.0
    x = log_p - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


_EMPTY = Path(*[np.zeros(0, np.int64)] * 3, np.zeros(0))
_models: dict[int, PieceModel] = {}


def _model(raw: bytes) -> PieceModel:
    if hash(raw) not in _models:
        _models[hash(raw)] = PieceModel(raw)
    return _models[hash(raw)]


_OUT = {"sample": ("int", pa.int32()), "n_pieces": ("long", pa.int64()), "log_prob": ("double", pa.float64()), "log_inclusion": ("double", pa.float64()), "ids_sha256": ("string", pa.string()), "round_trip": ("boolean", pa.bool_())}


def sample_segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, seed: int = 7, model_file: str = MODEL_FILE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Sampled segmentations of every row: (key, sample, n_pieces, log_prob, log_inclusion, ids_sha256, round_trip, ids) and the columns `carry` of docs.

    One row for each of the `samples` distinct segmentations of a text, in
    falling order of their perturbed log-probabilities (sample 0, 1, ...); a
    text with fewer segmentations has all it has.  ids: the pieces themselves;
    ids_sha256 is of them as little-endian 32-bit integers.  A null or empty
    text has one empty segmentation with log_prob and log_inclusion 0.
    round_trip: decoding gives the text again.  The draws depend on key, seed and
    text alone; rows repeated under one key get the same samples, a null key
    counts as zero.  A carried column that has the name of one of these columns
    is left out.  A task holds up to about 170 bytes for each character of the
    longest run of text without a space, beside bounded blocks of texts.
    """
    spark = docs.sparkSession
    with open(model_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    names = ["key", *_OUT, "ids"]
    carried = [c for c in carry if c not in names]

    def run(batches):
        model = _model(shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            keys = K.mix(K.mix(batch.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) + np.uint64(seed))
            data, offsets, _ = K.column_bytes(batch.column("text"))
            for lo, hi in K.pieces(offsets, _LATTICE_BYTES):
                yield from sampled(model, batch, texts, keys, data, offsets, lo, hi)

    def sampled(model, batch, texts, keys, data, offsets, lo, hi):
        """The rows [lo, hi) of a batch; their lattice goes when they are done."""
        lattice = Lattice(model, texts[lo:hi])
        for a, b in K.pieces(offsets[lo : hi + 1], _WALK_BYTES):
            searches = sample_texts(lattice, a, b, keys[lo + a : lo + b], samples)
            ids, ends = flat_ids(lattice, [p for x in searches for _, p in x.best or [(0.0, _EMPTY)]])
            spelt, spelt_ends = model.spelt(ids, ends)
            rows, out, at, spelt_at = [], [], 0, 0
            for row, search in zip(range(lo + a, lo + b), searches):
                threshold = -search.heap[0][0] if search.heap else None
                own = data[offsets[row] : offsets[row + 1]].tobytes()
                for k, (_, path) in enumerate(search.best or [(0.0, _EMPTY)]):
                    end, spelt_end = int(ends[len(rows)]), int(spelt_ends[len(rows)])
                    log_p = float(path.before[-1])
                    same = spelt[spelt_at + 1 : spelt_end].tobytes() == own
                    out.append((k, end - at, log_p, log_inclusion(log_p, threshold), hashlib.sha256(ids[at:end].astype("<i4").tobytes()).hexdigest(), same))
                    rows.append(row)
                    at, spelt_at = end, spelt_end
            taken = pa.array(rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), *(pa.array(x, t) for x, (_, t) in zip(zip(*out), _OUT.values())), lists, *(batch.column(3 + k).take(taken) for k in range(len(carried)))],
                [*names, *carried],
            )

    seeds = F.coalesce(F.xxhash64(F.col(key).cast("string")), F.lit(0)).alias("seed")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), seeds, *(F.col(c) for c in carried))
    kinds = "".join(f", `{x.name}` {x.dataType.simpleString()}" for x in docs.select(*carried).schema)
    return rows.toDF("key", "text", "seed", *(f"c{k}" for k in range(len(carried)))).mapInArrow(run, f"key {dict(rows.dtypes[:1])['key']}, " + ", ".join(f"{n} {t}" for n, (t, _) in _OUT.items()) + f", ids array<int>{kinds}")


def decode_pieces(encoded: DataFrame, ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """encoded with a column `decoded`: the text of the piece ids; null ids give null."""
    spark = encoded.sparkSession
    with open(model_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decode(column):
        model = _model(shared.value)
        return column.map(lambda x: None if x is None else model.decode(x))

    return encoded.withColumn("decoded", decode(F.col(ids)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every whole document, with their piece ids."""
    return sample_segmentations(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
