"""Secret scans by grammar inference.

Fixed patterns find the plain credentials. From a bounded sample of them, labelled by kind, a
prefix tree is built for each kind and its statistically compatible states are merged, which
gives a probabilistic automaton a kind. States are compatible if chance explains how their
frequencies of ending, of each next character and of each number of characters still to come
differ (the bounds of Hoeffding, and of Dvoretzky, Kiefer and Wolfowitz, which have one form),
and if so do the states behind them. A state that fewer than ``EVIDENCE`` strings reach says
nothing against any other, so such siblings are pooled before they are compared: random
characters become one state a position, and the automaton knows a format's length.

Every candidate, the base spans among them, is scored by how much likelier an automaton makes
it, its end included, than a model of ordinary runs does. Runs of credential characters that
are no base span, and what base spans leave of a run, are added as spans ``like_<kind>`` above a
threshold, however many there are. The threshold bounds the share of ordinary runs by their
likelihood ratio and is set on labelled strings and ordinary runs that trained no model.
Ordinary by their shape are runs of words and numbers; of the others none trains a model.
"""

from __future__ import annotations

import bisect
import dataclasses
import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clash_free, per_batch, stored, texts

#: Fixed by the contract: patterns, least lengths, order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as of [0-9a-f]+ with the short ones dropped
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")
#: Any of these must occur, in either case, where ASSIGN matches.
HINTS = (b"password", b"passwd", b"secret", b"token", b"api")
#: Runs as short as the shortest base credential.
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_ASSIGN},}}")
#: Words in one case or capitalised, numbers, and words with a number behind, with signs between.
_PIECE = r"(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]*"
DIGITS = frozenset("0123456789+/_.=-")
ORDINARY = re.compile(rf"{_PIECE}(?:[+/_.=-]+{_PIECE})*")
#: Parameters of the sample: documents, strings to a kind, ordinary runs, longest string in characters.
SAMPLE_DOCS, SAMPLE_STRINGS, SAMPLE_RUNS, SAMPLE_CHARS = 20_000, 300, 4000, 200
#: Level of the merging test, least strings of a state that can differ from another, least strings of a kind.
ALPHA, EVIDENCE, LEAST_STRINGS = 0.05, 8, 5
#: Share of ordinary runs that may pass, what such a run costs against a missed labelled string,
#: least gain in nats a character.
FALSE_SHARE, FALSE_COST, LEAST_GAIN = 0.001, 10.0, 0.3
#: Weights of the end where a state has not seen it, and of characters that no string has; characters there are.
END, EPSILON, SYMBOLS = 0.05, 0.01, 67
#: Runs that a Python worker remembers, and the longest of them.
MEMORY, MEMORY_CHARS = 40_000, 40


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, by start, then kind as listed."""
    found = []
    lowered = data.lower()
    if any(h in lowered for h in HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


class Automaton:
    """A probabilistic automaton inferred from strings by state merging."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, evidence: int = EVIDENCE):
        self.next: list[dict[str, int]] = [{}]  # character -> state
        self.counts: list[dict[str, int]] = [{}]
        self.rests: list[dict[int, int]] = [{}]  # characters still to come -> strings; 0: those that end here
        for s in sorted(strings):
            at = 0
            for i, c in enumerate(s):
                self._add(self.rests[at], len(s) - i)
                self._add(self.counts[at], c)
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    for table in (self.next, self.counts, self.rests):
                        table.append({})
                at = self.next[at][c]
            self._add(self.rests[at], 0)
        self.bound, self.evidence = math.sqrt(0.5 * math.log(2 / alpha)), evidence
        self.states = self._merge()
        # characters of the whole kind stand in for those that a state has not seen, the more the
        # more different ones it has seen (Witten and Bell)
        usual: dict[str, int] = {}
        for s in strings:
            for c in s:
                self._add(usual, c)
        total = sum(usual.values()) + EPSILON * SYMBOLS
        usual_share = {c: (n + EPSILON) / total for c, n in usual.items()}
        #: for each state: logarithm of the end, next state of a character it has not seen, moves of seen ones
        self.ends, self.onward, self.moves, self.none = [], [], [], []
        for q, (seen, rests) in enumerate(zip(self.counts, self.rests, strict=True)):
            here, ended, going = sum(rests.values()), rests.get(0, 0), sum(seen.values())
            stay = math.log((here - ended + END) / (here + 2 * END))
            self.ends.append(math.log((ended + END) / (here + 2 * END)))
            onward = self.next[q][max(seen, key=lambda c: (seen[c], c))] if seen else q  # noqa: B023
            spread = max(1, len(seen))
            share = {c: (seen.get(c, 0) + spread * u) / (going + spread) for c, u in usual_share.items()}
            self.moves.append({c: (stay + math.log(x), self.next[q].get(c, onward)) for c, x in share.items()})
            self.onward.append(onward)
            self.none.append(stay + math.log(spread * EPSILON / total / (going + spread)))

    @staticmethod
    def _add(table: dict, key: str | int, n: int = 1) -> None:
        table[key] = table.get(key, 0) + n

    def _alike(self, p: int, q: int) -> bool:
        """Whether chance explains how two states differ, without those behind them."""
        n_p, n_q = sum(self.rests[p].values()), sum(self.rests[q].values())
        if min(n_p, n_q) < self.evidence:
            return True
        limit = self.bound * (n_p**-0.5 + n_q**-0.5)
        if any(abs(self.counts[p].get(c, 0) / n_p - self.counts[q].get(c, 0) / n_q) > limit for c in self.counts[p].keys() | self.counts[q].keys()):
            return False
        below_p = below_q = 0
        for rest in sorted(self.rests[p].keys() | self.rests[q].keys()):
            below_p += self.rests[p].get(rest, 0)
            below_q += self.rests[q].get(rest, 0)
            if abs(below_p / n_p - below_q / n_q) > limit:
                return False
        return True

    def _compatible(self, p: int, q: int) -> bool:
        todo, met = [(p, q)], set()
        while todo:
            pair = todo.pop()
            if pair[0] == pair[1] or pair in met:
                continue
            met.add(pair)
            if not self._alike(*pair):
                return False
            p, q = pair
            todo += [(self.next[p][c], self.next[q][c]) for c in self.next[p].keys() & self.next[q].keys()]
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to the automaton at p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            for rest, n in self.rests[q].items():
                self._add(self.rests[p], rest, n)
            for c, n in self.counts[q].items():
                self._add(self.counts[p], c, n)
                if c not in self.next[p]:
                    self.next[p][c] = self.next[q][c]
                elif self.next[p][c] != self.next[q][c]:
                    todo.append((self.next[p][c], self.next[q][c]))

    def _merge(self) -> int:
        """Keeps states in order of their distance; each further one is pooled, folded into a kept one or kept."""
        kept, order, i = {0}, [0], 0
        while i < len(order):
            p = order[i]
            rare: int | None = None
            for c in sorted(self.next[p]):  # siblings of little evidence are one state
                q = self.next[p][c]
                if q not in kept and sum(self.rests[q].values()) < self.evidence:
                    if rare is None:
                        rare = q
                    elif q != rare:
                        self._fold(rare, q)
                        self._redirect(p, q, rare)
            for c in sorted(self.next[p]):
                q = self.next[p][c]
                if q in kept:
                    continue
                for r in order:
                    if self._compatible(r, q):
                        self._redirect(p, q, r)
                        self._fold(r, q)
                        break
                else:
                    kept.add(q)
                    order.append(q)
            i += 1
        return len(order)

    def _redirect(self, p: int, q: int, to: int) -> None:
        for c, s in self.next[p].items():
            if s == q:
                self.next[p][c] = to

    def likelihood(self, s: str, least: float = -math.inf) -> float:
        """Natural logarithm of the string's probability, its end included; unseen characters take the commonest move.

        No character adds to it, so once it is below ``least`` it is given as it is.
        """
        at, total = 0, 0.0
        for c in s:
            if move := self.moves[at].get(c):
                total += move[0]
                at = move[1]
            else:
                total += self.none[at]
                at = self.onward[at]
            if total < least:
                return total
        return total + self.ends[at]


class Ordinary:
    """Pairs of characters in runs that are no credentials; numbers are any digits and signs."""

    def __init__(self, runs: list[str]):
        self.pairs: dict[tuple[str, str], int] = defaultdict(int)
        self.firsts: dict[str, int] = defaultdict(int)
        for r in runs:
            for a, b in zip("^" + r, r, strict=False):
                self.pairs[a, b] += 1
                self.firsts[a] += 1
        self.logs = {p: math.log((n + 0.5) / (self.firsts[p[0]] + 0.5 * SYMBOLS)) for p, n in self.pairs.items()}
        self.unseen = {a: math.log(0.5 / (n + 0.5 * SYMBOLS)) for a, n in self.firsts.items()}
        self.pairs, self.firsts = dict(self.pairs), dict(self.firsts)

    def likelihood(self, s: str) -> float:
        logs, unseen = self.logs, self.unseen
        number = -len(s) * math.log(len(DIGITS)) if DIGITS.issuperset(s) else -math.inf
        return max(number, sum([x if (x := logs.get(p)) is not None else unseen.get(p[0], -math.log(SYMBOLS)) for p in zip("^" + s, s, strict=False)]))


@dataclasses.dataclass
class Grammar:
    automata: dict[str, Automaton]
    ordinary: Ordinary
    threshold: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def verdict(self, run: str) -> tuple[float, str] | None:
        """Gain and kind of a run that is likelier a credential than not, else None; short runs are remembered."""
        known = self.__dict__.setdefault("known", {})
        if run in known:
            return known[run]
        least = max(self.threshold, LEAST_GAIN * len(run))
        found = self.gain(run, least)
        found = found if found[0] > least else None
        if len(run) <= MEMORY_CHARS:
            if len(known) >= MEMORY:
                known.clear()
            known[run] = found
        return found

    def gain(self, s: str, least: float = -math.inf) -> tuple[float, str]:
        """The best automaton's gain over ordinary runs in nats, and its kind; a gain below ``least`` may be too high."""
        usual = self.ordinary.likelihood(s)
        return max((a.likelihood(s, usual + least) - usual, kind) for kind, a in self.automata.items())

    def spans(self, text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, gain) of candidates outside the spans already taken that are likelier credentials than not."""
        if not self.automata:
            return []
        out, held, k = [], sorted((lo, hi) for lo, _, hi, _ in taken), 0
        for m in CANDIDATE.finditer(text):
            lo, end = m.span()
            while k < len(held) and held[k][1] <= lo:
                k += 1
            j = k
            while lo < end:  # what the base spans leave of the run
                hi = min(end, held[j][0]) if j < len(held) else end
                if hi - lo >= LEAST_ASSIGN:
                    if found := self.verdict(text[lo:hi]):
                        out.append((lo, hi, f"like_{found[1]}", found[0]))
                if j == len(held) or held[j][0] >= end:
                    break
                lo, j = max(lo, held[j][1]), j + 1
            k = max(k, j - 1)  # a base span that began in this run may reach into the next
        return out

    def base_gains(self, base: list[tuple[int, int, int, str]]) -> list[float]:
        """The gain of every base span's value; they are credentials whatever it is."""
        return [self.gain(v)[0] if self.automata else 0.0 for _, _, _, v in base]


def fit(labelled: dict[str, list[str]], runs: list[str]) -> Grammar:
    """Automata from strings labelled by kind, and the threshold from runs that are ordinary by their shape.

    Every fifth string of a kind that can spare it, and every other run, train nothing. A
    ratio of likelihoods above 1 / FALSE_SHARE is met by at most that share of what the ordinary
    model gives, for each automaton. From there on, the threshold is where the share of those
    strings that is missed and ``FALSE_COST`` times the share of those runs that passes are
    least together. Runs of other shapes have no say in it.
    """
    spare = {k: [s for i, s in enumerate(v) if i % 5 == 4] if len(v) >= 5 * EVIDENCE else [] for k, v in labelled.items()}
    automata = {k: Automaton([s for i, s in enumerate(v) if not spare[k] or i % 5 != 4]) for k, v in sorted(labelled.items()) if len(v) >= LEAST_STRINGS}
    runs = [r for r in runs if ORDINARY.fullmatch(r)]
    grammar = Grammar(automata, Ordinary(runs[::2]), math.log(max(1, len(automata)) / FALSE_SHARE))
    if automata:
        held = sorted(grammar.gain(s)[0] for of in spare.values() for s in of)
        passing = sorted(x for r in runs[1::2] if (x := grammar.gain(r)[0]) > grammar.threshold)

        def cost(t: float) -> tuple[float, float]:
            missed = bisect.bisect_right(held, t) / max(1, len(held))
            return missed + FALSE_COST * (len(passing) - bisect.bisect_right(passing, t)) / max(1, len(runs[1::2])), t

        grammar.threshold = min(map(cost, [grammar.threshold, *passing]))[1]
    return grammar


def outside(matches: Iterable[re.Match], spans: list[tuple[int, int, int, str]]) -> Iterator[str]:
    """The matches that no span touches; both come in order of their start."""
    k, reach = 0, 0
    for m in matches:
        while k < len(spans) and spans[k][0] < m.end():
            reach, k = max(reach, spans[k][2]), k + 1
        if reach <= m.start():
            yield m[0]


def train(docs: DataFrame) -> Grammar:
    """A grammar from the base credentials and the ordinary runs of a bounded sample of ``docs``.

    The sample: about ``SAMPLE_DOCS`` documents of least hash, all if there are fewer; of their
    findings of at most ``SAMPLE_CHARS`` characters ``SAMPLE_STRINGS`` a kind and
    ``SAMPLE_RUNS`` runs of ordinary shape, those of least hash.
    """
    rows = clash_free(docs, "doc_id", "text").where("text is not null")
    total = max(1, rows.count())
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30))
    chosen = rows.where(key < F.lit(float(1 << 30)) * SAMPLE_DOCS / total).select("text")

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        kinds, values = [], []
        for data in texts(b.column(0)):
            text = data.decode()
            spans = base_spans(text, data)
            kinds += [KINDS[k] for _, k, _, _ in spans]
            values += [v for _, _, _, v in spans]
            runs = {r for r in outside(CANDIDATE.finditer(text), spans) if ORDINARY.fullmatch(r)}
            kinds += ["ordinary"] * len(runs)
            values += sorted(runs)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    found = stored(per_batch(chosen, kernel, "kind string, value string").where(F.length("value") <= SAMPLE_CHARS).distinct(), "credentials")
    of = lambda kind, most: found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(most)
    parts = of("ordinary", SAMPLE_RUNS)
    for k in KINDS:
        parts = parts.union(of(k, SAMPLE_STRINGS))
    got: dict[str, list[str]] = defaultdict(list)
    for r in parts.collect():
        got[r.kind].append(r.value)
    return fit({k: got[k] for k in KINDS if k in got}, sorted(got["ordinary"]))


def joined(spans: list[tuple[int, int, int, str]], more: list[tuple[int, int, str, float]] = ()) -> str:
    return ",".join(x for _, _, x in _ordered(spans, more))


def _ordered(spans: list[tuple[int, int, int, str]], more: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    return sorted([(lo, k, f"{KINDS[k]}:{lo}:{hi}") for lo, k, hi, _ in spans] + [(lo, len(KINDS), f"{kind}:{lo}:{hi}") for lo, hi, kind, _ in more])


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_like bigint, gains array<double>"


def scan(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_like, gains for every row of ``docs``.

    Spans are code points of the whole match, end exclusive; ``gains`` are the scores of the
    base spans, in their order, then those of the added ones. Null and empty texts have none.
    Texts are scanned whole, in time in proportion to their length. Repeated rows give repeated
    rows, an empty table an empty one; no column but doc_id and text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        g, rows = shared.value, []
        for doc, data in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            data = data or b""
            text = data.decode()
            base = base_spans(text, data)
            more = g.spans(text, base)
            counts = [sum(x[1] == k for x in base) for k in range(3)]
            rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base, more), len(more), [*g.base_gains(base), *[x[3] for x in more]]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.float64())]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return per_batch(clash_free(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text"), kernel, SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """``scan`` with a grammar learnt from ``docs``; both state the edge cases."""
    return scan(docs, train(docs))
