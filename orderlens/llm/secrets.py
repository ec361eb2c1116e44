"""Secret scans by one combined deterministic automaton.

The regular expressions of all rules become one automaton over bytes: a state is the set of all places at which
matches that have begun anywhere can be (subset construction), and states that no further text tells apart are one
(minimisation). It is a transition array of state by byte class, and every byte of a text is looked up in it once,
for all rules. The bytes between two places where no match is under way are a stretch; a stretch in which a rule
ends is handed to two arrays of that rule, one from right to left that marks where its matches begin,
one from left to right that takes the longest from there. Matches of a rule are leftmost, longest and do not overlap.

Some bytes lead to the start from every state. Texts are cut there into lanes of about ``LANE`` bytes that
are run side by side; a lane without such a byte is just longer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import arrow_schema, map_arrow, sliced_rows, utf8

LANE = 2048
#: Bytes of texts that are looked up side by side.
AT_ONCE = 4 << 20
#: Lanes still running from which on they are run one by one.
FEW = 12
RESULT = "doc_id long, kinds binary, starts array<long>, ends array<long>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (over bytes) whose ``group`` has ``least`` characters."""
    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The kinds of the contract. Dropping runs of fewer than 32 hexadecimal digits or asking for 32 is the same,
# as a match is always the whole run.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
# Published formats of keys and tokens.
ADDED = (
    Rule("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
)
RULES = BASE + ADDED


class _Places:
    """Places of all rules: what each leads to without a byte, and with bytes of a set."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.taken: list[tuple[frozenset, int] | None] = []

    def new(self) -> int:
        self.free.append([])
        self.taken.append(None)
        return len(self.free) - 1

    def add(self, items, end: int, backwards: bool) -> int:
        """Build from the end; the place at which a sequence of parsed items starts."""
        for op, value in (items if backwards else reversed(list(items))):
            end = self._item(op, value, end, backwards)
        return end

    def _item(self, op, value, end: int, backwards: bool) -> int:
        if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY):
            place = self.new()
            self.taken[place] = _bytes_of(op, value), end
            return place
        if op is sre.SUBPATTERN:
            return self.add(value[-1], end, backwards)
        if op is sre.BRANCH:
            place = self.new()
            self.free[place] = [self.add(branch, end, backwards) for branch in value[1]]
            return place
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            if high is sre.MAXREPEAT:
                loop = self.new()
                self.free[loop] = [self.add(inner, loop, backwards), end]
                start = loop
            else:
                start = end
                for _ in range(high - low):
                    optional = self.new()
                    self.free[optional] = [self.add(inner, start, backwards), end]
                    start = optional
            for _ in range(low):
                start = self.add(inner, start, backwards)
            return start
        raise ValueError(f"rules may not use {op}")


def _bytes_of(op, value) -> frozenset:
    if op is sre.LITERAL:
        return frozenset([value])
    if op is sre.NOT_LITERAL:
        return frozenset(range(256)) - {value}
    if op is sre.ANY:
        return frozenset(range(256)) - {10}
    held: set[int] = set()
    for kind, x in value:
        if kind is sre.LITERAL:
            held.add(x)
        elif kind is sre.RANGE:
            held.update(range(x[0], x[1] + 1))
        elif kind is not sre.NEGATE:
            raise ValueError(f"rules may not use {kind}")
    return frozenset(range(256)) - held if value[0][0] is sre.NEGATE else frozenset(held)


class Automaton:
    """Transition arrays of one or several rules: ``step[state * width + byte_class[byte]]``.

    State 0 is the start; ``ends[state]`` has a bit for each rule that ends there. ``anywhere`` lets matches begin at
    every byte, else at the first only, and the start is never met again; ``dead`` is the state without a way on.
    """

    def __init__(self, rules: tuple[Rule, ...], anywhere: bool, backwards: bool = False):
        places, finals, starts = _Places(), {}, []
        for i, rule in enumerate(rules):
            final = places.new()
            finals[final] = 1 << i
            starts.append(places.add(_parser.parse(rule.pattern.encode("latin-1")), final, backwards))
        closed = self._closures(places)
        sets = list(dict.fromkeys(t[0] for t in places.taken if t))
        sign = [tuple(b in s for s in sets) for b in range(256)]
        classes = {x: i for i, x in enumerate(dict.fromkeys(sign))}
        self.byte_class = np.array([classes[x] for x in sign], np.uint8)
        self.width = len(classes)
        byte = [sign.index(x) for x in classes]
        # For each class, what every place leads to.
        onward = [[closed[t[1]] if t and b in t[0] else 0 for t in places.taken] for b in byte]
        takers = [sum(1 << p for p, to in enumerate(row) if to) for row in onward]
        begin = 0
        for s in starts:
            begin |= closed[s]
        number, waiting, step = {begin: 0}, [begin], []
        for state in waiting:
            for row, takes in zip(onward, takers):
                left, to = state & takes, begin if anywhere else 0
                while left:
                    low = left & -left
                    to |= row[low.bit_length() - 1]
                    left ^= low
                if to not in number:
                    number[to] = len(number)
                    waiting.append(to)
                step.append(number[to])
        ends = [sum(bit for place, bit in finals.items() if state >> place & 1) for state in waiting]
        self._minimise(np.array(step).reshape(-1, self.width), np.array(ends))
        reached = self.step.reshape(-1, self.width)
        #: Bytes after which nothing is under way, whatever came before.
        self.resets = (reached == 0).all(0)[self.byte_class]
        lost = np.flatnonzero((reached == np.arange(len(reached))[:, None]).all(1) & (self.ends == 0))
        self.dead = int(lost[0]) if len(lost) else -1

    @staticmethod
    def _closures(places: _Places) -> list[int]:
        closed = []
        for place in range(len(places.free)):
            seen, waiting = {place}, [place]
            for p in waiting:
                for q in places.free[p]:
                    if q not in seen:
                        seen.add(q)
                        waiting.append(q)
            closed.append(sum(1 << p for p in seen))
        return closed

    def _minimise(self, step: np.ndarray, ends: np.ndarray) -> None:
        """Divide states until all of a part lead to the same parts."""
        part = np.unique(ends, return_inverse=True)[1].ravel()
        while True:
            finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        # The start keeps number 0.
        order = np.unique(np.append(part[0], part), return_index=True)[1]
        rank = np.empty(len(order), np.int64)
        rank[np.argsort(order, kind="stable")] = np.arange(len(order))
        part = rank[part]
        chosen = np.unique(part, return_index=True)[1]
        self.step = part[step[chosen]].astype(np.uint16 if len(chosen) < 1 << 16 else np.uint32).ravel()
        self.ends = ends[chosen]


class Scanner:
    """The combined automaton, and both ways through every single rule."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton(rules, True)
        self.alone = [(Automaton((r,), True, backwards=True), Automaton((r,), False)) for r in rules]
        self.groups = [re.compile(r.pattern.encode("latin-1")) for r in rules]

    def states(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The state after every byte of texts that begin at ``first``."""
        a, n = self.all, len(data)
        kind = a.byte_class[data].astype(np.int64)
        cuts = np.flatnonzero(a.resets[data]) + 1
        at = np.searchsorted(cuts, np.arange(LANE, n, LANE))
        begin = np.unique(np.concatenate([first, cuts[at[at < len(cuts)]]]))
        begin = begin[begin < n]
        length = np.diff(begin, append=n)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        out, state = np.empty(n, a.step.dtype), np.zeros(len(begin), np.int64)
        running = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        for i, active in enumerate(running.tolist()):
            if active < FEW:
                break
            place = begin[:active] + i
            state[:active] = found = a.step[state[:active] * a.width + kind[place]]
            out[place] = found
        else:
            return out
        table, width = a.step.tolist(), a.width
        for lane in range(running[i]):
            s, at = int(state[lane]), int(begin[lane])
            rest = []
            for k in kind[at + i:at + int(length[lane])].tolist():
                s = table[s * width + k]
                rest.append(s)
            out[at + i:at + int(length[lane])] = rest
        return out

    def spans(self, rule: int, text: bytes) -> Iterator[tuple[int, int]]:
        """Matches of one rule in a stretch."""
        back, ahead = self.alone[rule]
        kinds, state, starts = back.byte_class[np.frombuffer(text, np.uint8)].tolist(), 0, []
        step, ends, width = back.step, back.ends, back.width
        for at in range(len(text) - 1, -1, -1):
            state = int(step[state * width + kinds[at]])
            if ends[state]:
                starts.append(at)
        kinds, step, ends, width = ahead.byte_class[np.frombuffer(text, np.uint8)].tolist(), ahead.step, ahead.ends, ahead.width
        free = 0
        for start in reversed(starts):
            if start < free:
                continue
            state, end, at = 0, start, start
            while at < len(text) and state != ahead.dead:
                state = int(step[state * width + kinds[at]])
                at += 1
                if ends[state]:
                    end = at
            free = end
            least, group = self.rules[rule].least, self.rules[rule].group
            size = end - start
            if group:
                a, b = self.groups[rule].fullmatch(text, start, end).span(group)
                size = b - a
            if size >= least:
                yield start, end

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in bytes for each text, in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        at = 0
        while at < len(texts):
            stop, weight = at + 1, len(texts[at])
            while stop < len(texts) and weight + len(texts[stop]) <= AT_ONCE:
                weight += len(texts[stop])
                stop += 1
            self._scan(texts, at, stop, found)
            at = stop
        return found

    def _scan(self, texts, at, stop, found) -> None:
        part = texts[at:stop]
        first = np.append(0, np.cumsum([len(t) for t in part]))
        data = np.frombuffer(b"".join(part), np.uint8)
        state = self.states(data, first)
        hit = np.flatnonzero(self.all.ends[state])
        if not len(hit):
            return
        idle = np.flatnonzero(state == 0)
        text = np.searchsorted(first, hit, "right") - 1
        before = np.searchsorted(idle, hit)
        start = np.maximum(np.where(before > 0, idle[before - 1] + 1 if len(idle) else 0, 0), first[text])
        for s in np.unique(start).tolist():
            of = int(np.searchsorted(first, s, "right")) - 1
            after = int(np.searchsorted(idle, s))
            e = min(int(idle[after]) if after < len(idle) else len(data), int(first[of + 1]))
            rules = np.bitwise_or.reduce(self.all.ends[state[s:e]])
            stretch, base = data[s:e].tobytes(), s - int(first[of])
            for r in range(len(self.rules)):
                if rules >> r & 1:
                    found[at + of] += [(base + x, r, base + y) for x, y in self.spans(r, stretch)]
        for i in range(at, stop):
            found[i].sort()


@lru_cache(4)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    """The compiled rules, kept by the driver for later scans."""
    return Scanner(rules)


def _code_points(data: bytes, places: list[int]) -> list[int]:
    """Code points before each byte place."""
    if data.isascii():
        return places
    begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return [int(begins[p - 1]) if p else 0 for p in places]


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds, starts, ends) of every row: the spans of its secrets in code points, the end exclusive, by start,
    then in the order of the rules; ``kinds`` has a byte with the number of the rule for each.

    Null texts are empty; null ids stay; repeated rows are scanned each. An empty table gives an empty result; other
    columns are not read.
    """
    scanner = scanner_of(rules)

    def work(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column("text")]

            def rows():
                for doc_id, data, found in zip(b.column("doc_id").to_pylist(), texts, scanner.scan(texts)):
                    starts, ends = (_code_points(data, [x[i] for x in found]) if found else [] for i in (0, 2))
                    yield doc_id, bytes(r for _, r, _ in found), starts, ends
            yield from sliced_rows(rows(), arrow_schema(RESULT))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return map_arrow(source, work, RESULT)


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """(doc_id, n_<kind> of the base kinds, base_sha256, spans): spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    places = F.sequence(F.lit(1), F.col("size"))
    number = lambda i: F.conv(F.hex(F.substring("kinds", i, F.lit(1))), 16, 10).cast("int")
    listed = found.withColumn("size", F.octet_length("kinds")).withColumn("all", F.when(F.col("size") > 0, F.transform(
        places, lambda i: F.struct(number(i).alias("rule"), F.concat_ws(
            ":", F.element_at(names, number(i) + 1), F.element_at("starts", i).cast("string"),
            F.element_at("ends", i).cast("string")).alias("span")))).otherwise(F.array().cast("array<struct<rule:int,span:string>>")))
    own = [i for i, r in enumerate(rules) if r in base]
    counts = [(F.size("all") - F.size(F.array_remove("all.rule", i))).cast("long").alias(f"n_{rules[i].kind}") for i in own]
    of_base = F.filter("all", lambda x: x["rule"].isin(own))
    return listed.select("doc_id", *counts, F.sha2(F.array_join(of_base["span"], ","), 256).alias("base_sha256"),
                         F.array_join(F.col("all.span"), ",").alias("spans"))
