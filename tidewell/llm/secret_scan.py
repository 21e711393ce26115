"""Secret scan: all rules in one deterministic automaton over bytes.

Rule regexes are parsed to a syntax tree, turned into one nondeterministic automaton, made deterministic by subset
construction and minimised by partition refinement. The result is a transition array over byte classes. A batch of texts is
one byte buffer, cut into lanes anywhere, and all lanes advance through the array together, so each byte is looked at once for
all rules. A lane begins in a guessed state; where its predecessor ends in another one, its first bytes are read again from
there until the states agree with those of the first reading. Transitions that end a match carry the rule's bit; its start
comes from the rule's reversed automaton, run backwards from that end.

Rules must end in a run that takes all it can (``+``, ``{n,}``) or in a fixed end that can't follow itself, as secrets' rules
do: a match ends where the automaton leaves the rule's accepting states.

Defined cases: a null or empty text has no spans; rows are judged one by one, so repeated rows give repeated results; other
columns are carried along untouched; an empty table gives an empty result. Texts have no length limit.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.llm.common import map_texts

#: A private key's first line and what its body holds: base64, line ends (also escaped ones) and indentation behind them.
PEM, BODY = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", r"(?:[A-Za-z0-9+/=\\]|[\r\n][\x20\t]*)"
#: Kind, regex, least length of the match, least length of the value after the separator (0: not looked at).
#: The first three are the contract's; hex has its least length in the pattern, which cuts the same runs.
RULES = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 0, 12),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 24, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20, 0),
    ("google", r"AIza[A-Za-z0-9_-]+", 35, 0),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", 24, 0),
    ("pem", rf"{PEM}{BODY}*", 0, 0),
    ("pem_headed", rf"{PEM}[\x20\t]*\r?\n(?:[\x20\t]*[A-Za-z0-9-]+:[^\r\n]*\r?\n)+[\x20\t]*\r?\n{BODY}+", 0, 0),
)
BASE = 3
VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
END = 0xFF  # never part of UTF-8; stands after each text
LANES = 4096


class Nfa:
    """Thompson automaton; edges are (set of bytes, target), empty moves apart."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, choices: list, start: int, back: bool) -> int:
        """Append the choices of a tree (see :func:`parse_rule`) after ``start`` (in reverse order if ``back``); the end state."""
        ends = []
        for items in choices:
            last = start
            if len(choices) > 1:
                last = self.state()
                self.empty[start].append(last)
            for item, low, high in reversed(items) if back else items:
                last = self.repeat(item, low, high, last, back)
            ends.append(last)
        if len(ends) == 1:
            return ends[0]
        end = self.state()
        for e in ends:
            self.empty[e].append(end)
        return end

    def once(self, item, start: int, back: bool) -> int:
        if isinstance(item, list):
            return self.add(item, start, back)
        end = self.state()
        self.edges[start].append((item, end))
        return end

    def repeat(self, item, low: int, high: int | None, start: int, back: bool) -> int:
        if (low, high) == (1, 1):
            return self.once(item, start, back)
        for _ in range(low):
            start = self.once(item, start, back)
        end = self.state()
        self.empty[start].append(end)
        if high is None:
            self.empty[self.once(item, end, back)].append(end)
        for _ in range((high or low) - low):
            start = self.once(item, start, back)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


ITEM = re.compile(r"\(\?(i?):|(\()|(\))|(\|)|\[(\^?)((?:\\.|[^\]\\])+)\]|(\.)|\\x([0-9a-fA-F]{2})|\\([trn])|\\([^A-Za-z0-9])|([^\\()\[\]{}*+?|.^$])", re.S)
MEMBER = re.compile(r"(\\x[0-9a-fA-F]{2}|\\.|[^\\])(?:-(\\x[0-9a-fA-F]{2}|\\.|[^\\\]]))?", re.S)
TIMES = re.compile(r"([*+?])|\{(\d+)(,?)(\d*)\}")


def _code(text: str) -> int:
    """The byte that a pattern's character or escape stands for."""
    if len(text) == 4:
        return int(text[2:], 16)
    return ord({"\\t": "\t", "\\r": "\r", "\\n": "\n"}.get(text, text[-1]))


def _bytes(found: set[int], negate: bool, fold: bool) -> frozenset:
    out = set(range(255)) - found if negate else found
    if fold:
        out = out | {ord(chr(b).swapcase()) for b in out if b < 128 and chr(b).isalpha()}
    if max(out) > 254:
        raise ValueError("rules are over bytes below 255")
    return frozenset(out)


def parse_rule(pattern: str) -> list:
    """A tree of ``pattern``: a list of choices, each a list of (bytes or tree, least times, most times or None).

    Rules use literals, escapes, classes, groups ``(...)``, ``(?:...)`` and ``(?i:...)``, choices and greedy repetition.
    """
    at, top = 0, [[]]
    stack = [(top, False)]
    while at < len(pattern):
        m = ITEM.match(pattern, at)
        if m is None:
            raise ValueError(f"this rule syntax isn't supported: {pattern[at:]}")
        at, (choices, fold) = m.end(), stack[-1]
        if m[1] is not None or m[2]:
            stack.append(([[]], fold or m[1] == "i"))
            continue
        if m[4]:
            choices.append([])
            continue
        if m[3]:
            item = stack.pop()[0]
            if not stack:
                raise ValueError(f"unbalanced parenthesis: {pattern}")
        elif m[6]:
            members = {b for a, z in MEMBER.findall(m[6]) for b in range(_code(a), _code(z or a) + 1)}
            item = _bytes(members, bool(m[5]), fold)
        elif m[7]:
            item = _bytes({10}, True, False)
        else:
            item = _bytes({_code(m[0])}, False, fold)
        low, high = 1, 1
        if times := TIMES.match(pattern, at):
            at = times.end()
            if times[1]:
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[times[1]]
            else:
                low = int(times[2])
                high = int(times[4]) if times[4] else None if times[3] else low
        stack[-1][0][-1].append((item, low, high))
    if len(stack) > 1:
        raise ValueError(f"unbalanced parenthesis: {pattern}")
    return top


@dataclass
class Dfa:
    """``move[state * n_classes + classes[byte]]``; ``accept[state]`` has a bit for each rule."""

    classes: np.ndarray
    n_classes: int
    move: np.ndarray
    accept: np.ndarray


def _classes(nfa: Nfa) -> tuple[np.ndarray, int]:
    marks: list[list[int]] = [[] for _ in range(256)]
    for k, s in enumerate({s for out in nfa.edges for s, _ in out}):
        for b in s:
            marks[b].append(k)
    names = {m: i for i, m in enumerate(dict.fromkeys(map(tuple, marks)))}
    return np.array([names[tuple(m)] for m in marks], dtype=np.uint8), len(names)


def determinise(nfa: Nfa, start: int, ends: dict[int, int], again: bool) -> Dfa:
    """Subset construction, then minimisation. ``again``: a match may begin anywhere; state 0 is the start."""
    classes, n = _classes(nfa)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(n)]
    base = nfa.closure([start])
    moves: dict[int, list[tuple[int, int]]] = {s: [(c, t) for on, t in out for c in range(n) if sample[c] in on] for s, out in enumerate(nfa.edges)}
    closed = [nfa.closure([s]) for s in range(len(nfa.edges))]
    ids, order, rows = {base: 0}, [base], []
    for states in order:
        to: list[set] = [set(base) if again else set() for _ in range(n)]
        for s in states:
            for c, t in moves[s]:
                to[c] |= closed[t]
        row = []
        for x in map(frozenset, to):
            if x not in ids:
                ids[x] = len(order)
                order.append(x)
            row.append(ids[x])
        rows.append(row)
    accept = np.array([sum({1 << ends[s] for s in states if s in ends}) for states in order], dtype=np.int64)
    return minimise(Dfa(classes, n, np.array(rows, dtype=np.int64).ravel(), accept))


def minimise(dfa: Dfa) -> Dfa:
    """Partition refinement: split blocks until all states of a block agree on their successors' blocks."""
    move = dfa.move.reshape(-1, dfa.n_classes)
    block = np.unique(dfa.accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(first)  # the block of the start state comes first
    name = np.empty(len(first), dtype=np.int64)
    name[order] = np.arange(len(first))
    keep = first[order]
    return Dfa(dfa.classes, dfa.n_classes, name[block[move[keep]]].ravel(), dfa.accept[keep])


@dataclass
class Scanner:
    """The combined automaton and, for each rule, the reversed one."""

    rules: tuple
    dfa: Dfa
    step: np.ndarray  # next state, with the bits of the rules whose match ends here from bit 20 on
    back: list


@lru_cache(maxsize=4)
def compile_rules(rules: tuple = RULES) -> Scanner:
    nfa = Nfa()
    start, ends, back = nfa.state(), {}, []
    for k, (_, pattern, *_) in enumerate(rules):
        tree = parse_rule(pattern)
        first = nfa.state()
        nfa.empty[start].append(first)
        ends[nfa.add(tree, first, False)] = k
        rev = Nfa()
        begin = rev.state()
        last = rev.add(tree, begin, True)
        d = determinise(rev, begin, {last: 0}, False)
        dead = next((s for s in range(len(d.accept)) if not d.accept[s] and (d.move.reshape(-1, d.n_classes)[s] == s).all()), -1)
        back.append((d.classes.tolist(), d.move.reshape(-1, d.n_classes).tolist(), d.accept.tolist(), dead))
    dfa = determinise(nfa, start, ends, True)
    if len(dfa.accept) >= 1 << 20:
        raise ValueError("too many states")
    move = dfa.move.reshape(-1, dfa.n_classes)
    ended = dfa.accept[:, None] & ~dfa.accept[move]
    return Scanner(rules, dfa, (move | ended << 20).astype(np.int64).ravel(), back)


def ends_of(scanner: Scanner, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (exclusive ends) and rule bits of all match ends in ``data``, whose last byte is ``END``."""
    lanes = max(1, min(LANES, len(data) // 256))
    length = -(-len(data) // lanes)
    n, mask = scanner.dfa.n_classes, (1 << 20) - 1
    # one row for each step, a column for each lane; ``END`` fills the last lanes up
    padded = np.full(lanes * length, END, dtype=np.uint8)
    padded[: len(data)] = data
    classes = np.ascontiguousarray(scanner.dfa.classes[padded].reshape(lanes, length).T)
    got = np.empty((length, lanes), dtype=np.int64)
    state = np.zeros(lanes, dtype=np.int64)
    for t in range(length):
        scanner.step.take(state * n + classes[t], out=got[t])
        state = got[t] & mask
    begun = np.zeros(lanes, dtype=np.int64)
    spread = 1
    while True:
        ends = got[-1] & mask
        wanted = np.concatenate([[0], ends[:-1]])
        wrong = np.flatnonzero(wanted != begun)
        if not wrong.size:
            break
        # a lane that ended in the state it began in tells what the lanes behind it may begin in: these are tried along
        held = wrong[(wanted[wrong] == ends[wrong - 1]) & (begun[wrong - 1] == ends[wrong - 1]) & (ends[wrong - 1] != 0)]
        ahead = (held[:, None] + np.arange(1, spread)).ravel()
        guess = np.repeat(wanted[held], spread - 1)
        keep = (ahead < lanes) & ~np.isin(ahead, wrong)
        ahead, first = np.unique(ahead[keep], return_index=True)
        lane, state = np.concatenate([wrong, ahead]), np.concatenate([wanted[wrong], guess[keep][first]])
        spread = min(2 * spread, lanes)
        begun[lane] = state
        for t in range(length):
            new = scanner.step.take(state * n + classes[t, lane])
            state = new & mask
            on = state != got[t, lane] & mask
            got[t, lane] = new
            if not on.all():
                lane, state = lane[on], state[on]
                if not lane.size:
                    break
    flat = got.T.ravel()[: len(data)]
    at = np.flatnonzero(flat > mask)
    return at, flat[at] >> 20


def _start(scanner: Scanner, rule: int, text: bytes, end: int, low: int) -> int:
    """The leftmost start from ``low`` on of the rule's match that ends at ``end``, or -1."""
    classes, move, accept, dead = scanner.back[rule]
    state, found, i = 0, -1, end
    while i > low:
        i -= 1
        state = move[state][classes[text[i]]]
        if accept[state]:
            found = i
        elif state == dead:
            break
    return found


def _kept(rules: tuple, rule: int, match: bytes) -> bool:
    _, _, least, value = rules[rule]
    if len(match) < least:
        return False
    if value:  # the value is what follows the first separator, spaces and at most one quote
        cut = min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0)
        rest = match[cut + 1 :].lstrip(b" ")
        return len(rest[1:] if rest[:1] in (b'"', b"'") else rest) >= value
    return True


def scan_texts(scanner: Scanner, texts: list[bytes | None]) -> list[list[tuple[int, int, int]]]:
    """For each UTF-8 text its spans (rule, start, end) in code points, by start, then rule."""
    texts = [t or b"" for t in texts]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not any(texts):
        return found
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    at, bits = ends_of(scanner, data)
    docs = np.searchsorted(offsets, at, side="right") - 1
    last: dict[tuple[int, int], int] = defaultdict(int)
    spans: dict[int, list] = defaultdict(list)
    for d, e, b in zip(docs.tolist(), (at - offsets[docs]).tolist(), bits.tolist()):
        for rule in range(len(scanner.rules)):
            if b >> rule & 1 and (s := _start(scanner, rule, texts[d], e, last[d, rule])) >= 0:
                last[d, rule] = e
                if _kept(scanner.rules, rule, texts[d][s:e]):
                    spans[d].append((s, rule, e))
    for d, got in spans.items():
        before = np.concatenate([[0], np.cumsum((np.frombuffer(texts[d], dtype=np.uint8) & 0xC0) != 0x80)])
        found[d] = [(rule, int(before[s]), int(before[e])) for s, rule, e in sorted(got)]
    return found


SPANS = "spans array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, rules: tuple = RULES, text: str = "text") -> DataFrame:
    """``docs`` with a column ``spans`` of (kind, start, end); a clashing column of that name is replaced."""
    docs = docs.drop("spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    shipped = docs.sparkSession.sparkContext.broadcast(compile_rules(rules))  # a few megabytes, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shipped.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                texts = part.column(part.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
                spans = [[{"kind": rules[r][0], "start": s, "end": e} for r, s, e in x] for x in scan_texts(scanner, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], names=[*part.schema.names, "spans"])

    return map_texts(docs, run, StructType([*docs.schema.fields, *StructType.fromDDL(SPANS).fields]))


def digest(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The contract's columns, from :func:`find_secrets`."""
    kinds = [r[0] for r in rules[:BASE]]
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return find_secrets(docs.select("doc_id", "text"), rules).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(kinds))), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` in ``text``; overlapping spans become one. Same columns, same rows."""
    columns = docs.columns
    where = columns.index("text")

    shipped = docs.sparkSession.sparkContext.broadcast(compile_rules(rules))  # a few megabytes, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shipped.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                raw = part.column(where).cast(pa.large_binary()).to_pylist()
                texts = part.column(where).to_pylist()
                for i, spans in enumerate(scan_texts(scanner, raw)):
                    if spans:
                        out, end = [], 0
                        for _, s, e in spans:
                            if s >= end:
                                out += [texts[i][end:s], mark]
                            end = max(end, e)
                        texts[i] = "".join(out) + texts[i][end:]
                arrays = list(part.columns)
                arrays[where] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_texts(docs, run, docs.schema)
