"""Token counts by a finite-state transducer compiled from a BPE piece vocabulary.

Greedy merging by score gives every prefix of a text one last token, and a token sequence is the greedy one exactly if each
neighbouring pair is. So reading a character only needs, for each suffix that may still grow into a piece, the token before
that suffix and its distance in tokens. These tuples are the states of a deterministic transducer; a transition carries the
number of tokens that the longer prefix has more. States are made when first met and kept, as in lazy determinisation.

A chunk's state map is a function from the state before the chunk to the state behind it and the tokens gained. It is held as
what was read from the start state: from another state only the first characters are read again, until both readings are in one
state. No piece holds a space mark behind another character, so each such boundary is one known state for all readings, and a
map is constant from its first boundary on. Maps compose associatively at any cut point, also inside words.

Every text is cut into chunks. The map of a text's only chunk gives its count at once. The chunks of longer texts are rows of
their own: tasks all over the cluster turn chunks into maps, and groups of neighbouring maps are composed, level by level, up
to one map for each text, as in a parallel prefix scan.

Defined cases: null and empty texts have 0 tokens; repeated rows are counted each (equal chunks of equal rows are read once,
with the number of rows beside them); a null id stays null; other columns of the input are dropped; an empty table gives an
empty result. Texts have no length limit; a word's cost is linear in its length, and states made are dropped beyond a fixed
number, also within a word. A map travels with the characters before its first boundary, so the last task of a text without any
space holds that text once, as the scan did.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_texts, store

MARK = "▁"
CHUNK = 1 << 16
#: Neighbouring maps that one step composes.
FAN = 64
#: Words and merges, and states and transitions, that a worker keeps before it begins anew.
KEEP, KEEP_STATES, KEEP_MOVES = 500_000, 200_000, 800_000
#: Characters after which two readings are compared.
STEP = 64
#: A state: for each suffix that is empty or begins a piece, (suffix, token before it, tokens up to there, relative).
State = tuple[tuple[str, str, int], ...]
START: State = (("", "", 0),)
#: A word; between two of them lies a boundary, before a mark that follows another character.
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Transducer:
    """Counts the tokens of words; a word is a run of space marks and the characters up to the next one."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.prefixes = {p[:k] for p in scores for k in range(1, len(p))}
        self.inner = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}
        self.line_alone = not any("\n" in p for p in scores)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[State, int] = {START: 0}
        self.states = [START]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.compiled = 0

    def number(self, state: State) -> int:
        got = self.ids.get(state)
        if got is None:
            got = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return got

    def fits(self, left: str, token: str) -> bool:
        """Whether greedy merging of ``left + token`` ends in these two: again and again the best-scored neighbouring pair
        that forms a piece is merged, the leftmost of equals."""
        known = self.pairs.get((left, token))
        if known is not None:
            return known
        score, none = self.scores.get, float("-inf")
        parts, border = list(left + token), len(left)
        values = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        fit = True
        while values and (best := max(values)) > none:
            i = values.index(best)
            if i == border - 1:
                fit = False
                break
            border -= i < border
            parts[i] += parts.pop(i + 1)
            del values[i]
            if i:
                values[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(values):
                values[i] = score(parts[i] + parts[i + 1], none)
        fit = fit and len(parts) == 1 + bool(left)
        if len(self.pairs) > KEEP:
            self.pairs.clear()
        self.pairs[left, token] = fit
        return fit

    def width(self, token: str) -> int:
        """Tokens that stand for one merged symbol: itself, or the bytes of a character without a piece."""
        return 1 if token in self.scores else len(token.encode("utf-8", "surrogatepass"))

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition of ``state`` on ``char``: next state and tokens gained."""
        entries, scores, prefixes = self.states[state], self.scores, self.prefixes
        for suffix, before, count in entries:
            token = suffix + char
            if (not suffix or token in scores) and self.fits(before, token):
                gained = count + self.width(token)
                break
        else:
            raise AssertionError("greedy merging gives each prefix a last token")
        new = (("", token, 0), *[(s + char, before, count - gained) for s, before, count in entries if s + char in prefixes])
        move = self.moves[state][char] = (self.number(new), gained)
        self.compiled += 1
        return move

    def run(self, text: str, state: State = START) -> tuple[State, int]:
        """Reads ``text``; the state reached and the tokens gained."""
        total, at, moves = 0, self.number(state), self.moves
        for char in text:
            move = moves[at].get(char)
            if move is None:
                if len(self.states) > KEEP_STATES or self.compiled > KEEP_MOVES:
                    state = self.states[at]
                    self.clear()
                    at, moves = self.number(state), self.moves
                move = self.compile(at, char)
            at, gained = move
            total += gained
        return self.states[at], total


class Counts(dict):
    """Tokens of whole words, read by the transducer when first met."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) > KEEP:
            self.clear()
        if "\n" in word and self.transducer.line_alone:  # a line feed is in no piece, so nothing merges across it
            return word.count("\n") * self.transducer.width("\n") + sum(self[x] for x in word.split("\n") if x)
        n = self.transducer.run(word)[1]
        if len(word) <= 64:
            self[word] = n
        return n


class Reading:
    """The map of a stretch without a boundary: the state and tokens when read from the start state."""

    def __init__(self, text: str, transducer: Transducer, read: tuple[State, int] | None = None) -> None:
        self.text, self.transducer = text, transducer
        self.exit, self.total = read or transducer.run(text)

    def __call__(self, state: State) -> tuple[State, int]:
        start, lead = START, 0
        for i in range(0, len(self.text), STEP):
            if state == start:
                return self.exit, self.total + lead
            part = self.text[i : i + STEP]
            state, n = self.transducer.run(part, state)
            start, known = self.transducer.run(part, start)
            lead += n - known
        return state, self.total + lead


@dataclass(frozen=True)
class Map:
    """From the state before a chunk to the state behind it and the tokens gained: the readings up to the first boundary, and
    if there is one (``exit`` isn't None), the tokens from there on and the state at the end."""

    head: tuple[Reading, ...]
    tokens: int = 0
    exit: State | None = None

    def __call__(self, state: State) -> tuple[State, int]:
        total = self.tokens
        for reading in self.head:
            state, n = reading(state)
            total += n
        return (state if self.exit is None else self.exit), total


def chunk_map(text: str, counts: Counts) -> Map:
    """``text`` has space marks for spaces."""
    units = UNIT.findall(text)
    if not units:
        return Map(())
    head = (Reading(units[0], counts.transducer),)
    if len(units) == 1:
        return Map(head)
    end, last = counts.transducer.run(units[-1])
    return Map(head, sum(map(counts.__getitem__, units[1:-1])) + last, end)


def compose(a: Map, b: Map) -> Map:
    """First ``a``, then ``b``."""
    if a.exit is None:
        return Map(a.head + b.head, a.tokens + b.tokens, b.exit)
    end, n = b(a.exit)
    return Map(a.head, a.tokens + n, end)


def compose_all(maps: list[Map]) -> Map:
    while len(maps) > 1:  # one level of the scan: neighbours compose, whatever stands before them
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def packed(m: Map) -> bytes:
    return pickle.dumps(([(r.text, (r.exit, r.total)) for r in m.head], m.tokens, m.exit))


def unpacked(data: bytes, transducer: Transducer) -> Map:
    head, tokens, end = pickle.loads(data)
    return Map(tuple(Reading(text, transducer, read) for text, read in head), tokens, end)


def marked(chunk: str, part: int) -> str:
    """The ``part``-th chunk of a text with space marks, and the mark before the text's first."""
    return MARK * (part == 0) + chunk.replace(" ", MARK)


def count_text(text: str | None, counts: Counts, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    return compose_all([chunk_map(marked(text[i : i + chunk], i), counts) for i in range(0, len(text), chunk)])(START)[1]


@lru_cache(maxsize=2)
def load(model_file: str) -> Transducer:
    """The pieces of a sentencepiece BPE model that merging may form, with their scores."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only BPE models with plain text, kept spaces and a leading space mark can be compiled")
    scores = {p.piece: p.score for p in model.pieces if p.type == 1}
    if any(MARK in p.lstrip(MARK) for p in scores):
        raise ValueError("pieces with inner space marks can't be compiled")
    return Transducer(scores)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_texts(docs: DataFrame, text: str, chunk: int, model_file: str | None) -> DataFrame:
    """``doc_id, n_bytes`` and the tokens of each text of one chunk; a longer text's chunks by its digest and their number."""

    def rows(ids: list, sizes: list, texts: list, counts: Counts) -> Iterator[tuple]:
        for doc, size, t in zip(ids, sizes, texts):
            if len(t or "") <= chunk:
                yield doc, size, count_text(t, counts, chunk), None, None, None
            else:
                digest = hashlib.blake2b(t.encode(), digest_size=16).digest()
                for i in range(0, len(t), chunk):
                    yield doc, size, None, digest, i // chunk, t[i : i + chunk]

    names = ["doc_id", "n_bytes", "n_tokens", "digest", "part", "chunk"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(load(model_file or default_model()))
        for batch in batches:
            got = rows(*(c.to_pylist() for c in batch.columns), counts)
            while some := list(islice(got, 128)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), F.col(text).alias("text"))
    return map_texts(rows_in, run, "doc_id long, n_bytes long, n_tokens long, digest binary, part int, chunk string")


def count_long(chunks: DataFrame, fan: int, model_file: str | None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of texts of several chunks: a map for each chunk, then levels of composed neighbours."""
    last = chunks.agg(F.max("part")).first()[0]
    keys = ["doc_id", "n_bytes", "digest", "rows"]
    names = [*keys, "part", "map", "n_tokens"]
    schema = "doc_id long, n_bytes long, digest binary, rows long, part int, map binary, n_tokens long"

    def step(make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = Counts(load(model_file or default_model()))
            for batch in batches:
                maps = [make(item.as_py(), part.as_py(), counts) for item, part in zip(batch.column(5), batch.column(4))]
                more = [pa.array([packed(m) for m in maps], pa.binary()), pa.array([m(START)[1] for m in maps], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=names)

        return run

    of_chunk = step(lambda chunk, part, counts: chunk_map(marked(chunk, part), counts))
    of_group = step(lambda maps, part, counts: compose_all([unpacked(m["map"], counts.transducer) for m in maps]))

    # equal rows have equal chunks, and so does any try of a task that is run again
    single = chunks.groupBy("doc_id", "n_bytes", "digest", "part", "chunk").agg(F.count("*").alias("rows"))
    maps = map_texts(single.select(*keys, "part", "chunk"), of_chunk, schema)
    while last:
        last //= fan
        neighbours = F.sort_array(F.collect_list(F.struct("part", "map"))).alias("maps")
        groups = maps.groupBy(*keys, F.floor(F.col("part") / fan).cast("int").alias("group")).agg(neighbours)
        maps = map_texts(groups, of_group, schema)
    return maps.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")


def count_tokens(docs: DataFrame, model_file: str | None = None, text: str = "text", chunk: int = CHUNK, limit: int = 4096, fan: int = FAN) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, a row for each document. One pass over the texts; only chunks of texts that
    have several are shuffled."""
    read = store(read_texts(docs, text, chunk, model_file))
    done = read.filter("digest is null").select("doc_id", "n_bytes", "n_tokens")
    chunks = read.filter("digest is not null").select("doc_id", "n_bytes", "digest", "part", "chunk")
    return done.unionAll(count_long(chunks, fan, model_file)).withColumn("over_limit", F.col("n_tokens") > limit)
