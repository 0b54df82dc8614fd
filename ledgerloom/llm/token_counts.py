"""Token counts by a compiled finite-state tokenizer (operator 2).

A SentencePiece BPE vocabulary is compiled, lazily, into a deterministic
transducer that reads one character a step and emits the change of the token
count. It rests on two facts about BPE merging:

* a sequence of tokens is an encoding exactly if every two neighbours, merged
  on their own, stay the two; so the last token of a prefix's encoding is the
  one suffix that is compatible with the last token before it;
* no token is longer than ``L``, so only the prefixes that end less than ``L``
  characters back, at a place where a token may still begin, matter.

A state is that finite list: for each place where a token may have begun, the
place in the vocabulary's trie, the last token before it and the tokens up to
it, relative to now. Where no token can span two characters the list forgets
what came before: the state is *reset*. Characters outside the vocabulary
emit one token a UTF-8 byte and reset.

A bar (a blank) after another character resets the state whatever it was. So
a text is cut there, and the state map of such a run is constant: a number of
tokens. Constant maps compose by addition, in one prefix sum over a whole
slice of texts; distinct runs are looked up once a slice and memoised, with a
bound.

A run longer than ``CHUNK`` is cut into chunks. A chunk's map takes a state at
its entry to the tokens it emits and the state at its exit; it is known for
the states that were reached so far, first for the one that the characters
before the chunk suggest. Maps compose pairwise, in a balanced tree. From
another entry state a chunk is run only until it meets a state that it has
been in at the same place; from there on the tokens are known.

Defined results: null counts as empty, with 0 bytes and 0 tokens; repeated
rows are counted alike; a null ``doc_id`` is kept; empty tables give no rows;
other columns are ignored. A long text is counted by one task.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table
from .textvec import parts

CONTEXT = 4096
CHUNK = 1 << 16
#: Text counted at once; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Runs that are remembered, and compiled steps; when full, they are forgotten and compiled anew.
MEMO = 800_000
STEPS = 1_000_000
#: Characters between the states that a chunk remembers.
MARK = 64
_BAR = "▁"


class Transducer:
    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if train.model_type != 2 or not train.byte_fallback or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or kinds & {4, 5} or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, no normalisation and no user-defined pieces are compiled")
        del sentencepiece
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.trie: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in self.score:
            node = 0
            for c in p:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.piece.append(None)
                node = self.trie[node][c]
            self.piece[node] = p
        self.joint = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self._fresh()
        # with none of these, a bar always starts a new run after another character
        self.bar_resets = not any(a != _BAR and b == _BAR for a, b in self.joint)

    def _fresh(self) -> None:
        self.states: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.steps: dict[int, int] = {}  # state and character in one number -> next state and tokens in one
        self.start = self._state(START)

    def _state(self, config: tuple) -> int:
        if config not in self.states:
            self.states[config] = len(self.configs)
            self.configs.append(config)
        return self.states[config]

    def merge(self, text: str) -> list[str]:
        """The BPE merges of a short text, by their definition."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = self.merge(left + right) == ([left, right] if left else [right])
        return self.fits[key]

    def step(self, state: int, c: str) -> tuple[int, int]:
        """Next state and change of the count; compiled when first needed."""
        if c not in self.trie[0]:
            return self.start, len(c.encode())
        config = self.configs[state]
        grown = [(self.trie[node][c], before, n) for node, before, n in config if c in self.trie[node]]
        last, count = next((self.piece[node], n + 1) for node, before, n in grown if self.piece[node] is not None and self.compatible(before, self.piece[node]))
        after = [(node, before, n - count) for node, before, n in grown if self.trie[node]]
        return self._state((*[x for x in after], (0, last, 0))), count

    def run(self, config: tuple, text: str) -> tuple[tuple, int]:
        """From one state (as its list) through a text: the state at the end and the tokens emitted."""
        if len(self.steps) > STEPS:
            self._fresh()
        state, total, steps = self._state(config), 0, self.steps
        for o in map(ord, text):
            got = steps.get(state << 21 | o)
            if got is None:
                following, n = self.step(self._forget(state, chr(o)), chr(o))
                got = steps[state << 21 | o] = following << 16 | n + 0x8000
            state = got >> 16
            total += (got & 0xFFFF) - 0x8000
        return self.configs[state], total

    def _forget(self, state: int, c: str) -> int:
        """The state without the last token, if no token spans it and ``c``."""
        *rest, (node, last, n) = self.configs[state]
        if last and last[-1] + c not in self.joint:
            return self.start
        return state

    def count_run(self, run: str, chunk: int = CHUNK) -> int:
        """Tokens of one run: its chunks' maps, joined in a balanced tree."""
        maps: list = [Chunk(self, run, i, min(i + chunk, len(run))) for i in range(0, len(run), chunk)]
        while len(maps) > 1:
            maps = [Pair(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0](START)[1]

    def count(self, text: str, memo: dict, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        total = 0
        for run in _RUN.findall(_BAR + text.replace(" ", _BAR)):
            if run not in memo:
                if len(memo) > MEMO:
                    memo.clear()
                memo[run] = self.count_run(run, chunk)
            total += memo[run]
        return total


class Chunk:
    """The state map of ``run[begin:end]``."""

    def __init__(self, machine: Transducer, run: str, begin: int, end: int):
        self.machine = machine
        self.pieces = [run[i : min(i + MARK, end)] for i in range(begin, end, MARK)]
        self.known: dict[tuple, tuple[tuple, int]] = {}
        #: for each place between pieces: state there -> (state at the exit, tokens up to it)
        self.marks: list[dict] = [{} for _ in self.pieces]
        if len(run) > end - begin:
            self(machine.run(START, run[max(0, begin - MARK) : begin])[0])

    def __call__(self, entry: tuple) -> tuple[tuple, int]:
        if entry not in self.known:
            state, way, done = entry, [], None
            for k, piece in enumerate(self.pieces):
                done = self.marks[k].get(state)
                if done:
                    break
                way.append((k, state))
                state, n = self.machine.run(state, piece)
                way[-1] += (n,)
            out, total = done or (state, 0)
            for k, at, n in reversed(way):
                total += n
                self.marks[k][at] = out, total
            self.known[entry] = out, total
        return self.known[entry]


class Pair:
    """One map after another."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.known: dict[tuple, tuple[tuple, int]] = {}

    def __call__(self, entry: tuple) -> tuple[tuple, int]:
        if entry not in self.known:
            middle, n = self.a(entry)
            out, m = self.b(middle)
            self.known[entry] = out, n + m
        return self.known[entry]


#: The state before any character.
START = ((0, "", 0),)
# a bar after another character starts a run whatever the state: see bar_resets
_RUN = re.compile(f"{_BAR}*[^{_BAR}]+|{_BAR}+")


class Counter:
    """Counts of whole slices of texts."""

    def __init__(self, model_file: str):
        self.machine = Transducer(model_file)
        if not self.machine.bar_resets:
            raise ValueError("a piece spans a word's end; its runs can't be cut there")
        self.memo: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.words, self.tokens = pa.array([], pa.large_string()), np.empty(0, np.int64)

    def _known(self, words: pa.Array) -> np.ndarray:
        """Tokens of distinct words, each with a bar before it."""
        if len(self.words) + len(words) > MEMO:
            self._forget()
        at = pc.index_in(words, value_set=self.words)
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            new = words.filter(at.is_null())
            fresh = np.array([self.machine.count_run(_BAR + w) for w in new.to_numpy(zero_copy_only=False)], np.int64)
            out[out < 0] = np.arange(len(self.words), len(self.words) + len(new))
            self.words, self.tokens = pa.concat_arrays([self.words, new]), np.concatenate((self.tokens, fresh))
        return self.tokens[out]

    def counts(self, text: pa.Array) -> np.ndarray:
        out = np.zeros(len(text), np.int64)
        # single blanks between words: the runs are the words; other texts are cut one by one
        odd = pc.match_substring_regex(text, f"^ |  | $|{_BAR}").to_numpy(zero_copy_only=False)
        empty = pc.equal(text, "").to_numpy(zero_copy_only=False)
        plain = text.filter(pa.array(~odd & ~empty))
        if len(plain):
            words = pc.split_pattern(plain, " ")
            coded = words.flatten().dictionary_encode()
            total = np.concatenate(([0], np.cumsum(self._known(coded.dictionary)[coded.indices.to_numpy()])))
            out[~odd & ~empty] = np.diff(total[np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))])
        for k in np.flatnonzero(odd):
            out[k] = self.machine.count(text[int(k)].as_py(), self.memo)
        return out


@functools.cache
def _counter(model_file: str) -> Counter:
    """One compiled machine and memo for each Python worker, kept between its tasks."""
    return Counter(model_file)


def token_counts(docs: DataFrame, model_file: str, context: int = CONTEXT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for batch in batches:
            for part in parts(batch, max_bytes=SLICE_BYTES):
                n = counter.counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(part.column("text")), pa.array(n), pa.array(n > context)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op2_token_counts": op2_token_counts}
SQL: dict[str, str] = {}
