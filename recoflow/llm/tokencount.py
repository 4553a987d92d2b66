"""Operator 3: token counts by compiled finite-state transducers.

Two deterministic machines run one after the other.

* The cutting machine reads classes of code points and tells where a piece starts.
  A block is split into chunks; for every chunk the map from each possible state at
  its start to the state at its end is computed, all chunks in step; the maps are
  composed by a parallel prefix scan, which gives the true state at each chunk start.

* The merging machine reads the bytes of a piece.  Its transitions carry the number
  of tokens that the encoding of the prefix gains (or loses) by the byte, so the
  count of a piece is the sum along its path.  A state holds, for every suffix of
  the prefix that some longer token may still extend, the last token of the encoding
  before that suffix and the token count since then; this decides all later
  behaviour.  Transitions are compiled when first needed, for all pieces in step.

  A long piece is cut into chunks too.  The machine has too many states for whole
  maps, so a chunk's map holds the states that it is entered in: first the one that
  the bytes just before the chunk lead to, which is nearly always right, since a state
  looks back no further than tokens reach.  The maps compose from chunk to chunk; one
  that is entered in another state gets that entry added.  Equal chunks share a map.

That a state needs no more than last tokens rests on two facts on merges in rank
order: a cut of an encoding at a token end is the encoding of both sides, and a
sequence is an encoding if each two neighbours are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recoflow.llm.common import small_batches, texts
from recoflow.llm.pieces import LETTER, NUMBER, SPACE, blocks, class_table, code_points, distinct_pieces
from recoflow.llm.shingles import GOLDEN

# --- the cutting machine ---------------------------------------------------------

#: Classes of code points that the byte-level pattern tells apart.
CLASSES = ("blank", "white", "apostrophe", "sign", "digit", "letter", "stmd", "r", "v", "l", "e", "end")
#: start: before a text. A: an apostrophe that begins a piece; AR, AV, AL: and the
#: first letter of a possible contraction; C: a whole contraction. B, W: in white
#: space, its last character a blank or not.
STATES = ("start", "L", "N", "O", "A", "AR", "AV", "AL", "C", "B", "W")
HERE, BEFORE = 1, 2
#: Code point that stands between texts; no text holds it.
END = 0x110000
CHUNK = 512


@lru_cache(1)
def cutting_machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each code point, next state, output) of the cutting machine; the
    output says whether a piece starts here, and at the character before."""
    of = {c: k for k, c in enumerate(CLASSES)}
    kinds = class_table()
    table = np.full(END + 1, of["sign"], np.uint8)
    for kind, name in ((LETTER, "letter"), (NUMBER, "digit"), (SPACE, "white")):
        table[:END][kinds == kind] = of[name]
    table[0x20], table[0x27], table[END] = of["blank"], of["apostrophe"], of["end"]
    for letters, name in (("stmd", "stmd"), *((c, c) for c in "rvle")):
        table[[ord(c) for c in letters]] = of[name]
    state = {s: k for k, s in enumerate(STATES)}
    after, output = np.zeros((len(STATES), len(CLASSES)), np.uint8), np.zeros((len(STATES), len(CLASSES)), np.uint8)
    run_of = {"blank": "B", "white": "W", "apostrophe": "A", "sign": "O", "digit": "N"}
    for s in STATES:
        for c in CLASSES:
            run = run_of.get(c, "L")
            out = HERE
            if c == "end":
                run, out = "start", 0
            elif s in ("B", "W") and run in ("B", "W"):
                out = 0
            elif s in ("B", "W"):  # the last white character leaves its run
                out = BEFORE if s == "B" else BEFORE | HERE
                run = "O" if s == "B" and run == "A" else run
            elif s == "A" and run == "L":
                run, out = {"stmd": ("C", 0), "r": ("AR", 0), "v": ("AV", 0), "l": ("AL", 0)}.get(c, ("L", HERE))
            elif s in ("A", "O") and run in ("A", "O"):
                run, out = "O", 0
            elif s in ("AR", "AV", "AL"):
                if c == ("l" if s == "AL" else "e"):
                    run, out = "C", 0
                else:
                    out = BEFORE if run == "L" else BEFORE | HERE
            elif s == run:
                out = 0
            if c == "end" and s in ("AR", "AV", "AL"):
                out = BEFORE
            after[state[s], of[c]], output[state[s], of[c]] = state[run], out
    return table, after, output


def cut(cps: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point of texts that END separates."""
    table, after, output = cutting_machine()
    n, states = len(cps), len(STATES)
    chunks = max(1, -(-n // CHUNK))
    kinds = np.full(chunks * CHUNK, CLASSES.index("end"), np.uint8)
    kinds[:n] = table[cps]
    kinds = np.ascontiguousarray(kinds.reshape(chunks, CHUNK).T)
    flat, k = after.ravel(), np.intp(len(CLASSES))
    maps = np.broadcast_to(np.arange(states, dtype=np.intp), (chunks, states))
    for column in kinds:
        maps = flat[maps * k + column[:, None]].astype(np.intp)
    step = 1
    while step < chunks:  # inclusive scan: maps[i] becomes the map of chunks 0..i
        later = np.take_along_axis(maps[step:], maps[:-step], 1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.concatenate([[0], maps[:-1, 0]]).astype(np.intp)
    out = np.empty((CHUNK, chunks), np.uint8)
    flat_out = output.ravel()
    for j, column in enumerate(kinds):
        at = state * k + column
        out[j] = flat_out[at]
        state = flat[at].astype(np.intp)
    out = out.T.ravel()[:n]
    starts = (out & HERE) > 0
    starts[:-1] |= (out[1:] & BEFORE) > 0
    return starts


# --- the merging machine ---------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1
    ones for themselves, the others for the rest from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 32]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


#: State before a piece: (trie node, last token, tokens since) of each suffix alive.
ROOT = ((0, -1, 0),)
#: Runs in step, and bytes before a chunk that lead to the state it is entered in.
ROWS, WARM_UP = 8192, 64
#: Pieces whose counts a machine remembers, and bytes of the longest of these.
MEMORY, REMEMBERED = 1_000_000, 64


class Transitions:
    """Open-addressed table from (state, byte) to the next state and the tokens gained, with
    room for four transitions a state and more: few bytes are ever met in one."""

    def __init__(self, states: int):
        self.bits = (8 * states + 4 * ROWS).bit_length()
        self.keys = np.zeros(1 << self.bits, np.int64)  # 0: free, since a key is one more
        self.after = np.zeros(1 << self.bits, np.int32)
        self.gain = np.zeros(1 << self.bits, np.int16)
        self.size = 0

    def full(self) -> bool:
        return 2 * self.size > len(self.keys)

    def slots(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each pair stands or would go, which ones are not there)."""
        key = (state.astype(np.int64) << 8 | byte) + 1
        slot = (key.astype(np.uint64) * GOLDEN >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        rest = np.flatnonzero((found != key) & (found != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            found[rest] = self.keys[slot[rest]]
            rest = rest[(found[rest] != key[rest]) & (found[rest] != 0)]
        return slot, np.flatnonzero(found == 0)

    def add(self, state: int, byte: int, after: int, gain: int) -> None:
        key = (state << 8 | byte) + 1
        slot = (key * int(GOLDEN) & (1 << 64) - 1) >> 64 - self.bits
        while self.keys[slot]:
            slot = (slot + 1) & (len(self.keys) - 1)
        self.keys[slot], self.after[slot], self.gain[slot] = key, after, gain
        self.size += 1


class MergingMachine:
    """Lazily compiled transducer from the bytes of a piece to its token count."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], max_states: int = 250_000, memory: int = MEMORY):
        alphabet = byte_alphabet()
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for rank, (a, b) in enumerate(merges):
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank[left, right] = rank
            if token in self.parts:
                raise ValueError("two merges give one token")
            self.parts[token] = left, right, rank
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        made = set(self.parts) | {vocab[c] for c in alphabet}
        for text, token in vocab.items():
            if token in made:
                node = 0
                for c in text:
                    key = node << 8 | alphabet[c]
                    if key not in self.trie:
                        self.trie[key] = len(self.token_at)
                        self.token_at.append(-1)
                    node = self.trie[key]
                self.token_at[node] = token
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.max_states, self.memory = max_states, memory
        self.known: dict[bytes, int] = {}  # token counts of pieces
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.transitions = Transitions(self.max_states)
        self._number(ROOT)

    def _number(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at the left (0) or right (1) edge while ``token`` is built, each with
        the rank of the merge that takes it up."""
        if (token, side) not in self.spines:
            found, taken, t = [], float("inf"), token
            while True:
                found.append((t, taken))
                if t not in self.parts:
                    break
                taken, t = self.parts[t][2], self.parts[t][side]
            self.spines[token, side] = found
        return self.spines[token, side]

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of its bytes: no merge ever joins a token at the
        right edge of a to one at the left edge of b.  Equal ranks go leftmost first."""
        if (a, b) not in self.fits:
            if len(self.fits) > 500_000:
                self.fits.clear()
            rank = self.pair_rank.get
            self.fits[a, b] = not any((q := rank((x, y))) is not None and q < taken_x and q <= taken_y for x, taken_x in self._spine(a, 1) for y, taken_y in self._spine(b, 0))
        return self.fits[a, b]

    def _compile(self, state: int, byte: int) -> None:
        alive, last, gain = [], None, 0
        for node, before, count in self.keys[state]:
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            alive.append((child, before, count))
            token = self.token_at[child]
            if last is None and token >= 0 and (before < 0 or self._neighbours(before, token)):
                last, gain = token, count + 1
        key = (*((node, before, count - gain) for node, before, count in alive), (0, last, 0))
        self.transitions.add(state, byte, self._number(key), gain)

    def _full(self) -> bool:
        return len(self.keys) > self.max_states or self.transitions.full()

    def known_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Token counts of these pieces; those of about ``memory`` usual ones are remembered,
        so a piece that recurs from block to block runs through the machine once."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.memory:
            self.known, new = {}, pieces
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        counts = self.counts(np.frombuffer(b"".join(new), np.uint8), np.cumsum(lengths) - lengths, lengths).tolist()
        here = dict(zip(new, counts, strict=True))
        self.known.update((p, n) for p, n in here.items() if len(p) <= REMEMBERED)
        return np.fromiter((self.known[p] if p in self.known else here[p] for p in pieces), np.int64, len(pieces))

    def counts(self, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Token counts of the pieces data[begin : begin + length]."""
        out, long = np.zeros(len(begin), np.int64), lengths > 2 * CHUNK
        usual = np.flatnonzero(~long)
        usual = usual[np.argsort(-lengths[usual], kind="stable")]
        for k in range(0, len(usual), ROWS):
            some = usual[k : k + ROWS]
            out[some] = self._run(data, begin[some], lengths[some], None)[0]
        for i in np.flatnonzero(long):
            out[i] = self._long(data[begin[i] : begin[i] + lengths[i]])
        return out

    def _long(self, piece: np.ndarray) -> int:
        """Token count of one long piece, by the maps of its chunks."""
        starts = np.arange(0, len(piece), CHUNK)
        lengths = np.minimum(CHUNK, len(piece) - starts)
        content = [piece[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        maps: dict[bytes, dict[tuple, tuple[int, tuple]]] = {c: {} for c in content}

        def enter(chunks: np.ndarray, states: list[tuple]) -> None:
            gains, ends = self._run(piece, starts[chunks], lengths[chunks], states)
            for c, state, gain, end in zip(chunks.tolist(), states, gains.tolist(), ends, strict=True):
                maps[content[c]][state] = gain, end

        for k in range(0, len(starts), ROWS):
            chunks = np.arange(k, min(k + ROWS, len(starts)))
            ahead = np.minimum(WARM_UP, starts[chunks])
            new, seen = [], set()
            for c, state in zip(chunks.tolist(), self._run(piece, starts[chunks] - ahead, ahead, [ROOT] * len(chunks))[1], strict=True):
                if (content[c], state) not in seen:
                    seen.add((content[c], state))
                    new.append((c, state))
            new.sort(key=lambda x: -lengths[x[0]])
            enter(np.array([c for c, _ in new]), [state for _, state in new])
        total, state = 0, ROOT
        for c in range(len(starts)):
            if state not in maps[content[c]]:
                enter(np.array([c]), [state])
            gain, state = maps[content[c]][state]
            total += gain
        return total

    def _run(self, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray, states: list[tuple] | None) -> tuple[np.ndarray, list[tuple]]:
        """(token counts gained, states left in) of runs over data[begin : begin + length];
        lengths descend.  Without ``states`` all begin at the root and no states are given."""
        if self._full():
            self._clear()
        state = np.zeros(len(begin), np.int32) if states is None else np.fromiter(map(self._number, states), np.int32, len(begin))
        total = np.zeros(len(begin), np.int64)
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
        for p, n in enumerate(active):
            if self._full():  # compile anew what the runs are in
                used, at = np.unique(state, return_inverse=True)
                kept = [self.keys[s] for s in used.tolist()]
                self._clear()
                state = np.fromiter(map(self._number, kept), np.int32, len(kept))[at]
            now, byte = state[:n], data[begin[:n] + p]
            slot, missing = self.transitions.slots(now, byte)
            if len(missing):
                for pair in np.unique(now[missing].astype(np.int64) << 8 | byte[missing]).tolist():
                    self._compile(pair >> 8, pair & 255)
                slot[missing] = self.transitions.slots(now[missing], byte[missing])[0]
            total[:n] += self.transitions.gain[slot]
            state[:n] = self.transitions.after[slot]
        return total, [] if states is None else [self.keys[s] for s in state.tolist()]


class TokenCounter:
    """Counts the tokens of whole texts as the library does for a byte-level file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.machine = MergingMachine(spec["model"]["vocab"], merges)
        #: Strings that the library takes out of a text and counts as one token each.
        self.special = [t["content"] for t in spec["added_tokens"]]

    def block(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                if s in text:
                    pieces = [p for piece in pieces for p in piece.split(s)]
                    extra[i] += len(pieces) - 1 - extra[i]
            parts += pieces
            owner += [i] * len(pieces)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        joined = "\0".join(parts)
        cps = code_points(joined).copy()
        ends = np.cumsum(sizes + 1) - 1
        cps[ends[:-1]] = END
        starts = cut(np.append(cps, np.uint32(END)))
        begin = np.flatnonzero(starts)
        if not len(begin):
            return extra
        part = np.searchsorted(ends, begin)
        end = np.minimum(np.append(begin[1:], len(cps)), ends[part])
        codes, first = distinct_pieces(cps, begin, end)
        tokens = self.machine.known_counts([joined[a:b].encode() for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
        return extra + np.bincount(np.array(owner)[part], tokens[codes], len(texts)).astype(np.int64)


@lru_cache(2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty (0 tokens).  Rows map one to one: repeated rows and
    null doc_ids stay, an empty table stays empty, further columns are dropped.  Memory
    grows with the longest text only; the compiled states are bounded.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            n_bytes = np.fromiter((len(t.encode()) for t in rows), np.int64, len(rows))
            n_tokens = np.concatenate([np.zeros(0, np.int64), *(counter.block(rows[a:b]) for a, b in blocks(rows))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
