"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 machine decodes.

The merges are compiled into a trie of tokens and a test that tells whether two tokens may stand
side by side (the merges leave their joined bytes as these two tokens).  A token sequence in which
every neighbouring pair passes that test is the one that the merges give.  Reading a piece byte by
byte, the transducer follows all open readings at once: each is the tokens since the last certain
one and a place in the trie.  Where all readings agree on their first tokens, these are emitted;
as no reading is open for longer than the longest token, so is the lookahead.  A set of readings
is a state; states and their moves are made when needed and are thrown away together when
there are too many, which bounds the memory.  Most pieces are rare, so a move is made when it is needed for the
32nd time; until then, what is left of a piece of at most 64 bytes is followed from its state without making states, the readings of
all new pieces of a step side by side in arrays.  A worker keeps its transducer from task to task.

Defined results: null is the empty text and gives no ids; a null list of ids decodes to the
empty text; ids that do not decode to valid UTF-8 give U+FFFD per maximal broken part.  Unknown ids raise an error.
Columns other than ``doc_id`` and ``text`` (or ``ids``) are not looked at; repeated rows stay.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from itertools import chain, islice
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, rows_of, table, text_steps


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(data: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[int]:
    """The tokens that the merges (of ranks under ``below``) leave of a short byte string, one merge after the other."""
    below = len(ranks) if below is None else below
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def packed(tokens: tuple) -> bytes:
    return pack(f"<{len(tokens)}i", *tokens)


class State(dict):
    """Moves by byte, each (emitted tokens, packed; next state), or how often it was needed; ``last`` is the last emitted token.

    ``heads``, ``nodes`` and ``lefts`` are the readings' packed tokens, places in the trie and last tokens, as ``follow`` takes them.
    """

    __slots__ = ("last", "readings", "heads", "nodes", "lefts")


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_pairs: int = 400_000, needs: int = 32):
        self.ranks, self.max_states, self.max_pairs, self.needs = ranks, max_states, max_pairs, needs
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                edge = node << 8 | byte
                if edge not in self.child:
                    self.child[edge] = len(self.token)
                    self.token.append(None)
                node = self.child[edge]
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple] = {}
        self.trie = Trie(self.child, self.token)
        self.fits = Fits(self)
        self.reset()

    def reset(self) -> None:
        """Throw all states away; they point to each other, so the collector has to look for them."""
        self.states: dict[tuple, State] = {}
        self.first = 0  # moves needed, but not made
        gc.collect()
        self.start = self.state(None, (((), 0),))

    def state(self, last: int | None, readings: tuple) -> State:
        key = (last, readings)
        if key not in self.states:
            made = self.states[key] = State()
            made.last, made.readings = last, readings
            none = len(self.ranks)
            lefts = [tokens[-1] if tokens else last for tokens, _ in readings]
            made.nodes, made.lefts = [node for _, node in readings], [none if left is None else left for left in lefts]
            made.heads = [packed(tokens) for tokens, _ in readings]
        return self.states[key]

    def spines(self, token: int) -> tuple[list, list] | None:
        """The parts at a token's left and right end while it is merged: (bytes, rank that ends the part).

        None for a token that the merges never make.
        """
        if token not in self.edges:
            whole, never = self.bytes_of[token], len(self.ranks)
            if len(whole) == 1:
                found = [(whole, never)], [(whole, never)]
            else:
                parts = merge(whole, self.ranks, token)
                left, right = (self.spines(parts[0]), self.spines(parts[-1])) if len(parts) == 2 else (None, None)
                found = None
                if left and right:
                    found = tuple([*side[:-1], (side[-1][0], token), (whole, never)] for side in (left[0], right[1]))
            self.edges[token] = found
        return self.edges[token]

    def stand(self, left: int | None, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (None: may begin a piece).

        Merges happen in the order of their ranks, so the two tokens come about side by side unless
        the parts that touch each other at some time have a merge that is due before either changes.
        Of equal merges the one further left is first.
        """
        pair = -right - 1 if left is None else left << 32 | right
        if pair not in self.pairs:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            self.pairs[pair] = self.apart(left, right)
        return self.pairs[pair]

    def apart(self, left: int | None, right: int) -> bool:
        right_spine = self.spines(right)
        if right_spine is None or left is None:
            return right_spine is not None
        ends, starts = self.spines(left)[1], right_spine[0]
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = ends[i], starts[j]
            due = self.ranks.get(a + b)
            if due is not None and due < until_a and due <= until_b:
                return False
            if i + 1 == len(ends) and j + 1 == len(starts):
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def move(self, state: State, byte: int) -> tuple[bytes, State]:
        readings, upto_here, last = [], None, state.last
        child, token_of, pairs = self.child, self.token, self.pairs
        for tokens, node in state.readings:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            readings.append((tokens, node))
            if upto_here is None and (token := token_of[node]) is not None:
                left = tokens[-1] if tokens else last
                fits = pairs.get(-token - 1 if left is None else left << 32 | token)
                if self.stand(left, token) if fits is None else fits:
                    upto_here = (*tokens, token)
        sure = 0
        for sign in upto_here:
            if any(len(t) <= sure or t[sure] != sign for t, _ in readings):
                break
            sure += 1
        readings.append((upto_here, 0))
        if sure:
            last = upto_here[sure - 1]
            readings = [(t[sure:], node) for t, node in readings]
        step = state[byte] = (packed(upto_here[:sure]), self.state(last, tuple(readings)))
        return step

    def follow(self, open_at: list[tuple[State, bytes]]) -> tuple[list[int], list[bytes]]:
        """Of each state and all that follows it (not empty): the reading that holds, and its further tokens as packed ids.

        Makes no states.  A place is a boundary of bytes or a reading that is inside a token.  Only one reading ends at each
        boundary, so its last token and the place where that token begins tell all; the boundaries of all texts that are equally far
        from their states are settled together.
        """
        sizes = np.array([len(data) for _, data in open_at])
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        signs = np.empty(ends[-1] + 1, np.int16)
        inside = np.ones(len(signs), bool)
        inside[ends] = False
        signs[inside] = np.frombuffer(b"".join([data for _, data in open_at]), np.uint8)
        signs[ends] = Trie.END
        # the last reading of a state is at a boundary, the others have places of their own after all boundaries
        counts = np.array([len(state.nodes) for state, _ in open_at])
        nodes = np.fromiter(chain.from_iterable([state.nodes for state, _ in open_at]), np.int32)
        lefts = np.fromiter(chain.from_iterable([state.lefts for state, _ in open_at]), np.int64)
        final = np.cumsum(counts) - 1
        other = np.ones(len(nodes), bool)
        other[final] = False
        owner = np.repeat(np.arange(len(counts)), counts)[other]
        boundaries = np.flatnonzero(inside)
        far = (np.arange(len(signs)) - np.repeat(starts, sizes + 1))[inside]
        place, upto, token = self.trie.tokens(
            np.concatenate([boundaries, len(signs) + np.arange(len(owner))]),
            np.concatenate([boundaries, starts[owner]]),
            np.concatenate([np.zeros(len(boundaries), np.int32), nodes[other]]),
            signs,
        )
        level = np.zeros(len(signs) + len(owner), np.min_scalar_type(sizes.max()))  # short numbers sort fastest
        level[boundaries] = far
        last = np.full(len(level), -1, np.int64)
        last[starts], last[len(signs) :] = lefts[final], lefts[other]
        back = np.full(len(level), -1, np.int64)
        order = np.argsort(level[place], kind="stable")
        place, upto, token = place[order], upto[order], token[order]
        cuts = np.cumsum([0, *np.bincount(level[place])])
        for low, high in zip(cuts, cuts[1:]):
            left, right = last[place[low:high]], token[low:high]
            fit = np.flatnonzero(self.fits(left, right) & (left >= 0))  # no reading ends at a place without a last token
            last[upto[low:high][fit]], back[upto[low:high][fit]] = right[fit], place[low:high][fit]
        if (back[ends] < 0).any():
            raise ValueError("a byte without a token")
        taken, at, live = np.zeros(len(signs), bool), ends.copy(), np.arange(len(ends))
        while len(live):
            taken[at[live]] = True
            at[live] = back[at[live]]
            live = live[back[at[live]] >= 0]
        ids = last[: len(signs)][taken].astype("<i4").tobytes()
        upto_piece = (4 * np.cumsum(taken)[ends]).tolist()
        reading = counts - 1
        virtual = np.flatnonzero(at >= len(signs))
        ranks_of_other = np.flatnonzero(other) - (final - counts + 1)[owner]
        reading[virtual] = ranks_of_other[at[virtual] - len(signs)]
        return reading.tolist(), [ids[low:high] for low, high in zip([0, *upto_piece], upto_piece)]

    def walk(self, piece: bytes, short: int) -> tuple[bytes, State, int]:
        """The moves that are made: the tokens emitted, the state, and where the bytes begin that are left to follow."""
        if len(self.states) + self.first / 4 > self.max_states:
            self.reset()
        state, out, final = self.start, b"", len(piece) - 1
        for at, byte in enumerate(piece):
            step = state.get(byte, 0)
            if type(step) is int:
                if at == final:
                    return out, state, at
                if final - at < short and step + 1 < self.needs:
                    self.first += not step
                    state[byte] = step + 1
                    return out, state, at
                self.first -= step > 0
                step = self.move(state, byte)
            emitted, state = step
            if emitted:
                out += emitted
        return out, state, len(piece)

    def encode(self, pieces: list[bytes], short: int = 64, step_bytes: int = 1 << 15) -> list[bytes]:
        """The packed ids of pieces.  What is left of pieces that met a move not made yet is followed in steps of about ``step_bytes``."""
        found, opened, open_at, size = [], [], [], 0

        def close():
            for (i, out), (state, _), reading, ids in zip(opened, open_at, *self.follow(open_at)):
                found[i] = out + state.heads[reading] + ids
            opened.clear(), open_at.clear()

        for piece in pieces:
            out, state, at = self.walk(piece, short)
            if at < len(piece):
                opened.append((len(found), out))
                open_at.append((state, piece[at:]))
                found.append(b"")
                size += len(piece) - at
                if size >= step_bytes:
                    close()
                    size = 0
            else:
                found.append(out + state.heads[-1] if piece else out)
        if open_at:
            close()
        return found


class Trie:
    """The trie of tokens in arrays: nodes with one move hold it, the others have a row of moves.  Node 0 is the root; a move to it is none."""

    END = 256  # the sign after a text

    def __init__(self, child: dict[int, int], token: list[int | None]):
        edges, to = np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child))
        moves = np.bincount(edges >> 8, minlength=len(token))
        one, many = (moves == 1)[edges >> 8], (moves > 1)[edges >> 8]
        self.sign, self.only = np.full(len(token), -1, np.int16), np.zeros(len(token), np.int32)
        self.sign[edges[one] >> 8], self.only[edges[one] >> 8] = edges[one] & 255, to[one]
        self.row = np.where(moves > 1, np.cumsum(moves > 1), 0).astype(np.int32)
        self.next = np.zeros((1 + self.row.max(), 257), np.int32)
        self.next[self.row[edges[many] >> 8], edges[many] & 255] = to[many]
        self.token = np.array([-1 if t is None else t for t in token], np.int32)

    def tokens(self, place: np.ndarray, at: np.ndarray, node: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, end, token) of all tokens that the readings of the places, which go on with the sign ``at``, can end with."""
        found = []
        while len(place):
            sign = signs[at]
            node = np.where(self.sign[node] == sign, self.only[node], self.next[self.row[node], sign])
            on = np.flatnonzero(node)
            place, at, node = place[on], at[on] + 1, node[on]
            token = self.token[node]
            on = np.flatnonzero(token >= 0)
            found.append((place[on], at[on], token[on]))
        return tuple(np.concatenate(parts) for parts in zip(*found))


class Fits:
    """``Transducer.stand`` for arrays of pairs; the left token may be the number of tokens for none.

    Answers are kept in a table of fixed size, where a pair takes the place of another one with the same hash.
    """

    def __init__(self, transducer: Transducer, bits: int = 20):
        self.spines, self.ranks = transducer.spines, transducer.ranks
        self.never, self.shift = len(self.ranks), np.uint64(64 - bits)
        self.kept = np.full(1 << bits, -1, np.int64)  # 2 * pair + answer
        joined = [
            (left * (self.never + 1) + right, rank)
            for whole, rank in self.ranks.items()
            for i in range(1, len(whole))
            if (left := self.ranks.get(whole[:i])) is not None and (right := self.ranks.get(whole[i:])) is not None
        ]
        pairs, due = np.array([(-1, self.never), *joined], np.int64).T
        order = np.argsort(pairs)
        self.pairs, self.due = pairs[order], due[order]
        #: 0: not looked at, 1: has spines, 2: the merges never make it
        self.made = np.zeros(self.never + 1, np.int8)
        self.parts = np.zeros((2, self.never, 8), np.int32)  # by side, token, depth: the part, and the rank that ends it
        self.until = np.zeros((2, self.never, 8), np.int32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * (self.never + 1) + right
        place = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        kept = self.kept[place]
        answer = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != pair)
        if len(new):
            different, one, which = np.unique(pair[new], return_index=True, return_inverse=True)
            fit = self.apart(*np.divmod(different, self.never + 1))
            answer[new] = fit[which]
            self.kept[place[new][one]] = 2 * different + fit
        return answer

    def look(self, tokens: np.ndarray) -> None:
        for token in np.unique(tokens[self.made[tokens] == 0]).tolist():
            spines = self.spines(token) if token < self.never else None
            self.made[token] = 1 if spines else 2
            if spines:
                deepest = max(map(len, spines))
                while deepest > self.parts.shape[2]:
                    self.parts, self.until = (np.concatenate([x, np.zeros_like(x)], axis=2) for x in (self.parts, self.until))
                for side, spine in enumerate(spines):
                    self.parts[side, token, : len(spine)] = [self.ranks[part] for part, _ in spine]
                    self.until[side, token, : len(spine)] = [until for _, until in spine]

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The answers by ``Transducer.apart``, step by step for all pairs."""
        self.look(np.concatenate([left, right]))
        answer = self.made[right] == 1
        # readings hold only tokens that the merges make, so a left token without spines is none
        open_ = np.flatnonzero(answer & (self.made[left] == 1))
        left, right = left[open_], right[open_]
        i, j = np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
        while len(open_):
            until_a, until_b = self.until[1, left, i], self.until[0, right, j]
            pair = self.parts[1, left, i].astype(np.int64) * (self.never + 1) + self.parts[0, right, j]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            due = np.where(self.pairs[at] == pair, self.due[at], self.never)
            clash = (due < until_a) & (due <= until_b)
            answer[open_[clash]] = False
            go = np.flatnonzero(~clash & ((until_a < self.never) | (until_b < self.never)))
            first = (until_a <= until_b)[go]
            open_, left, right, i, j = open_[go], left[go], right[go], i[go] + first, j[go] + ~first
        return answer


class Encoder:
    """Texts to ids; remembers the ids of at most ``memory`` pieces of at most 64 characters.

    The memory has two halves.  When the newer one has no room it takes the older one's place; a piece that is met in the older one moves over.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 400_000):
        self.transducer, self.pattern, self.memory = Transducer(ranks), regex.compile(pattern), memory
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of every text; each different piece is looked up once, and the new ones are encoded together."""
        pieces = [self.pattern.findall(text) for text in texts]
        ids = dict.fromkeys(chain.from_iterable(pieces))
        ids.update(zip(ids, list(map(self.known.get, ids))))
        ids.update(self.learn([piece for piece, found in ids.items() if found is None]))
        return [b"".join(map(ids.__getitem__, found)) for found in pieces]

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of different pieces that are not in the memory's newer half, which takes them in."""
        new = dict(zip(pieces, map(self.older.get, pieces)))
        unknown = [piece for piece, ids in new.items() if ids is None]
        new.update(zip(unknown, self.transducer.encode([piece.encode() for piece in unknown])))
        half = self.memory // 2
        kept = dict(islice(((piece, ids) for piece, ids in new.items() if len(piece) <= 64), half))
        if len(self.known) + len(kept) > half:
            self.older, self.known = self.known, {}
        self.known.update(kept)
        return new


# first byte of a sequence: bytes that follow, and the range of the second byte
_LEADS = (
    (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
)
_LEAD = {b: (n, low, high) for first, final, n, low, high in _LEADS for b in range(first, final + 1)}


def utf8_step(pending: bytes, byte: int) -> tuple[str, bytes]:
    """One byte: the text that became certain, and the open bytes of a sequence."""
    text = ""
    if pending:
        n, low, high = _LEAD[pending[0]]
        if (low if len(pending) == 1 else 0x80) <= byte <= (high if len(pending) == 1 else 0xBF):
            pending += bytes([byte])
            return ("", pending) if len(pending) <= n else (pending.decode(), b"")
        text = "�"
    if byte < 0x80:
        return text + chr(byte), b""
    return (text, bytes([byte])) if byte in _LEAD else (text + "�", b"")


class Decoder:
    """Ids to text, token by token; the moves of the UTF-8 machine over whole tokens are kept once made.

    ``whole`` has the texts of the moves that lead from the start back to it; such tokens are looked up all at once.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.states: dict[bytes, dict] = {b"": {}}
        self.whole: dict[int, str] = {}

    def move(self, pending: bytes, token: int) -> tuple[str, dict, bytes]:
        text, state = [], pending
        for byte in self.bytes_of[token]:
            said, state = utf8_step(state, byte)
            text.append(said)
        step = self.states[pending][token] = ("".join(text), self.states.setdefault(state, {}), state)
        if not pending and not state:
            self.whole[token] = step[0]
        return step

    def stream(self, ids) -> Iterator[str]:
        state, pending = self.states[b""], b""
        for token in ids:
            text, state, pending = state.get(token) or self.move(pending, token)
            yield text
        if pending:
            yield "�"

    def decode(self, ids: list[int]) -> str:
        texts = [*map(self.whole.get, ids), None]
        state, pending, at = self.states[b""], b"", texts.index(None)
        while at < len(ids):  # the machine goes from a token that is not whole until it is back at the start
            for at in range(at, len(ids)):
                texts[at], state, pending = state.get(ids[at]) or self.move(pending, ids[at])
                if not pending:
                    break
            at = texts.index(None, at + 1)
        texts[-1] = "�" if pending else ""
        return "".join(texts)


#: Encoders and decoders of this worker by their parameters; a worker runs many tasks, and their states and pieces serve all of them.
_MADE: dict[tuple, Encoder | Decoder] = {}


def made(kind: type, vocabulary: str, *more: str) -> Encoder | Decoder:
    """The worker's encoder or decoder for a vocabulary file; four are kept at most."""
    key = (kind, vocabulary, *more)
    if key not in _MADE:
        while len(_MADE) >= 4:
            del _MADE[next(iter(_MADE))]
        _MADE[key] = kind(read_ranks(vocabulary), *more)
    return _MADE[key]


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
TEXTS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode(documents: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids): the ids of every text, each match of ``pattern`` encoded by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made(Encoder, vocabulary, pattern)
        gc.set_threshold(1_000_000)  # hundreds of thousands of lasting states make frequent collections dear
        for rows, texts in text_steps(batches):
            ids_of = encoder.encode_all([t.decode() for t in texts])
            ends = np.cumsum([0, *(len(p) // 4 for p in ids_of)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids_of), dtype="<i4")))
            yield rows_of(IDS, rows.column(0).cast(pa.int64()), ids)

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, step_rows: int = 200) -> DataFrame:
    """(doc_id, ids, decoded): the text of every list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = made(Decoder, vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, step_rows):
                rows = batch.slice(at, step_rows)
                texts = [decoder.decode(ids.values.to_numpy().tolist() if ids.is_valid else []) for ids in rows.column(1)]
                yield rows_of(TEXTS, rows.column(0).cast(pa.int64()), rows.column(1).cast(pa.list_(pa.int32())), texts)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


@query("op2_byte_pairs")
def op2_byte_pairs(spark, folder):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = decode(encode(table(spark, folder, "documents"), vocabulary), vocabulary)
    return texts.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
