"""Byte-level BPE encoding and decoding.

Encoding. A piece's BPE tokens are determined from left to right: every prefix
of the piece has one last token, namely the token ending there that is
*compatible* with the last token of the prefix before it (two tokens are
compatible if BPE over their joined bytes gives back just these two). The
transducer below reads bytes; a state holds the bytes since the earliest
position where a longer token may still have begun, and for each such open
position the tokens still pending there. A token is emitted as soon as the
pending tokens of all open positions begin with it, so the lookahead is
bounded by the longest token of the vocabulary. States and transitions are
determinised lazily: each is built once, when a text first needs it, and the
table starts afresh when it holds ``max_states`` (results do not change).
The tables are flat: one dictionary holds the transitions of all states, words
and pieces keep their ids as tuples, and what was not used lately goes first.

Decoding. ``StreamDecoder`` feeds token bytes through an incremental UTF-8
state machine: it gives the text of complete characters at once, keeps an
unfinished character's bytes until the next token, and gives U+FFFD for each
maximal invalid part, like ``bytes.decode("utf-8", "replace")``.

Nulls and empty texts have no tokens. Any text length is allowed; a text is
held whole in its task, tables are bounded.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable
from itertools import chain

import regex
from pyspark.sql import DataFrame

from tablewash.llm.common import map_texts

_NEVER = 1 << 60
CACHE = 300_000  # words and states that a worker keeps, about 1 KB for each of both; fewer cost time only


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: lines of base64 token and rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}


class Vocabulary:
    """Merges of a byte-level BPE: a trie of its tokens, and the compatibility
    test of two tokens."""

    def __init__(self, ranks: dict[bytes, int], max_fits: int = 500_000):
        self.ranks, self.max_fits = ranks, max_fits
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.trie: dict[int, int] = {}  # (node << 8 | byte) -> node; 0 is the root
        self.token_at, self.inner = [-1], [True]  # of a node: its token; whether it has children
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                to = self.trie.get(node << 8 | byte)
                if to is None:
                    to = self.trie[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = to
            self.token_at[node] = rank
        self._right: dict[int, tuple[int, ...]] = {}
        self._left: dict[int, tuple[int, ...]] = {}
        self._fits: dict[int, bool] = {}

    def _children(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one (None for a byte)."""
        b = self.bytes_of[token]
        if len(b) == 1:
            return None
        parts = [b[i:i + 1] for i in range(len(b))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1),
                       key=lambda i: self._below(parts[i] + parts[i + 1], token))
            if self._below(parts[best] + parts[best + 1], token) == _NEVER:
                raise ValueError(f"token {token} is not made by merges of earlier tokens")
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _below(self, b: bytes, limit: int) -> int:
        r = self.ranks.get(b, _NEVER)
        return r if r < limit else _NEVER

    def _spine(self, token: int, side: int) -> tuple[int, ...]:
        """Tokens that border the given side of a token while it is built, from its byte up."""
        memo = (self._left, self._right)[side]
        if token not in memo:
            kids = self._children(token)
            memo[token] = (self._spine(kids[side], side) if kids else ()) + (token,)
        return memo[token]

    def fits(self, a: int, b: int) -> bool:
        """True if no merge crosses the border of a and b before both are complete."""
        known = self._fits.get(a << 32 | b)
        if known is not None:
            return known
        u, v, i, j, out = self._spine(a, 1), self._spine(b, 0), 0, 0, True
        while True:
            up = u[i + 1] if i + 1 < len(u) else _NEVER
            vp = v[j + 1] if j + 1 < len(v) else _NEVER
            crossing = self.ranks.get(self.bytes_of[u[i]] + self.bytes_of[v[j]], _NEVER)
            # of equal merges the left one comes first
            if crossing < up and (crossing <= vp and crossing != _NEVER):
                out = False
                break
            if up == vp == _NEVER:
                break
            if up <= vp:
                i += 1
            else:
                j += 1
        if len(self._fits) >= self.max_fits:
            self._fits.clear()
        self._fits[a << 32 | b] = out
        return out


class Transducer:
    """Lazily determinised transducer from the bytes of one piece to its tokens."""

    def __init__(self, vocab: Vocabulary, max_states: int = 300_000):
        self.vocab, self.max_states = vocab, max_states
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # (state << 8 | byte) -> (state, tokens)
        self._reset()

    def _reset(self) -> None:
        # a state: for each open position, earliest first, the trie node of the
        # bytes since it, the last of all its tokens, and the tokens pending before it
        start = ((0, -1),)
        self.states = [start]
        self.index = {start: 0}
        self.moves.clear()

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        v, reached, kept = self.vocab, None, []
        child, token_at, inner, known = v.trie.get, v.token_at, v.inner, v._fits.get
        for place in self.states[state]:
            to = child(place[0] << 8 | byte)
            if to is None:
                continue
            if reached is None:  # the longest token that fits
                token = token_at[to]
                if token >= 0:
                    last = place[1]
                    fits = last < 0 or known(last << 32 | token)
                    if fits or (fits is None and v.fits(last, token)):
                        reached = (0, token, *place[2:], token)
            if inner[to]:
                kept.append((to, *place[1:]))
        if reached is None:
            raise ValueError("the vocabulary lacks a byte")
        kept.append(reached)
        first, out = kept[0], 2
        while out < len(first) and all(len(x) > out and x[out] == first[out] for x in kept):
            out += 1
        key = tuple((*x[:2], *x[out:]) for x in kept) if out > 2 else tuple(kept)
        to = self.index.get(key)
        full = to is None and len(self.states) >= self.max_states
        if full:
            self._reset()
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
        move = to, first[2:out]
        if not full:  # else the state before is gone
            self.moves[state << 8 | byte] = move
        return move

    def encode(self, piece: bytes) -> list[int]:
        state, out, known = 0, [], self.moves.get
        for byte in piece:
            move = known(state << 8 | byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        out += self.states[state][-1][2:]
        return out


class Recent:
    """Values by key, at most ``size``: those not used for longest are left out first."""

    def __init__(self, size: int):
        self.half = max(1, size // 2)
        self.young, self.old = {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Encoder:
    """Whole texts to token ids; each match of ``pattern`` is encoded separately."""

    # Beside a single blank between two other characters no match crosses over.
    _UNEVEN = re.compile(r"^ | $| \s|\s ")

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(Vocabulary(ranks, max_fits=2 * cache), max_states=cache)
        self.words, self.pieces = Recent(cache), Recent(cache // 2)
        self.decimals = {rank: str(rank) for rank in ranks.values()}

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = tuple(self.transducer.encode(piece.encode("utf-8")))
            if len(piece) <= 64:
                self.pieces.put(piece, ids)
        return ids

    def _plain(self, text: str) -> tuple[int, ...]:
        parts = list(map(self._piece, self.pattern.findall(text)))
        return parts[0] if len(parts) == 1 else tuple(chain.from_iterable(parts))

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a blank and the word."""
        ids = self._plain(" " + word)
        if len(word) <= 64:
            self.words.put(word, ids)
        return ids

    def encode_with_text(self, text: str) -> tuple[list[int], str]:
        """Ids of the text, and the same as decimals joined by commas."""
        if self._UNEVEN.search(text):
            ids = list(self._plain(text))
        else:
            first, *rest = text.split(" ")
            parts = list(map(self.words.young.get, rest))
            if None in parts:
                parts = [p or self.words.get(w) or self._word(w) for w, p in zip(rest, parts)]
            ids = [*self._plain(first), *chain.from_iterable(parts)]
        return ids, ",".join(map(self.decimals.__getitem__, ids))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_with_text(text or "")[0]


class Utf8Machine:
    """Incremental UTF-8: ``step(state, data) -> (text, state)``; a state is the
    unfinished character's bytes."""

    @staticmethod
    def step(state: bytes, data: bytes) -> tuple[str, bytes]:
        data = state + data
        out, i, n = [], 0, len(data)
        while i < n:
            b = data[i]
            if b < 0x80:
                out.append(chr(b))
                i += 1
                continue
            # length, and the range of the second byte (no overlong forms, surrogates or over U+10FFFF)
            if 0xC2 <= b <= 0xDF:
                size, lo, hi = 2, 0x80, 0xBF
            elif 0xE0 <= b <= 0xEF:
                size, lo, hi = 3, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                size, lo, hi = 4, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
                i += 1
                continue
            j, point = i + 1, b & (0x7F >> size)
            while j < n and j < i + size and lo <= data[j] <= hi:
                point = point << 6 | data[j] & 0x3F
                lo, hi, j = 0x80, 0xBF, j + 1
            if j == i + size:
                out.append(chr(point))
            elif j == n:
                return "".join(out), data[i:]
            else:
                out.append("�")
            i = j
        return "".join(out), b""


class StreamDecoder:
    """Token ids to text, any number of ids at a time; ``finish`` ends the stream.
    Transitions by token are kept once made."""

    def __init__(self, bytes_of: dict[int, bytes], memo: dict | None = None):
        self.bytes_of, self.state = bytes_of, b""
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {} if memo is None else memo

    def feed(self, ids: Iterable[int]) -> str:
        out, state = [], self.state
        moves = self.moves.setdefault(state, {})
        for i in ids:
            move = moves.get(i)
            if move is None:
                move = moves[i] = Utf8Machine.step(state, self.bytes_of[i])
            out.append(move[0])
            if move[1] != state:
                state = move[1]
                moves = self.moves.setdefault(state, {})
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        left, self.state = self.state, b""
        return left.decode("utf-8", "replace")


_made: dict[tuple, tuple[Encoder, dict]] = {}


def _tools(path: str, pattern: str, cache: int = CACHE) -> tuple[Encoder, dict]:
    """One encoder and one decoder table for each worker process."""
    gc.disable()  # the tables hold no cycles, and scanning them takes a third of the time
    key = path, pattern, cache
    if key not in _made:
        _made.clear()
        with open(path, "rb") as f:
            _made[key] = Encoder(parse_ranks(f.read()), pattern, cache), {}
    return _made[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Encode every text. ``vocabulary`` is the path of the ranks file, installed
    on every machine. Returns ``id_col`` and ``ids array<int>``."""
    def make():
        encoder, _ = _tools(vocabulary, pattern)
        return lambda texts: [[encoder.encode(t) for t in texts]]

    return map_texts(docs, [id_col], text_col, make, {"ids": "array<int>"})


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str,
                     id_col: str = "doc_id") -> DataFrame:
    """Texts of ``ids`` by the streaming decoder; null ids give an empty text."""
    def make():
        encoder, memo = _tools(vocabulary, pattern)
        bytes_of = encoder.transducer.vocab.bytes_of

        def one(ids):
            decoder = StreamDecoder(bytes_of, memo)
            return decoder.feed(ids or ()) + decoder.finish()

        return lambda lists: [[one(ids) for ids in lists]]

    return map_texts(encoded, [id_col], "ids", make, {"text": "string"})


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text", with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Encode, then decode the ids, in one pass over the texts: ``n_tokens``,
    ``ids_sha256`` (decimal ids joined by commas), ``decoded_sha256`` (bytes), and
    the ``ids`` if asked for."""
    def make():
        encoder, memo = _tools(vocabulary, pattern, cache)
        bytes_of = encoder.transducer.vocab.bytes_of

        def one(text):
            ids, decimals = encoder.encode_with_text(text or "")
            decoder = StreamDecoder(bytes_of, memo)
            back = decoder.feed(ids) + decoder.finish()
            return (len(ids), hashlib.sha256(decimals.encode()).hexdigest(),
                    hashlib.sha256(back.encode("utf-8")).hexdigest(), *[ids] * with_ids)

        return lambda texts: list(zip(*map(one, texts))) or [()] * (3 + with_ids)

    out = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_texts(docs, [id_col], text_col, make, out | ({"ids": "array<int>"} if with_ids else {}))
