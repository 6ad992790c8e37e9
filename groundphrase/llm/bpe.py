"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding. BPE of a prefix of a piece ends with exactly one token, and a sequence of tokens is the encoding of its
bytes if and only if every neighbouring pair of it is (two tokens are "compatible" if BPE of their joined bytes gives
the two back). So a nondeterministic machine that walks the vocabulary's trie from every position where a token may
start, and closes a token where the trie has one that is compatible with the token before, encodes BPE. The
transducer below determinises it on demand: a state is the set of open walks, each with the tokens that are not
common to all walks yet; a token is emitted as soon as all walks agree on it, which is after at most the bytes of the
longest token. States and transitions are kept until a bound, then forgotten and built anew.

Decoding. Tokens become bytes, and an incremental UTF-8 machine turns blocks of bytes into text, holding back the
bytes of a character that is not complete.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from groundphrase.llm.batches import slices

#: Bounds of what a Python worker keeps.
MAX_STATES, MAX_PIECES, DECODE_BLOCK = 300_000, 150_000, 1 << 16
#: No rank.
NEVER = 1 << 62


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Transducer:
    """Maps the bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.max_states = max_states
        self.child: dict[int, int] = {}  # node * 256 + byte: node
        self.token_at = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.inner = bytearray(len(self.token_at))
        for key in self.child:
            self.inner[key >> 8] = 1
        self.spines: tuple[dict, dict] = ({}, {})
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {((0, -1, ()),): 0}
        self.walks = [((0, -1, ()),)]
        self.moves: dict[int, tuple[int, tuple]] = {}  # state << 8 | byte: transition
        self.rest: list[tuple] = [()]
        self.fit: dict[int, bool] = {}  # left << 32 | right: whether they are compatible

    def merged(self, piece: bytes) -> list[int]:
        """Plain BPE of a few bytes: the pair of lowest rank is joined until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 62))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int, right: bool) -> list[int]:
        """The tokens that touch one end of a token while it is merged, from its first or last byte to itself."""
        known = self.spines[right].get(token)
        if known is None:
            text = self.tokens[token]
            if len(text) == 1:
                known = [token]
            else:
                own = self.ranks.pop(text)  # what remains to be merged is the token's last merge
                try:
                    parts = self.merged(text)
                finally:
                    self.ranks[text] = own
                known = [*self.spine(parts[-1] if right else parts[0], right), token] if len(parts) == 2 else []
            self.spines[right][token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE of the joined bytes is the two tokens.

        Merges happen in the order of ranks (a token ranks after its parts), so it is enough to watch the two tokens
        that meet at the border: it fails if their pair ranks before the merge that takes either of them away.
        """
        a, b = self.spine(left, True), self.spine(right, False)
        if not a or not b:
            return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        i = j = 0
        tokens, ranks = self.tokens, self.ranks
        while True:
            pair = ranks.get(tokens[a[i]] + tokens[b[j]], NEVER)
            next_a = a[i + 1] if i + 1 < len(a) else NEVER
            next_b = b[j + 1] if j + 1 < len(b) else NEVER
            if pair < next_a and pair <= next_b:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def move(self, state: int, byte: int) -> tuple[int, tuple]:
        """The transition of a state on a byte: (next state, tokens that are certain now)."""
        child, token_at, inner = self.child.get, self.token_at, self.inner
        walks, closed = [], None
        for node, last, pending in self.walks[state]:
            node = child(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                walks.append((node, last, pending))
            if closed is None and (token := token_at[node]) >= 0:
                if last < 0 or self.pair_fits(last, token):
                    closed = (0, token, (*pending, token))
        if closed is None:
            raise ValueError("the vocabulary lacks a single byte")
        walks.append(closed)
        same, sure = 0, walks[0][2]
        if sure:
            same = len(sure)
            for w in walks:
                while w[2][:same] != sure[:same]:
                    same -= 1
                if not same:
                    break
        out = sure[:same]
        key = tuple([(n, last, pending[same:]) for n, last, pending in walks] if same else walks)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.walks)
            self.walks.append(key)
            self.rest.append(key[-1][2])
        step = self.moves[state << 8 | byte] = to, out
        return step

    def last(self, state: int, byte: int) -> tuple:
        """All tokens that are still open when the piece ends with this byte; no state is made for it."""
        step = self.moves.get(state << 8 | byte)
        if step is not None:
            return (*step[1], *self.rest[step[0]])
        for node, last, pending in self.walks[state]:
            node = self.child.get(node << 8 | byte)
            if node is not None and (token := self.token_at[node]) >= 0:
                if last < 0 or self.pair_fits(last, token):
                    return (*pending, token)
        raise ValueError("the vocabulary lacks a single byte")

    def pair_fits(self, left: int, right: int) -> bool:
        known = self.fit.get(left << 32 | right)
        if known is None:
            known = self.fit[left << 32 | right] = self.fits(left, right)
        return known

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if not piece:
            return []
        if len(self.walks) > self.max_states:
            self.forget()
        out: list[int] = []
        state, known = 0, self.moves.get
        for byte in piece[:-1]:
            state, sure = known(state << 8 | byte) or self.move(state, byte)
            if sure:
                out += sure
        out += self.last(state, piece[-1])
        return out


class Utf8Stream:
    """Incremental UTF-8: feed() gives the text of all complete characters, close() what is left over.

    The state is the bytes of a character that has begun (three at most). Malformed bytes become U+FFFD, as Python's
    errors="replace" has it, wherever the blocks are cut.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end belong to a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(
                    byte, (0x80, 0xBF)
                )
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, block: bytes) -> str:
        data = self.held + block
        keep = self._open(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


class _Pieces(dict):
    """Piece to the bytes of its int32 ids; the newer of two generations, so that common pieces outlive a bound."""

    def __init__(self, machine: Transducer, bound: int = MAX_PIECES):
        super().__init__()
        self.machine, self.bound, self.older = machine, bound, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        found = self.older.get(piece)
        if found is None:
            found = array("i", self.machine.encode(piece.encode("utf-8"))).tobytes()
        self[piece] = found
        return found


class Codec:
    """What one Python worker needs to encode and decode."""

    def __init__(self, raw: bytes, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        ranks = parse_ranks(raw)
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(Transducer(ranks, max_states), max_pieces)
        tokens = self.pieces.machine.tokens
        size = max(tokens, default=-1) + 1
        self.sizes = np.array([len(tokens.get(i, b"")) for i in range(size)], "int64")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if size else np.zeros(0, "int64")
        self.blob = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), "uint8")

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.pattern.findall(text))), "int32")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.blob[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        stream = Utf8Stream()
        parts = [stream.feed(self.decode_bytes(ids[i : i + DECODE_BLOCK])) for i in range(0, len(ids), DECODE_BLOCK)]
        return "".join([*parts, stream.close()])


_codecs: dict[tuple, Codec] = {}


def _codec(raw: bytes, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> Codec:
    """The codec of this Python worker, kept between tasks; one of another vocabulary or other bounds takes its place."""
    key = hash(raw), pattern, max_states, max_pieces
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern, max_states, max_pieces)
    return _codecs[key]


def _free(name: str, taken: list[str]) -> None:
    if name.lower() in {c.lower() for c in taken}:
        raise ValueError(f"the input has a column {name} already; name another for the result")


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str | None = None,
    max_states: int = MAX_STATES,
    max_pieces: int = MAX_PIECES,
) -> DataFrame:
    """docs with ids array<int>: the text's tokens; null and empty texts get an empty array. max_states and max_pieces bound
    what a Python worker keeps in memory; results are the same under any bounds.

    With decoded_col the ids are decoded again on the spot, as a round trip. A narrow map over Arrow batches: no
    shuffle, one pass, other columns pass through. The rank file is broadcast (its size is the vocabulary's). A result
    column whose name the input has is refused before anything runs.
    """
    _free(ids_col, docs.columns)
    fields = [*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]
    if decoded_col:
        _free(decoded_col, [*docs.columns, ids_col])
        fields.append(StructField(decoded_col, StringType()))
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    text_at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern, max_states, max_pieces)
        for part in slices(batches):
            ids = [codec.encode(t or "") for t in part.column(text_at).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype="int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, "int32")])))
            more = [pa.array([codec.decode(i) for i in ids], pa.string())] if decoded_col else []
            yield pa.RecordBatch.from_arrays([*part.columns, lists, *more], [f.name for f in fields])

    return docs.mapInArrow(work, StructType(fields))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text of its ids; null ids give the empty text. A narrow map like encode()."""
    _free(text_col, df.columns)
    raw = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [*df.schema.fields, StructField(text_col, StringType())]
    at = df.columns.index(ids_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern)
        for part in slices(batches):
            texts = [codec.decode(np.array(i or [], "int32")) for i in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [f.name for f in fields])

    return df.mapInArrow(work, StructType(fields))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip through encode()."""
    ids = encode(docs.select("doc_id", "text"), ranks_path, pattern, decoded_col="decoded")
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
