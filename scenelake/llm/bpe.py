"""Byte-level BPE by finite-state transducers.

Encoding. The merges are compiled into a transducer over bytes that is made deterministic only where texts
lead it. Its states are beginnings of tokens: the longest that the bytes read so far end with. A state knows
the longest token that ends here, hence every token that does. The last token of a prefix's encoding is the
longest of them that may follow the last token before it; a pair may follow if it is its own encoding. So the
encodings of all prefixes form a tree, and a token is decided, and given out, once every place from which a
token may still reach past the last byte shares it: after a lookahead of no more than the longest token.

Decoding. Tokens become bytes in chunks; an incremental UTF-8 machine keeps the one to three bytes of a
character that a chunk has cut, and gives out whole characters only.

Ids are stored as the bytes of little-endian unsigned 32-bit integers, the form that training reads.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from scenelake.llm.common import small_batches, table, text_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bounds of what a worker keeps besides the states, of which there are no more than beginnings of tokens: pairs
#: of tokens, and pieces of text with their tokens. Beyond them each starts anew; nothing else changes.
MOST_PAIRS, MOST_PIECES = 1_000_000, 400_000
#: Undecided bytes after which a long piece is looked through for decided tokens.
LOOK = 1024
#: Bytes of text in a batch that goes back to Spark.
BATCH_BYTES = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class _State:
    """`text`: the beginning of a token it stands for. `go`: byte -> next state. `token`: longest token that
    ends here."""

    __slots__ = ("text", "go", "token")

    def __init__(self, text: bytes, token: int):
        self.text, self.go, self.token = text, {}, token


class Transducer:
    """Encodes pieces of text, each on its own."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.ranks = ranks
        self.words = [b""] * size
        for word, i in ranks.items():
            self.words[i] = word
        self.lengths = list(map(len, self.words))
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.beginnings = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self.states: dict[bytes, _State] = {}
        self.start = _State(b"", -1)
        #: Token -> next shorter token that ends like it.
        self.shorter: dict[int, int] = {}
        #: First token -> second token -> whether the second may follow.
        self.pairs: list[dict[int, bool] | None] = [None] * size
        self.known = 0
        self.own: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], tuple[int, ...]] = {}

    def merged(self, piece: bytes, least: int = 1) -> list[int]:
        """Tokens of a short piece by the merges themselves: the lowest rank first, the leftmost of equals.
        It stops at `least` tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [r for r in ranks if r is not None]
            if not known:
                break
            i = ranks.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _ending(self, text: bytes) -> int:
        """The longest token that ends `text` and that the merges can make."""
        for k in range(len(text)):
            token = self.ranks.get(text[k:])
            if token is not None:
                if token not in self.own:
                    self.own[token] = self.merged(text[k:]) == [token]
                if self.own[token]:
                    return token
        raise ValueError("the ranks lack a token for a single byte")

    def _go(self, state: _State, byte: int) -> _State:
        """The transition, made when it is first taken."""
        text = state.text + bytes((byte,))
        while len(text) > 1 and text not in self.beginnings:
            text = text[1:]
        target = self.states.get(text)
        if target is None:
            target = self.states[text] = _State(text, self._ending(text))
        state.go[byte] = target
        return target

    def _follows(self, before: int, token: int) -> bool:
        if self.known >= MOST_PAIRS:
            self.pairs, self.known = [None] * len(self.words), 0
        if self.pairs[before] is None:
            self.pairs[before] = {}
        self.known += 1
        follows = self.pairs[before][token] = self._stand_apart(self._edge(before, 1), self._edge(token, 0))
        return follows

    def _edge(self, token: int, side: int) -> tuple[int, ...]:
        """Tokens at one edge of `token` as its merges make it, from the single byte on."""
        key = (token, side)
        if key not in self.edges:
            inner = () if self.lengths[token] == 1 else self._edge(self.merged(self.words[token], 2)[side], side)
            self.edges[key] = (*inner, token)
        return self.edges[key]

    def _stand_apart(self, left: tuple[int, ...], right: tuple[int, ...]) -> bool:
        """Whether no merge joins two tokens over their boundary. Both edges grow in the order of their ranks;
        the boundary's pair must never come first. Of equal ranks the one to the left goes first."""
        i = j = 0
        never = len(self.words)
        while True:
            joint = self.ranks.get(self.words[left[i]] + self.words[right[j]], never)
            grown_left = left[i + 1] if i + 1 < len(left) else never
            grown_right = right[j + 1] if j + 1 < len(right) else never
            if joint < grown_left and joint <= grown_right and joint < never:
                return False
            if grown_left == grown_right == never:
                return True
            if grown_left <= grown_right:
                i += 1
            else:
                j += 1

    def _path(self, last: list[int], end: int) -> list[int]:
        """Tokens of the first `end` bytes."""
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= self.lengths[out[-1]]
        return out[::-1]

    def _decided(self, last: list[int], state: _State) -> list[int]:
        """Tokens that every later encoding begins with."""
        n = len(last)
        reach = len(state.text)
        paths = [
            self._path(last, k) for k in range(n - reach, n + 1) if k == n or state.text[k - n :] in self.beginnings
        ]
        shared = 0
        while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
            shared += 1
        return paths[0][:shared]

    def encode(self, piece: bytes) -> bytes:
        """Packed ids of a piece. A piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.packed[whole]
        lengths, shorter = self.lengths, self.shorter
        state, last, out, limit = self.start, [], [], LOOK
        before = -1  # last token given out
        n = 0
        for byte in piece:
            state = state.go.get(byte) or self._go(state, byte)
            token = state.token
            n += 1
            while True:
                k = n - lengths[token]
                if k >= 0:
                    ahead = last[k - 1] if k else before
                    if ahead < 0:
                        break
                    known = self.pairs[ahead]
                    follows = known.get(token) if known is not None else None
                    if follows or follows is None and self._follows(ahead, token):
                        break
                if token not in shorter:
                    shorter[token] = self._ending(self.words[token][1:])
                token = shorter[token]
            last.append(token)
            if n >= limit:
                given = self._decided(last, state)
                if given:
                    out.extend(map(self.packed.__getitem__, given))
                    cut = sum(lengths[t] for t in given)
                    last, n, before = last[cut:], n - cut, given[-1]
                limit = n + LOOK
        out.extend(map(self.packed.__getitem__, self._path(last, n)))
        return b"".join(out)


class _Pieces(dict):
    """Piece -> packed ids, filled by the transducer."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        if len(self) >= MOST_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Encodes whole texts: the pattern's matches are the pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = _Pieces(Transducer(ranks))
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> bytes:
        if len(text) < 1 << 20:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        # A long text's pieces aren't all held at once.
        out, found = [], (m.group() for m in self.pattern.finditer(text))
        while chunk := b"".join(map(self.pieces.__getitem__, islice(found, 1 << 16))):
            out.append(chunk)
        return b"".join(out)


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any cuts and gives out text; what is invalid becomes U+FFFD.

    Its state is the beginning of one character, at most three bytes, that may still be completed.
    """

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def _cut(data: bytes) -> int:
        """Where the character begins that `data` ends within, else its length."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80:
                break
            if lead >= 0xC0:
                need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                if need <= back:
                    break
                if back > 1:
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                    if not low <= data[-back + 1] <= high:
                        break
                return len(data) - back
        return len(data)

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = self._cut(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.words = [None] * (max(ranks.values(), default=-1) + 1)
        for word, i in ranks.items():
            self.words[i] = word

    def chunks(self, ids: bytes, size: int = 1 << 14) -> Iterator[bytes]:
        """Bytes of the tokens, `size` tokens at a time. An id that isn't in the ranks raises an error."""
        word = self.words.__getitem__
        for at in range(0, len(ids), 4 * size):
            yield b"".join(map(word, np.frombuffer(ids[at : at + 4 * size], "<u4").tolist()))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.chunks(ids))

    def text(self, ids: bytes) -> str:
        machine = Utf8Machine()
        return "".join(map(machine.feed, self.chunks(ids))) + machine.end()


_MADE: dict[tuple, object] = {}


def _made(kind, *args):
    """One encoder or decoder a worker process and vocabulary; the vocabulary is read where it is needed."""
    key = (kind, *args)
    if key not in _MADE:
        _MADE[key] = kind(read_ranks(args[0]), *args[1:])
    return _MADE[key]


def _mapped(df: DataFrame, column: str, made: str, kind: str, work) -> DataFrame:
    """`df` with the column `made`, `work(value)` of `column`; batches out hold about BATCH_BYTES."""
    small_batches(df.sparkSession)
    dtype = BinaryType() if kind == "binary" else StringType()
    schema = StructType([f for f in df.schema.fields if f.name != made] + [StructField(made, dtype)])
    arrow = pa.binary() if kind == "binary" else pa.string()

    def run(batches):
        call = work()
        for batch in batches:
            keep = [n for n in batch.schema.names if n != made]
            at, size, values = 0, 0, []

            def part(upto):
                piece = batch.slice(at, upto - at)
                return pa.RecordBatch.from_arrays(
                    [*(piece.column(n) for n in keep), pa.array(values, arrow)], names=[*keep, made]
                )

            source = batch.column(column)
            for i in range(len(source)):
                value = source[i].as_py()
                values.append(None if value is None else call(value))
                size += len(value or "") + len(values[-1] or "")
                if size >= BATCH_BYTES:
                    yield part(i + 1)
                    at, size, values = i + 1, 0, []
            if values:
                yield part(len(source))

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks: str = "", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`df` with the column `ids` (a column of that name is replaced): packed ids of the whole text, without
    special tokens. Null and empty texts have none (zero bytes). `ranks` is the place of a rank file that every
    executor can read."""
    path = ranks or public_tokenizers.path(RANKS)
    whole = df.withColumn(text, text_of(df, text))
    return _mapped(whole, text, ids, "binary", lambda: _made(Encoder, path, pattern).encode)


def decode(df: DataFrame, ids: str = "ids", made: str = "decoded", ranks: str = "", as_text: bool = True) -> DataFrame:
    """`df` with the column `made`: the text of packed ids, or with `as_text` false their bytes. Null ids stay null."""
    path = ranks or public_tokenizers.path(RANKS)
    if as_text:
        return _mapped(df, ids, made, "string", lambda: _made(Decoder, path).text)
    return _mapped(df, ids, made, "binary", lambda: _made(Decoder, path).decode)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs).select("doc_id", "ids"))
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
