"""Byte-level BPE: encode by backtracking over longest matches, decode by lookup.

The merges of a rank file give every byte string one encoding.  A token list
is that encoding exactly when each adjacent pair of tokens is *compatible*:
merging the bytes of the two tokens alone gives back the same two tokens.  So
instead of replaying merges, the encoder takes the longest vocabulary match at
each position (an Aho-Corasick automaton over the bytes, mapped to Latin-1
because the automaton works on text), checks it against the token before it,
falls back to the next shorter prefix, and backs up one token when none fits.
A position found to be a dead end is never tried again, so the work is linear
in the bytes.  Compatibility of a pair is found once by replaying its merges
and then remembered, as are the ids of recently seen words.

The vocabulary (under 1 MB) is read on the driver and broadcast; tasks need
no file.

Defined cases: null text encodes as the empty text (0 ids); repeated rows and
repeated ids give one output row per input row; an empty table gives an empty
table; other columns of the input are ignored; very long texts are processed
whole, in linear time.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import lean

_MEMO_ROWS = 150_000      # remembered words per worker, in each of two generations
_MEMO_CHARS = 48          # longer words are encoded each time

# Fixed value: the pattern that cuts a text into the pieces that are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """Rank file lines: base64 bytes, a space, the rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"not a byte-level vocabulary: {len(missing)} bytes have no rank")
    return ranks


class Backtracker:
    """Exact BPE of byte pieces by longest match and backtracking."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self._edges: dict[int, tuple[list, list] | None] = {}
        self._auto = ahocorasick.Automaton()
        for b, r in ranks.items():
            self._auto.add_word(b.decode("latin-1"), (len(b), r))
        self._auto.make_automaton()
        self._size = {r: len(b) for b, r in ranks.items()}
        self._max = max(self._size.values())

    def replay(self, piece: bytes, least: int = 1) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank until none
        (or ``least`` parts) is left."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > least:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: nothing before it)."""
        key = (before, token)
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) > 400_000:
                self._fits.clear()
            got = self._check(before, token)
            self._fits[key] = got
        return got

    def edges(self, token: int) -> tuple[list, list] | None:
        """The tokens that stand at the token's left and at its right end while
        it is merged, smallest first, each as (bytes, rank); None if the merges
        do not build the token or not in rising order of rank."""
        if token not in self._edges:
            b = self.bytes_of[token]
            if len(b) == 1:
                got = ([(b, token)], [(b, token)])
            else:
                halves = self.replay(b, 2)
                ends = [self.edges(t) for t in halves] if len(halves) == 2 and max(halves) < token else [None]
                got = (ends[0][0] + [(b, token)], ends[1][1] + [(b, token)]) if all(ends) else None
            self._edges[token] = got
        return self._edges[token]

    def _check(self, before: int, token: int) -> bool:
        right = self.edges(token)
        left = self.edges(before) if before >= 0 else right
        if left is None or right is None:        # an unusual vocabulary: replay
            head = self.bytes_of[before] if before >= 0 else b""
            return self.replay(head + self.bytes_of[token]) == ([before, token] if before >= 0 else [token])
        if before < 0:
            return True
        # Merges happen in order of rank.  Follow the pieces on both sides of
        # the boundary as they grow; a merge across it that comes first breaks the pair.
        a, b, i, j, never = left[1], right[0], 0, 0, 1 << 60
        while True:
            across = self.ranks.get(a[i][0] + b[j][0], never)
            grow_a = a[i + 1][1] if i + 1 < len(a) else never
            grow_b = b[j + 1][1] if j + 1 < len(b) else never
            if across < grow_a and across <= grow_b and across < never:
                return False
            if grow_a == never and grow_b == never:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def shorter(self, token: int) -> int:
        """The longest vocabulary entry that is a proper prefix of ``token``; -1 if none."""
        got = self._shorter.get(token)
        if got is None:
            b, got = self.bytes_of[token], -1
            for n in range(len(b) - 1, 0, -1):
                if b[:n] in self.ranks:
                    got = self.ranks[b[:n]]
                    break
            self._shorter[token] = got
        return got

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None or not piece:
            return [whole] if piece else []
        rank, reach, known = self.ranks.get, self._auto.longest_prefix, self._fits.get
        size, most, text, stop = self._size, self._max, piece.decode("latin-1"), len(piece)
        out: list[int] = []
        at, last, token, dead = 0, -1, None, set()
        while True:
            if token is None:
                # the automaton says how far any entry can reach; step back to an entry
                n = reach(text[at:at + most])
                token = rank(piece[at:at + n])
                while token is None:
                    n -= 1
                    token = rank(piece[at:at + n])
                end = at + n
            else:
                end = at + size[token]
            if end not in dead:
                fits = known((last, token))
                if self.fits(last, token) if fits is None else fits:
                    out.append(token)
                    if end == stop:
                        return out
                    at, last, token = end, token, None
                    continue
            token = self.shorter(token)
            if token < 0:
                dead.add(at)                     # no token leads on from here
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                # the token that led here is tried again: its end is dead now


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, blob: bytes):
        self.core = Backtracker(parse_ranks(blob))
        self.find = regex.compile(PATTERN).findall
        # A space before a non-space always starts a match of the pattern, so
        # a text without other spaces can be cut there and its words remembered.
        self.odd_space = regex.compile(r" (?=\s|\z)").search
        self.le4 = {r: r.to_bytes(4, "little") for r in self.core.bytes_of}
        self.memo: dict[str, bytes] = {}         # recent words
        self.older: dict[str, bytes] = {}        # words of the memo before it

    def _matches(self, chunk: str) -> list[str]:
        """The pattern's matches in a chunk; the common forms without a search."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():                       # exactly a run of \p{L}
            return [chunk]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.find(chunk)

    def _word(self, chunk: str) -> bytes:
        got = self.memo.get(chunk)
        if got is None:
            got = self.older.get(chunk)
            if got is None:
                matches = self._matches(chunk)
                if len(matches) > 1:
                    got = b"".join([self._word(m) for m in matches])
                else:
                    le4 = self.le4
                    got = b"".join([le4[i] for m in matches for i in self.core.encode(m.encode("utf-8"))])
            if len(chunk) <= _MEMO_CHARS:
                if len(self.memo) >= _MEMO_ROWS:
                    self.older, self.memo = self.memo, {}
                self.memo[chunk] = got
        return got

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        word = self._word
        if self.odd_space(text):
            return b"".join([word(m) for m in self.find(text)])
        known = self.memo.get
        first, *rest = text.split(" ")
        return word(first) + b"".join([known(w) or word(w) for w in [" " + w for w in rest]])


_BY_KEY: dict[str, TextEncoder] = {}


def encoder(blob: bytes) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _BY_KEY:
        _BY_KEY[key] = TextEncoder(blob)
    return _BY_KEY[key]


def vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ``ids`` holds each whole text's token ids as little-endian
    unsigned 32-bit integers.  ``path`` is read on the driver only."""
    vocab = vocabulary(docs, path)

    @lean
    def run(batches):
        enc = encoder(vocab.value)
        for b in batches:
            ids = [enc(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, ids binary")


def _bytes(of: dict[int, bytes], ids: bytes) -> bytes:
    """The bytes that serialized ids stand for."""
    return b"".join(map(of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) in one pass: each batch is encoded and its ids decoded by one worker."""
    vocab = vocabulary(docs, path)

    @lean
    def run(batches):
        enc = encoder(vocab.value)
        of = enc.core.bytes_of
        for b in batches:
            ids = [enc(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([_bytes(of, x) for x in ids], pa.binary())],
                                             names=[id_col, "ids", "decoded"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, ids binary, decoded binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): the bytes that the ids stand for."""
    vocab = vocabulary(encoded, path)

    @lean
    def run(batches):
        of = encoder(vocab.value).core.bytes_of
        for b in batches:
            out = [_bytes(of, x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())],
                                             names=[id_col, "ids", "decoded"])
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text: token count and the SHA-256 of the ids and of the decoded bytes."""
    return decoded.select(
        id_col, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
