"""Chat formatting into prefix-shared packs.

A turn is formatted as ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``.
Control strings inside roles and texts are broken by a backslash after their
first character (and backslashes doubled), so no text can open or close a
turn, and ``unescape`` gives the text back.  The marks are ids of their own
behind the vocabulary; role and text are byte-level BPE ids.

Conversations that begin with the same turns share them: sorted by the hashes
of their turns they come in depth-first order of the prefix tree, and a pack
holds each node of its part of the tree once, as a segment of token ids.  Each
token has the position it has in its own conversation; each segment lists the
intervals of the pack that its ancestors fill (neighbouring ones joined), so a
token attends to those and to its own segment up to itself.  The loss mask
covers the texts of assistant turns.  A conversation is its last segment.

Conversations are range-partitioned by their turns and id, so a first turn
that a third of them share spreads over many tasks.  A pack ends at
``PACK_TOKENS`` tokens or ``PACK_CONVERSATIONS`` conversations; the next one
begins with the path to its first conversation again, so shared turns are
written once a pack.  A task holds one pack; one conversation is never cut.

Defined cases: a null role or text counts as empty; turns go by number, null
first, equal ones by role and text, and repeated rows stay turns of their own;
a row without a conversation id is a conversation of its own; equal
conversations share all segments; an empty table gives no packs; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragspark.llm import bpe
from ragspark.llm.common import snapshot

PACK_TOKENS = 32_768
PACK_CONVERSATIONS = 4_096
BEGIN, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"

# The control strings of common chat templates, each cut after its first character.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_OPEN = re.compile("|".join([r"\\"] + [f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL]))
_BACK = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out = []
    for part in formatted.split(END + "\n")[:-1]:
        head = _ROLE.match(part, len(BEGIN))
        if not part.startswith(BEGIN) or head is None:
            raise ValueError("not a formatted conversation")
        out.append((unescape(head.group(1)), unescape(part[head.end():])))
    return out


class Tokens:
    """Ids of turns and bytes of ids; the two marks follow the vocabulary."""

    def __init__(self, blob: bytes):
        self.encode = bpe.encoder(blob)
        self.bytes_of = self.encode.core.bytes_of
        self.begin = max(self.bytes_of) + 1
        self._marks = {self.begin: BEGIN.encode(), self.begin + 1: END.encode()}
        self._begin, self._end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.begin + 1))

    def turn(self, role: str, text: str) -> tuple[bytes, int, int]:
        """Ids of a turn as little-endian 32-bit integers, and which of them are its text."""
        head = self._begin + self.encode(_escape_role(role) + "\n")
        body = self.encode(escape(text))
        return head + body + self._end + self.encode("\n"), len(head) // 4, (len(head) + len(body)) // 4

    def text(self, ids: np.ndarray) -> str:
        of, marks = self.bytes_of, self._marks
        return b"".join([of[i] if i < self.begin else marks[i] for i in ids.tolist()]).decode("utf-8")


class _Pack:
    """The part of the prefix tree written so far."""

    def __init__(self):
        self.ids, self.loss, self.positions = [], [], []
        self.size, self.segments, self.members = 0, [], []
        self.path: list[tuple[tuple[str, str], int]] = []      # turns from the root and their segments

    def shared(self, turns: list) -> int:
        n = 0
        while n < min(len(self.path), len(turns)) and self.path[n][0] == turns[n]:
            n += 1
        return n

    def add(self, conv, turns: list, coded: list, shared: int) -> None:
        del self.path[shared:]
        for turn, (ids, lo, hi) in zip(turns[shared:], coded):
            n = len(ids) // 4
            parent = self.path[-1][1] if self.path else -1
            above = self.segments[parent] if parent >= 0 else None
            seen = []
            if above:                              # what the parent sees, and the parent
                seen = list(above["seen"])
                if seen and seen[-1]["end"] == above["start"]:
                    seen[-1] = {"start": seen[-1]["start"], "end": above["end"]}
                else:
                    seen.append({"start": above["start"], "end": above["end"]})
            first = above["position"] + above["end"] - above["start"] if above else 0
            self.ids.append(ids)
            self.positions.append(np.arange(first, first + n, dtype="<u4").tobytes())
            mask = np.zeros(n, np.uint8)
            if turn[0] == LEARNT:
                mask[lo:hi] = 1
            self.loss.append(mask.tobytes())
            self.path.append((turn, len(self.segments)))
            self.segments.append({"start": self.size, "end": self.size + n, "position": first, "parent": parent, "seen": seen})
            self.size += n
        self.members.append({"conv": conv, "leaf": self.path[-1][1]})

    def row(self) -> tuple:
        return b"".join(self.ids), b"".join(self.positions), b"".join(self.loss), self.segments, self.members


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_SEGMENT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("parent", pa.int32()),
                      ("seen", pa.list_(_SPAN))])
_DDL = ("ids binary, positions binary, loss binary, segments array<struct<start:int,end:int,position:int,parent:int,"
        "seen:array<struct<start:int,end:int>>>>, conversations array<struct<conv:{kind},leaf:int>>")


def _grouped(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns, path): whole conversations and the hashes of their turns."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    conv = F.col(conv_col)
    known = turns.where(conv.isNotNull()).groupBy(conv.alias("conv")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    alone = turns.where(conv.isNull()).select(conv.alias("conv"), F.array(one).alias("turns"))
    return known.unionByName(alone).select(
        "conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("path"))


def pack(turns: DataFrame, vocabulary: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
         text_col: str = "text", pack_tokens: int = PACK_TOKENS, pack_conversations: int = PACK_CONVERSATIONS) -> DataFrame:
    """One row per pack: token ids, positions (little-endian 32-bit integers) and
    loss mask (a byte each) of all segments, the segments, and the conversations
    with their last segments.  ``vocabulary`` names a rank file, read on the driver."""
    spark = turns.sparkSession
    blob = bpe.vocabulary(turns, vocabulary)
    rows = _grouped(turns, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv"].dataType
    members = pa.list_(pa.struct([("conv", to_arrow_type(kind)), ("leaf", pa.int32())]))
    types = [pa.binary(), pa.binary(), pa.binary(), pa.list_(_SEGMENT), members]
    names = ["ids", "positions", "loss", "segments", "conversations"]

    def batch(p: _Pack) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(p.row(), types)], names=names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        code = Tokens(blob.value).turn
        now = _Pack()
        for b in batches:
            for at in range(b.num_rows):
                conv, said = b.column(0)[at].as_py(), b.column(1)[at].as_py()
                said = [(t["role"], t["text"]) for t in said]
                shared = now.shared(said)
                coded = [code(*t) for t in said[shared:]]
                more = sum(len(c[0]) for c in coded) // 4
                if now.members and (now.size + more > pack_tokens or len(now.members) >= pack_conversations):
                    yield batch(now)
                    now = _Pack()
                    coded = [code(*t) for t in said[:shared]] + coded
                    shared = 0
                now.add(conv, said, coded, shared)
        if now.members:
            yield batch(now)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartitionByRange(parts, "path", "conv").sortWithinPartitions("path", "conv").select("conv", "turns")
            .mapInArrow(run, _DDL.format(kind=kind.simpleString())))


def unpack(packs: DataFrame, vocabulary: str) -> DataFrame:
    """(conv, formatted, turns, loss): every conversation as its last segment's
    tokens see it, its turns parsed back, and its text under the loss mask."""
    blob = bpe.vocabulary(packs, vocabulary)
    conv_kind = packs.schema["conversations"].dataType.elementType["conv"].dataType
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    types = [to_arrow_type(conv_kind), pa.string(), pa.list_(turn), pa.string()]

    def one(tokens: Tokens, ids, positions, loss, leaf: dict) -> tuple:
        spans = [*leaf["seen"], {"start": leaf["start"], "end": leaf["end"]}]
        at = np.concatenate([np.arange(s["start"], s["end"]) for s in spans])
        if not np.array_equal(positions[at], np.arange(len(at))):
            raise ValueError("positions do not follow the attention intervals")
        own = ids[at]
        text = tokens.text(own)
        said = [{"role": r, "text": t} for r, t in parse(text)]
        return text, said, unescape(tokens.text(own[loss[at] == 1]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(blob.value)
        for b in batches:
            for row in range(b.num_rows):
                ids, positions, loss, segments, members = (b.column(c)[row].as_py() for c in range(5))
                ids, positions = np.frombuffer(ids, "<u4"), np.frombuffer(positions, "<u4")
                loss = np.frombuffer(loss, np.uint8)
                last, got, out = None, None, []
                for m in members:
                    if m["leaf"] != last:
                        last, got = m["leaf"], one(tokens, ids, positions, loss, segments[m["leaf"]])
                    out.append((m["conv"], *got))
                    if len(out) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)
    names = ["conv", "formatted", "turns", "loss"]
    return packs.select("ids", "positions", "loss", "segments", "conversations").mapInArrow(
        run, f"conv {conv_kind.simpleString()}, formatted string, turns array<struct<role:string,text:string>>, loss string")


def round_trip(turns: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Packs written below the checkpoint folder and read back, as digests per conversation."""
    back = unpack(snapshot(pack(turns, vocabulary, **options), "chat-packs"), vocabulary)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def _sql_escaped(col: str) -> str:
    col = f"replace({col}, '\\', '\\\\')"
    for c in CONTROL:
        col = f"replace({col}, '{c}', '{c[0]}\\{c[1:]}')"
    return col


SQL = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
    SELECT *, '{BEGIN}' || replace({_sql_escaped('role')}, chr(10), '\\' || chr(10)) || chr(10) || {_sql_escaped('text')}
        || '{END}' || chr(10) AS formatted
    FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
