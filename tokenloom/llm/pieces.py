"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by score, then by place: the best pair merges, and its new
neighbours join the agenda. No merge crosses the border between a character and the space mark that follows it (the
vocabulary is checked for that), so a text falls into chunks, encoded on their own and remembered in a bounded
dictionary of each Python worker. In each Arrow batch, the chunks met for the first time are checked against the
sentencepiece library; a difference stops the task.

Defined results: null is encoded as the empty text, which has no ids. Characters outside the vocabulary become UTF-8
byte pieces. Ids of control pieces decode to nothing; byte pieces that are not UTF-8 decode to U+FFFD, one for each
byte. Further input columns are not read; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Chunks in each of the two generations that a worker remembers, and the longest chunk that it remembers.
REMEMBERED, LONGEST = 250_000, 64
SHORT, INF = 32, float("inf")
#: A private-use character, in no piece.
OUTSIDE = "\ue000"
OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """A merge-type vocabulary read from a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            blob = f.read()
        model = proto.ModelProto()
        model.ParseFromString(blob)
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only merge-type vocabularies with byte fallback, a space prefix and no other normalisation are served")
        kinds = proto.ModelProto.SentencePiece
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.surface: list[bytes] = []
        self.byte_ids = [0] * 256
        self.is_byte: list[bool] = []
        for i, p in enumerate(model.pieces):
            self.is_byte.append(p.type == kinds.BYTE)
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.NORMAL:
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError(f"a piece crosses a word border: {p.piece}")
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kinds.CONTROL:
                self.surface.append(b"")
            elif p.type == kinds.UNKNOWN:
                self.surface.append(trainer.unk_surface.encode())
                self.unknown = i
            else:
                raise ValueError(f"pieces of type {p.type} are not served")
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        loners = "".join(re.escape(c) for c in "\t\n\r" if c not in inside)  # in no longer piece, so borders on both sides
        self.split = re.compile(f"{SPACE}+[^{SPACE}{loners}]*|[{loners}]|[^{SPACE}{loners}]+" if loners else f"{SPACE}+[^{SPACE}]*")
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.costs = {p: -s for p, s in self.scores.items()}
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def chunks(self, text: str) -> list[str]:
        return self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def merge(self, chunk: str) -> list[int]:
        """The ids of a chunk, by the agenda."""
        if (whole := self.ids.get(chunk)) is not None and len(chunk) == 1:
            return [whole]
        scores, symbols = self.scores, list(chunk)
        n = len(symbols)
        if n <= SHORT:  # a short agenda is a list with a place for each pair
            get = self.costs.get
            agenda = [get(a + b, INF) for a, b in zip(symbols, symbols[1:], strict=False)]
            while agenda and (least := min(agenda)) < INF:
                i = agenda.index(least)
                symbols[i] += symbols.pop(i + 1)
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = get(symbols[i] + symbols[i + 1], INF)
                if i:
                    agenda[i - 1] = get(symbols[i - 1] + symbols[i], INF)
            return self._ids(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (s := scores.get(pair)) is not None:
                agenda.append((-s, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != len(pair) or after[left] != right:
                continue
            symbols[left], symbols[right] = pair, ""
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
                new = pair + symbols[follower]
                if (s := scores.get(new)) is not None:
                    heapq.heappush(agenda, (-s, left, follower, new))
            if (leader := before[left]) >= 0:
                new = symbols[leader] + pair
                if (s := scores.get(new)) is not None:
                    heapq.heappush(agenda, (-s, leader, left, new))
        return self._ids([s for s in symbols if s])

    def _ids(self, symbols: list[str]) -> list[int]:
        out, ids = [], self.ids
        for s in symbols:
            if (i := ids.get(s)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in s.encode())
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.chunks(text or "") for i in self.merge(c)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first piece loses one leading space, and stray bytes become U+FFFD."""
        parts, at, first = [], 0, True
        while at < len(ids):
            if self.is_byte[ids[at]]:
                end = at
                while end < len(ids) and self.is_byte[ids[end]]:
                    end += 1
                parts.append(_utf8(b"".join(self.surface[i] for i in ids[at:end])))
                at, first = end, False
                continue
            piece = self.surface[ids[at]].decode()
            if first and piece.startswith(" ") and ids[at] != self.unknown:
                piece, first = piece[1:], False
            first = first and not piece
            parts.append(piece)
            at += 1
        return "".join(parts)

    def batch(self, texts: list[str | None], check: bool = True) -> list[tuple[int, str, str]]:
        """(number of ids, digest of ids, digest of the decoded text) of each text."""
        known, out, fresh = self.known, [], []
        for text in texts:
            got = []
            for c in self.chunks(text or ""):
                if (x := known.get(c)) is None:
                    if (x := self.older.get(c)) is None:
                        x = self._new(c, fresh)
                    if len(c) <= LONGEST:
                        known[c] = x
                got.append(x)
            joined, decoded = ",".join([x[0] for x in got]), b"".join([x[1] for x in got])
            if decoded[:1] == b" ":
                decoded = decoded[1:]
            out.append((joined.count(",") + 1 if got else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            if len(known) > REMEMBERED:
                self.older, known = known, {}
                self.known = known
            if len(fresh) > 20_000:
                fresh = self._check(fresh) if check else []
        if check and fresh:
            self._check(fresh)
        return out

    def _new(self, chunk: str, fresh: list[tuple[str, list[int]]]) -> tuple[str, bytes]:
        """A chunk's ids, joined, and what they decode to. Pairs of characters in no piece are borders; the parts are remembered too."""
        pairs, parts, begin = self.pairs, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in pairs:
                parts.append(chunk[begin:i])
                begin = i
        parts.append(chunk[begin:])
        got = []
        for p in parts:
            if (x := self.known.get(p) or self.older.get(p)) is None:
                ids = self.merge(p)
                x = ",".join(map(str, ids)), self._decoded(ids)
                fresh.append((p, ids))
                if len(p) <= LONGEST and len(parts) > 1:
                    self.known[p] = x
            got.append(x)
        return got[0] if len(got) == 1 else (",".join([x[0] for x in got]), b"".join([x[1] for x in got]))

    def _decoded(self, ids: list[int]) -> bytes:
        # a chunk holds whole characters, so its bytes are UTF-8
        return b"".join(map(self.surface.__getitem__, ids))

    def _check(self, fresh: list[tuple[str, list[int]]]) -> list:
        """Against the library, behind a character that is in no piece and so begins a chunk of its own."""
        before = self.library.encode(OUTSIDE)
        for (c, ids), got in zip(fresh, self.library.encode([OUTSIDE + c for c, _ in fresh], num_threads=1), strict=True):
            if got != before + ids:
                raise ValueError(f"the library encodes {c!r} as {got}, not {ids}")
        return []


def _utf8(raw: bytes) -> str:
    """One U+FFFD for each byte that begins no whole character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True, rows: int = 256) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of its ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                got = pieces.batch(part.column(1).to_pylist(), check)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, OUT)


def token_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for b in batches:
            ids = [pieces.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([pieces.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
