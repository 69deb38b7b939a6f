"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi pass.

The automaton runs over the text once; at every position it reports, by its
output links, all pieces that end there, longest first, and each relaxes the best
score at that position. The best segmentation under the pieces' scores is exact.
A character that is no piece falls back to the pieces of its UTF-8 bytes.

No piece has the space mark after another character, so a best segmentation never
crosses the start of a word and words are segmented one by one; the answers for
common words are kept.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.arrow import long_rows

MARK = "▁"
KEPT_WORDS = 300_000
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Pieces:
    """Pieces with scores; ``normal`` maps a piece to its id, ``byte_ids`` holds the
    ids of the 256 byte pieces (empty: unknown characters become ``unknown``)."""

    def __init__(self, normal: dict[str, int], scores: np.ndarray, byte_ids: list[int], unknown: int = 0):
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece has the space mark after another character")
        self.normal, self.scores, self.byte_ids, self.unknown = normal, scores, byte_ids, unknown
        self.automaton = ahocorasick.Automaton()
        for piece, number in normal.items():
            self.automaton.add_word(piece, (len(piece), float(scores[number]), number))
        self.automaton.make_automaton()
        self.single = {p for p in normal if len(p) == 1}
        self.fallback = min((float(scores[i]) for i in normal.values()), default=0.0) - 10.0
        self.texts = {number: piece.replace(MARK, " ").encode() for piece, number in normal.items()}
        self.texts |= {number: bytes([b]) for b, number in enumerate(byte_ids)}
        self.words: dict[str, tuple[bytes, float]] = {}

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        byte_ids, normal = [0] * 256 if any(model.is_byte(i) for i in range(n)) else [], {}
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(BYTE.fullmatch(model.id_to_piece(i))[1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal[model.id_to_piece(i)] = i
        return cls(normal, np.array([model.get_score(i) for i in range(n)]), byte_ids, model.unk_id())

    def _spelled(self, char: str) -> tuple[list[int], float]:
        """Ids and score of a character that is no piece."""
        if not self.byte_ids:
            return [self.unknown], self.fallback
        ids = [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return ids, self.fallback * len(ids)

    def segment(self, word: str) -> tuple[bytes, float]:
        """Ids, as 32-bit numbers, and score of the best segmentation of marked
        text. Among equal scores the longest last piece wins, at every position."""
        n = len(word)
        best: list[float] = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        spelled = [k for k, c in enumerate(word) if c not in self.single]
        due = 0
        for end, (length, score, number) in self.automaton.iter(word):
            while due < len(spelled) and spelled[due] < end:       # before pieces that end after it
                k = spelled[due]
                total = best[k] + self._spelled(word[k])[1]
                if total > best[k + 1]:
                    best[k + 1], back[k + 1] = total, (k, -1)
                due += 1
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (end + 1 - length, number)
        for k in spelled[due:]:
            total = best[k] + self._spelled(word[k])[1]
            if total > best[k + 1]:
                best[k + 1], back[k + 1] = total, (k, -1)
        ids: list[int] = []
        at = n
        while at:
            start, number = back[at]
            ids += [number] if number >= 0 else self._spelled(word[start])[0][::-1]
            at = start
        return array("i", ids[::-1]).tobytes(), best[n]

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids and score of a text. A space mark in the text itself is spelled in
        bytes, so that it is not taken for a space."""
        ids, score = [], 0.0
        known = self.words
        if len(known) > KEPT_WORDS:
            known.clear()
        if not text:
            return b"", 0.0
        for k, part in enumerate(text.split(MARK)):
            if k:
                spelled, cost = self._spelled(MARK)
                ids.append(array("i", spelled).tobytes())
                score += cost
            for word in WORD.findall((" " + part if not k else part).replace(" ", MARK)):
                got = known.get(word)
                if got is None:
                    got = self.segment(word)
                    if len(word) < 64:
                        known[word] = got
                ids.append(got[0])
                score += got[1]
        return b"".join(ids), score

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space put before it."""
        texts = self.texts
        data = b"".join([texts.get(i, b" \xe2\x81\x87 ") for i in array("i", ids)])
        return data.removeprefix(b" ").decode("utf-8", "replace")


def public_pieces() -> Callable[[], Pieces]:
    """The 32k vocabulary that every worker has installed."""
    def make() -> Pieces:
        import public_tokenizers

        return Pieces.from_model(public_tokenizers.path("piece_bpe_32k.model"))
    return make


_LOADED: dict[str, Pieces] = {}     # of one worker process


def _loaded(make: Callable[[], Pieces]) -> Pieces:
    name = f"{make.__module__}.{make.__qualname__}"
    if name not in _LOADED:
        _LOADED[name] = make()
    return _LOADED[name]


def encode(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    pieces: Callable[[], Pieces] | None = None,
) -> DataFrame:
    """``doc_id, ids`` (little-endian 32-bit numbers) and ``score`` of every row.

    Null and empty texts have no ids. Repeated rows stay, an empty table gives an
    empty one, other columns are not read.
    """
    make = pieces or public_pieces()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(make)
        for batch in batches:
            found = [model.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i for i, _ in found], pa.binary()),
                 pa.array([s for _, s in found], pa.float64())], names=["doc_id", "ids", "score"])
    return long_rows(docs).select(F.col(id_column).cast("long").alias("doc_id"), text_column).mapInArrow(
        run, "doc_id long, ids binary, score double")


def decode(encoded: DataFrame, pieces: Callable[[], Pieces] | None = None) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id`` and ``ids``."""
    make = pieces or public_pieces()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(make)
        for batch in batches:
            texts = [model.decode(i.as_py() or b"") for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    pieces: Callable[[], Pieces] | None = None,
) -> DataFrame:
    """Encode and decode in one pass: ``doc_id, n_pieces, n_bytes`` (of those, byte
    pieces), ``ids_crc32, score`` and ``round_trip``, whether the text came back."""
    make = pieces or public_pieces()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(make)
        spelled = np.zeros(len(model.scores), bool)
        spelled[model.byte_ids] = True
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                ids, score = model.encode(text)
                numbers = np.frombuffer(ids, np.int32)
                rows.append((len(numbers), int(spelled[numbers].sum()), zlib.crc32(ids), score,
                             model.decode(ids) == text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            columns = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "score", "round_trip"])
    return long_rows(docs).select(F.col(id_column).cast("long").alias("doc_id"), text_column).mapInArrow(
        run, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, score double, round_trip boolean")
