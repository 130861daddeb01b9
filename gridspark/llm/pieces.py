"""SentencePiece encoding and decoding with a forward pass shared over a trie of marked words."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import text_chunks

MARK = "▁"
#: No piece crosses from a word into the next mark, nor touches a line end; Codec checks that.
UNITS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
#: Distinct words that a Python worker remembers between batches; then it starts anew.
REMEMBERED = 400_000


class Codec:
    """Pieces of a public SentencePiece model with identity normalisation and byte fallback.

    kind "unigram": the forward state of a prefix is the best sum of piece scores and its last piece (Viterbi).
    kind "bpe": merges, not sums, decide.  The segmentation of a prefix is that of a shorter prefix and one more
    piece which forms a stable pair with the piece before it, that is, merging both together from characters gives
    back the two.  So the forward state is the one last piece that passes, and the lattice is walked in the same way.
    """

    def __init__(self, pieces: Iterable[tuple[str, float, str]], kind: str = "bpe"):
        """pieces in order of id: (piece, score, normal | byte | control | unknown)."""
        self.kind, self.table = kind, list(pieces)
        self.ids = {p: i for i, (p, _, t) in enumerate(self.table) if t == "normal"}
        self.score = {p: s for p, s, t in self.table if t == "normal"}
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.table) if t == "byte"}
        self.unknown = next((i for i, x in enumerate(self.table) if x[2] == "unknown"), 0)
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in self.ids):
            raise ValueError("a piece crosses the end of a marked word")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if t == "byte" else p.replace(MARK, " ").encode() if t == "normal" else b"" for p, _, t in self.table]
        self.worst = min(self.score.values(), default=0.0) - 10.0
        self.suffixes = {p[k:] for p in self.ids for k in range(len(p))}
        self.stable: dict[tuple[str, str], bool] = {}
        self.words: dict[str, np.ndarray] = {}

    @classmethod
    def load(cls, path: str) -> list[tuple[str, float, str]]:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        sort = lambda i: "byte" if p.is_byte(i) else "control" if p.is_control(i) else "unknown" if p.is_unknown(i) else "normal"
        return [(p.id_to_piece(i), p.get_score(i), sort(i)) for i in range(p.get_piece_size())]

    def merged(self, s: str) -> list[str]:
        """Byte-pair merges of a short string: the best score first, then the leftmost."""
        parts, score = list(s), self.score.get
        pairs = [score(x + y) for x, y in zip(parts, parts[1:])]
        while True:
            best, at = None, 0
            for i, x in enumerate(pairs):
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1])

    def _stable(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.stable.get(key)) is None:
            known = (not left or left + right not in self.score) and self.merged(left + right) == ([left, right] if left else [right])
            if len(self.stable) > 500_000:
                self.stable.clear()
            self.stable[key] = known
        return known

    def _best(self, word: str, end: int, states: list[tuple[float, str]]) -> tuple[float, str]:
        """Best sum and last piece of word[:end], given those of all shorter prefixes (states[0] is the empty one)."""
        best = (states[end - 1][0] + self.score.get(word[end - 1], self.worst), word[end - 1])
        for start in range(max(0, end - self.longest), end - 1):
            if (s := self.score.get(word[start:end])) is not None and states[start][0] + s > best[0]:
                best = (states[start][0] + s, word[start:end])
        return best

    def _passing(self, word: str, begin: int, lasts: list[str]) -> None:
        """Add the one last piece that passes of each prefix of word longer than begin to lasts, those of the shorter ones."""
        known, score, suffixes = self.stable.get, self.score, self.suffixes
        for end in range(begin + 1, len(word) + 1):
            start, piece = end - 1, word[end - 1]
            fits = True
            while True:
                if fits:
                    left = lasts[start]
                    if (ok := known((left, piece))) is None:
                        ok = self._stable(left, piece)
                    if ok:
                        break
                if not start or piece not in suffixes:
                    raise AssertionError("some piece always fits")
                start -= 1
                piece = word[start:end]
                fits = piece in score
            lasts.append(piece)

    def encode_sorted(self, words: list[str]) -> Iterable[tuple[str, list[str]]]:
        """Pieces of distinct words in sorted order, which is a depth-first walk over their trie.

        The last pieces of the last word's prefixes are a stack; what a word shares with the last one stays on it.
        """
        lasts, states, last = [""], [(0.0, "")], ""
        for word in words:
            same = 0
            for x, y in zip(word, last):
                if x != y:
                    break
                same += 1
            del lasts[same + 1 :]
            if self.kind == "unigram":
                del states[same + 1 :]
                for end in range(same + 1, len(word) + 1):
                    states.append(self._best(word, end, states))
                    lasts.append(states[-1][1])
            else:
                self._passing(word, same, lasts)
            last, out, at = word, [], len(word)
            while at:
                out.append(lasts[at])
                at -= len(out[-1])
            out.reverse()
            yield word, out

    def piece_ids(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin (one place more than texts)."""
        code: defaultdict[str, int] = defaultdict()
        code.default_factory = code.__len__  # a new word's code is the number of words before it
        per, flat = [], []
        for t in texts:
            units = UNITS.findall(MARK + t.replace(" ", MARK)) if t else ()
            per.append(len(units))
            flat.extend(map(code.__getitem__, units))
        code.default_factory = None
        if len(self.words) > REMEMBERED:
            self.words.clear()
        for word, pieces in self.encode_sorted(sorted(w for w in code if w not in self.words)):
            ids = list(map(self.ids.get, pieces))
            if None in ids:
                ids = [i for p in pieces for i in self.piece_ids(p)]
            self.words[word] = np.array(ids, np.int32)
        arrays = [self.words[w] for w in code]
        lengths = np.array([len(a) for a in arrays], np.int64)
        every = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        codes = np.array(flat, np.int64)
        n = lengths[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(begin[codes] - (ends - n), n)
        first = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        return every[at], np.concatenate([[0], ends])[first]

    def decode(self, ids) -> str:
        """Text of a sequence of ids: the first mark is the one that encoding adds; broken bytes become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, ids))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    pieces, kind, key = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(pieces, kind)
    return _codecs[key]


def _slices(batches, rows: int = 200):
    """Arrow batches by few rows at a time: of a batch of long texts only so many become Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_pieces(docs: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids, round_trip (decoding gives the text back).

    model is the path of a SentencePiece file on the driver; its pieces (a fixed vocabulary) are broadcast.  Words
    are looked up, walked and put together within a batch, so nothing is shuffled.  NULL and empty texts have no
    ids; a mark within a text counts as a space; NULL ids and repeated rows are kept; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((Codec.load(model), kind, uuid.uuid4().hex))

    def run(batches):
        codec = _codec(shared)
        for batch in _slices(batches):
            for ids, texts in text_chunks(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), 1_000_000):
                plain = [t.decode() for t in texts]
                flat, at = codec.encode(plain)
                same = [codec.decode(flat[a:b].tolist()) == t.replace(MARK, " ") for t, a, b in zip(plain, at, at[1:])]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.diff(at), pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text of arrays of ids; NULL gives the empty text."""
    spark = encoded.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((Codec.load(model), "bpe", uuid.uuid4().hex))

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            texts = [codec.decode(x or ()) for x in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
