"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton names every piece that ends there, following its output links; each relaxes the best
score of that position from the one where it begins. Characters that no piece covers take the unknown score and
become byte pieces (or the unknown piece). The pieces' scores are taken as they stand in the model file. Of a
file of kind BPE a text gets the best-scoring path, which the order of merges need not give.
"""

from __future__ import annotations

import functools
import re
import zlib
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import small_batches

SPACE = "▁"
# Kinds of pieces in a model file, and what an unknown character costs below the lowest score.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNKNOWN_PENALTY = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Recent:
    """Words and what was found for them, in two generations: a full young one becomes the old one, so that words met again stay."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def keep(self, word: str, found: list[int]) -> None:
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[word] = found

    def get(self, word: str) -> list[int] | None:
        found = self.young.get(word)
        if found is None and (found := self.old.get(word)) is not None:
            self.keep(word, found)
        return found


class PieceCodec:
    #: Words of one generation whose ids are kept.
    MOST = 150_000

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.prefix, self.plain = spec.add_dummy_prefix, not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        self.path, self._library = path, None
        self.automaton = ahocorasick.Automaton()
        self.bytes: list[bytes] = []
        byte_id: dict[int, int] = {}
        self.unknown, scores, inner = 0, [], False
        for i, p in enumerate(model.pieces):
            raw = p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER) else b""
            if p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                byte_id[value], raw = i, bytes([value])
            elif p.type == UNKNOWN:
                self.unknown = i
            elif p.type in (NORMAL, USER):
                self.automaton.add_word(p.piece, (len(p.piece), p.score, i))
                scores.append(p.score)
                inner = inner or SPACE in p.piece.lstrip(SPACE)
            self.bytes.append(raw)
        self.automaton.make_automaton()
        self.fallback = [byte_id[b] for b in range(256)] if len(byte_id) == 256 else None
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        # No piece goes on over the start of a word, so the best path is the best paths of the words.
        self.words = re.compile("(?s).+") if inner else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.singles = frozenset(p.piece for p in model.pieces if p.type in (NORMAL, USER) and len(p.piece) == 1)
        self.known = Recent(self.MOST)

    def normalise(self, text: str) -> str:
        if not self.plain:
            if self._library is None:
                import sentencepiece

                self._library = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return self._library.normalize(text)
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def viterbi(self, word: str) -> list[int]:
        return self._covered(word) if self.singles.issuperset(word) else self._gapped(word)

    def _covered(self, word: str) -> list[int]:
        """Of a word whose every character is a piece: no unknown one, which costs more than any piece, is on its best path."""
        n = len(word)
        best, back = [-inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for end, piece in self.automaton.iter(word):
            end += 1
            reached = best[end - piece[0]] + piece[1]
            if reached > best[end]:
                best[end], back[end] = reached, piece
        ids: list[int] = []
        while n:
            size, _, i = back[n]
            ids.append(i)
            n -= size
        return ids[::-1]

    def _gapped(self, word: str) -> list[int]:
        n = len(word)
        best, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        done = 0

        def settle(upto: int) -> None:
            """Positions that no piece has reached are reached by an unknown character."""
            for j in range(done + 1, upto + 1):
                other = best[j - 1] + self.unknown_score
                if back[j][1] < 0 or other > best[j]:
                    best[j], back[j] = other, (j - 1, self.unknown)

        for end, (size, score, i) in self.automaton.iter(word):
            j = end + 1
            if j - 1 > done:
                settle(j - 1)
                done = j - 1
            reached = best[j - size] + score
            if back[j][1] < 0 or reached > best[j]:
                best[j], back[j] = reached, (j - size, i)
        settle(n)
        ids: list[int] = []
        j = n
        while j:
            start, i = back[j]
            if i == self.unknown and self.fallback:
                ids += [self.fallback[b] for b in reversed(word[start:j].encode())]
            else:
                ids.append(i)
            j = start
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, young = self.known, self.known.young
        for word in self.words.findall(self.normalise(text)):
            found = young.get(word)
            if found is None:
                found = known.get(word)
                if found is None:
                    found = self.viterbi(word)
                    if len(word) <= 64:
                        known.keep(word, found)
                young = known.young
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode(text: Column, model_path: str | None = None) -> Column:
    """The text's piece ids. Null and empty texts have none."""
    path = model_path or default_path()

    @arrow_udf("array<int>")
    def to_pieces(texts: pa.Array) -> pa.Array:
        codec = load(path)
        return pa.array([codec.encode(x.as_py() or "") for x in texts], pa.list_(pa.int32()))

    return to_pieces(text)


def decode(ids: Column, model_path: str | None = None) -> Column:
    """The text of piece ids; null ids have the empty text."""
    path = model_path or default_path()

    @arrow_udf("string")
    def from_pieces(lists: pa.Array) -> pa.Array:
        codec = load(path)
        return pa.array([codec.decode(x.as_py() or []) for x in lists], pa.string())

    return from_pieces(ids)


def encoded_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids_crc32, round_trip) for each row of `docs` (doc_id, text).

    ids_crc32 is over little-endian unsigned 32-bit ids; round_trip tells whether decoding gives the text again. A null
    text counts as empty, texts of any length are encoded whole. Repeated rows stay, other columns are ignored, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    path = model_path or default_path()

    @arrow_udf("struct<n_tokens: bigint, ids_crc32: bigint, round_trip: boolean>")
    def digest(texts: pa.Array) -> pa.Array:
        codec = load(path)
        counts, crcs, same = [], [], []
        for x in texts:
            text = x.as_py() or ""
            ids = codec.encode(text)
            counts.append(len(ids))
            crcs.append(zlib.crc32(np.array(ids, "<u4").tobytes()))
            same.append(codec.decode(ids) == text)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], ["n_tokens", "ids_crc32", "round_trip"])

    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), digest("text").alias("d"))
    return rows.select("doc_id", "n_bytes", "d.*")
