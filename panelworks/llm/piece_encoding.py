"""Exact merge-type (BPE) encoding with a SentencePiece vocabulary by backtracking, and decoding.

A text is cut where no piece can reach across: before a run of space marks and around characters
without a piece of their own. Each cut is encoded by backtracking: an Aho-Corasick automaton gives
all pieces that start at each position; the longest is tried first; a piece is accepted if merging
the text of it and its left neighbour anew gives just these two; positions from which no way leads
on are marked in a bitfield and never tried again. Frequent cuts are remembered, in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import text_kernels as K
from panelworks.llm.learning import table

MARK = "▁"
CUT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
REMEMBERED = 100_000  # cuts in each of two generations
LONGEST_REMEMBERED = 40  # characters


class PieceCodec:
    """Encoder and decoder for a vocabulary of (piece, score, kind); kind: n(ormal), b(yte), other."""

    def __init__(self, vocabulary: list[tuple[str, float, str]], end_id: int):
        self.end_id, self.unknown = end_id, next((i for i, x in enumerate(vocabulary) if x[2] == "u"), 0)
        self.ids = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == "n"}
        self.score = [s for _, s, _ in vocabulary]
        self.pieces = [p for p, _, _ in vocabulary]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "b"}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == "b" else p.replace(MARK, " ").encode() if kind == "n" else b"" for p, _, kind in vocabulary]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.decimal = [b"%d" % i for i in range(len(vocabulary))]
        self.characters = frozenset(p for p in self.ids if len(p) == 1)
        self.size = [len(p) for p in self.pieces]
        self.shorter = [0] * len(vocabulary)  # the next shorter piece that a piece begins with; 0: none
        self.automaton = ahocorasick.Automaton()
        usable = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [i]}  # others never come out of merging
        for p, i in usable.items():
            self.automaton.add_word(p, i)
            self.shorter[i] = next((usable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in usable), 0)
        self.automaton.make_automaton()
        self.fit: dict[int, bool] = {}
        self.hot: dict[str, tuple[bytes, bytes]] = {}
        self.cold: dict[str, tuple[bytes, bytes]] = {}

    def merge(self, text: str) -> list[int]:
        """Merges adjacent pieces, best score first and leftmost among equals; for short texts of known characters."""
        parts, ids, score = list(text), self.ids, self.score
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, where = score[i], k
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        got = self.fit.get(pair)
        if got is None:
            if len(self.fit) > 200_000:
                self.fit.clear()
            got = self.fit[pair] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return got

    def backtrack(self, text: str) -> list[int]:
        """Piece ids of a text whose characters all are pieces (piece 0 is none of them)."""
        n, size, shorter, fit = len(text), self.size, self.shorter, self.fit
        longest = [0] * n
        for end, i in self.automaton.iter(text):  # of pieces with one start, the longest comes last
            longest[end + 1 - size[i]] = i
        usable, taken, at, last, i = bytearray(b"\1") * (n + 1), [], 0, 0, longest[0]
        while at < n:
            while i:
                if usable[at + size[i]]:
                    good = not last or fit.get(last << 32 | i)
                    if good or good is None and self.compatible(last, i):
                        break
                i = shorter[i]
            if i:
                taken.append(i)
                at += size[i]
                last, i = i, longest[at] if at < n else 0
            else:
                usable[at] = 0
                if not taken:
                    raise ValueError(f"no valid encoding of {text[:80]!r}")
                i = taken.pop()
                at -= size[i]
                last, i = taken[-1] if taken else 0, shorter[i]
        return taken

    def encode_cut(self, text: str) -> list[int]:
        if self.characters.issuperset(text):
            return self.backtrack(text)
        out, known = [], []
        for c in text:
            if c in self.characters:
                known.append(c)
                continue
            if known:
                out += self.backtrack("".join(known))
                known = []
            out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
        return out + self.backtrack("".join(known)) if known else out

    def decode_cut(self, ids: list[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])

    def _learnt(self, cut: str) -> tuple[bytes, bytes]:
        got = self.cold.get(cut)
        if got is None:
            ids = self.encode_cut(cut)
            got = b" ".join([self.decimal[i] for i in ids]), self.decode_cut(ids)
        if len(cut) <= LONGEST_REMEMBERED:
            if len(self.hot) >= REMEMBERED:
                self.cold, self.hot = self.hot, {}
            self.hot[cut] = got
        return got

    def digest(self, text: str) -> tuple[bytes, bytes]:
        """Ids as decimal text, the end id last, and the decoded text in UTF-8."""
        end = b"%d" % self.end_id
        if not text:
            return end, b""
        cuts = CUT.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.hot.get, cuts))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    found[k] = self.hot.get(cuts[k]) or self._learnt(cuts[k])
        ids = [x[0] for x in found]
        ids.append(end)
        decoded = b"".join([x[1] for x in found])[1:]  # less the space that encoding put first
        try:
            decoded.decode()
        except UnicodeDecodeError:
            decoded = decoded.decode("utf-8", "replace").encode()
        return b" ".join(ids), decoded

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.digest(text)[0].split()]


def read_vocabulary(path: str) -> tuple[list[tuple[str, float, str]], int]:
    """Pieces, scores and kinds of a model file, and its end id."""
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "b" if p.is_byte(i) else "u" if p.is_unknown(i) else "c" if p.is_control(i) or p.is_unused(i) else "n"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())], p.eos_id()


_codecs: WeakKeyDictionary = WeakKeyDictionary()


def _codec(shared) -> PieceCodec:
    """One codec for each broadcast vocabulary in a Python worker, so that what it remembers serves all its tasks; it goes when the broadcast does."""
    if shared not in _codecs:
        _codecs[shared] = PieceCodec(*shared.value)
    return _codecs[shared]


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(documents: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Token counts and digests of ids and decoded text of every whole text; with the ids and the text themselves on request.

    Null and empty texts have the end id alone and decode to the empty text. Repeated rows are
    encoded one by one; other columns are ignored.
    """
    vocabulary, end_id = read_vocabulary(model_path)
    shared = documents.sparkSession.sparkContext.broadcast((vocabulary, end_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts, ids, texts, plain = [], [], [], ([], [])
                for value in part.column("text"):
                    coded, decoded = codec.digest(value.as_py() or "")
                    counts.append(coded.count(b" ") + 1)
                    ids.append(hashlib.sha256(coded).hexdigest())
                    texts.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        plain[0].append([int(x) for x in coded.split()])
                        plain[1].append(decoded.decode())
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
                if with_ids:
                    columns |= {"ids": pa.array(plain[0], pa.list_(pa.int32())), "decoded": pa.array(plain[1], pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    schema = ENCODED + (", ids array<int>, decoded string" if with_ids else "")
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.lean(run), schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), default_model())
