"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut at blanks into words, each marked at its front with U+2581.  The distinct marked
words of a batch are sorted, which puts them in the order of a depth-first walk over their trie;
going from one word to the next keeps the forward scores of the common prefix and computes only
what is new.  The best segmentation has the highest sum of piece scores (ties: the longer last
piece).  Characters without a piece become byte pieces.  Decoding gives back the exact text.

The vocabulary is read once on the driver and travels with the tasks; no task reads a local file.
Words already seen by a task are remembered, up to ``REMEMBER`` words.
"""
from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pick

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBER = 300_000
#: A byte piece scores this much less than the worst piece.
BYTE_PENALTY = 10.0


def load_vocabulary(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; kind 0: ordinary, 1: byte, 2: never used."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        other = sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)
        out.append((sp.id_to_piece(i), sp.get_score(i), 1 if sp.is_byte(i) else 2 if other else 0))
    return out


class Segmenter:
    """Best segmentations of marked words."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        self.pieces = vocabulary
        self.head: dict[str, tuple[float, int]] = {}   # pieces that begin with the mark
        self.body: dict[str, tuple[float, int]] = {}
        self.byte = [-1] * 256
        for i, (p, score, kind) in enumerate(vocabulary):
            if kind == 1:
                self.byte[int(p[1:-1], 16)] = i
            elif kind == 0 and MARK not in p[1:]:
                (self.head if p[0] == MARK else self.body)[p] = (score, i)
        if MARK not in self.head or min(self.byte) < 0:
            raise ValueError("the vocabulary needs the mark and all byte pieces")
        worst = min(s for _, s, kind in vocabulary if kind == 0)
        self.byte_score = worst - BYTE_PENALTY
        tails: dict[str, set[int]] = {}
        for p in self.body:
            if len(p) > 2:
                tails.setdefault(p[-3:], set()).add(len(p))
        # lengths of the pieces that end in three characters, longest first; one and two are always tried
        self.tails: dict[str, tuple[int, ...]] = {t: (*sorted(n, reverse=True), 2, 1) for t, n in tails.items()}
        self.longest_head = max(map(len, self.head))
        self.known: dict[str, bytes] = {}
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if kind == 1 else (" " + p[1:] if p[:1] == MARK else p).encode("utf-8", "surrogatepass")
                         for p, _, kind in vocabulary]

    def learn(self, words: Iterable[str]) -> None:
        """Segment the words in sorted order, sharing the forward scores of common prefixes."""
        head, body, tails, longest, short = self.head, self.body, self.tails, self.longest_head, (2, 1)
        best: list[float] = [0.0]                      # score of the best segmentation of each prefix
        back: list[tuple[int, tuple[int, ...]]] = [(0, ())]  # where its last piece starts, and the piece's ids
        last = ""
        for w in sorted(words):
            n = 0
            top = min(len(w), len(last))
            while n < top and w[n] == last[n]:
                n += 1
            del best[n + 1:], back[n + 1:]
            for i in range(n + 1, len(w) + 1):
                score, at, ids = None, 0, ()
                if i <= longest and (hit := head.get(w[:i])):
                    score, ids = hit[0], (hit[1],)
                for m in tails.get(w[i - 3:i], short) if i > 3 else short:
                    j = i - m
                    if j < 1:
                        continue
                    hit = body.get(w[j:i])
                    if hit and (score is None or best[j] + hit[0] > score):
                        score, at, ids = best[j] + hit[0], j, (hit[1],)
                if score is None:  # no piece ends here: the bytes of the last character
                    raw = w[i - 1].encode("utf-8", "surrogatepass")
                    score, at = best[i - 1] + self.byte_score * len(raw), i - 1
                    ids = tuple(self.byte[b] for b in raw)
                best.append(score)
                back.append((at, ids))
            last = w
            out: list[tuple[int, ...]] = []
            i = len(w)
            while i:
                i, ids = back[i]
                out.append(ids)
            flat = [x for ids in reversed(out) for x in ids]
            self.known[w] = struct.pack(f"<{len(flat)}i", *flat)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers; an empty text has none."""
        split = [[MARK + w for w in t.split(" ")] if t else [] for t in texts]
        if len(self.known) > REMEMBER:
            self.known = {}
        known = self.known
        self.learn({w for ws in split for w in ws if w not in known})
        return [b"".join([known[w] for w in ws]) for ws in split]

    def decode(self, raw: bytes) -> str:
        whole = b"".join(map(self.bytes_of.__getitem__, memoryview(raw).cast("i")))
        return whole.decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, vocabulary: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text.  Null and empty texts have none; no rows from an
    empty table."""
    src = pick(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))

    def make():
        seg = Segmenter(vocabulary)
        return lambda texts: [[list(memoryview(r).cast("i")) for r in seg.encode_batch(texts)]]
    return map_texts(src, make, "ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: list, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the inverse of ``encode``.  Null ids count as none."""
    src = pick(encoded, id_col, ids_col).toDF("id", "ids")

    def make():
        seg = Segmenter(vocabulary)
        return lambda rows: [[seg.decode(struct.pack(f"<{len(r or [])}i", *(r or []))) for r in rows]]
    return map_texts(src, make, "text string", text="ids").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, vocabulary: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_chars, n_tokens, ids_sha256`` (of the ids as little-endian 32-bit
    integers) and ``restored``: whether decoding gives the text back."""
    src = pick(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    src = src.withColumn("n_chars", F.char_length("text").cast("long"))

    def make():
        seg = Segmenter(vocabulary)

        def work(texts):
            raw = seg.encode_batch(texts)
            return [[len(r) // 4 for r in raw], [hashlib.sha256(r).hexdigest() for r in raw],
                    [seg.decode(r) == t for r, t in zip(raw, texts)]]
        return work
    return map_texts(src, make, "n_tokens long, ids_sha256 string, restored boolean").withColumnRenamed("id", id_col)
