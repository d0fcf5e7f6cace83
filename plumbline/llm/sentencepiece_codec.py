"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reads a text once. At every position it names all pieces that end there (the node's own and those along its
output links), and each relaxes the best score of that position from the best score of its start. A character that no
piece covers costs ``UNKNOWN`` below the worst piece and is written in byte pieces. The result is the segmentation of
highest total score; equal scores take the longer last piece.

No piece of such a model has a blank after another character, so every best segmentation has a border before each run of
blanks. Words can then be solved one by one and looked up when they come again, with the same result; a model that breaks
this rule is run over whole texts. Spark reads each text once; nothing moves.

Ids decode to exactly the text they came from: blanks are marked in pieces, and a mark that stands in the text itself is
written in bytes.

Defined results: null and empty texts have no pieces and score 0. Rows without ``doc_id`` and repeated rows are encoded
like others. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_and_text

MARK = "▁"
UNKNOWN = 10.0
CACHE_WORDS = 300_000
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Codec:
    """Pieces, scores and bytes of a model, with its automaton. ``seen`` is a bounded table of solved words."""
    pieces: dict[str, int]
    scores: list[float]
    spelled: list[bytes]
    bytes_of: list[int]
    unknown: float
    by_word: bool
    automaton: ahocorasick.Automaton
    seen: dict[str, tuple[bytes, int, float]] = field(default_factory=dict)

    def solve(self, text: str) -> tuple[list[int], float]:
        """Best segmentation of a marked text: ids and score."""
        n = len(text)
        best, came, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        scores, unknown, done = self.scores, self.unknown, 0
        for end, (i, length) in self.automaton.iter(text):
            while done < end:  # positions that no later match can improve: cross one character without a piece
                done += 1
                if best[done] < best[done - 1] + unknown:
                    best[done], came[done], piece[done] = best[done - 1] + unknown, done - 1, -1
            score = best[end + 1 - length] + scores[i]
            if score > best[end + 1]:
                best[end + 1], came[end + 1], piece[end + 1] = score, end + 1 - length, i
        while done < n:
            done += 1
            if best[done] < best[done - 1] + unknown:
                best[done], came[done], piece[done] = best[done - 1] + unknown, done - 1, -1
        ids: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(self.bytes_of[b] for b in reversed(text[came[at]:at].encode("utf-8", "surrogatepass")))
            at = came[at]
        return ids[::-1], best[n]

    def word(self, text: str) -> tuple[bytes, int, float]:
        """Ids as little-endian int32 bytes, their number, and the score."""
        known = self.seen.get(text)
        if known is None:
            ids, score = self.solve(text)
            known = np.array(ids, "<i4").tobytes(), len(ids), score
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            if len(text) <= 64:
                self.seen[text] = known
        return known

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids (little-endian int32 bytes) and score of a text."""
        if not text:
            return b"", 0.0
        out, total = [], 0.0
        for i, part in enumerate((" " + text).split(MARK)):
            if i:  # a mark in the text itself
                out.append(np.array([self.bytes_of[b] for b in MARK.encode()], "<i4").tobytes())
                total += self.unknown
            marked = part.replace(" ", MARK)
            got = [self.word(w) for w in (WORDS.findall(marked) if self.by_word else [marked] if marked else [])]
            out.extend([g[0] for g in got])
            total += sum([g[2] for g in got])
        return b"".join(out), total

    def decode(self, ids) -> str:
        """The text of ids, without the blank that encoding puts before it."""
        return b"".join([self.spelled[i] for i in ids]).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def load(path: str) -> Codec:
    """The codec of a model file; made once per Python process."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, spelled, bytes_of = {}, [], [], [0] * 256
    automaton = ahocorasick.Automaton()
    for i in range(model.get_piece_size()):
        text, score = model.id_to_piece(i), model.get_score(i)
        scores.append(score)
        if model.is_byte(i):
            bytes_of[int(text[3:5], 16)] = i
            spelled.append(bytes([int(text[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            pieces[text] = i
            spelled.append(text.replace(MARK, " ").encode())
            automaton.add_word(text, (i, len(text)))
    automaton.make_automaton()
    by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
    return Codec(pieces, scores, spelled, bytes_of, min(scores[i] for i in pieces.values()) - UNKNOWN, by_word, automaton)


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_pieces, score, ids, exact (whether the ids decode to the text again)."""
    def run(batches):
        codec = load(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(1).to_pylist()
                got = [codec.encode(t) for t in texts]
                flat = np.frombuffer(b"".join(g[0] for g in got), "<i4")
                sizes = np.array([len(g[0]) // 4 for g in got], np.int32)
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                exact = [codec.decode(flat[at[i]:at[i + 1]].tolist()) == t for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), pa.array([g[1] for g in got], pa.float64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(exact)],
                                                 names=["doc_id", "n_pieces", "score", "ids", "exact"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_pieces long, score double, ids array<int>, exact boolean")


def decoded(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the column ``text`` made from ``ids``; null ids give null."""
    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        codec = load(model_path)
        return pa.array([None if x.as_py() is None else codec.decode(x.as_py()) for x in column], pa.string())

    return rows.withColumn("text", text(ids))
