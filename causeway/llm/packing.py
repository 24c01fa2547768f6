"""Vector bin packing of token sequences by the dot-product heuristic.

Limits hold at once for tokens, segments and loss-bearing tokens of a sequence. The open sequence takes, of a bounded pool of examples,
the one whose demand has the largest dot product with what is left (each dimension scaled by its limit) among those that fit whole; if
none does, the one with the largest demand is cut to fill the rest exactly. A sequence that can't be filled (the segment or loss limit is
reached, or the partition ends) is closed at the largest power of two that it holds, where no padding is due, and the rest goes back to
the pool. So no position is padded, in any partition.

Each partition of the input is packed by itself as it streams by, in its own order: no shuffle, memory bounded by the pool and the longest
text, and a retried task gives the same sequences.

Edge cases: a null or empty text holds the end token alone; a null id stays null; repeated rows are packed each for itself; a text of any
length is cut; other columns are neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import by_value

by_value(__name__)

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
TOKENIZER = "word_bpe_49k.json"


class Words:
    """Ids of a text, word by word. The vocabulary's rules never cross white space, so each distinct word is encoded once while it is kept.

    A word of Latin-1 characters is lower-cased and cut into pieces here, as the vocabulary's file asks, and only unseen pieces go to its
    merges; any other word goes through the whole tokenizer.
    """

    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, keep: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known, self.pieces = Tokenizer.from_file(path), keep, {}, {}
        self.merge, self.cut = self.tokenizer.model.tokenize, regex.compile(self.PIECE).findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        self.byte = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in plain)}

    def piece(self, p: str) -> bytes:
        if (own := self.pieces.get(p)) is None:
            ids = [t.id for t in self.merge(p if p.isascii() and p.isalnum() else p.encode().decode("latin-1").translate(self.byte))]
            own = self.pieces[p] = struct.pack(f"<{len(ids)}I", *ids)
        return own

    def word(self, w: bytes) -> bytes:
        text = w.decode()
        if not w.isascii() and max(text) > "\xff" or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        text = text.lower()
        if text.isalpha():
            return self.piece(text)
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            return self.piece(text[:-1]) + self.piece(text[-1])
        return b"".join([self.piece(p) for p in self.cut(text)])

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words, known = text.split(), self.known
        if len(known) > self.keep:
            known.clear()
        if len(self.pieces) > self.keep:
            self.pieces.clear()
        word = self.word
        out = []
        for w in words:
            if (own := known.get(w)) is None:
                own = known[w] = word(w)
            out.append(own)
        return b"".join(out)


class Packer:
    """Takes examples one by one, gives finished sequences as lists of pieces (key, start, length, offset, example)."""

    def __init__(self, tokens: int = 4096, segments: int = 64, loss: int = 4096, pool: int = 256):
        self.limits, self.most = np.array([tokens, segments, loss]), pool
        self.items: list = []  # [key, ids, at, end, first position that bears loss]
        self.need = np.zeros((4 * pool, 3), np.int64)

    def demand(self, x: list) -> tuple[int, int, int]:
        return x[3] - x[2], 1, max(0, x[3] - max(x[2], x[4]))

    def put(self, x: list) -> None:
        if len(self.items) == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[len(self.items)] = self.demand(x)
        self.items.append(x)

    def pull(self, i: int) -> list:
        x, last = self.items[i], self.items.pop()
        if last is not x:
            self.items[i] = last
            self.need[i] = self.need[len(self.items)]
        return x

    def add(self, key, ids: bytes, loss_from: int = 0) -> Iterator[list]:
        n, tokens = len(ids) // 4, int(self.limits[0])
        at = 0
        while n - at >= tokens and self.limits[2] >= tokens:
            yield [(key, at, tokens, 0, ids, loss_from)]
            at += tokens
        if at < n:
            self.put([key, ids, at, n, loss_from])
        while len(self.items) >= self.most:
            yield self.sequence()

    def finish(self) -> Iterator[list]:
        while self.items:
            yield self.sequence()

    def sequence(self) -> list:
        left, used, pieces = self.limits.copy(), 0, []
        while left.min() > 0 and self.items:
            need = self.need[: len(self.items)]
            score = (need / self.limits) @ (left / self.limits)
            if len(self.items) > 1 and left[1] == 1:  # the last segment should fill the sequence
                score = np.where(need[:, 0] >= left[0], score + 10, score)
                i = int(score.argmax())
            else:
                fits = (need <= left).all(1)
                i = int(np.where(fits, score, -1).argmax()) if fits.any() else int(score.argmax())
            x = self.pull(i)
            take = min(x[3] - x[2], int(left[0]))
            while max(0, x[2] + take - max(x[2], x[4])) > left[2]:  # only if loss is limited more tightly than tokens
                take = max(0, x[4] - x[2]) + int(left[2])
            pieces.append((x[0], x[2], take, used, x[1], x[4]))
            left -= (take, 1, max(0, x[2] + take - max(x[2], x[4])))
            used += take
            if x[2] + take < x[3]:
                self.put([x[0], x[1], x[2] + take, x[3], x[4]])
        if used < self.limits[0]:
            whole = 1 << (used.bit_length() - 1)
            while used > whole:
                key, start, length, offset, ids, loss_from = pieces.pop()
                keep = max(0, whole - offset)
                if keep:
                    pieces.append((key, start, keep, offset, ids, loss_from))
                self.put([key, ids, start + keep, start + length, loss_from])
                used = offset + keep
        return pieces


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokens: int = 4096, segments: int = 64, loss: int | None = None, pool: int = 256, loss_from_col: str | None = None, prompt_col: str | None = None) -> DataFrame:
    """A row for each piece, as in SCHEMA: positions start to start + length of a document's ids stand at `offset` of sequence_id.

    prompt_col names a text whose ids stand before the text's own and bear no loss; loss_from_col the first position of each text's own ids that
    does. Without them, or where they are null, all do.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, packer, end = Words(tokenizer_path), Packer(tokens, segments, loss or tokens, pool), np.array([end_id], "<u4").tobytes()
        number, rows = TaskContext.get().partitionId() << 36, []

        def note(pieces: list) -> None:
            nonlocal number
            for key, start, length, offset, ids, loss_from in pieces:
                rows.append((key, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, number, offset, max(0, start + length - max(start, loss_from))))
            number += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            rows.clear()
            return out

        for b in batches:
            for key, text, bears, prompt in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                before = words.encode(prompt.as_buffer().to_pybytes())
                for pieces in packer.add(key, before + words.encode(text.as_buffer().to_pybytes()) + end, len(before) // 4 + bears):
                    note(pieces)
                if len(rows) > 20_000:
                    yield batch()
        for pieces in packer.finish():
            note(pieces)
        if rows:
            yield batch()

    coded = lambda c: F.encode(F.coalesce(F.col(f"`{c}`") if c else F.lit(""), F.lit("")), "UTF-8")
    bears = F.coalesce(F.col(f"`{loss_from_col}`").cast("long"), F.lit(0)) if loss_from_col else F.lit(0)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), coded(text_col).alias("text"), bears.cast("long").alias("loss_from"), coded(prompt_col).alias("prompt")).mapInArrow(run, SCHEMA)


def answers(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", role: str = "assistant") -> DataFrame:
    """id_col, turn_col, prompt and text: each turn of the role as an answer, the turn before it, if there is one, as its prompt. A null prompt or text is empty."""
    before = F.lag(text_col).over(Window.partitionBy(id_col).orderBy(turn_col, role_col, text_col))
    return conversations.select(id_col, turn_col, role_col, F.coalesce(before, F.lit("")).alias("prompt"), F.coalesce(text_col, F.lit("")).alias("text")).where(F.col(role_col) == role).drop(role_col)
