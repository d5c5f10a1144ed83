"""Packing token sequences by a dot-product heuristic over several limits.

A document's tokens are cut into pieces that a sequence can hold, which wait in
a bounded pool. An open sequence takes, again and again, the waiting piece
whose demand vector (tokens, segments, loss-bearing tokens; each as a share of
its limit) has the largest dot product with the room left, among those that
fit. If none fits, the best one is cut to the room left. A document's prompt
bears no loss: where a sequence's loss-bearing tokens are used up, prompts of
other documents fill it. Each task packs what it reads: there is no shuffle,
and of a document only the tokens that still wait are held. The sequences that
stay short (the last of a task, or where a limit other than tokens binds) are
cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import default_tokenizer_path, release, word_encoder

END_ID = 1
PIECE_SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Packs documents given one by one; ``pieces`` takes (doc, start, length, sequence, offset, loss)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int):
        import numpy as np

        if min(max_tokens, max_segments, max_loss, pool) < 1:
            raise ValueError("Every limit of a sequence must be 1 at least")
        self.np = np
        self.limits = (float(max_tokens), float(max_segments), float(max_loss))
        self.max_tokens, self.max_segments, self.max_loss, self.size = max_tokens, max_segments, max_loss, pool
        self.need = np.zeros((3, pool))  # of the waiting pieces, as shares of the limits
        self.waiting: list[list[int]] = []  # doc, start, end, first loss-bearing token
        self.pieces: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    @staticmethod
    def loss(start: int, end: int, first: int) -> int:
        return max(0, end - max(start, first))

    def fitting(self, start: int, end: int, first: int, tokens: int, loss: int) -> int:
        """The longest piece from ``start`` within ``tokens`` and ``loss``."""
        return min(end - start, tokens, max(0, first - start) + loss)

    def add(self, doc: int, length: int, first: int) -> None:
        start = 0
        while start < length:
            n = self.fitting(start, length, first, self.max_tokens, self.max_loss)
            if n == self.max_tokens:
                self.close([(doc, start, start + n, self.loss(start, start + n, first))])
            else:
                self.wait([doc, start, start + n, first])
                if len(self.waiting) == self.size:
                    while len(self.waiting) > self.size // 2:
                        self.fill()
            start += n

    def wait(self, item: list[int]) -> None:
        self.waiting.append(item)
        self.rate(len(self.waiting) - 1)

    def rate(self, at: int) -> None:
        _, start, end, first = self.waiting[at]
        a, b, c = self.limits
        self.need[:, at] = ((end - start) / a, 1 / b, self.loss(start, end, first) / c)

    def take(self, at: int) -> list[int]:
        item, last = self.waiting[at], self.waiting.pop()
        if at < len(self.waiting):
            self.waiting[at] = last
            self.need[:, at] = self.need[:, len(self.waiting)]
        return item

    def fill(self) -> None:
        """Fill and close one sequence."""
        np, held = self.np, []
        tokens, segments, loss = self.max_tokens, self.max_segments, self.max_loss
        while self.waiting and tokens and segments:
            room = (tokens / self.limits[0], segments / self.limits[1], loss / self.limits[2])
            sizes, ones, lossy = self.need[:, : len(self.waiting)]
            worth = sizes * room[0] + ones * room[1] + lossy * room[2]
            fits = (sizes <= room[0] + 1e-12) & (lossy <= room[2] + 1e-12)
            if fits.any():
                doc, start, end, first = self.take(int(np.where(fits, worth, -1).argmax()))
            else:
                at = int(worth.argmax())
                if not loss:  # only prompts can be cut to the room left
                    prompts = lossy < sizes * (self.limits[0] / self.limits[2]) - 1e-12
                    at = int(np.where(prompts, worth, -1).argmax())
                item = self.waiting[at]
                doc, start, _, first = item
                n = self.fitting(start, item[2], first, tokens, loss)
                if n == 0:
                    break
                end = item[1] = start + n
                self.rate(at)
            lost = self.loss(start, end, first)
            held.append((doc, start, end, lost))
            tokens, segments, loss = tokens - (end - start), segments - 1, loss - lost
        self.close(held)

    def close(self, held: list[tuple[int, int, int, int]]) -> None:
        """Give the pieces to a sequence, or to several whose lengths are powers of two."""
        total = sum(end - start for _, start, end, _ in held)
        while total:
            left = total if total == self.max_tokens else 1 << (total.bit_length() - 1)
            total, offset, rest = total - left, 0, []
            for doc, start, end, lost in held:
                n = min(end - start, left - offset)
                if n:
                    own = lost if n == end - start else max(0, n - (end - start - lost))
                    self.pieces.append((doc, start, n, self.sequences, offset, own))
                    offset += n
                    start, lost = start + n, lost - own
                if start < end:
                    rest.append((doc, start, end, lost))
            held = rest
            self.sequences += 1

    def finish(self) -> None:
        while self.waiting:
            self.fill()


#: Documents that a task encodes at a time.
ROWS = 1024
#: Limits of a sequence beside its tokens, for instruction data.
MAX_SEGMENTS, MAX_LOSS = 16, 1920


def first_line(text: Column) -> Column:
    """Code points of the prompt of a text: its first line, if others follow; else it has none."""
    return F.coalesce(F.instr(text, "\n"), F.lit(0))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    prompt_chars: Column | None = None,
    max_tokens: int = 2048,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    pool: int = 512,
) -> DataFrame:
    """Pieces of documents, placed in sequences.

    A document is the ids of its whole text and ``end_id``; a null text is
    empty, so it holds ``end_id`` alone. With ``prompt_col`` (a column of
    token counts; null is 0) so many leading tokens bear no loss; with
    ``prompt_chars`` those of the words that start in so many leading code points. Each
    id lies in exactly one piece. Rows with equal ids are separate documents,
    null ids stay null, other columns are not read, an empty table gives no
    rows. A text of any length is encoded at once; after that only its waiting
    tokens are held. A limit under 1 is an error.

    Returns one row for each piece: doc_id, start, length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id,
    offset (in its sequence, gapless from 0), loss_tokens.
    """
    path = tokenizer or default_tokenizer_path()
    Packer(max_tokens, max_segments, max_loss, pool)  # limits that can't hold fail here
    prompt = F.col(prompt_col) if prompt_col else prompt_chars if prompt_chars is not None else F.lit(0)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, packer = word_encoder(path), Packer(max_tokens, max_segments, max_loss, pool)
        encoder.forget_sizes()
        release()
        base = TaskContext.get().partitionId() << 40
        end = int(end_id).to_bytes(4, "little")
        held: dict[int, tuple] = {}  # of documents that still wait: id, tokens, first token held, bytes of ids
        count, kind = 0, None

        def out() -> pa.RecordBatch:
            rows = []
            for d, s, n, q, o, lost in packer.pieces:
                doc, total, first, ids = held[d]
                rows.append((doc, s, n, zlib.crc32(ids[4 * (s - first) : 4 * (s - first + n)]), total, base + q, o, lost))
            packer.pieces.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 8
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).fill_null("")
                firsts = [max(0, int(n or 0)) for n in part.column(2).to_pylist()]
                found, heads = encoder.many_and_heads(texts, [0] * len(firsts) if prompt_col else firsts)
                firsts = firsts if prompt_col else heads
                for doc, ids, first in zip(part.column(0).to_pylist(), found, firsts, strict=True):
                    held[count] = (doc, len(ids) // 4 + 1, 0, ids + end)
                    packer.add(count, len(ids) // 4 + 1, first)
                    count += 1
                yield out()
                least: dict[int, int] = {}
                for d, start, _, _ in packer.waiting:
                    least[d] = min(start, least.get(d, start))
                held = {d: (held[d][0], held[d][1], s, held[d][3][4 * (s - held[d][2]) :]) for d, s in least.items()}
                del found
            release()
        if kind is not None:
            packer.finish()
            yield out()

    return docs.select(id_col, text_col, prompt.cast("long").alias("prompt")).mapInArrow(run, PIECE_SCHEMA.format(id=id_type))
