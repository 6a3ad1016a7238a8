"""Vector bin packing of tokenised examples into fixed-length sequences.

An example asks for three things at once: tokens, a segment, and loss-bearing tokens; a sequence has a limit on each. While
a sequence is open, the example that fits whole and whose demand has the largest dot product with what is left (both as
shares of the limits) is placed next; when none fits whole, one is cut to fill the rest exactly. A sequence that cannot
reach the full length (the segments or the loss are used up, or the task's examples end) is cut back to a power of two,
which needs no padding, and the rest goes back to the pool. Each task packs its own rows in one pass with a bounded pool:
no shuffle, no driver state, and at most a dozen short sequences a task.

Defined results: a null or empty text still has its end id, so one piece; repeated doc_ids and null doc_ids are packed row
by row; a text of any length is cut into as many pieces as needed; an empty table gives no rows; columns besides doc_id
and text are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import text as tx
from auditlake.llm import tokens

#: (key, start, length, crc, total, sequence, offset)
Piece = tuple


class Packer:
    """examples: (key, ids, loss), loss a boolean array or None where every id bears loss."""

    def __init__(self, max_tokens: int = 2048, max_segments: int = 64, max_loss: int | None = None, pool: int = 512):
        if max_tokens < 1 or max_tokens & (max_tokens - 1):
            raise ValueError("max_tokens must be a power of two")
        if max_segments < 1 or (max_loss is not None and max_loss < 1):
            raise ValueError("limits must be positive")
        self.max_tokens, self.max_segments, self.max_loss, self.pool = max_tokens, max_segments, max_loss or max_tokens, pool
        self.items: list[tuple] = []  # (key, start, ids, loss prefix sums or None, total)
        self.size: list[int] = []
        self.cost: list[int] = []
        self.held = 0
        self.sequence = 0

    def _add(self, item: tuple) -> None:
        n = len(item[2])
        self.items.append(item)
        self.size.append(n)
        self.cost.append(n if item[3] is None else int(item[3][-1] - item[3][0]))
        self.held += n

    def _take(self, i: int) -> tuple:
        item, n = self.items[i], self.size[i]
        for x in (self.items, self.size, self.cost):
            x[i] = x[-1]
            x.pop()
        self.held -= n
        return item

    @staticmethod
    def _cut(item: tuple, n: int) -> tuple[tuple, tuple]:
        key, start, ids, loss, total = item
        return (key, start, ids[:n], None if loss is None else loss[: n + 1], total), (key, start + n, ids[n:], None if loss is None else loss[n:], total)

    def _close(self, placed: list[tuple]) -> Iterator[Piece]:
        at = 0
        for key, start, ids, _, total in placed:
            yield key, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, self.sequence, at
            at += len(ids)
        self.sequence += 1

    def _fill(self, target: int) -> Iterator[Piece]:
        """Pack one sequence of `target` tokens, or of a smaller power of two."""
        placed: list[tuple] = []
        room, loss = target, self.max_loss
        size, cost = np.array(self.size), np.array(self.cost)
        live = np.ones(len(size), bool)
        taken: list[int] = []
        while room and len(placed) < self.max_segments:
            fits = live & (size <= room) & (cost <= loss)
            if not fits.any():
                break
            # demand and room as shares of the limits; each segment asks for the same share
            worth = size * (room / self.max_tokens**2) + cost * (loss / self.max_loss**2)
            i = int(np.argmax(np.where(fits, worth, -1.0)))
            live[i] = False
            taken.append(i)
            placed.append(self.items[i])
            room, loss = room - int(size[i]), loss - int(cost[i])
        rest = None
        if room and len(placed) < self.max_segments and live.any():
            i = int(np.argmax(np.where(live, size, -1)))
            item = self.items[i]
            n = min(room, len(item[2]))
            if item[3] is not None:
                n = min(n, int(np.searchsorted(item[3], item[3][0] + loss, "right")) - 1)
            else:
                n = min(n, loss)
            if n > 0:
                live[i] = False
                taken.append(i)
                head, rest = self._cut(item, n)
                placed.append(head)
                room -= n
        for i in sorted(taken, reverse=True):
            self._take(i)
        if rest is not None and len(rest[2]):
            self._add(rest)
        filled = sum(len(x[2]) for x in placed)
        keep = 1 << (filled.bit_length() - 1)
        while filled > keep:  # back to a power of two
            item = placed.pop()
            n = len(item[2])
            if filled - n < keep:
                head, tail = self._cut(item, keep - (filled - n))
                placed.append(head)
                self._add(tail)
                filled = keep
            else:
                self._add(item)
                filled -= n
        yield from self._close(placed)

    def pack(self, examples: Iterable[tuple]) -> Iterator[Piece]:
        full = self.max_tokens
        for key, ids, loss in examples:
            marks = None if loss is None else np.concatenate([[0], np.cumsum(loss)])
            item = (key, 0, ids, marks, len(ids))
            while len(item[2]) >= full and (full if marks is None else int(item[3][full] - item[3][0])) <= self.max_loss:
                head, item = self._cut(item, full)
                yield from self._close([head])
            if len(item[2]):
                self._add(item)
            while len(self.items) >= self.pool and self.held >= full:
                yield from self._fill(full)
        while self.held:
            yield from self._fill(min(full, 1 << (self.held.bit_length() - 1)))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, limits: dict) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    packer = Packer(**limits)

    def examples():
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield key, np.append(tokens.encode(text.as_py(), path), np.uint32(end_id)), None

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows: list[Piece] = []

    def out():
        columns = list(zip(*rows))
        columns[5] = [base + x for x in columns[5]]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    for piece in packer.pack(examples()):
        rows.append(piece)
        if len(rows) >= 10_000:
            yield out()
    if rows:
        yield out()


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 64, max_loss: int | None = None) -> DataFrame:
    """One row per piece; (sequence_id, offset) says where it lies. Every id of a document, its end id too, lies in one piece."""
    tx.arrow_batches(docs.sparkSession)
    limits = {"max_tokens": max_tokens, "max_segments": max_segments, "max_loss": max_loss}
    return tx.only(docs, "doc_id", "text").mapInArrow(lambda b, p=path or tokens.vocabulary(), e=end_id, m=limits: _pack_batches(b, p, e, m), SCHEMA)


class LossPacker(Packer):
    """Pieces also say how many of their tokens bear loss."""

    def _close(self, placed: list[tuple]) -> Iterator[Piece]:
        for piece, item in zip(super()._close(placed), list(placed)):
            yield *piece, len(item[2]) if item[3] is None else int(item[3][-1] - item[3][0])


CONVERSATION_SCHEMA = "conv_id long, first_turn long, start long, length long, ids_crc32 long, example_tokens long, sequence_id long, offset long, loss_tokens long"


def _conversation_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, limits: dict, roles: frozenset) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    packer = LossPacker(**limits)

    def examples():
        key, ids, loss, held = None, [], [], 0
        for batch in batches:
            for conv, turn, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                mine = np.append(tokens.encode(text, path), np.uint32(end_id))
                if key is not None and (key[0] != conv or held + len(mine) > packer.max_tokens):
                    yield key, np.concatenate(ids), np.concatenate(loss)
                    key, ids, loss, held = None, [], [], 0
                key = key or (conv, turn)
                ids.append(mine), loss.append(np.full(len(mine), role in roles))
                held += len(mine)
        if key is not None:
            yield key, np.concatenate(ids), np.concatenate(loss)

    names = [x.split()[0] for x in CONVERSATION_SCHEMA.split(", ")]
    rows: list[tuple] = []

    def out():
        columns = list(zip(*rows))
        columns[6] = [base + x for x in columns[6]]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    for key, *piece in packer.pack(examples()):
        rows.append((*key, *piece))
        if len(rows) >= 10_000:
            yield out()
    if rows:
        yield out()


def pack_conversations(
    turns: DataFrame,
    path: str | None = None,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 16,
    max_loss: int | None = 1536,
    roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """Instruction data: turns(conv_id, turn, role, text) packed under limits on tokens, segments and loss-bearing tokens, which
    are those of `roles`. An example is a run of a conversation's turns, in order, of up to max_tokens (or one longer turn). Turns
    meet by a sort on (conv_id, turn), so a conversation of any length may lie in several tasks, and is then several examples.

    Defined results: null texts have their end id only; a null conv_id is one conversation; repeated turns follow each other;
    an empty table gives no rows; other columns are not read."""
    tx.arrow_batches(turns.sparkSession)
    limits = {"max_tokens": max_tokens, "max_segments": max_segments, "max_loss": max_loss}
    order = ["conv_id", "turn", "role", "text"]
    sorted_turns = tx.only(turns, *order).withColumn("turn", F.col("turn").cast("long")).repartitionByRange(
        "conv_id",
        "turn",
        F.xxhash64("role", "text"),
    ).sortWithinPartitions(*order)
    return sorted_turns.mapInArrow(
        lambda b, p=path or tokens.vocabulary(), e=end_id, m=limits, r=frozenset(roles): _conversation_batches(b, p, e, m, r),
        CONVERSATION_SCHEMA,
    )


def pack_conversations_query(spark, sf_dir: str) -> DataFrame:
    return pack_conversations(tx.table(spark, sf_dir, "conversations"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(tx.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of every document that is left."""
    return pack_documents(docs)
