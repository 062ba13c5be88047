"""Token sequences from documents: tokenize, cut and pack inside each task, a block of documents at a time.

Each task tokenizes its documents and packs them while it holds their ids, so nothing is shuffled and a long or
frequent document weighs no more than its tokens. What does not fill a sequence is carried from block to block. A
sequence's id is the task's number and a count within the task; a task that runs again makes the same sequences.

* :func:`pack_min_slack` - minimum bin slack: a bitset subset-sum over the lengths that remain picks the multiset
  that fills each sequence closest to its capacity.
* :func:`pack_best_fit` - best-fit decreasing: a segment tree over free capacities finds the fullest sequence that
  still takes a piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

from fairlead.llm.common import batches, small_batches, tokenizer_path, word_tokens

#: Documents that are tokenized at once, as long as they are short: their words are looked up together.
BATCH_DOCS = 800
CAPACITY = 4096
#: Ends each document.
SEPARATOR = 2
#: Pieces that wait to be packed together; more pieces fill sequences more exactly and take more memory.
BLOCK = 2000
#: Sequence ids of a task start at its number times this.
TASK_IDS = 1 << 40


class Piece:
    """Ids ``start`` to ``start + len(ids)`` of a document of ``total`` ids."""

    __slots__ = ("doc", "start", "total", "ids")

    def __init__(self, doc, start, total, ids):
        self.doc, self.start, self.total, self.ids = doc, start, total, ids

    def __len__(self):
        return len(self.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.total, self.ids[:n]), Piece(self.doc, self.start + n, self.total, self.ids[n:])


def closest_subset(lengths: Iterable[tuple[int, int]], capacity: int) -> dict[int, int]:
    """How many of each length to take for the largest sum up to ``capacity``.

    ``lengths``: (length, count), each length once, read no further than needed. Bit s of ``reach`` says that sum s can be made; the state before
    each length is kept, so the counts are found backwards. Stops as soon as the capacity itself is reached.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, states = 1, []
    for length, count in lengths:
        states.append((length, count, reach))
        step = 1  # counts by binary parts: 1, 2, 4, ... and the rest
        left = min(count, capacity // length)
        while left > 0:
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen = {}
    for length, count, before in reversed(states):
        taken = 0
        while not before >> total & 1:
            total -= length
            taken += 1
        if taken:
            chosen[length] = taken
    return chosen


class MinSlack:
    """Fills sequences from the pieces that wait; a sequence starts with the longest of them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.waiting: dict[int, list[Piece]] = defaultdict(list)
        self.lengths: list[int] = []  # of waiting pieces, ascending, each once
        self.tokens = self.pieces = 0

    def add(self, piece: Piece) -> None:
        n = len(piece)
        if n not in self.waiting:
            insort(self.lengths, n)
        self.waiting[n].append(piece)
        self.tokens += n
        self.pieces += 1

    def _take(self, length: int) -> Piece:
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.tokens -= length
        self.pieces -= 1
        return piece

    def fill(self) -> list[Piece]:
        """One full sequence; there must be tokens for it. If no multiset fills it, a waiting piece is cut."""
        first = self._take(self.lengths[-1])
        room = self.capacity - len(first)
        out = [first]
        fitting = range(bisect_right(self.lengths, room) - 1, -1, -1)
        counts = ((self.lengths[i], len(self.waiting[self.lengths[i]])) for i in fitting)
        for n, k in sorted(closest_subset(counts, room).items()):
            for _ in range(k):
                out.append(self._take(n))
                room -= n
        while room:
            piece = self._take(self.lengths[-1])
            if len(piece) > room:
                piece, rest = piece.cut(room)
                self.add(rest)
            out.append(piece)
            room -= len(piece)
        return out

    def rest(self) -> Iterator[list[Piece]]:
        """What doesn't fill a sequence, in sequences whose lengths are powers of two, the largest first."""
        left = [p for n in reversed(self.lengths) for p in self.waiting[n]]
        total = self.tokens
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            out = []
            while room:
                piece = left.pop(0)
                if len(piece) > room:
                    piece, more = piece.cut(room)
                    left.insert(0, more)
                out.append(piece)
                room -= len(piece)
            yield out


class FreeCapacity:
    """Segment tree over capacities 0..n: how many open sequences have just so much room."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def smallest_from(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open sequence has."""
        count, i = self.count, need + self.size
        while not count[i]:
            while i & 1:  # a right child: all to the right of it is higher up
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i *= 2
            if not count[i]:
                i += 1
        return i - self.size


def best_fit(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Best-fit decreasing of pieces of at most ``capacity``."""
    tree, by_room, bins = FreeCapacity(capacity), defaultdict(list), []
    for piece in sorted(pieces, key=lambda p: -len(p)):  # stable: ties stay in the order of the input
        n = len(piece)
        room = tree.smallest_from(n)
        if room is None:
            room, one = capacity, []
            bins.append(one)
        else:
            one = by_room[room].pop()
            tree.change(room, -1)
        one.append(piece)
        if room - n:
            by_room[room - n].append(one)
            tree.change(room - n, 1)
    return bins


def _pieces(frames: Iterator, path: str, capacity: int) -> Iterator[list[Piece]]:
    """For each Arrow batch of (id, text): its documents' pieces, cut at multiples of the capacity."""
    import numpy as np

    tokens = word_tokens(path)
    end = np.array([SEPARATOR], np.uint32)
    for batch in batches(frames):
        ids, offsets = tokens.encode(batch.column(1).to_pylist())
        out = []
        for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = np.concatenate([ids[a:b], end])
            out += [Piece(doc, i, len(own), own[i : i + capacity]) for i in range(0, len(own), capacity)]
        yield out


def _numbered(sequences: Iterator) -> Iterator:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() * TASK_IDS
    return ((first + i, s) for i, s in enumerate(sequences))


def _min_slack(pieces: Iterator[list[Piece]], capacity: int) -> Iterator[list[Piece]]:
    packer = MinSlack(capacity)
    for some in pieces:
        for piece in some:
            if len(piece) == capacity:
                yield [piece]
            else:
                packer.add(piece)
        while packer.pieces > BLOCK and packer.tokens >= capacity:
            yield packer.fill()
    while packer.tokens >= capacity:
        yield packer.fill()
    yield from packer.rest()


def _best_fit(pieces: Iterator[list[Piece]], capacity: int) -> Iterator[list[Piece]]:
    waiting: list[Piece] = []
    for some in pieces:
        waiting += some
        if len(waiting) > BLOCK:
            bins = best_fit(waiting, capacity)
            open_ = {id(b) for b in bins if sum(map(len, b)) < capacity * 63 // 64}
            yield from (b for b in bins if id(b) not in open_)
            waiting = [p for b in bins if id(b) in open_ for p in b]
            if len(waiting) > BLOCK:  # nothing fits together any more
                yield from (b for b in bins if id(b) in open_)
                waiting = []
    yield from best_fit(waiting, capacity)


def _in_groups(rows: Iterator, n: int = 5000) -> Iterator[list]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= n:
            yield out
            out = []
    if out:
        yield out


def _map(docs: DataFrame, id_col: str, text_col: str, schema: str, rows: Callable[[Iterator], Iterator], group: int) -> DataFrame:
    """``docs`` through ``rows``: an iterator of Arrow batches of (id, text) to one of column lists."""
    small_batches(docs.sparkSession, BATCH_DOCS)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(frames):
        import pyarrow as pa

        for some in _in_groups(rows(frames), group):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, fields)


def pack_min_slack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: the id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are those of its text and the separator; null text counts as empty (the separator alone).
    Documents are cut at multiples of the capacity, and elsewhere only where no multiset of waiting pieces fills a
    sequence. Sequences are full but for the last of each task, whose lengths are powers of two. Equal rows are
    packed once each. An empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(frames):
        for number, sequence in _numbered(_min_slack(_pieces(frames, path, capacity), capacity)):
            offset = 0
            for p in sequence:
                yield p.doc, p.start, len(p), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, number, offset
                offset += len(p)

    return _map(docs, id_col, text_col, f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", rows, 5000)


def width_of(path: str, capacity: int) -> str:
    """The type of ids and positions in a matrix: little-endian unsigned integers that hold all of both."""
    from tokenizers import Tokenizer

    ids = max(Tokenizer.from_file(path).get_vocab().values(), default=0) + 1
    return "<u2" if max(ids, capacity) <= 1 << 16 else "<u4"


def pack_best_fit(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a sequence, as a trainer reads it:

    ``sequence_id, n_tokens``; ``input_ids`` (binary: a row of the packed matrix, little-endian unsigned ids,
    padded with zeros to the capacity); ``cu_seqlens`` (array: where each segment begins, and the end of the last);
    ``position_ids`` (binary, as the ids: positions that start from 0 in each segment, as a document's later pieces
    attend to nothing before them); ``segment_ids`` and ``segment_starts`` (arrays: each segment's document, and its
    ids before the segment).

    Documents, each with the separator at its end, are cut at multiples of the capacity, so nothing is lost. Null
    text counts as empty. An id or position has 16 bits where the vocabulary and the capacity have at most 65,536, else
    32 (see :func:`width_of`).
    """
    path = tokenizer or tokenizer_path()
    width = width_of(path, capacity)
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(frames):
        import numpy as np

        steps = np.arange(capacity, dtype=width)
        for number, sequence in _numbered(_best_fit(_pieces(frames, path, capacity), capacity)):
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in sequence])])
            ids, positions = np.zeros(capacity, width), np.zeros(capacity, width)
            for p, a, b in zip(sequence, cuts[:-1], cuts[1:], strict=True):
                ids[a:b] = p.ids
                positions[a:b] = steps[: b - a]
            yield number, int(cuts[-1]), ids.tobytes(), cuts.tolist(), positions.tobytes(), [p.doc for p in sequence], [p.start for p in sequence]

    return _map(docs, id_col, text_col, f"sequence_id long, n_tokens long, input_ids binary, cu_seqlens array<int>, position_ids binary, segment_ids array<{id_type}>, segment_starts array<long>", rows, 500)
