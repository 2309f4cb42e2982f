"""Token ids of a public byte-level tokenizer for a whole corpus (problem 6).

Pre-tokenisation needs no regular expression. A batch of texts becomes one array of code points,
each of which maps to a symbol: a class (letter, number, blank, other white space, rest) and, for an
apostrophe, the length of the contraction it would open. The splitting pattern is then a small
automaton. Every symbol is a function from state to state, and function composition is associative,
so the state before each position comes from a blocked scan: compose within rows of a block matrix,
scan the row totals, apply. Token boundaries are a lookup on (state, symbol). The slices feed a pair
merging that is cached by slice; offsets are kept, so that texts can be restored exactly.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

TOKENIZERS = "/opt/tokenizers"
#: Code points scanned at once; bounds the memory of a task whatever the length of a text.
CHUNK = 1 << 19
#: Slices and texts whose result is kept by a worker.
CACHE_SLICES = 400_000

# Symbols and states of the automaton.
LETTER, NUMBER, BLANK, SPACE, OTHER, APOS1, APOS2, RESET = range(8)
S_NEW, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_ONE, S_TWO = range(8)
# The white space of the pattern, and its contractions.
WHITE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    step = np.zeros((8, 8), np.uint8)  # [symbol, state] -> state after
    cut = np.ones((8, 8), bool)  # [symbol, state] -> a token starts here
    after = {LETTER: S_LETTER, NUMBER: S_NUMBER, BLANK: S_BLANK, SPACE: S_SPACE, OTHER: S_OTHER, APOS1: S_ONE, APOS2: S_TWO, RESET: S_NEW}
    for symbol, state in after.items():
        step[symbol, :] = state
    step[LETTER, S_ONE], step[LETTER, S_TWO] = S_NEW, S_ONE
    for state in (S_LETTER, S_BLANK, S_ONE, S_TWO):
        cut[LETTER, state] = False
    for state in (S_NUMBER, S_BLANK):
        cut[NUMBER, state] = False
    for state in (S_OTHER, S_BLANK):  # there an apostrophe opens no contraction
        cut[OTHER, state] = cut[APOS1, state] = cut[APOS2, state] = False
        step[APOS1, state] = step[APOS2, state] = S_OTHER
    for symbol in (BLANK, SPACE):
        cut[symbol, [S_BLANK, S_SPACE]] = False
    return step, cut


STEP, CUT = _tables()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point, by general category."""
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    found[list(WHITE)] = SPACE
    found[32] = BLANK
    return found


def states_before(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """State before each symbol, by a two-level associative scan over transition functions."""
    n = len(symbols)
    if n <= width * 2:
        out, state = np.empty(n, np.uint8), S_NEW
        for i, symbol in enumerate(symbols.tolist()):
            out[i] = state
            state = int(STEP[symbol, state])
        return out
    rows = -(-n // width)
    padded = np.full(rows * width, RESET, np.uint8)
    padded[:n] = symbols
    grid = padded.reshape(rows, width).T.copy()
    total = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    for column in grid:  # total = step of this column after total
        total = STEP[column[:, None], total]
    # Exclusive scan of the row totals by doubling.
    entry = np.vstack([np.arange(8, dtype=np.uint8)[None], total[:-1]])
    shift = 1
    while shift < rows:
        entry[shift:] = np.take_along_axis(entry[shift:], entry[:-shift].copy(), 1)
        shift *= 2
    state = entry[:, S_NEW].copy()
    out = np.empty((width, rows), np.uint8)
    for i, column in enumerate(grid):
        out[i] = state
        state = STEP[column, state]
    return out.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Where tokens start. ``points``: code points; ``fresh``: where texts start."""
    n = len(points)
    kind = _classes()[points]
    symbol = kind.copy()
    where = np.flatnonzero(points == 39)
    if len(where):
        padded = np.append(points, [0, 0])
        ends = np.append(np.append(fresh, True), True)
        one, two = padded[where + 1], padded[where + 2]
        first, second = ~ends[where + 1], ~ends[where + 1] & ~ends[where + 2]
        short = np.isin(one, [ord(c) for c in CONTRACTIONS if len(c) == 1]) & first
        long = np.zeros(len(where), bool)
        for c in CONTRACTIONS:
            if len(c) == 2:
                long |= (one == ord(c[0])) & (two == ord(c[1])) & second
        symbol[where[long]] = APOS2
        symbol[where[short]] = APOS1
    # A text's first symbol is seen in the state of a new text: one RESET goes before it.
    at = np.flatnonzero(fresh)
    spread = np.full(n + len(at), RESET, np.uint8)
    place = np.arange(n) + np.cumsum(fresh)
    spread[place] = symbol
    before = states_before(spread)[place]
    before[at] = S_NEW
    start = CUT[symbol, before]
    white = (kind == BLANK) | (kind == SPACE)
    follows = np.ones(n, bool)  # white space or the end of the text comes next
    follows[:-1] = white[1:] | fresh[1:]
    start |= white & ~follows
    return start | fresh


class PairMerger:
    """Byte-level pair merging by rank, cached by slice."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.by_id = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap over a linked list, for very long slices."""
        import heapq

        ranks, n = self.ranks, len(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (rank := ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if live[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j], right[i] = a + b, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return tuple(ranks[p] for p, ok in zip(parts, live, strict=True) if ok)

    def ids(self, piece: str) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= CACHE_SLICES:
                self.cache.clear()
            found = self.cache[piece] = self.merge(piece.encode("utf-8", "surrogatepass"))
        return found

    def decode(self, ids) -> str:
        return b"".join(self.by_id[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(4)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def slices(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text; '' gives none."""
    out: list[list[str]] = [[] for _ in texts]
    group: list[int] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        whole = "".join(texts[i] for i in group)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(texts[i]) for i in group), np.int64, len(group))
        first = np.cumsum(lengths) - lengths
        fresh = np.zeros(len(points), bool)
        fresh[first] = True
        start = np.flatnonzero(boundaries(points, fresh))
        owner_end = np.searchsorted(start, first + lengths)
        bounds = [*start.tolist(), len(points)]
        at = 0
        for i, end in zip(group, owner_end.tolist(), strict=True):
            out[i] = [whole[bounds[k] : bounds[k + 1]] for k in range(at, end)]
            at = end

    for i, text in enumerate(texts):
        if not text:
            continue
        if size + len(text) > CHUNK:
            flush()
            group, size = [], 0
        group.append(i)
        size += len(text)
    flush()
    return out


def encode(texts: list[str], path: str) -> list[list[int]]:
    """Token ids of each text; a marker of the tokenizer in a text is ordinary text."""
    tool = merger(path)
    cache, ids = tool.cache, tool.ids
    found = []
    for pieces in slices(texts):
        row: list[int] = []
        for piece in pieces:
            row.extend(cache.get(piece) or ids(piece))
        found.append(row)
    return found


def restore(ids, path: str) -> str:
    """The text of a list of ids."""
    return merger(path).decode(ids)


def token_ids(df: DataFrame, id_col: str, text_col: str, ranks: str, offsets_too: bool = False) -> DataFrame:
    """``id_col, ids``: one row per input row, by the rank file ``ranks``.

    ``offsets_too`` adds ``starts`` and ``firsts``: for each pre-token the code point where it starts
    and the index of its first id, so that any span of ids can be traced back to the text. A null and an empty text both give the empty list; no text is altered or cut; ids may repeat or
    be null; other columns are ignored. Texts of any length are scanned whole. No shuffle.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = encode(texts, ranks)
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                flat = np.fromiter((i for r in rows for i in r), np.int32, int(offsets[-1]))
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if offsets_too:
                    pieces, tool = slices(texts), merger(ranks)
                    columns += [pa.array([_starts(len, row) for row in pieces], pa.list_(pa.int32())),
                                pa.array([_starts(lambda p: len(tool.ids(p)), row) for row in pieces], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "ids", *(["starts", "firsts"] if offsets_too else [])]
    kind = df.schema[id_col].dataType.simpleString()
    extra = ", starts array<int>, firsts array<int>" if offsets_too else ""
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>{extra}")


def _starts(measure, row: list[str]) -> list[int]:
    out, at = [], 0
    for piece in row:
        out.append(at)
        at += measure(piece)
    return out


def tokenizer_file(spark: SparkSession, name: str) -> str:
    return os.path.join(spark.conf.get("leadflow.tokenizers", TOKENIZERS), name)


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return token_ids(table(spark, root, "documents"), "doc_id", "text", tokenizer_file(spark, "byte_bpe_50k.tiktoken"))


def p6_offsets(spark: SparkSession, root: str) -> DataFrame:
    """The ids with the offsets that lead back to the text."""
    return token_ids(table(spark, root, "documents"), "doc_id", "text", tokenizer_file(spark, "byte_bpe_50k.tiktoken"), True)


QUERIES = {"p6_ids": p6_ids, "p6_offsets": p6_offsets}
