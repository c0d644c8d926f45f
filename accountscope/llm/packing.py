"""Hierarchical multi-length packing of tokenised documents.

Every task packs the documents of its own partition while it streams over them. A document of at least the longest
context fills whole windows by itself; the rest of it, like any shorter document, is routed to the smallest context
tier that holds it. A tier packs its waiting pieces largest first; what a window lacks is filled with pieces of its
own tier, then of shorter tiers, and at last by cutting one piece. At the end of a partition the waiting pieces are
laid end to end, and the last window is cut into powers of two. So nothing is padded, and no row is shuffled.

Only the waiting pieces (some windows per tier) and one batch are in memory. A lost task is computed anew from its
input split with the same result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = ("id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, context bigint, step bigint")

#: White space before more of it or the end, or at the start of a line: there the pre-tokenizer may join it across a cut.
_JOINED = re.compile(r"\s(?=\s|\Z)|\A[^\S ]")
#: Words that a Python worker remembers before it forgets them all.
_CACHED_WORDS = 600_000


@dataclass(frozen=True)
class PackConfig:
    """tokenizer: file name among the public tokenizers, or a path; contexts: window lengths, powers of two, ascending;
    waiting: windows' worth of pieces that a tier gathers before it packs; step_tokens: tokens of one step group."""

    tokenizer: str = "byte_bpe_50k.json"
    contexts: tuple[int, ...] = (128, 256, 512, 1024)
    end_id: int = 0
    waiting: int = 32
    step_tokens: int = 8192


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


_LETTERS = _byte_letters()
_SPACE = chr(_LETTERS[0x20])
#: What may end a word and is neither letter, number, white space nor an apostrophe, which may begin a pre-token of letters.
_MARKS = ".,;:!?#$%&*|<>=+-/()[]{}\"@^~`_\\"


class Joined(Exception):
    """A word with white space that may belong to its neighbours."""


class Words(dict):
    """Ids of words, each after the space before it, as little-endian 32-bit bytes; new ones are encoded when asked for."""

    def __init__(self, name: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(str(path))
        self.model = self.tokenizer.model
        #: Tokens that the tokenizer finds in a text before it cuts it into words.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.packed = [struct.pack("<I", k) for k in range(max(self.tokenizer.get_vocab().values()) + 1)]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        core = word.rstrip(_MARKS)
        if not core.removeprefix(" ").isalpha():
            if word != "\n" and _JOINED.search(word):
                raise Joined
            ids = self.whole(word)
        elif core != word:  # marks after letters are the next pre-token
            ids = self[core] + self[word[len(core):]]
        else:  # a run of letters, with or without the space before it, is one pre-token: only the model has to see it
            spelled = core.replace(" ", _SPACE) if core.isascii() else core.encode().decode("latin-1").translate(_LETTERS)
            ids = b"".join([self.packed[t.id] for t in self.model.tokenize(spelled)])
        self[word] = ids
        return ids


class Encoder:
    """Token ids of whole texts.

    A text is cut before single spaces and around single line breaks, where the byte-level pre-tokenizer always ends a
    token, so the ids of repeated words are looked up; texts with joined white space, which shows in a word of theirs or
    behind a line break, or with a token that was added to the vocabulary are encoded whole. The words known so far
    outlive a task.
    """

    _known: dict[str, Words] = {}

    def __init__(self, name: str) -> None:
        self.words = self._known.setdefault(name, None) or Words(name)
        self._known[name] = self.words

    def encode(self, text: str) -> bytes:
        words = self.words
        if "\0" in text or "\n " in text or "\n\n" in text or text[-1:].isspace() or any(t in text for t in words.added):
            return words.whole(text)
        if len(words) > _CACHED_WORDS:
            words.clear()
        try:
            return b"".join(map(words.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))
        except Joined:
            return words.whole(text)


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: bytes
    total: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n:], self.total)


@dataclass
class Packer:
    cfg: PackConfig
    first_sequence: int
    rows: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.pools: list[list[Piece]] = [[] for _ in self.cfg.contexts]
        self.tokens = [0] * len(self.cfg.contexts)
        self.sequence = self.first_sequence
        self.open_steps: dict[int, int] = {}  # step -> tokens still free
        self.step = self.first_sequence

    # Steps: every group gets the same number of tokens, whatever contexts it mixes.
    def _step(self, length: int) -> int:
        fits = [(free, s) for s, free in self.open_steps.items() if free >= length]
        if fits:
            free, s = min(fits)
        else:
            free, s = self.cfg.step_tokens, self.step
            self.step += 1
        if free == length:
            self.open_steps.pop(s, None)
        else:
            self.open_steps[s] = free - length
        return s

    def _emit(self, pieces: list[Piece], context: int) -> None:
        at, step = 0, self._step(sum(map(len, pieces)))
        for p in pieces:
            n = len(p)
            self.rows.append((p.doc, p.start, n, zlib.crc32(p.ids), p.total, self.sequence, at, context, step))
            at += n
        self.sequence += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        longest = self.cfg.contexts[-1]
        rest = Piece(doc, 0, ids, len(ids) // 4)
        while len(rest) >= longest:
            window, rest = rest.cut(longest)
            self._emit([window], longest)
        if len(rest):
            self._wait(rest)

    def _tier(self, n: int) -> int:
        return next(k for k, c in enumerate(self.cfg.contexts) if n <= c)

    def _wait(self, piece: Piece) -> None:
        k = self._tier(len(piece))
        self.pools[k].append(piece)
        self.tokens[k] += len(piece)
        if self.tokens[k] >= self.cfg.waiting * self.cfg.contexts[k]:
            self._pack(k)

    def _take(self, k: int, gap: int, whole: bool) -> Piece | None:
        """The longest waiting piece of tier ``k`` or a shorter one that fits ``gap``; any piece unless ``whole``."""
        for t in range(k, -1, -1):
            pool = self.pools[t]  # ascending by length
            lo, hi = 0, len(pool)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if len(pool[mid]) <= gap else (lo, mid)
            at = lo - 1 if lo else (0 if pool and not whole else -1)
            if at >= 0:
                piece = pool.pop(at)
                self.tokens[t] -= len(piece)
                return piece
        return None

    def _pack(self, k: int) -> None:
        """Full windows of tier ``k`` until half of its pool is left to choose from."""
        size = self.cfg.contexts[k]
        for t in range(k + 1):
            self.pools[t].sort(key=len)
        while self.tokens[k] >= self.cfg.waiting * size // 2:
            gap, window, back = size, [], None
            while gap:
                piece = self._take(k, gap, whole=True) or self._take(k, gap, whole=False)
                if piece is None:
                    break
                if len(piece) > gap:
                    piece, back = piece.cut(gap)
                window.append(piece)
                gap -= len(piece)
            self._emit(window, size)
            if back is not None:
                t = self._tier(len(back))
                self.pools[t].append(back)
                self.tokens[t] += len(back)
                self.pools[t].sort(key=len)

    def finish(self) -> None:
        longest, window, free = self.cfg.contexts[-1], [], self.cfg.contexts[-1]
        for piece in [p for pool in reversed(self.pools) for p in pool]:
            while len(piece) >= free:
                head, piece = piece.cut(free)
                self._emit([*window, head], longest)
                window, free = [], longest
            if len(piece):
                window.append(piece)
                free -= len(piece)
        left = longest - free
        while left:  # the last window: powers of two, largest first
            size = 1 << (left.bit_length() - 1)
            part, need = [], size
            while need:
                head = window.pop(0)
                if len(head) > need:
                    head, tail = head.cut(need)
                    window.insert(0, tail)
                part.append(head)
                need -= len(head)
            self._emit(part, size)
            left -= size


def pack(docs: DataFrame, cfg: PackConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step``.

    NULL text counts as empty: its document is the end id alone. Repeated rows are packed once each. Sequence ids are
    unique over the table: partition number, then a count. Other columns are ignored.
    """
    cfg = cfg or PackConfig()

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(cfg.tokenizer)
        end = np.array([cfg.end_id], "<u4").tobytes()
        packer = Packer(cfg, TaskContext.get().partitionId() << 40)

        def drained() -> pd.DataFrame:
            rows, packer.rows = packer.rows, []
            out = pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step"])
            return out.astype({c: "int64" for c in out.columns if c != "id"} | {"id": "Int64"})

        for batch in batches:
            ids = batch["id"].astype("Int64")
            for doc, text in zip(ids, batch["text"]):
                packer.add(None if doc is pd.NA else int(doc), encoder.encode(text) + end)
            yield drained()
        packer.finish()
        yield drained()

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInPandas(tasks, PIECES).withColumnRenamed("id", id_col)
