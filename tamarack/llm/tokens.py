"""Problem 8: token ids of a whole corpus under a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. Bytes become Latin-1 characters, so that one
Aho-Corasick pass lists every token that occurs in a piece. The encoder walks from the longest token on
and steps back to a shorter one, or to an earlier token, where two neighbours could not have come out
of the merges next to each other. That test is memoised by pair, a finished piece by its text; each
position is given up at most once, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..storage import spread

MEMO = 400_000
#: the pattern of the rank files, from the vocabularies' own description
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabularies are installed."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


class Encoder:
    """Exact BPE of a rank file by backtracking over token matches."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.split_text = regex.compile(pattern)
        self.rank: dict[str, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.rank[base64.b64decode(token).decode("latin-1")] = int(rank)
        self.token = {i: t for t, i in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _halves(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token i; None for a single byte."""
        if i in self.halves:
            return self.halves[i]
        parts = list(self.token[i])
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: self._before(parts[k] + parts[k + 1], i))
            if self._before(parts[best] + parts[best + 1], i) == float("inf"):
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        self.halves[i] = out
        return out

    def _before(self, text: str, i: int) -> float:
        r = self.rank.get(text)
        return r if r is not None and r < i else float("inf")

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens side by side.

        Undo merges from the latest on. A merge across the border would have happened if it ranks before
        the merges still to be made on both sides at that point.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        a, b, before = left, right, float("inf")
        out = True
        while True:
            across = self.rank.get(self.token[a] + self.token[b])
            if across is not None and across < before:
                halves = self._halves(across)
                if halves == (a, b):
                    out = False
                    break
            split_a, split_b = self._halves(a), self._halves(b)
            if split_a is None and split_b is None:
                break
            # the later merge is undone first; of equal ones the left was made first
            if split_b is None or (split_a is not None and a > b):
                before, a = a, split_a[1]
            else:
                before, b = b + 1, split_b[0]
        if len(self.fits) > MEMO:
            self.fits.clear()
        self.fits[key] = out
        return out

    def piece(self, latin: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 text."""
        known = self.pieces.get(latin)
        if known is not None:
            return known
        whole = self.rank.get(latin)
        if whole is not None:
            out: tuple[int, ...] = (whole,)
        else:
            n = len(latin)
            starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            for end, (size, i) in self.automaton.iter(latin):
                starts[end - size + 1].append((size, i))  # ends rise, so shorter tokens come first
            usable = [True] * (n + 1)
            path: list[tuple[int, int, int]] = []  # (start, index into starts, id)
            at, choice = 0, len(starts[0]) - 1
            while at < n:
                last = path[-1][2] if path else -1
                options = starts[at]
                while choice >= 0:
                    size, i = options[choice]
                    if usable[at + size] and (last < 0 or self._fits(last, i)):
                        break
                    choice -= 1
                if choice >= 0:
                    path.append((at, choice, i))
                    at += size
                    choice = len(starts[at]) - 1 if at < n else 0
                else:
                    usable[at] = False
                    at, choice, _ = path.pop()
                    choice -= 1
            out = tuple(i for _, _, i in path)
        if len(latin) <= 64:
            if len(self.pieces) > MEMO:
                self.pieces.clear()
            self.pieces[latin] = out
        return out

    def encode(self, text: str | None) -> list[int] | None:
        """Ids of a text; an empty text gives an empty list, a null text null."""
        if text is None:
            return None
        out: list[int] = []
        for p in self.split_text.findall(text):
            out.extend(self.piece(p if p.isascii() else p.encode("utf-8", "surrogatepass").decode("latin-1")))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)


def encoded(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): one row for each row of the table, repeated rows included; whole texts, no special tokens."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    rows = spread(documents.selectExpr(f"cast({id_col} as bigint) {id_col}", text_col))
    return rows.mapInArrow(run, f"{id_col} bigint, ids array<int>")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
