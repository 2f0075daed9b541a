"""Problem 9: test passages inside a training corpus.

Pigeonhole edit matching over words. Every window of a passage is cut into error-budget-plus-one
pieces: a stretch of text within the budget must hold one of them unchanged. One Aho-Corasick pass over
a document's normalised words finds piece hits; around each, Myers' bit-parallel recurrence gives the
least number of word edits that turn the window into a stretch of the document; that number alone decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread
from .shingles import words

#: passages an automaton holds at a time; longer lists are searched in blocks
BLOCK = 20_000


def distance(pattern: list[str], text: list[str]) -> int:
    """Least edits between the pattern and any stretch of the text (Myers' recurrence, words as symbols)."""
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = score
    for w in text:
        eq = where.get(w, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        right_up = down | (full & ~(diagonal | up))
        right_down = up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        # a match may begin anywhere: the first row stays zero
        right_up = (right_up << 1) & full
        right_down = (right_down << 1) & full
        up = right_down | (full & ~(diagonal | right_up))
        down = right_up & diagonal
        best = min(best, score)
    return best


class Searcher:
    """items: (item_id, passage). Windows of `window` words, of all words in shorter passages."""

    def __init__(self, items: list[tuple[int, str]], window: int = 12, budget: int = 1):
        self.budget = budget
        self.words: dict[int, list[str]] = {}
        pieces: dict[str, set[tuple[int, int, int, int]]] = defaultdict(set)
        for item, passage in items:
            ws = words(passage)
            if not ws:
                continue
            self.words[item] = ws
            size = min(window, len(ws))
            parts = min(budget + 1, size)
            cuts = [round(k * size / parts) for k in range(parts + 1)]
            for start in range(len(ws) - size + 1):
                for a, b in zip(cuts, cuts[1:]):
                    pieces[" " + " ".join(ws[start + a : start + b]) + " "].add((item, start, size, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), tuple(uses)))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def search(self, text: str | None) -> dict[int, int]:
        """item_id -> least word edits of any of its windows, for those within the budget."""
        if self.empty or not text:
            return {}
        ws = words(text)
        line = " " + " ".join(ws) + " "
        found: dict[int, int] = {}
        place: dict[int, int] | None = None
        tried = set()
        for end, (size, uses) in self.automaton.iter(line):
            if place is None:
                place, at = {}, 0
                for k, w in enumerate(ws):
                    place[at] = k
                    at += len(w) + 1
            first = place[end - size + 1]
            for item, start, length, offset in uses:
                if found.get(item) == 0:
                    continue
                begin = first - offset
                key = (item, start, begin)
                if key in tried:
                    continue
                tried.add(key)
                d = distance(self.words[item][start : start + length], ws[max(0, begin - self.budget) : begin + length + self.budget])
                if d <= self.budget and d < found.get(item, self.budget + 1):
                    found[item] = d
        return found


@lru_cache(maxsize=2)
def searcher(window: int, budget: int, items: tuple[tuple[int, str], ...]) -> Searcher:
    """One searcher a Python worker and block of passages."""
    return Searcher(list(items), window, budget)


def leaks(documents: DataFrame, items: DataFrame, window: int = 12, budget: int = 1) -> DataFrame:
    """(doc_id, item_id, edits) of each document that holds a window of a passage with at most `budget` edits.

    The passages are a query set: BLOCK of them at a time go to the workers, whatever their number; the
    corpus stays where it is. Null and empty texts and passages match nothing; repeated rows repeat.
    """
    spark = documents.sparkSession
    queries = items.where("passage is not null and item_id is not null").select("item_id", "passage")
    blocks = max(1, -(-queries.count() // BLOCK))
    docs = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    out = None
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(tuple((r["item_id"], r["passage"]) for r in part.collect()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = searcher(window, budget, shared.value).search
            for b in batches:
                rows = [(d, i, e) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, e in find(t).items()]
                cols = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["doc_id", "item_id", "edits"])

        one = docs.mapInArrow(run, "doc_id bigint, item_id bigint, edits int")
        out = one if out is None else out.union(one)
    return out


def p9_found(spark, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))
    return found.where("edits = 0").select("doc_id", "item_id")


def p9_near(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, edits): passages that stand with one word changed, lost or put in, as well."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))
