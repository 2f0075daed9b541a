"""Problem 6: each new batch against all that earlier batches left accepted.

Chunks are content-defined: a hash rolls over the words, and a chunk ends where the hash meets the boundary mask. The
mask here is zero bits wide, so a chunk of three words ends after every word: any sparser mask loses pairs at an overlap
of 0.6 (a few edits in a short body leave no chunk of several words whole), and TESTDATA's measure counts these very
chunks. `History` is a persistent table of records and their chunks: a take looks its rows' chunks up there, chunks
shared by two records give their coverage, coverage decides, and the chunks of accepted rows are appended. Of a record's
chunks only the rarest few, which stand first, are needed to meet every record it may be like (prefix.py); all are
compared only for the records met.

A take is one or more batches. What repeats the history is known first; only the other rows are compared with one
another. A campaign is therefore compared with the few of its variants that were accepted, not with itself, and where
the new rows would still make too many pairs, the take is cut in two: the first part is taken, then the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BatchTable, Scratch, materialize, spread, workspace
from . import pairs as P
from . import prefix
from . import shingles as S

K, THRESHOLD = 3, 0.6
TAKES = 2  # a backlog of batches is taken in so many groups of batches; None takes every batch alone
FEW = 16_384  # rows that are never worth cutting
MOST_IDS = 1_000_000  # ids (8 MB) sent to every task to pick rows of texts or chunks; of more, a bit map (see of_ids)
MOST_WORDS = 1 << 20  # words of 64 bits of such a map (16 MB)
MOST_PAIRS = 400  # meetings of chunks a new row, on average, beyond which a take is cut in two
RECORDS, ROWS, HOT, REPEATS = "id bigint, s array<bigint>, k int", "id bigint, mail struct<x:bigint,y:int>", "h bigint, n bigint", "first_id bigint, id bigint"


def chunked(texts: DataFrame, hot: list[np.ndarray]) -> DataFrame:
    """(id, text) -> (id, s, k): the chunks in the common order, and how many of them are looked up; no row for texts
    under 20 words."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sets, firsts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(ws := S.words(t)) >= 20:
                    s, k = prefix.ordered(S.shingle_set(ws, K), shared.value, THRESHOLD)
                    ids.append(i)
                    sets.append(s)
                    firsts.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), P._list_column(sets), pa.array(firsts, pa.int32())], ["id", "s", "k"])

    return texts.mapInArrow(run, "id bigint, s array<bigint>, k int")


def of_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose id is among ids (distinct), or with left_anti is not. Up to MOST_IDS ids are broadcast. Of more, a
    bit map of their hashes is, with eight bits an id as long as it may grow: only the rows it shows, those of the ids and
    about one in eight of the others, meet the ids in a shuffled join, so texts and chunks never move as a whole."""
    if (n := ids.count()) <= MOST_IDS:
        return df.join(F.broadcast(ids.withColumnRenamed("id", "__id")), F.col("id") == F.col("__id"), how)
    mask = min(64 * MOST_WORDS, 1 << (8 * n).bit_length()) - 1
    place = F.xxhash64("id").bitwiseAND(F.lit(mask).cast("bigint"))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    bits = ids.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("__bits"))
    shown = df.join(F.broadcast(bits), word == F.col("__word"), "left").withColumn("__shown", F.coalesce(F.bit_get("__bits", bit) == 1, F.lit(False)))
    exact = shown.where("__shown").select(*df.columns).join(ids.withColumnRenamed("id", "__id").hint("merge"), F.col("id") == F.col("__id"), how)
    return exact if how == "left_semi" else exact.union(shown.where("not __shown").select(*df.columns))


def lookup_keys(records: DataFrame) -> DataFrame:
    """(id, s, k) -> (h, id, n, at)."""
    return records.select("id", F.size("s").alias("n"), F.posexplode(F.slice("s", F.lit(1), F.col("k"))).alias("at", "h")).select("h", "id", "n", "at")


def covered(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) -> those of enough coverage. pairs: materialised; a, b: (id, s), where the sides' chunks stand. Only the
    chunks of records that are met move."""
    side = lambda t, x: of_ids(t, pairs.select(F.col(x).alias("id")).distinct()).select(F.col("id").alias(x), F.col("s").alias(f"s{x}"))
    return pairs.join(side(a, "a"), "a").join(side(b, "b"), "b").where(P.alike("sa", "sb", THRESHOLD)).select("a", "b")


def under(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """reps: (id, s, k), ids: (rep, id), few -> the chunks of each rep under the id given for it."""
    return ids.join(of_ids(reps, ids.select(F.col("rep").alias("id")).distinct()).withColumnRenamed("id", "rep"), "rep").select("id", "s", "k")


def decide(rows: DataFrame, watches: DataFrame, known: DataFrame, keep=materialize) -> DataFrame:
    """(id, first_id) of the repeats. rows: (id, rank, key) a row owns the keys of its mail id and text class;
    watches: (key, seen) a row owning `key` repeats any earlier accepted row that owns `seen`; known: (id) rows that
    are repeats already and so never accepted, but may repeat an accepted one of these rows as well.

    Rounds: a row is accepted once no undecided and no accepted row before it is in sight, and is a repeat
    once an accepted one is. Each round decides at least the first open row of every key, all at once, from
    combined minima; nothing is gathered by key.
    """
    sight = keep(rows.select("id", "rank", "key").join(watches, "key").select("id", "rank", "seen").distinct(), "sight")
    owned = rows.select("id", "rank", F.col("key").alias("seen"))
    # a key that only one row owns and no other row sees settles nothing
    busy = sight.groupBy("seen").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x != y").select("seen")
    sight = keep(sight.join(busy, "seen"), "sight")
    owned = keep(owned.join(busy, "seen"), "owned")
    open_ = keep(sight.select("id", "rank").distinct().join(known.select("id"), "id", "left_anti"), "open-rows")
    accepted = None
    while not open_.isEmpty():
        first_open = owned.join(open_.select("id"), "id", "left_semi").groupBy("seen").agg(F.min("rank").alias("o"))
        state = sight.join(open_.select("id"), "id", "left_semi").join(first_open, "seen", "left")
        if accepted is not None:
            taken = owned.join(accepted.select("id"), "id", "left_semi").groupBy("seen").agg(F.min("rank").alias("t"))
            state = state.join(taken, "seen", "left")
        else:
            state = state.withColumn("t", F.lit(None).cast(rows.schema["rank"].dataType))
        judged = keep(
            state.groupBy("id", "rank").agg(F.min("o").alias("o"), F.min("t").alias("t"))
            .select("id", "rank", F.when(F.col("t") < F.col("rank"), "repeat").when(F.col("o") >= F.col("rank"), "accept").otherwise("open").alias("state")), "judged")
        new = judged.where("state = 'accept'").select("id", "rank")
        accepted = keep(new if accepted is None else accepted.union(new), "accepted")
        open_ = judged.where("state = 'open'").select("id", "rank")
    if accepted is None:
        return rows.select("id", F.col("id").alias("first_id")).limit(0)
    holders = owned.join(accepted.select("id"), "id", "left_semi").groupBy("seen").agg(F.min("rank").alias("t"), F.min_by("id", "rank").alias("first"))
    # of one key at most one row is ever accepted, so the key's first holder is its only one
    hits = sight.join(accepted.select("id"), "id", "left_anti").join(holders, "seen").where(F.col("t") < F.col("rank"))
    return hits.groupBy("id").agg(F.min("first").alias("first_id"))


class History:
    """What earlier batches left accepted: a chunk table and what decides, under one folder.

    A take is one atomic batch of the table: a crash leaves nothing of it, and a take of a name that is there already
    only returns its repeats. A take reads the chunks of the history (8 bytes each), never its texts; the rarest of each
    record are looked up, and all of a record's chunks move only where its rows meet it.
    """

    def __init__(self, spark: SparkSession, path: str, sample: DataFrame | None = None):
        """sample: (id, body_text) rows that show which chunks are frequent, the first take's where none are given."""
        self.spark, self.table, self.sample = spark, BatchTable(spark, path), sample

    def _hot(self, rows: DataFrame) -> list[np.ndarray]:
        """The order of chunks, fixed by the first take for good: it bears on cost alone."""
        if "0-order" not in self.table.batches():
            seen = spread((rows if self.sample is None else self.sample).where("id is not null and length(body_text) >= 39").select("id", F.col("body_text").alias("text")))
            h, n = prefix.hot_shingles(seen, K)
            self.table.append("0-order", hot=self.spark.createDataFrame(pa.table({"h": h.view(np.int64), "n": n})).select(F.col("h").cast("bigint"), F.col("n").cast("bigint")))
        got = self.table.read("hot", HOT).orderBy(F.col("h")).toArrow()
        h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
        order = np.argsort(h)
        return [h[order], n[order]]

    def take(self, name: str, rows: DataFrame) -> DataFrame:
        """(first_id, id) of the repeats among rows (id, email_id, body_text, batch_no); the others are accepted.

        Rows go by batch_no (null first), then id. A null email_id equals no other; null and short bodies are compared by
        email_id only; rows without an id are left out. Names sort as the takes follow each other.
        """
        if f"1-{name}" not in self.table.batches():
            rows = rows.where("id is not null")
            begun = self._parts(name)
            if begun:  # a take that was cut and broke off: its finished parts stand
                done = self.table.read("rows", ROWS, begun).select("id").union(self.table.read("repeats", REPEATS, begun).select("id"))
                rows = rows.join(done, "id", "left_anti")
            rank = F.struct(F.col("batch_no").cast("bigint").alias("batch"), F.col("id").alias("id"))
            mail = F.when(F.col("email_id").isNotNull(), F.struct(F.xxhash64("email_id").alias("x"), F.hash("email_id").alias("y")))
            texts = spread(rows.where("length(body_text) >= 39").select("id", F.col("body_text").alias("text")))
            scratch = Scratch(self.spark)
            heads = scratch.keep(rows.select("id", rank.alias("rank"), mail.alias("mail")), "heads")
            # classes of equal texts: their first row stands for all
            keyed = scratch.keep(rows.where("length(body_text) >= 39").select("id", F.unhex(F.md5("body_text")).alias("key")), "text-keys")
            members = scratch.keep(keyed.join(keyed.groupBy("key").agg(F.min("id").alias("rep")), "key").select("id", "rep"), "members")
            reps = scratch.keep(chunked(of_ids(texts, members.where("id != rep").select("id"), "left_anti"), self._hot(rows)), "chunks")
            members = scratch.keep(members.join(reps.select(F.col("id").alias("rep")), "rep", "left_semi"), "members")
            self._settle(name, heads, members, reps, scratch)
            scratch.clear()
        return self.repeats(name)

    def _parts(self, name: str) -> list[str]:
        return [b for b in self.table.batches() if b == f"1-{name}" or b.startswith(f"1-{name}.")]

    def repeats(self, name: str) -> DataFrame:
        """What a take found, all parts of it."""
        return self.table.read("repeats", REPEATS, self._parts(name))

    def _settle(self, name: str, heads: DataFrame, members: DataFrame, reps: DataFrame, scratch: Scratch) -> None:
        """heads: (id, rank, mail); members: (id, rep), the class of each row with a text; reps: (id, s, k)."""
        keep = scratch.keep
        old_rows, old = self.table.read("rows", ROWS), self.table.read("records", RECORDS)
        known = heads.select("id", F.col("id").alias("first")).limit(0)
        rising = True
        if any(b.startswith("1-") for b in self.table.batches()):
            a, b = prefix.sides(lookup_keys(reps), lookup_keys(old))
            met = keep(prefix.met(a.join(b.hint("merge"), "h"), THRESHOLD), "met-history")
            by_text = members.join(covered(met, reps, old).groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("first")), "rep").select("id", "first")
            by_mail = heads.where("mail is not null").select("id", "mail").join(old_rows.where("mail is not null").select("mail", F.col("id").alias("first")), "mail").select("id", "first")
            known = keep(by_text.union(by_mail).groupBy("id").agg(F.min("first").alias("first")), "known")
            rising = (heads.agg(F.min("id")).first()[0] or 0) > (old_rows.agg(F.max("id")).first()[0] or 0)
        open_reps = reps
        if rising:
            # a known repeat of a smaller id than any new row's needs no comparison with these; a class of such rows is done
            state = members.join(known.select("id", F.lit(True).alias("k")), "id", "left").groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("k"))
            open_reps = of_ids(reps, keep(state.where("n = k").select("id"), "done"), "left_anti")
        keys = lookup_keys(open_reps)
        if self._cut(name, heads, members, reps, keys, scratch):
            return
        a, b = prefix.sides(keys, keys)
        met = keep(prefix.met(a.join(b.hint("merge"), "h").where("a < b"), THRESHOLD), "met-new")
        like = keep(covered(met, reps, reps), "like-new")
        key = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
        text = lambda c: key("t", F.col(c), F.lit(0))
        # only what could meet another row: mail ids met twice, texts met twice or like another
        mails = heads.where("mail is not null").select("id", "rank", key("m", F.col("mail.x"), F.col("mail.y")).alias("key"))
        twice = mails.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        shared = members.where("id != rep").select("rep").union(like.select("a")).union(like.select("b")).distinct()
        of_text = members.join(shared, "rep").join(heads.select("id", "rank"), "id").select("id", "rank", text("rep").alias("key"))
        owned = keep(mails.join(twice, "key").select("id", "rank", "key").union(of_text), "owned-keys")
        watches = owned.select("key").distinct().select("key", F.col("key").alias("seen")).union(like.select(text("a"), text("b"))).union(like.select(text("b"), text("a")))
        new = decide(owned, watches, known, keep).select("id", F.col("first_id").alias("first"))
        found = keep(known.union(new).groupBy("id").agg(F.min("first").alias("first_id")).select("first_id", "id"), "repeats")
        fresh = heads.join(found.select("id"), "id", "left_anti")
        records = of_ids(reps, found.select("id"), "left_anti")
        late = keep(members.where("id != rep").join(found.select("id"), "id", "left_anti"), "late")
        if not late.isEmpty():  # accepted rows whose class begins with a repeat
            records = records.union(under(reps, late))
        self.table.append(f"1-{name}", rows=fresh.select("id", "mail"), records=records, repeats=found)

    def _cut(self, name: str, heads: DataFrame, members: DataFrame, reps: DataFrame, keys: DataFrame, scratch: Scratch) -> bool:
        """Takes the rows in two parts where their keys would meet too often, as those of a new large campaign do."""
        # the meetings on one chunk in sixteen tell their number well enough: it bears on cost alone
        many = 16 * (keys.where("h & 15 = 0").groupBy("h").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0.0)
        if many <= MOST_PAIRS * FEW or many <= MOST_PAIRS * (n := heads.count()) or n <= FEW:
            return False
        # near the first eighth of the rows in their order; any cut gives the same repeats
        batch = F.coalesce(F.col("rank.batch").cast("double"), F.lit(-1.0))
        at = heads.select(batch.alias("b")).approxQuantile("b", [0.125], 0.01)[0]
        inside = heads.where(batch == at).select(F.col("id").cast("double").alias("i"))
        share = heads.where(batch < at).count()
        cut = inside.approxQuantile("i", [min(1.0, max(0.0, (n / 8 - share) / max(1, inside.count())))], 0.01)[0]
        early = (batch < at) | ((batch == at) & (F.col("id") <= cut))
        parts = [scratch.keep(heads.where(early), "heads"), scratch.keep(heads.where(~early), "heads")]
        if any(p.isEmpty() for p in parts):
            return False
        for tag, part in zip("ab", parts):
            mine = members.join(part.select("id"), "id", "left_semi")
            first = scratch.keep(mine.groupBy("rep").agg(F.min("id").alias("new")), "first")  # a class may begin later in its part
            moved = first.where("rep != new").select("rep", F.col("new").alias("id"))
            some = scratch.keep(of_ids(reps, first.where("rep = new").select(F.col("rep").alias("id"))).union(under(reps, moved)), "chunks")
            self._settle(f"{name}.{tag}", part, scratch.keep(mine.join(first, "rep").select("id", F.col("new").alias("rep")), "members"), some, scratch)
        self.table.append(f"1-{name}", repeats=self.spark.createDataFrame([], REPEATS))  # marks the whole
        return True


def steps(log: DataFrame, takes: int | None = TAKES) -> list[list[int | None]]:
    """The batches of a log in order, in at most `takes` groups of about equal rows, or each alone."""
    sizes = sorted(((r["batch_no"], r["n"]) for r in log.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (x[0] is not None, x[0]))  # one row a batch
    if takes is None:
        return [[b] for b, _ in sizes]
    out: list[list[int | None]] = [[] for _ in range(takes)]
    total, before = max(1, sum(n for _, n in sizes)), 0
    for b, n in sizes:
        out[before * takes // total].append(b)
        before += n
    return [g for g in out if g]


def replay(log: DataFrame, groups: list[list[int | None]] | None = None) -> DataFrame:
    """(first_id, id) of each repeat in a log, taken into a new history by groups of batches (see steps), in order. The
    groups bear on cost alone: fewer takes cost less, more of them are what happens as batches arrive."""
    log = log.select("id", "email_id", "body_text", F.col("batch_no").cast("bigint").alias("batch_no"))
    store = History(log.sparkSession, workspace(log.sparkSession, "history"), log)
    out = log.sparkSession.createDataFrame([], REPEATS)
    for k, batches in enumerate(steps(log) if groups is None else groups):
        some = [b for b in batches if b is not None]
        of = F.col("batch_no").isin(some) if some else F.lit(False)
        out = out.union(store.take(f"{k:06d}", log.where(of | F.col("batch_no").isNull() if None in batches else of)))
    return out


def p6_found(spark, sf_dir: str) -> DataFrame:
    return replay(spark.read.parquet(f"{sf_dir}/triage_log.parquet"))


def p6_accepted(spark, sf_dir: str) -> DataFrame:
    """(id): the rows newly accepted."""
    log = spark.read.parquet(f"{sf_dir}/triage_log.parquet")
    return log.select("id").join(replay(log).select("id"), "id", "left_anti")
