"""Campaign fingerprints and the memory of verdicts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize, spread
from .tiles import Tiles, meet


def simhash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) -> (id, simhash), row by row: no shuffle. A feature's hash is the first 8 bytes of its md5."""
    memo: dict[str, int] = {}
    for b in batches:
        out = []
        for words in b.column(1).to_pylist():
            fs = (words or []) + [f"{x}_{y}" for x, y in zip(words or [], (words or [])[1:])]
            if not fs:
                out.append(0)
                continue
            if len(memo) > 200_000:
                memo.clear()
            hashes = []
            for f in fs:
                h = memo.get(f)
                if h is None:
                    h = memo[f] = int.from_bytes(hashlib.md5(f.encode(), usedforsecurity=False).digest()[:8], "big")
                hashes.append(h)
            votes = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out.append(int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["id", "simhash"])


def simhash_of(words: DataFrame) -> DataFrame:
    """(id bigint, words array<string>) -> (id, simhash): 64-bit SimHash of the words and word pairs, as a signed long;
    no words give 0."""
    return words.mapInArrow(simhash_rows, "id bigint, simhash bigint")


def simhash(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, simhash) of each row's normalised words; rows are independent, so nothing is shuffled."""
    words = F.filter(F.split(T.cluster_text(F.col(text_col)), " "), lambda w: w != "")
    return simhash_of(spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col))).select("id", words.alias("words")))


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def from_hex16(c: Column) -> Column:
    """A hash of 16 hexadecimal digits as a signed long."""
    part = lambda at: F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(part(1), 32).bitwiseOR(part(9))


def campaign_key(rows: DataFrame) -> DataFrame:
    """(id, d, s, simhash) -> (id, campaign_id): of root domain, normalised subject and the upper 44 bits of the hash."""
    coarse = F.shiftrightunsigned(F.col("simhash"), 20).cast("string")
    return rows.select("id", F.concat(F.lit("camp_"), F.substring(F.sha2(F.concat_ws("|", "d", "s", coarse), 256), 1, 10)).alias("campaign_id"))


def campaign_ids(df: DataFrame, id_col: str, subject: str, body: str, sender: str) -> DataFrame:
    """(id, campaign_id) of each row; see campaign_key."""
    key = df.select(F.col(id_col).cast("bigint").alias("id"), T.root_domain(F.col(sender)).alias("d"), T.cluster_subject(F.col(subject)).alias("s"))
    return campaign_key(key.join(simhash(df, id_col, body), "id"))


SLICE_BITS = 11  # bits of a slice that rows meet by, at most: 2,048 cells a slice
TILE_LEAST, TILE_MOST = 1024, 32_768  # rows a tile: a 64th of all, within these bounds


def _sliced(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, mask) of the bits + 1 slices of a hash."""
    cuts = [round(64 * k / (bits + 1)) for k in range(bits + 2)]
    return [(a, (1 << min(b - a, SLICE_BITS)) - 1) for a, b in zip(cuts, cuts[1:])]


def within(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance), a < b, of a task's rows (see tiles.py) of equal `cell` within `bits` differing bits. A pair that
    meets in several slices is taken in the first of them."""
    side, cell, ids, h = (table.column(c).to_numpy() for c in ("side", "cell", "id", "simhash"))
    order = np.lexsort((cell, side))
    cell, ids, h, ones = cell[order], ids[order], h[order].view(np.uint64), int(side.sum())
    split, slices = len(cell) - ones, _sliced(bits)
    out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(cell[:split])) + 1, [split]]) if split else np.array([0])
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        c = int(cell[lo])
        lo1, hi1 = (split + np.searchsorted(cell[split:], [c, c + 1])).tolist() if ones else (lo, hi)
        for i in range(lo, hi, 256):
            for j in range(lo1 if ones else i, hi1, 4096):
                x, y = h[i : min(i + 256, hi)], h[j : min(j + 4096, hi1)]
                u, v = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= bits)
                ok = ids[i + u] != ids[j + v]
                if not ones:
                    ok &= i + u < j + v
                d = x[u] ^ y[v]
                for low, mask in slices[: c >> SLICE_BITS]:
                    ok &= (d >> np.uint64(low)) & np.uint64(mask) != 0
                a, b = ids[i + u[ok]], ids[j + v[ok]]
                out.append((np.minimum(a, b), np.maximum(a, b), np.bitwise_count(d[ok]).astype(np.int64)))
    a, b, d = (np.concatenate(c) for c in zip(*out))
    return a, b, d


def near_pairs(hashes: DataFrame, bits: int = 5) -> DataFrame:
    """(a, b, distance), a < b: distinct hashes within `bits` differing bits.

    Split in bits + 1 slices, one must be equal (pigeonhole): rows of an equal slice are compared each with each in packed
    words, in tasks of bounded size whatever share of the rows has the slice (tiles.py), so only pairs become rows.
    """
    hashes = materialize(hashes.select("id", "simhash").where("id is not null and simhash is not null"), "hamming-hashes")
    cells = F.array(*[F.shiftrightunsigned("simhash", low).bitwiseAND(F.lit(mask)).cast("bigint") + F.lit(k << SLICE_BITS) for k, (low, mask) in enumerate(_sliced(bits))])
    keyed = hashes.select("id", "simhash", F.explode(cells).alias("cell"))
    held = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row for each of 2,048 cells a slice
    counts = np.zeros((bits + 1) << SLICE_BITS, np.int64)
    counts[held.column("cell").to_numpy()] = held.column("n").to_numpy()
    tiles = Tiles(counts, int(min(TILE_MOST, max(TILE_LEAST, counts.sum() // (bits + 1) // 64))), range(0, len(counts), 1 << SLICE_BITS))
    pairs = [(i, j) for i in range(len(tiles.low)) for j in range(i, i + 1 if tiles.parts[tiles.low[i]] == 1 else tiles.first[tiles.low[i]] + tiles.parts[tiles.low[i]])]
    shared = hashes.sparkSession.sparkContext.broadcast(tiles)

    def place(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(b)), shared.value.of(b.column("cell").to_numpy(), b.column("id").to_numpy())

    return meet(keyed, place, pairs, partial(within, bits=bits))


def representatives(hashes: DataFrame) -> DataFrame:
    """(simhash, id): the smallest id of each hash."""
    return hashes.groupBy("simhash").agg(F.min("id").alias("id"))


def members(hashes: DataFrame) -> DataFrame:
    """(rec_id, rep_id) of every row of (id, simhash): two rows are near-duplicates where their representatives are
    the same or a near pair, so a hash that many rows share needs no pair for each two of them."""
    return hashes.join(representatives(hashes).select("simhash", F.col("id").alias("rep_id")), "simhash").select(F.col("id").alias("rec_id"), "rep_id")


def recall_verdicts(mails: DataFrame, cache: DataFrame, bits: int = 5) -> DataFrame:
    """Each mail with the cached verdict of its cluster, else of the first entry of equal domain and subject
    whose hash is within `bits`. mails: id, cluster_id, sender_domain, subject_key, simhash; cache: seq,
    cluster_id, sender_domain, normalized_subject, simhash, verdict. A mail without a match gets nulls."""
    exact = mails.join(cache.select("cluster_id", F.col("verdict").alias("v1"), F.col("cluster_id").alias("c1")), "cluster_id", "left")
    open_ = exact.where("c1 is null").select("id", "sender_domain", "subject_key", "simhash")
    near = (open_.alias("m").join(cache.alias("c"), (F.col("m.sender_domain") == F.col("c.sender_domain")) & (F.col("m.subject_key") == F.col("c.normalized_subject"))
                                  & (F.bit_count(F.col("m.simhash").bitwiseXOR(F.col("c.simhash"))) <= bits)).groupBy(F.col("m.id").alias("id"))
            .agg(F.min(F.struct("c.seq", "c.verdict", "c.cluster_id")).alias("first")))
    return (exact.join(near, "id", "left").select("id", F.coalesce("v1", "first.verdict").alias("verdict"), F.coalesce("c1", "first.cluster_id").alias("matched_cluster"),
            F.when(F.col("c1").isNotNull(), "cluster").when(F.col("first").isNotNull(), "near").alias("matched_by")))

def rollup(log: DataFrame) -> DataFrame:
    """Pending reports by campaign: size, means, first and last sight, and the latest report's words.

    Combined aggregates only: a campaign may hold any share of the reports.
    """
    pending = log.where("routed_to_review = 1 and analyst_label is null")
    cid = F.when(F.coalesce("campaign_cluster_id", F.lit("")) != "", F.col("campaign_cluster_id")).otherwise(F.col("email_id"))
    zero = lambda c, d: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.lit(d)).otherwise(F.col(c))
    last = F.struct("received_at", "id")
    out = pending.groupBy(cid.alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("reports"), F.avg(zero("phishing_prob", 0.5)).alias("avg_phishing"), F.min(zero("trust_score", 50.0)).alias("min_trust"),
        F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"), F.max_by(F.coalesce("subject", F.lit("(no subject)")), last).alias("subject"),
        F.max_by(F.when(F.coalesce("sender_address", F.lit("")) != "", F.col("sender_address")).otherwise("unknown_sender"), last).alias("sender"),
        F.max_by(F.coalesce(F.get("reasons", F.lit(0)), F.lit("Boundary uncertainty")), last).alias("top_signal"))
    return out


def reports_of(log: DataFrame, cards: DataFrame) -> DataFrame:
    """(cluster_id, email_id, id, received_at, subject, trust_score, phishing_prob): the reports of the given campaigns,
    one row each: a campaign may hold any share of the log, so no list is gathered."""
    pending = log.where("routed_to_review = 1 and analyst_label is null")
    cid = F.when(F.coalesce("campaign_cluster_id", F.lit("")) != "", F.col("campaign_cluster_id")).otherwise(F.col("email_id"))
    return pending.withColumn("cluster_id", cid).join(cards.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "email_id", "id", "received_at", F.coalesce("subject", F.lit("(no subject)")).alias("subject"), "trust_score", "phishing_prob")


def latest(log: DataFrame, key: str = "email_id") -> DataFrame:
    """The latest row of each key, by arrival and id: a combined maximum, not a window over hot keys."""
    cols = [c for c in log.columns if c != key]
    best = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("received_at", "id")).alias("x"))
    return best.select(key, *[F.col(f"x.{c}").alias(c) for c in cols])
