"""Problem 10: template residue, filler, error pages and script notices instead of content.

A naive Bayes model of passages (sentences and lines) is learned from positive and unlabelled data. Trusted records,
found by six narrow patterns, are the positives: their seed passages, and what else holds an unfilled slot or an empty
value in the same record. All other passages are unlabelled and start as content; expectation-maximization gives each
its share in both classes and fits again, so that wordings which no seed knows are learned from those they share words
with, whether or not they hold a known concept (a slot, a status code, a word of errors, scripts or filler), and
passages that only speak of such things are left by the words that go with them. Features are words and word pairs with
concepts, numbers and names made uniform, hashed into a table of fixed size, so the model and every sum sent to the
driver are bounded whatever the corpus. A document is a case if one of its passages is likelier residue than content.

The corpus is read once: that pass writes the features of all passages, packed, on which the rounds run and the
decisions are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, spread

BUCKETS = 1 << 18
ROUNDS = 6
ALPHA = 5.0  # pseudo-counts a feature, split over the classes as their sizes are: what neither class knows weighs nothing
PRIOR = 0.05
PLAIN_PRIOR = 1e-5  # of passages without a concept: they are nearly all of the corpus, and hardly any is residue
PLAIN, OPEN, TRUSTED = range(3)  # kinds of passages: without a concept, with one, residue beyond doubt
UNIT = 1_000_000  # shares are summed as whole numbers, so that sums do not depend on their order

_field = r"[A-Za-z][\w .-]{0,30}"
# Placeholder syntaxes of the common template languages.
SLOT = re.compile(
    rf"\{{\{{\s*{_field}\s*\}}\}}|\{{%\s*{_field}\s*%\}}|<%=?\s*{_field}\s*%>|[$#]\{{{_field}\}}|\[\[{_field}\]\]|\*\|{_field}\|\*|@@{_field}@@|%%{_field}%%|(?<![\w%])%[A-Za-z][A-Za-z_. ]{{1,30}}%(?![\w%])"
    rf"|<<{_field}>>|(?<!\w)__{_field}__(?!\w)|(?<!\w)XX_{_field}_XX(?!\w)|\[(?i:your|insert|enter|add) {_field}\]|\[(?!at\]|dot\]|sic\])(?:[a-z]+[ _.][a-z]+|[A-Z]+_[A-Z]+|[A-Z]{{3,}}|[a-z]{{3,}}|[A-Z][a-z]+ [A-Z][a-z]+)\]|(?<![\w$#{{%])\{{{_field}\}}(?!\}})|(?<!<)<(?:[A-Z]+(?:_[A-Z]+)*|[a-z]+(?:_[a-z]+)+|[A-Z][a-z]+ [A-Z][a-z]+|[a-z]+\.[a-z]+|[a-z]+ [a-z]+|company|city|date|salutation|name)>(?!>)")
# Words an empty value leaves behind.
EMPTY = re.compile(r"(?<![\w.#/])(?:null|undefined|NaN|None|nil|\(null\)|N/A|#REF!|#N/A|#VALUE!|#NAME\?|\[object Object\])(?![\w/])")
# HTTP codes of failure.
STATUS = re.compile(r"(?<![\w.,#=+/-])(?:400|401|402|403|404|405|406|408|410|413|414|418|422|429|451|500|501|502|503|504|505|508)(?![\w=+/-]|[.,]\d)")
# Filler text of page builders.
LOREM_WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit laborum"
LOREM = re.compile(r"(?i)\b(?:" + "|".join(LOREM_WORDS.split()) + r")\b")
# Words of scripts, of filler and of failures, by language.
SCRIPT = re.compile(r"(?i)\b(?:java ?scripts?|js|scripts?|scripting|cookies?|noscript)\b")
FILLER = re.compile(r"(?i)\b(?:blindtext|platzhalter\w*|placeholder|dummy|sample text|your text|text goes|todo|asdf\w*|x{3,}|qwer\w*|рыба|relleno|faux)\b|κείμενο εδώ")
FAULT = re.compile(r"(?i)\b(?:errors?|erreur|fehler(?:code)?|erro|ошибка|not found|no such|introuvable|unavailable|forbidden|unauthorized|denied|timed? ?-?out|gateway|\w*exception|traceback|fatal|undefined|failed|expired|gone|bad request|too many requests|sign-in needed|down for|maintenance"
                   r"|can(?:'t|not) find|could(?:n't| not) (?:find|load|be)|(?:does|do) not exist|not here any|not allowed|unable to)\b|σφάλμα|не найден\w*|nicht gefunden|no encontrad\w|não encontrad\w|δεν βρέθηκε")
CONCEPTS = {"slot": SLOT, "empty": EMPTY, "status": STATUS, "script": SCRIPT, "lorem": LOREM, "fill": FILLER, "fault": FAULT}
# Strings of which each concept holds at least one, in lower case.
TRIGGERS = {
    "slot": "{ [ < % @@ __ xx_ *|",
    "empty": "null undefined nan none nil n/a #ref #value #name [object",
    "status": "400 401 402 403 404 405 406 408 410 413 414 418 422 429 451 500 501 502 503 504 505 508",
    "script": "script js cookie",
    "lorem": LOREM_WORDS,
    "fill": "blindtext platzhalter placeholder dummy sample·text your·text text·goes todo asdf xxx qwer рыба relleno faux κείμενο",
    "fault": "error erreur fehler erro ошибка not·found no·such introuvable unavailable forbidden unauthorized denied time timed gateway exception traceback fatal undefined failed expired gone bad·request requests sign-in down·for maintenance find could not·exist not·here not·allowed unable σφάλμα найден gefunden encontrad βρέθηκε",
}
_kinds: dict[str, set[str]] = {}
for _kind, _words in TRIGGERS.items():
    for _w in _words.split():
        _kinds.setdefault(_w.replace("·", " "), set()).add(_kind)
_triggers = ahocorasick.Automaton()
for _w, _ks in _kinds.items():
    _triggers.add_word(_w, tuple(_ks))
_triggers.make_automaton()

#: trusted records: what a passage, or its form with uniform concepts, must show
SEEDS = {
    "greeting": re.compile(r"^(?:Dear|Hello|Hi)\s+‹(?:slot|empty)›"),
    "status": re.compile(r"^(?:HTTP |Error |ERROR )?\s*‹status›"),
    "lorem": re.compile(r"(?i)^lorem ipsum"),
    "script": re.compile(r"(?i)(?:enable|allow|switch on|activate) .{0,20}javascript"),
    "filler": re.compile(r"(?i)^placeholder|your text (?:goes )?here"),
    "trace": re.compile(r"(?i)^traceback \(most"),
}

_WORDS = re.compile(r"‹\w+›|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[|<>(){}:!?]")
_PATH = re.compile(r"(?<![\w/:.])[a-z]{3,}/[a-z]{3,}(?![\w/])")
_SPLIT = re.compile(r"(?<=[.!?…])\s+(?=\S)|\n\s*\n|\n(?=[^\S\n]*[>|•*-])")
_LEAD = re.compile(r"(?m)^[ \t]*(?:[>|]+[ \t]?)+")


def passages(text: str) -> list[str]:
    """Sentences and lines of a text, quote marks taken off, wrapped lines joined; whole long lines stay whole."""
    return [p.strip() for p in _SPLIT.split(_LEAD.sub("", text.replace("\r", ""))) if p and not p.isspace()]


def triggered(p: str) -> set[str]:
    """The concepts a passage may hold."""
    return {k for _, ks in _triggers.iter(p.lower()) for k in ks}


def uniform(p: str) -> str:
    """The passage with its concepts made uniform; equal to it if it holds none."""
    kinds = triggered(p)
    if kinds:
        for k, pattern in CONCEPTS.items():
            if k in kinds:
                p = pattern.sub(f" ‹{k}› ", p)
    return p


def seeded(p: str, q: str, names: tuple[str, ...] = tuple(SEEDS)) -> bool:
    """Whether a passage p, uniform q, is residue beyond doubt."""
    return any(SEEDS[n].search(q) or SEEDS[n].search(p) for n in names)


class Features:
    """Hashed words and word pairs of a passage in its uniform form."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, q: str) -> list[int]:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        if "/" in q:
            q = _PATH.sub(" ‹path› ", q)
        caps = q.isupper()
        last, out = "^", set()
        for k, w in enumerate(_WORDS.findall(q)):
            if w[0].isdigit():
                w = "‹num›"
            elif k and w[0].isupper() and not caps and len(w) > 3 and not w.isupper():
                w = "‹cap›"
            else:
                w = w.lower()
            for x in (w, f"{last} {w}"):
                b = memo.get(x)
                if b is None:
                    b = memo[x] = xxhash.xxh3_64_intdigest(x) & (BUCKETS - 1)
                out.add(b)
            last = w
        out.add(xxhash.xxh3_64_intdigest(f"{last} $") & (BUCKETS - 1))
        return list(out)


def judged(text: str, features: Features, seeds: tuple[str, ...] = tuple(SEEDS)) -> list[tuple[list[int], int]]:
    """(features, kind) of every passage."""
    found = []
    for p in passages(text):
        q = uniform(p)
        found.append((features(q), PLAIN if q == p else TRUSTED if seeded(p, q, seeds) else OPEN, "‹slot›" in q or "‹empty›" in q))
    record = any(kind == TRUSTED for _, kind, _ in found)
    return [(f, TRUSTED if record and open_ else kind) for f, kind, open_ in found]


class Model:
    """Log-likelihood ratio by bucket. The smoothing is in proportion to the classes, so it is the same at every size."""

    def __init__(self, positive: np.ndarray, negative: np.ndarray):
        p, n = max(1.0, positive.sum()), max(1.0, negative.sum())
        self.weight = np.log(positive + ALPHA * p / (p + n)) - np.log(negative + ALPHA * n / (p + n)) - np.log(p / n)
        self.prior = np.log([PLAIN_PRIOR / (1 - PLAIN_PRIOR), PRIOR / (1 - PRIOR), PRIOR / (1 - PRIOR)])  # by kind

    def scores(self, features: np.ndarray, lengths: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Log odds of residue against content of passages with so many of the features each, one at least."""
        return self.prior[kinds] + np.add.reduceat(self.weight[features], np.cumsum(lengths) - lengths) if len(lengths) else np.empty(0)


def flat(found: list[list[tuple[list[int], int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages of documents, see `judged`, as features and features a passage, kinds, and passages a document."""
    lengths = np.array([len(f) for d in found for f, _ in d], np.int32)
    return np.array([x for d in found for f, _ in d for x in f], np.int32), lengths, np.array([kind for d in found for _, kind in d], np.uint8), np.array([len(d) for d in found], np.int64)


def residual(model: Model, features: np.ndarray, lengths: np.ndarray, kinds: np.ndarray, passages_: np.ndarray) -> np.ndarray:
    """Whether each document has a passage likelier residue than content."""
    bad = np.repeat(np.arange(len(passages_)), passages_)[model.scores(features, lengths, kinds) > 0]
    return np.bincount(bad, minlength=len(passages_)) > 0


PASSAGES = "doc_id bigint, trusted boolean, f binary, n binary, kinds binary"


def read(docs: DataFrame, seeds: tuple[str, ...] = tuple(SEEDS)) -> DataFrame:
    """docs: (doc_id, text) -> PASSAGES, a row for each document that has any: the features of its passages in three bytes
    each, how many each passage has, their kinds, and whether one is trusted. One pass over the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if found := judged(t or "", features, seeds):
                    f, n, kinds, _ = flat([found])
                    rows.append((i, bool((kinds == TRUSTED).any()), f.view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), n.tobytes(), kinds.tobytes()))
            columns = [("doc_id", pa.int64()), ("trusted", pa.bool_()), ("f", pa.binary()), ("n", pa.binary()), ("kinds", pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], [name for name, _ in columns])

    return docs.mapInArrow(run, PASSAGES)


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of PASSAGES in the form of `flat`."""
    joined = lambda c: np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8)
    three = joined("f").reshape(-1, 3)
    f = np.zeros((len(three), 4), np.uint8)
    f[:, :3] = three
    counts = np.array([len(x) for x in b.column("kinds").to_pylist()], np.int64)
    return f.view("<i4").ravel(), joined("n").view("<i4"), joined("kinds"), counts


def _dense(rows: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Sums by bucket as arrays of BUCKETS numbers, all that reaches the driver."""
    found = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    at, out = found.column("bucket").to_numpy(), []
    for c in columns:
        x = np.zeros(BUCKETS)
        x[at] = found.column(c).to_numpy()
        out.append(x)
    return out


def fit(some: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximization over the table of `read`: trusted passages stay residue, plain ones teach
    content, the others get their share. What is fitted so judges every passage, the plain ones too (see `found`)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = np.zeros(BUCKETS, np.int64)
        for b in batches:
            all_ += np.bincount(unpacked(b)[0], minlength=BUCKETS)
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(all_[at])], ["bucket", "n"])

    (all_,) = _dense(some.select("f", "n", "kinds").mapInArrow(count, "bucket bigint, n bigint"), ["n"])
    model = None
    for _ in range(rounds):
        shared = some.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, pos = shared.value, np.zeros(BUCKETS, np.int64)
            for b in batches:
                f, n, kinds, _ = unpacked(b)
                share = 0.0 if m is None else 1.0 / (1.0 + np.exp(-np.clip(m.scores(f, n, kinds), -50.0, 50.0)))
                whole = np.rint(np.where(kinds == TRUSTED, 1.0, np.where(kinds == OPEN, share, 0.0)) * UNIT)
                some_ = np.repeat(whole > 0, n)  # most passages have no share at all
                pos += np.bincount(f[some_], weights=np.repeat(whole, n)[some_], minlength=BUCKETS).astype(np.int64)
            at = np.flatnonzero(pos)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pos[at])], ["bucket", "pos"])

        (pos,) = _dense(some.select("f", "n", "kinds").mapInArrow(run, "bucket bigint, pos bigint"), ["pos"])
        model = Model(pos / UNIT, all_ - pos / UNIT)
    return model


def learned(docs: DataFrame, rounds: int = ROUNDS, seeds: tuple[str, ...] = tuple(SEEDS)) -> tuple[DataFrame, Model]:
    """The passages of all documents, written to the shared folder, and the model fitted on them."""
    docs = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null"))
    some = materialize(read(docs, seeds), "residue-passages", compression="zstd")
    return some, fit(some, rounds)


def found(docs: DataFrame, rounds: int = ROUNDS, seeds: tuple[str, ...] = tuple(SEEDS)) -> DataFrame:
    """(doc_id) of each residue document, once. Null, empty and blank texts have no passage and are none; a null id is kept."""
    some, model = learned(docs, rounds, seeds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.select(["doc_id"]).filter(pa.array(residual(m, *unpacked(b))))

    return some.select("doc_id", "f", "n", "kinds").mapInArrow(run, "doc_id bigint").distinct()


def clean(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text): the corpus without residue documents, judged row by row: repeated rows and null ids stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, rounds)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), shared.value
        for b in batches:
            yield b.filter(pa.array(~residual(m, *flat([judged(t or "", features) for t in b.column(1).to_pylist()]))))

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, text string")


def p10_found(spark, sf_dir: str) -> DataFrame:
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p10_clean(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text): the corpus without residue documents."""
    return clean(spark.read.parquet(f"{sf_dir}/documents.parquet"))
