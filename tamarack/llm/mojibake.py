"""Problem 3: text decoded with the wrong character encoding.

Every character of a suspect field is mapped back to the byte it had in a legacy code page. Over those
bytes an automaton for the structure of UTF-8 (lead and continuation classes, compiled per code page to
a pattern over the page's own characters) finds the maximal well-formed multibyte spans; only those
spans are decoded, again and again while something decodes. Pages whose lead and continuation bytes are
ordinary letters (Cyrillic, Greek) need a second witness: character pairs counted over all bodies must
make the decoded word clearly likelier. The same witness judges confusions of two single-byte pages,
which have no byte structure. U+FFFD and C1 controls are cases by themselves; what they stood for is lost.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread

# Code pages a mail client may have read with, and pairs (true page, page read with).
STRUCTURED_PAGES = ("cp1252", "cp1250", "cp437", "cp850", "mac_roman", "iso8859_15", "cp1254", "iso8859_2")
LETTER_PAGES = ("cp1251", "cp1253", "cp866", "koi8_r")
BYTE_PAIRS = (
    ("cp1251", "cp1252"), ("cp1251", "mac_roman"), ("cp1251", "koi8_r"), ("cp1251", "cp437"), ("cp1251", "cp850"), ("cp1251", "cp866"),
    ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("koi8_r", "cp866"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp866", "koi8_r"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1253", "cp1252"), ("cp1253", "mac_roman"), ("cp1253", "cp1251"),
)
#: characters at home in the corpus' languages and in ordinary typography
AT_HOME = set("äöüßÄÖÜéèêëàâçîïôùûœÉÈÀÇÊÔÎÂáíóúñÁÍÓÚÑ¿¡ãõÃÕ–—‘’“”„«»…€£°ºª№·©®™½¼¾²³§  ‍️­")
AT_HOME |= {chr(c) for c in range(0x410, 0x450)} | set("Ёё") | set("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩαβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰΆΈΉΊΌΎΏ")
# character pairs a million pairs of the corpus: known from the first rate on, unknown ones count as the second; so what
# is known does not depend on the size of the table
MIN_RATE, FLOOR_RATE = 0.4, 0.06
ASCII_LEVEL = 4.0  # log rate of words without a character beyond ASCII


def _bytes_of(page: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b  # undefined bytes pass through as C1 controls
    if page == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


PAGES = {p: _bytes_of(p) for p in {*STRUCTURED_PAGES, *LETTER_PAGES, *(r for _, r in BYTE_PAIRS)}}
def _pair_table(true: str, read: str) -> dict[int, str]:
    """Character as read -> character as written; a byte the true page lacks gives a character no mail holds."""
    table = {}
    for c, b in PAGES[read].items():
        try:
            table[ord(c)] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            table[ord(c)] = "\uffff"
    return table


PAIR_TABLES = [_pair_table(*pair) for pair in BYTE_PAIRS]
SUSPECT = {c for page in PAGES.values() for c in page} - AT_HOME


def _automaton(page: dict[str, int]) -> re.Pattern:
    """Runs of well-formed UTF-8 sequences, spelled in the page's characters."""
    group = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in page.items() if lo <= b <= hi) + "]"
    tail = group(0x80, 0xBF)
    forms = [group(0xC2, 0xDF) + tail, group(0xE0, 0xEF) + tail * 2, group(0xF0, 0xF4) + tail * 3]
    return re.compile("(?:" + "|".join(forms) + ")+")


AUTOMATA = {p: _automaton(PAGES[p]) for p in (*STRUCTURED_PAGES, *LETTER_PAGES)}
_LOST = re.compile("[�\x80-\x84\x86-\x9f]|[─-▟](?=\\w)|(?<=\\w)[─-▟]")
_LIGATURES = re.compile("[ﬀ-ﬆ]")  # they stand for letters far more often than for lost ones
# the byte-order mark may come out as nothing but characters at home in mail
_MARKS = ["".join(c for x in b"\xef\xbb\xbf" for c, b in PAGES[p].items() if b == x) for p in STRUCTURED_PAGES]
_ODD = re.compile("|".join(re.escape(m) for m in _MARKS if len(m) == 3) + "|[" + "".join(re.escape(c) for c in sorted(SUSPECT)) + "]"
                  r"|[a-zß-öø-ÿ][À-ÖØ-Þ]|[а-яё][А-ЯЁ]|[A-Za-z][Ͱ-Ͽ]|[Ͱ-Ͽ][A-Za-z]|[ВГ][\u00a0-¿ЁёЂЃЉЊЌЋЏђѓљњќћџЎўҐґЄє№]|[ΒΓ][\u00a0-¿]|[À-ÖØ-öø-ÿ]{3}|[ÂÃ][ -¿]|[А-ЯЁ]{4}|[«»·°º§©®½¼¾²³ª¿¡„№](?=\w)|(?<=\w)[«·°º§©®½¼¾²³ª¿¡„“‘–—]")
_TOKEN = re.compile(r"\S*[^\x00-\x7f]\S*")


def _plausible(text: str) -> bool:
    """Characters that mail of the corpus' languages may hold beyond ASCII."""
    for c in text:
        o = ord(c)
        if not (0xA0 <= o < 0x180 or 0x384 <= o < 0x3CF or 0x410 <= o < 0x450 or o in (0x401, 0x451, 0x20AC, 0x2122, 0x192, 0x2116, 0xFE0F) or 0x2010 <= o < 0x2040
                or 0x2600 <= o < 0x2800 or 0xFB00 <= o < 0xFB07 or 0x1F000 <= o < 0x1FB00):
            return False
    return True


def _assigned(text: str) -> bool:
    """Characters of three bytes and more may be any that are assigned and no control; two of a page's characters
    stand side by side by chance more often, so what they give must be plausible."""
    return all(unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") if c > "\u07ff" else _plausible(c) for c in text)


_SCRIPTS = tuple(re.compile(x) for x in ("[A-Za-zÀ-ÖØ-öø-ɏﬀ-ﬆ]", "[Ѐ-ӿ]", "[Ͱ-Ͽ]"))
_LETTERS = re.compile(r"[^\W\d_]+")


def _one_script(text: str) -> bool:
    """No run of letters mixes scripts."""
    return all(sum(bool(s.search(run)) for s in _SCRIPTS) < 2 for run in _LETTERS.findall(text))


class Repairer:
    """Applies the automata and byte pairs; counts: how often two characters stand side by side in the corpus."""

    def __init__(self, counts: dict[str, int]):
        million = max(1, sum(counts.values())) / 1e6
        self.log = {k: math.log(v / million) for k, v in counts.items() if v >= MIN_RATE * million}
        self.floor = math.log(max(FLOOR_RATE, 0.5 / million))  # a small table tells no rate under half a pair

    def likely(self, token: str) -> float:
        """Mean log count of the character pairs that hold a character beyond ASCII."""
        t = f" {token} "
        log, floor, total, n = self.log, self.floor, 0.0, 0
        for i in range(len(t) - 1):
            pair = t[i : i + 2]
            if not pair.isascii():
                total += log.get(pair, floor)
                n += 1
        return total / n if n else ASCII_LEVEL

    def _spans(self, text: str) -> str | None:
        """The text with every multibyte span of one page decoded, or None."""
        best, gain = None, 0
        for page, automaton in AUTOMATA.items():
            if not automaton.search(text):
                continue
            table, letters, hits = PAGES[page], page in LETTER_PAGES, 0

            def decode(m: re.Match) -> str:
                nonlocal hits
                s = m.group(0)
                try:
                    out = bytes(table[c] for c in s).decode("utf-8")
                except UnicodeDecodeError:
                    return s
                if not (_plausible(out) if letters else _assigned(out)):
                    return s
                a, b = m.start(), m.end()
                while a and text[a - 1].isalnum():
                    a -= 1
                while b < len(text) and text[b].isalnum():
                    b += 1
                old, new = text[a:b], text[a : m.start()] + out + text[m.end() : b]
                if len(out) < 3 and not _one_script(new):
                    return s
                if letters:
                    if out.isalnum() or old[: m.start() - a].isascii() is False or old[m.end() - a :].isascii() is False:
                        if self.likely(new) < self.likely(old) + 1.0:
                            return s
                hits += len(s) - len(out)
                return out

            fixed = automaton.sub(decode, text)
            if hits > gain:
                best, gain = fixed, hits
        return best

    def _tokens(self, text: str) -> str | None:
        """The text with words of a confused single-byte page mapped back, or None."""
        words = {w for w in _TOKEN.findall(text) if "://" not in w}
        best, gain = None, 0.0
        odd = [w for w in words if _ODD.search(w)]
        if not odd:
            return None
        chars = {c for w in odd for c in w if c > "\x7f"}
        for table in PAIR_TABLES:
            if not any(ord(c) in table for c in chars):
                continue
            first = self._changes(odd, table)
            if not first:
                continue
            change = first | self._changes([w for w in words if w not in first], table)
            sure = [(w, more) for w, (_, more) in change.items() if sum(map(str.isalpha, change[w][0])) > 1 and not _LIGATURES.sub("", w).isascii()]
            total = sum(more * (len(w) + 1) for w, more in sure)
            if total > gain and (len(sure) > 1 or sure[0][1] >= 3.0):
                best, gain = {w: new for w, (new, _) in change.items()}, total
        if not best or gain < 6.0:
            return None
        return _TOKEN.sub(lambda m: best.get(m.group(0), m.group(0)), text)

    def _changes(self, words: list[str], table: dict[int, str]) -> dict[str, tuple[str, float]]:
        """word -> (word mapped back, gain) where the mapped word is whole, of one script and clearly likelier."""
        out = {}
        for w in words:
            new = w.translate(table)
            if new == w or not _plausible("".join(c for c in new if c > "\x7f")) or not self.familiar(new) or not _one_script(new):
                continue
            more = self.likely(new) - max(self.likely(w), self.likely(w.lower()) if w.isupper() else self.floor)
            if more >= 1.0:
                out[w] = (new, more)
        return out

    def familiar(self, token: str) -> bool:
        """It has a letter beyond ASCII, and every pair of letters that holds one was seen often enough to count."""
        t = f" {token} "
        found = False
        for i in range(len(t) - 1):
            x, y = t[i], t[i + 1]
            if (x > "\x7f" and x.isalpha()) or (y > "\x7f" and y.isalpha()):
                found = True
                if (x.isalpha() or x == " ") and (y.isalpha() or y == " ") and x + y not in self.log:
                    return False
        return found

    def repair(self, text: str | None) -> tuple[str | None, bool]:
        """(text as it was written as far as it can be told, whether anything was decoded wrongly)."""
        if not text or text.isascii():
            return text, False
        bad = bool(_LOST.search(text))
        if not bad and not _ODD.search(text):
            return text, False
        while (fixed := self._spans(text)) is not None and fixed != text:  # a decoded span is shorter, so this ends
            text, bad = fixed, True
        fixed = self._tokens(text)
        if fixed is not None and fixed != text:
            text, bad = fixed, True
        return text, bad


def pair_counts(texts: DataFrame) -> dict[str, int]:
    """Counts of neighbouring characters over all bodies, words without an ASCII-only core left whole.

    Summed inside each partition first; only pairs of letters and spaces below U+0530 are kept, so what
    reaches the driver is bounded by the square of that alphabet whatever the corpus' size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    t = t.replace("\n", " ")
                    total.update(map("".join, zip(t, t[1:])))
        keep = {k: v for k, v in total.items() if k[0] < "԰" and k[1] < "԰" and (k[0].isalpha() or k[0] == " ") and (k[1].isalpha() or k[1] == " ")}
        yield pa.RecordBatch.from_arrays([pa.array(list(keep), pa.string()), pa.array(list(keep.values()), pa.int64())], ["pair", "n"])

    rows = texts.mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {r["pair"]: r["n"] for r in rows}


def model(emails: DataFrame) -> dict[str, int]:
    """Character pairs of all subjects and body texts."""
    return pair_counts(spread(emails.select(F.concat_ws(" ", "subject", "body_text").alias("text"))))


def fields(emails: DataFrame, names: tuple[str, ...] = ("subject", "body_text")) -> DataFrame:
    """(rec_id, field, text, repaired) for each field in which a character was decoded wrongly.

    Null, empty and pure ASCII fields are never cases and never leave the JVM. Repeated rows give repeated results.
    """
    shared = emails.sparkSession.sparkContext.broadcast(model(emails))
    suspect = " or ".join(f"{n} rlike '[^\\\\x00-\\\\x7f]'" for n in names)
    rows = spread(emails.select("rec_id", *names).where(suspect))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Repairer(shared.value)
        for b in batches:
            out: list[tuple] = []
            ids = b.column(0).to_pylist()
            for k, name in enumerate(names):
                for i, text in zip(ids, b.column(k + 1).to_pylist()):
                    fixed, bad = fix.repair(text)
                    if bad:
                        out.append((i, name, text, fixed))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["rec_id", "field", "text", "repaired"])

    return rows.mapInArrow(run, "rec_id bigint, field string, text string, repaired string")


def p3_repaired(spark, sf_dir: str) -> DataFrame:
    """(rec_id, field, repaired)."""
    return fields(spark.read.parquet(f"{sf_dir}/emails.parquet")).select("rec_id", "field", "repaired")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return fields(spark.read.parquet(f"{sf_dir}/emails.parquet")).select("rec_id", "field")
