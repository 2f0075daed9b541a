"""Problem 1: text that looks ordinary but is spelled with other characters.

Compatibility forms of letters and digits are folded, split accents composed, ignorable characters
deleted and odd spaces made U+0020. Then each word that mixes scripts, or stands in the wrong script
for its line, becomes a lattice: every letter offers itself and its look-alikes. Viterbi search picks
the path of best character-pair score under a price for each change of script and each replacement;
a word changes only if that path is of one script.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import spread
from . import mojibake

# Letters that look alike, Latin letter first, then Cyrillic and Greek ones.
LATIN_CYRILLIC = {
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "ІӀ", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "УҮ",
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "k": "к", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у", "ë": "ё", "ï": "ї", "Ë": "Ё", "Ï": "Ї",
}
LATIN_GREEK = {
    "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ",
    "a": "α", "c": "ϲ", "i": "ι", "j": "ϳ", "k": "κ", "n": "η", "o": "οσ", "p": "ρ", "t": "τ", "u": "υ", "v": "ν", "w": "ω", "x": "χ", "y": "γ", "ó": "ό", "í": "ί", "á": "ά", "ú": "ύ",
}
INVISIBLE = {0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, 0xFE0E, 0xFE0F, 0xFEFF, 0xFFA0}

_TWINS: dict[str, dict[str, str]] = {"L": {}, "C": {}, "G": {}}  # target script -> letter -> twin in it
for _table, _other in ((LATIN_CYRILLIC, "C"), (LATIN_GREEK, "G")):
    for _l, _xs in _table.items():
        for _x in _xs:
            _TWINS["L"].setdefault(_x, _l)
        _TWINS[_other].setdefault(_l, _xs[0])
for _a, _b in (("C", "G"), ("G", "C")):
    for _x, _l in list(_TWINS["L"].items()):
        if _l in _TWINS[_b] and (("Ͱ" <= _x < "Ѐ") == (_a == "G")):
            _TWINS[_b].setdefault(_x, _TWINS[_b][_l])


def script(c: str) -> str:
    """L, C, G for letters of the three scripts, else an empty string."""
    if c.isascii():
        return "L" if c.isalpha() else ""
    if not c.isalpha():
        return ""
    o = ord(c)
    if o in (0xAA, 0xBA, 0xB5):
        return ""
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    return ""


def _compat() -> dict[int, str]:
    """Width, font and ligature forms of letters and digits -> the usual ones."""
    table = {}
    ranges = [(0xFB00, 0xFB07), (0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B), (0x1D400, 0x1D800), (0x2102, 0x2150), (0x2160, 0x2180), (0x1F1E6, 0x1F1E6)]
    for lo, hi in ranges:
        for o in range(lo, hi):
            c = chr(o)
            n = unicodedata.normalize("NFKC", c)
            if n != c and all(x.isalnum() for x in n) and unicodedata.category(c) in ("Lu", "Ll", "Lo", "Nd", "Nl", "Lm"):
                table[o] = n
    table.update({o: unicodedata.normalize("NFKC", chr(o)) for o in (0x132, 0x133, 0x1C7, 0x1C9, 0x1CA, 0x1CC, 0x17F)})
    return table


COMPAT = _compat()
SPACES = {o: " " for o in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
_esc = lambda os: "".join(re.escape(chr(o)) for o in sorted(os))
_FOLD = re.compile("[\u00a0\u017f\u01c7-\u01cc\u0132\u0133\u1680\u2000-\u200a\u202f\u205f\u2102-\u214f\u2160-\u217f\u3000\ufb00-\ufb06\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\U0001d400-\U0001d7ff]")  # a little wider than COMPAT and SPACES
_HIDDEN = re.compile(f"[{_esc(INVISIBLE)}]")
_MARK = re.compile("[̀-ͯ]")
_L, _C, _G = "A-Za-zÀ-ÖØ-öø-ɏ", "Ѐ-ԯ", "Ͱ-Ͽ"
_MIXED = re.compile(f"[{_L}][{_C}{_G}]|[{_C}][{_L}{_G}]|[{_G}][{_L}{_C}]")
_WORD = re.compile(r"[^\W\d_]+")
# Letters of other scripts that pass for Latin ones even in a word of their own.
STRICT = "АВЕЅІЈКМНОРСТУХасеорухѕіјһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"
_FOREIGN_TWIN = re.compile(rf"(?<!\w)[{STRICT}]+(?!\w)")
_FIRM = {"C": re.compile(f"(?![{STRICT}])[{_C}]"), "G": re.compile(f"(?![{STRICT}])[{_G}]")}
_ANY = re.compile(f"{_FOLD.pattern}|{_HIDDEN.pattern}|{_MARK.pattern}|{_MIXED.pattern}")
_JOINERS = "‍️︎‌"
SWITCH, CHANGE = -9.0, -0.7


def _delete_hidden(text: str) -> str:
    """Without ignorable characters; those that shape an emoji or a joining script stay."""
    out = []
    for i, c in enumerate(text):
        if ord(c) in INVISIBLE:
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            if c in _JOINERS:
                emoji = lambda x: bool(x) and (unicodedata.category(x) in ("So", "Sk") or x in "‍️" or x in "#*0123456789")
                if c in "‍️" and before and (unicodedata.category(before) in ("So", "Sk") or before == "️") and (c == "️" or emoji(after)):
                    out.append(c)
                    continue
                if c in "‍‌" and before and after and 0x590 <= ord(before) < 0x1100 and 0x590 <= ord(after) < 0x1100:
                    out.append(c)
                    continue
            continue
        out.append(c)
    return "".join(out)


class Speller:
    """counts: neighbouring characters of the corpus, see mojibake.model."""

    def __init__(self, counts: dict[str, int]):
        self.repairer = mojibake.Repairer(counts)
        self.log, self.floor = self.repairer.log, self.repairer.floor
        self.memo: dict[tuple[str, str], str] = {}

    def lattice(self, word: str, prefer: str = "") -> str:
        """The best path through the word's look-alike lattice, if it is of one script; else the word."""
        key = (word, prefer)
        if key in self.memo:
            return self.memo[key]
        columns = []
        for c in word:
            own = script(c)
            column = [(c, own, 0.0)]
            for target, twins in _TWINS.items():
                if target != own and c in twins:
                    column.append((twins[c], target, CHANGE))
            columns.append(column)
        first = [(self.log.get(" " + c, self.floor) + cost + (2.0 if prefer and s == prefer else 0.0), None) for c, s, cost in columns[0]]
        table = [first]
        for i in range(1, len(columns)):
            row = []
            for c, s, cost in columns[i]:
                best = max(
                    (table[-1][j][0] + self.log.get(p + c, self.floor) + (SWITCH if s and t and s != t else 0.0), j)
                    for j, (p, t, _) in enumerate(columns[i - 1])
                )
                row.append((best[0] + cost + (2.0 if prefer and s == prefer else 0.0), best[1]))
            table.append(row)
        j = max(range(len(table[-1])), key=lambda k: table[-1][k][0] + self.log.get(columns[-1][k][0] + " ", self.floor))
        path = []
        for i in range(len(columns) - 1, -1, -1):
            path.append(columns[i][j])
            j = table[i][j][1]
        path.reverse()
        scripts = {s for _, s, _ in path if s}
        out = "".join(c for c, _, _ in path) if len(scripts) == 1 else word
        if len(self.memo) > 50_000:
            self.memo.clear()
        self.memo[key] = out
        return out

    def _mixed_word(self, m: re.Match) -> str:
        word = m.group(0)
        if word.isascii() or not _MIXED.search(word):
            return word
        own = [script(c) for c in word]
        return self.lattice(word, max("LCG", key=own.count))

    def _whole_words(self, text: str) -> str:
        """Words wholly in another script where no word near them is: lines without one firm letter of it."""
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if line.isascii() or not _FOREIGN_TWIN.search(line):
                continue
            near = "\n".join(lines[max(0, i - 1) : i + 2])

            def swap(m: re.Match, near: str = near) -> str:
                word = m.group(0)
                if _FIRM[script(word[0])].search(near) or not re.search("[A-Za-z]{3}", near):
                    return word
                new = "".join(_TWINS["L"][c] for c in word)
                return new if len(word) > 1 or self.log.get(f" {new}", self.floor) > self.log.get(f" {word}", self.floor) else word

            lines[i] = _FOREIGN_TWIN.sub(swap, line)
        return "\n".join(lines)

    def spell(self, text: str) -> str:
        """The consistent spelling of a text that is not garbled."""
        if _FOLD.search(text):
            text = text.translate(COMPAT).translate(SPACES)
        if _HIDDEN.search(text):
            text = _delete_hidden(text)
        if _MARK.search(text):
            text = unicodedata.normalize("NFC", text)
        if _MIXED.search(text):
            text = _WORD.sub(self._mixed_word, text)
        if _FOREIGN_TWIN.search(text):
            text = self._whole_words(text)
        return text

    def examine(self, text: str | None) -> tuple[str | None, bool]:
        """(consistent spelling, whether characters had to change); garbled text is problem 3's and no case."""
        if not text or text.isascii() or not (_ANY.search(text) or _FOREIGN_TWIN.search(text)):
            return text, False
        new = self.spell(text)
        if new == text:
            return text, False
        repaired, garbled = self.repairer.repair(text)
        return (self.spell(repaired), False) if garbled else (new, True)


def fields(emails: DataFrame, names: tuple[str, ...] = ("sender_display_name", "body_text")) -> DataFrame:
    """(rec_id, field, normalized) for each field that holds look-alike, hidden or split characters.

    Null, empty and pure ASCII fields are never cases and never leave the JVM; rows are judged one by one,
    so repeated rows give repeated results. Extra columns are ignored.
    """
    shared = emails.sparkSession.sparkContext.broadcast(mojibake.model(emails))
    suspect = " or ".join(f"{n} rlike '[^\\\\x00-\\\\x7f]'" for n in names)
    rows = spread(emails.select("rec_id", *names).where(suspect))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value)
        for b in batches:
            out: list[tuple] = []
            ids = b.column(0).to_pylist()
            for k, name in enumerate(names):
                for i, text in zip(ids, b.column(k + 1).to_pylist()):
                    new, case = speller.examine(text)
                    if case:
                        out.append((i, name, new))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["rec_id", "field", "normalized"])

    return rows.mapInArrow(run, "rec_id bigint, field string, normalized string")


def p1_normalized(spark, sf_dir: str) -> DataFrame:
    """(rec_id, sender_display_name, body_text): both fields of every mail in one consistent spelling."""
    from pyspark.sql import functions as F

    emails = spark.read.parquet(f"{sf_dir}/emails.parquet")
    new = fields(emails)
    by = new.groupBy("rec_id").agg(*[F.max(F.when(F.col("field") == n, F.col("normalized"))).alias(f"new_{n}") for n in ("sender_display_name", "body_text")])
    joined = emails.select("rec_id", "sender_display_name", "body_text").join(by, "rec_id", "left")
    return joined.select("rec_id", *[F.coalesce(f"new_{n}", n).alias(n) for n in ("sender_display_name", "body_text")])


def p1_found(spark, sf_dir: str) -> DataFrame:
    return fields(spark.read.parquet(f"{sf_dir}/emails.parquet")).select("rec_id", "field")
