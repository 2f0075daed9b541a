"""Problem 7: personal items inside free text, by anchor expansion.

One Aho-Corasick pass over a lower-cased body finds anchors: at-signs and their spellings, URL schemes,
identifier cues, street words and the parts of known names. A deterministic local parser for each kind
of anchor expands it to both sides and validates the boundaries; items inside other items are dropped.
Parsers of spelled mails and of street addresses read only the lines around their anchors. Phones have no cue of their
own: their anchor is a plus sign, a bracket or a group of digits.
Garbled or look-alike text is read in its repaired spelling and positions are mapped back.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread
from . import lookalikes, mojibake

MAX_NAMES = 200_000
WRAP = 4  # lines over which a wrapped item may run before and after its anchor
# Labels of identity numbers.
ID_CUES = """social security number|social security no|ssn|national id|national id number|national insurance number|identity card|id card|id number|identity number|taxpayer id|tax id|tax number|tin|driving licence|driving license|driver's licence|driver's license|driver license|licence number|license number|card number|credit card|debit card|passport|passport number|passport no
numéro de sécurité sociale|n° de sécurité sociale|carte d'identité|passeport|permis de conduire|numéro fiscal|carte bancaire|numéro de carte
sozialversicherungsnummer|steuer-id|steueridentifikationsnummer|steuernummer|personalausweis|personalausweisnummer|ausweisnummer|reisepass|reisepassnummer|führerschein|führerscheinnummer|kartennummer|kreditkarte
dni|nie|nif|pasaporte|número de la seguridad social|seguridad social|carnet de conducir|permiso de conducir|tarjeta|número de tarjeta|documento de identidad
cpf|cartão de cidadão|passaporte|carta de condução|número do cartão|cartão de crédito|bilhete de identidade|segurança social
снилс|инн|паспорт|водительское удостоверение|номер карты|номер паспорта|карта
αφμ|αμκα|διαβατήριο|διαβατηρίου|ταυτότητα|ταυτότητας|άδεια οδήγησης|αριθμός κάρτας|αριθμό κάρτας"""
TITLES = "mr|mrs|ms|miss|dr|prof|sir|madam|herr|frau|monsieur|madame|mme|m|señor|señora|sr|sra|senhor|senhora|г-н|г-жа|κ|κύριε|κυρία"
GREETINGS = "hi|hey|hello|dear|bonjour|cher|chère|salut|hallo|liebe|lieber|hola|querido|querida|estimado|estimada|olá|caro|cara|prezado|prezada|здравствуйте|привет|уважаемый|уважаемая|дорогой|γεια σου|γεια|αγαπητέ|αγαπητή|thanks|ask|call|with|to|from|for|by|an|von|für|à|a|para|de"
# Given names that are plain words too.
PLAIN_WORDS = {"hope", "grant", "summer", "penny"}
NOT_PERSONS = re.compile(r"\s+(?:street|road|lane|ave\b|avenue|close|crescent|ltd|works|gmbh|inc|llc|team|support|group|crew|office|desk|unit|hours|money|budget)", re.I)

W = r"(?:[ \t ]+|[ \t]*\r?\n[ \t]*(?:[>|][ \t>|]*)?)"  # a gap inside an item may hold a wrapped quoted line
X = r"[^\W\d_a-zа-яёα-ωß-öø-ÿ][\w'’-]*"  # a capitalised word
_local = r"[^\W_](?:[\w.+%'-]*[\w+%-])?"
_domain = r"[^\W_][\w-]*(?:\.[\w-]*[^\W_])+"
_at_mail = re.compile(rf"@({_domain})")
_dot = r"(?:[ ]?[\[({][ ]?dot[ ]?[\])}][ ]?|\.)"
_at = r"[ ]?[\[({][ ]?at[ ]?[\])}][ ]?"
_spelled = re.compile(rf"(?<![\w.+-])[\w+%-]+(?:{_dot}[\w+%-]+)*{_at}[\w-]+(?:{_dot}[\w-]+)+", re.I)
_worded = re.compile(rf"(?<![\w.+-])[\w+%.-]+(?:{W}dot{W}[\w+%-]+)*{W}at{W}[\w-]+(?:{W}dot{W}[\w-]+)+", re.I)
_url = re.compile(r"(?:https?://|www\.)[^\s<>\"']+", re.I)
_phone = re.compile(
    r"(?<![\w+.,/#$€£:=&?-])(?<![#$€£] )(?:"
    r"\+\d{1,3}[ .-]?\(?\d{1,5}\)?(?:[ .-]?\d{2,8}){1,5}"
    r"|00\d{2} \d{2,4}(?: \d{2,4}){2,4}"
    r"|\(\d{2,5}\) ?\d{3,4}[ -]?\d{3,4}"
    r"|(?:1[-. ])?\d{3}[-.]\d{3}[-.]\d{4}"
    r"|\d{3}-\d{4}"
    r"|0\d{4} \d{3} \d{3}|0\d{3} \d{3} \d{4}|0\d{2,4}/\d{5,9}|0\d(?:[. ]\d{2}){4}"
    r")(?![\w-]|[.,/:]\d)")
_id_gap = re.compile(rf"(?:{W}(?:number|numbers|no\.?|n[°ºo]\.?|nº|№|nr\.?|num\.?|número|numéro|номер|αριθμός|is|:|#))*\s*[:#=]?{W}?", re.I)
_id_value = re.compile(rf"[A-ZА-Я]{{0,4}}[\d][\dA-ZА-Я./-]*(?:{W}(?:[A-Z]{{0,3}}\d[\dA-Z./-]*|[A-Z]{{1,3}}(?={W}\d)|[A-Z]{{1,2}}\d))*|[XYZ]-\d[\d-]*[A-Z]?|[A-Z]{{1,4}}-?\d[\dA-Z./-]*")
_streets = [re.compile(x) for x in (
    rf"(?<![\w-])(?:(?i:unit|flat|apt|apartment|suite|room){W}\w{{1,5}},{W})?\d{{1,5}}[A-Za-z]?{W}(?:{X}{W}){{1,3}}(?i:street|road|lane|avenue|ave\.|ave|close|crescent|drive|court|square|terrace)(?!\w)(?:,{W}(?i:apt|flat|unit){W}\d+)?(?:,{W}{X}(?:{W}\d{{5}})?)?",
    rf"(?<![\w-])\d{{1,5}}(?:{W}(?:bis|ter))?,?{W}(?i:rue|avenue|chemin|boulevard|place|allée|impasse|quai){W}(?:(?:des|de{W}la|de|du){W}|d['’])?{X}(?:,{W}(?:\d{{5}}{W})?{X})?",
    rf"(?<![\w-])(?:{X}(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm)|(?:Am|Im|An{W}der|Zum|Zur){W}{X}){W}\d{{1,5}}{W}?[a-z]?(?!\w)(?:,{W}(?:\d{{5}}{W})?{X})?",
    rf"(?<![\w-])(?i:calle|avda\.|avenida|plaza|paseo|camino){W}(?:(?:del|de{W}la|de){W})?{X},?{W}\d{{1,5}}(?:,{W}\d+\.º(?:{W}[A-Za-z]+)?)?(?:,{W}(?:\d{{5}}{W})?{X})?",
    rf"(?<![\w-])(?i:rua|avenida|travessa|largo|praça|estrada){W}(?:(?:da|de|do|das|dos){W})?{X},{W}\d{{1,5}}(?:,{W}\d+\.º(?:{W}[a-z]+)?)?(?:,{W}(?:\d{{4}}-\d{{3}}{W})?{X})?",
    rf"(?<![\w-])(?:(?i:г\.){W}{X},{W})?(?i:ул\.|улица|проспект|пр-т|пер\.|переулок|площадь|бульвар|шоссе|наб\.){W}{X},?{W}(?:(?i:д\.|дом){W})?\d{{1,5}}(?:,{W}(?i:кв\.){W}\d+)?",
    rf"(?<![\w-])(?i:οδός|οδό|λεωφόρος|λεωφόρο|πλατεία){W}{X},?{W}\d{{1,5}}",
)]
STREET_CUES = ("street", "road", "lane", "ave", "close", "crescent", "drive", "court", "square", "terrace", "rue ", "chemin", "boulevard", "place", "allée", "impasse", "quai", "straße", "strasse", "str.", "weg", "platz", "gasse", "allee",
               "am ", "im ", "calle", "avda", "avenida", "plaza", "paseo", "camino", "rua ", "travessa", "largo", "praça", "estrada", "ул.", "улица", "проспект", "пер.", "переулок", "площадь", "бульвар", "шоссе", "οδός", "οδό", "λεωφόρο", "πλατεία")
_kinds_of = {c: tuple(k for k, cs in enumerate((STREET_CUES[:10], (*STREET_CUES[10:17], "ave"), STREET_CUES[17:27], ("calle", "avda", "avenida", "plaza", "paseo", "camino"), ("rua ", "avenida", "travessa", "largo", "praça", "estrada"), tuple(c for c in STREET_CUES if "а" <= c[0] <= "я"), ("οδός", "οδό", "λεωφόρο", "πλατεία"))) if c in cs) for c in STREET_CUES}
_initial = re.compile(rf"({X[:-8]})\.{W}?(?:{X[:-8]}\.{W}?)?$")
_gap = re.compile(rf"{W}$")
_before_title = re.compile(rf"(?<!\w)(?:{TITLES})\.?{W}$", re.I)
_before_greeting = re.compile(rf"(?<!\w)(?:{GREETINGS}),?{W}$", re.I)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _around(text: str, places: list[int], lines: int) -> list[tuple[int, int]]:
    """The lines that hold the places, and so many before and after each, as stretches of the text that do not meet."""
    out: list[tuple[int, int]] = []
    for at in places:
        if out and at < out[-1][1] and not lines:
            continue
        lo = at
        for _ in range(lines + 1):
            lo = text.rfind("\n", 0, max(0, lo))
            if lo < 0:
                break
        hi = at
        for _ in range(lines + 1):
            hi = text.find("\n", hi + 1)
            if hi < 0:
                hi = len(text)
                break
        if out and lo + 1 <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo + 1, hi))
    return out


def _ids(s: str) -> list[str]:
    return list(dict.fromkeys(x for line in s.split("\n") for x in line.split("|")))


class Finder:
    """given, family: the known names; counts: see mojibake.model, None reads bodies as they stand."""

    def __init__(self, given: list[str], family: list[str], counts: dict[str, int] | None = None):
        self.speller = lookalikes.Speller(counts) if counts else None
        kinds: dict[str, set] = {}
        for cue in _ids(ID_CUES):
            kinds.setdefault(cue, set()).add("id")
        for cue in STREET_CUES:
            kinds.setdefault(cue, set()).add("street")
        for cue in ("@", "[at]", "(at)", "{at}", "[ at ]", "( at )", " dot ", "dot\n", "\ndot"):
            kinds.setdefault(cue, set()).add("at")
        for cue in ("http://", "https://", "www."):
            kinds.setdefault(cue, set()).add("url")
        for names, tag in ((given, "G"), (family, "F")):
            for n in names:
                if n:
                    kinds.setdefault(_lower(n), set()).add(tag)
        self.automaton = ahocorasick.Automaton()
        for cue, tags in kinds.items():
            self.automaton.add_word(cue, (cue, tags))
        self.automaton.make_automaton()

    def find(self, body: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of each item, offsets from 0 in the body as it stands."""
        if not body:
            return []
        if self.speller and not body.isascii() and (mojibake._ODD.search(body) or mojibake._LOST.search(body) or lookalikes._ANY.search(body)):
            fixed, _ = self.speller.repairer.repair(body)
            fixed = self.speller.spell(fixed)
            if fixed != body:
                read, start, end = _aligned(body, fixed)
                return [(k, start(a), max(start(a) + 1, end(b))) for k, a, b in self._find(read)]
        return self._find(body)

    def _find(self, text: str) -> list[tuple[str, int, int]]:
        low = _lower(text)
        n = len(text)
        mails: list[tuple[int, int]] = []
        ids: list[tuple[int, int]] = []
        streets: dict[int, list[int]] = {}
        parts: list[tuple[int, int, set]] = []
        urls: list[tuple[int, int]] = []
        spelled: list[int] = []
        worded: list[int] = []
        for end, (cue, tags) in self.automaton.iter(low):
            a, b = end - len(cue) + 1, end + 1
            if "at" in tags:
                if cue == "@":
                    m = _at_mail.match(text, a)
                    start = a
                    while start and (text[start - 1].isalnum() or text[start - 1] in "_.+%'-"):
                        start -= 1
                    while start < a and text[start] in ".'%+-":
                        start += 1
                    if m and start < a:
                        mails.append((start, m.end()))
                elif "dot" in cue:
                    worded.append(a)
                else:
                    spelled.append(a)
                continue
            if "url" in tags:
                m = _url.match(text, a)
                if m:
                    urls.append((a, m.end()))
                continue
            if "street" in tags:
                for k in _kinds_of[cue]:
                    streets.setdefault(k, []).append(a)
                if len(tags) == 1:
                    continue
            if (a and (low[a - 1].isalnum() or low[a - 1] == "_")) or (b < n and (low[b].isalnum() or low[b] == "_")):
                continue
            if "id" in tags:
                gap = _id_gap.match(text, b)
                at = gap.end() if gap else b
                m = _id_value.match(text, at)
                if m and 5 <= sum(map(str.isdigit, m.group(0))) <= 22 and at > b:
                    ids.append((at, at + len(m.group(0).rstrip("./-"))))
            if tags & {"G", "F"}:
                if (a and low[a - 1] in "-'’" and a > 1 and low[a - 2].isalnum()) or (b + 1 < n and low[b] in "-'’" and low[b + 1].isalnum()):
                    continue
                parts.append((a, b, tags))
        # the parsers of spelled mails and addresses read the lines around their anchors, as far as an item may wrap
        for lo, hi in _around(text, spelled, 0):
            mails += [m.span() for m in _spelled.finditer(text, lo, hi)]
        for lo, hi in _around(text, worded, WRAP):
            mails += [m.span() for m in _worded.finditer(text, lo, hi)]
        found = [("email", a, b) for a, b in mails]
        found += [("id_number", a, b) for a, b in ids]
        found += [("phone", *m.span()) for m in _phone.finditer(text) if 7 <= sum(map(str.isdigit, m.group(0))) <= 15]
        for k, places in streets.items():
            for lo, hi in _around(text, places, WRAP):
                found += [("address", *m.span()) for m in _streets[k].finditer(text, lo, hi)]
        taken = sorted([(a, b) for _, a, b in found] + urls)
        found += [("name", a, b) for a, b in self._names(text, parts, taken)]
        # an item that lies in another one, or in a URL, does not count; the longer one stays
        found = [x for x in found if not any(a <= x[1] < b for a, b in urls)]
        found.sort(key=lambda x: (x[1], -x[2]))
        out: list[tuple[str, int, int]] = []
        reach = 0
        for kind, a, b in found:
            if a >= reach:
                out.append((kind, a, b))
                reach = b
        return out

    @staticmethod
    def _names(text: str, parts: list[tuple[int, int, set]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        # longest part first where one name holds another
        reach, start, outer = -1, -1, []
        for p in sorted(parts, key=lambda p: (p[0], -p[1])):
            # what starts no later and ends no earlier holds it; only an equal span is no longer
            if p[1] > reach or (p[0], p[1]) == (start, reach):
                outer.append(p)
                start, reach = p[0], p[1]
        parts = outer
        parts = [p for p in parts if not any(a <= p[0] < b for a, b in taken)] if taken else parts
        at = {a: (b, tags) for a, b, tags in parts}
        out, reach = [], -1
        for a, b, tags in sorted(parts, key=lambda p: p[0]):
            if a < reach:
                continue
            word = text[a:b]
            upright = not word[0].islower()
            if "G" in tags:
                m = re.compile(rf"{W}(?:{X[:-8]}\.{W})?").match(text, b)
                nxt = at.get(m.end()) if m else None
                if nxt and "F" in nxt[1] and (upright or text[m.end()].islower()):
                    out.append((a, nxt[0]))
                    reach = nxt[0]
                    continue
                if not upright:
                    continue
                m = re.compile(rf"{W}{X[:-8]}\.(?!\w)").match(text, b)
                if m and not NOT_PERSONS.match(text, b):
                    out.append((a, m.end()))
                    reach = m.end()
                    continue
                before = text[max(0, a - 24) : a]
                if word.lower() in PLAIN_WORDS:
                    line_start = text.rfind("\n", 0, a) + 1
                    line_end = text.find("\n", b)
                    alone = text[line_start:a].strip(" >|-–—\t\r") == "" and text[b : line_end if line_end >= 0 else len(text)].strip(" ,.!\r") == ""
                    if not (alone or (_before_greeting.search(before) and re.match(r"\s*[,.;:!?)–-]", text[b:]) or _before_title.search(before))):
                        continue
                if NOT_PERSONS.match(text, b):
                    continue
                out.append((a, b))
                reach = b
                continue
            # a family name
            if upright:
                m = re.compile(rf",{W}").match(text, b)
                nxt = at.get(m.end()) if m else None
                if nxt and "G" in nxt[1]:
                    out.append((a, nxt[0]))
                    reach = nxt[0]
                    continue
            m = _initial.search(text, max(0, a - 10), a)
            if m and (m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in ".-'")):
                out.append((m.start(), b))
                reach = b
                continue
            if upright and _before_title.search(text[max(0, a - 16) : a]):
                out.append((a, b))
                reach = b
        return out

    def replace(self, body: str | None) -> str | None:
        """The body with each item replaced by [KIND]; null stays null."""
        if not body:
            return body
        out, at = [], 0
        for kind, a, b in self.find(body):
            out.append(body[at:a])
            out.append(f"[{kind.upper()}]")
            at = b
        return "".join([*out, body[at:]])


def _aligned(raw: str, fixed: str):
    """(text to read, map of a start, map of an end): lines of as many words are read as repaired, others raw.

    Inside a word a start is counted from the word's beginning, an end from its end.
    """
    old, new = raw.split("\n"), fixed.split("\n")
    if len(old) != len(new):
        return raw, lambda i: i, lambda i: i
    token = re.compile(r"\S+")
    spans: list[tuple[int, int, int, int]] = []
    lines: list[str] = []
    a_raw = a_read = 0
    for x, y in zip(old, new):
        xs, ys = [m.span() for m in token.finditer(x)], [m.span() for m in token.finditer(y)]
        if len(xs) != len(ys):
            y, ys = x, xs
        spans += [(c + a_read, d + a_read, a + a_raw, b + a_raw) for (a, b), (c, d) in zip(xs, ys)]
        lines.append(y)
        a_raw += len(x) + 1
        a_read += len(y) + 1
    firsts = [s[0] for s in spans]

    def start(i: int) -> int:
        c, _, a, b = spans[max(0, bisect_right(firsts, i) - 1)]
        return min(a + i - c, b - 1)

    def end(i: int) -> int:
        _, d, a, b = spans[max(0, bisect_right(firsts, i - 1) - 1)]
        return max(a + 1, b - (d - i))

    return "\n".join(lines), start, end


def names_of(names: DataFrame) -> tuple[list[str], list[str]]:
    """(given, family) of the name list, whose size is checked: the automaton holds at most MAX_NAMES names."""
    rows = names.where("name is not null").select("name", "kind").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names: split the list and search once for each part")
    return sorted(r["name"] for r in rows if r["kind"] != "family"), sorted(r["name"] for r in rows if r["kind"] == "family")


def _bodies(tables: dict[str, tuple[DataFrame, str]], text_col: str) -> DataFrame:
    out = None
    for name, (df, id_col) in tables.items():
        one = df.select(F.lit(name).alias("table_name"), F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("body"))
        out = one if out is None else out.unionByName(one)
    return out


def _mapped(rows: DataFrame, names: DataFrame, schema: str, per_batch) -> DataFrame:
    given, family = names_of(names)
    counts = mojibake.pair_counts(spread(rows.select("body")))
    shared = rows.sparkSession.sparkContext.broadcast((given, family, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*shared.value)
        for b in batches:
            yield per_batch(finder, b)

    return spread(rows).mapInArrow(run, schema)


def items(tables: dict[str, tuple[DataFrame, str]], names: DataFrame, text_col: str = "body_text") -> DataFrame:
    """(table_name, row_id, kind, start_pos) of every item; tables: name -> (table, id column).

    Null and empty bodies hold no item; repeated rows give repeated finds; a null id is kept as null.
    """

    def find(finder: Finder, b: pa.RecordBatch) -> pa.RecordBatch:
        out = [(t, i, kind, a + 1) for t, i, body in zip(*(b.column(k).to_pylist() for k in range(3))) for kind, a, _ in finder.find(body)]
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["table_name", "row_id", "kind", "start_pos"])

    return _mapped(_bodies(tables, text_col), names, "table_name string, row_id bigint, kind string, start_pos bigint", find)


def redacted(tables: dict[str, tuple[DataFrame, str]], names: DataFrame, text_col: str = "body_text") -> DataFrame:
    """(table_name, row_id, body): every body with typed placeholders, otherwise unchanged."""

    def change(finder: Finder, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([finder.replace(t) for t in b.column(2).to_pylist()], pa.string())], ["table_name", "row_id", "body"])

    return _mapped(_bodies(tables, text_col), names, "table_name string, row_id bigint, body string", change)


def _tables(spark, sf_dir: str) -> tuple[dict, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return {"emails": (read("emails"), "rec_id"), "triage_log": (read("triage_log"), "id")}, read("person_names")


def p7_found(spark, sf_dir: str) -> DataFrame:
    return items(*_tables(spark, sf_dir))


def p7_redacted(spark, sf_dir: str) -> DataFrame:
    return redacted(*_tables(spark, sf_dir))
