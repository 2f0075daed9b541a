"""Problem 5: only what the sender newly wrote.

A recursive layout grammar over the lines of a mail:

    message    := block*
    block      := quoted | forward | signature | notice | text
    quoted     := intro? (prefix message)+         the prefix is stripped and the rest parsed again
    forward    := delimiter? header+ message$       a forwarded message reaches to the end of its level
    signature  := (signoff | "--") contact* device? | device | dash-name
    notice     := a paragraph of any length with two or more cues of a legal or confidentiality notice, and a
                  cue for every CUE_SPAN characters
    text       := any other line: newly written

The tree is built by recursive descent; serialising the text nodes of the top level gives the new text,
the other nodes' lines are what p5_found reports. Lines are judged in their consistent spelling, so that
look-alike or garbled characters do not hide a header.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread
from . import lookalikes, mojibake

# Formulas of the corpus' languages and their common variants.
SIGNOFFS = """kind regards|regards|best regards|warm regards|br|thanks|many thanks|many thanks and best|thank you|thanks and regards|cheers|best|best wishes|all the best|yours sincerely|sincerely|yours truly|yours faithfully|yours|take care
à bientôt|cordialement|bien cordialement|bien à vous|salutations|sincères salutations|meilleures salutations|merci|merci d'avance|amicalement
viele grüße|beste grüße|mit freundlichen grüßen|freundliche grüße|schöne grüße|liebe grüße|herzliche grüße|mfg|vielen dank|danke|hochachtungsvoll
saludos|saludos cordiales|un saludo|un cordial saludo|atentamente|un abrazo|gracias|muchas gracias
atenciosamente|cumprimentos|com os melhores cumprimentos|um abraço|abraços|obrigado|obrigada|saudações
с уважением|всего доброго|спасибо|с наилучшими пожеланиями|до свидания|заранее спасибо|искренне ваш
με εκτίμηση|ευχαριστώ|φιλικά|χαιρετισμούς|με φιλικούς χαιρετισμούς|σας ευχαριστώ"""
HEADER_KEYS = """from|sent|to|cc|bcc|date|subject|reply-to
de|envoyé|à|objet|date|cc
von|gesendet|an|betreff|datum
de|enviado|enviado el|para|asunto|fecha
de|enviada|enviada em|enviado|para|assunto|data
от|отправлено|кому|тема|дата|копия
από|στάλθηκε|προς|θέμα|ημερομηνία|εστάλη|απεστάλη"""
FORWARD_MARKS = """forwarded message|original message|begin forwarded message|message d'origine|message original|message transféré|ursprüngliche nachricht|originalnachricht|weitergeleitete nachricht|mensaje original|mensaje reenviado|mensagem original|mensagem encaminhada|исходное сообщение|пересылаемое сообщение|пересланное сообщение|αρχικό μήνυμα|προωθημένο μήνυμα"""
DEVICE = """sent from|get the .{1,30} app|sent via|sent with
envoyé de|envoyé depuis|envoyé à partir
von meinem .{1,30} gesendet|gesendet von|von unterwegs gesendet
enviado desde|enviado con
enviado do|enviado a partir do|enviado pelo
отправлено с|отправлено из
στάλθηκε από|εστάλη από|απεστάλη από"""
NOTICE_CUES = """confidential|privileged|named reader|addressee|intended|recipient|in error|delete it|takes no liability|liability|views in this mail|binds|signed by an officer|monitored|company rules|contents are private|any copy, use|without leave|barred|disclaimer|think of the trees|attachments are meant
confidentiel|destinés à|destinataire|en cas d'erreur|détruisez|pièces jointes sont
vertraulich|den empfänger bestimmt|nicht gemeint|löschen sie|falls sie
confidencial|dirigido solo|su destinatario|por error|bórrelo|avise a
confidencial|destinatário|por engano|apague-a|avise a
закрытые сведения|только адресату|по ошибке|удалите его|предназначено|конфиденциал
εμπιστευτικ|παραλήπτη|κατά λάθος|διαγράψτε|προορίζεται|διαγράψ"""
CUE_SPAN = 450  # of characters; mail that only touches on such matters holds fewer cues
QUOTE_VERBS = "wrote|said|schrieb|a écrit|escribió|escreveu|пишет|написала?|έγραψε"

_split = lambda s: [x for part in s.split("\n") for x in part.split("|") if x]
_signoffs = frozenset(_split(SIGNOFFS))
_headers = frozenset(_split(HEADER_KEYS))
_forward = re.compile(r"^[-_=* ]{3,}\s*(?:%s)\s*[-_=*: ]*$|^[_=]{10,}$|^-{20,}$|^(?:begin forwarded message|%s):?$" % (("|".join(_split(FORWARD_MARKS)),) * 2), re.I)
_device = re.compile(r"^(?:%s)\b.{0,60}$" % "|".join(_split(DEVICE)), re.I)
_cues = tuple(dict.fromkeys(_split(NOTICE_CUES)))
_prefix = re.compile(r"^\s{0,8}[>|]")
_strip = re.compile(r"^\s{0,8}[>|] ?")
_delimiter = re.compile(r"^--\s*$")
_header = re.compile(r"^\s*\*?([^\W\d_][\w -]{0,16}?) ?\*?:(?:\s|$)")
_person = r"[^\W\d_a-zа-яα-ω][\w'’.-]*(?:\s+(?:(?:de|van|von|da|du|der|del)\s+)?[^\W\d_a-zа-яα-ω][\w'’.-]*){0,3}"
_mail = r"<[^<>\s]+@[^<>\s]+>"
_day = r"[^<>@\n]{0,60}?\d[^<>@\n]{0,60}?"
_intros = [re.compile(x) for x in (
    rf"^(?:On|Am|Le|El|Em|Στις|Στην) {_day}[,\s]\s*(?:schrieb )?{_person}(?:\s*{_mail})?\s*(?:wrote|a écrit|escribió|escreveu|έγραψε)?\s?:$",
    rf"^{_person}(?:\s*{_mail})? (?:said|wrote|schrieb|a écrit|escribió|escreveu|пишет|написала?|έγραψε)(?: (?:on|am|le|el|em)? ?{_day})?\s?:$",
    rf"^(?:Quoting|Zitat von|Citation de|Citando a|Цитирую) {_person}(?:\s*{_mail})?\s?:$",
    rf"^{_day} (?:пользователь |ο χρήστης |η χρήστης )?{_person}(?:\s*{_mail})? (?:написала?|пишет|έγραψε)(?: \S+)?\s?:$",
    rf"^(?:Στις|Στην) {_day},? (?:ο|η)(?: χρήστης)? {_person}(?:\s*{_mail})? έγραψε\s?:$",
)]
_contact = re.compile(r"@|www\.|https?://|^\s*(?:t|tel|tél|phone|mobile|direct|fax|telefon|тел|τηλ)\b|\||\d{3}|^head of |^the .+ team$| ltd\b| works$", re.I)
_name = re.compile(rf"^{_person}$")
_dash_name = re.compile(rf"^[-–—] ?{_person}$")


@dataclass
class Node:
    kind: str  # text, quoted, intro, forward, signature, notice, blank
    lines: list[int]  # numbers in the mail, from 1
    inner: list[Node] = field(default_factory=list)


def _is_signoff(line: str) -> bool:
    s = line.strip()
    if len(s) > 45:
        return False
    s = s.rstrip(" ,.!;:").lower()
    if "�" in s:  # lost characters stand for one letter each, or two
        lost = re.compile(".{1,2}".join(map(re.escape, re.split("�+", s))))
        return any(lost.fullmatch(x) for x in _signoffs)
    return s in _signoffs


def _is_header(line: str) -> bool:
    m = _header.match(line)
    return bool(m) and m.group(1).strip().lower() in _headers


def _intro(lines: list[str], i: int) -> int:
    """How many lines from i on introduce a quotation: 0 to 3."""
    text = ""
    for n in range(1, 4):
        if i + n > len(lines) or (n > 1 and (not lines[i + n - 1].strip() or _prefix.match(lines[i + n - 1]))):
            return 0
        text = f"{text} {lines[i + n - 1].strip()}".strip()
        if text.endswith(":") and any(p.match(text) for p in _intros):
            return n
        if text.endswith(":") or n == 1 and not re.match(r"(?:On|Am|Le|El|Em|Στις|Στην|Quoting|Zitat|Citation|Citando|\d)\b|[^\W\d_a-zа-яα-ω]", text):
            return 0
    return 0


def _looks_signed(line: str) -> bool:
    """A line that may follow a sign-off: a name, a team, a place or a way to reach someone."""
    s = line.strip()
    return len(s) <= 90 and bool(_contact.search(s) or _name.match(s))


def parse(lines: list[str], numbers: list[int], top: bool = True) -> list[Node]:
    """The layout tree of one nesting level; numbers: the lines' numbers in the mail."""
    out: list[Node] = []
    i, n = 0, len(lines)
    state, seen = "text", False  # state: text, or signature until its paragraph ends

    def add(kind: str, count: int, inner: list[Node] | None = None) -> None:
        nonlocal i
        if out and out[-1].kind == kind and not inner and kind in ("text", "signature", "notice", "forward"):
            out[-1].lines.extend(numbers[i : i + count])
        else:
            out.append(Node(kind, numbers[i : i + count], inner or []))
        i += count

    while i < n:
        line = lines[i]
        s = line.strip()
        if not s:
            if state == "signature" and i + 1 < n:
                state = "after"
            add("blank", 1)
            continue
        if _prefix.match(line):
            j = i
            while j < n and _prefix.match(lines[j]):
                j += 1
            inner = parse([_strip.sub("", x) for x in lines[i:j]], numbers[i:j], False)
            add("quoted", j - i, inner)
            state = "text"
            continue
        k = _intro(lines, i)
        if k:
            add("intro", k)
            state = "text"
            continue
        mark = bool(_forward.match(s))
        if mark or _is_header(line):
            j = i + mark
            while mark and j < n and not lines[j].strip():
                j += 1
            h = j
            while h < n and lines[h].strip() and (_is_header(lines[h]) or h > j and lines[h][0] in " \t"):
                h += 1
            # an edited header block may have lost a line or two
            keys = sum(_is_header(x) for x in lines[j : j + 5])
            if (mark and keys >= 2) or (h - j >= 1 and keys >= 2) or (mark and re.search(r"[^\W\d_]", s)):
                out.append(Node("forward", numbers[i:], parse(lines[h:], numbers[h:], False)))
                return out
        if _delimiter.match(line) and seen:
            add("signature", 1)
            state = "signature"
            continue
        if state == "signature":
            add("signature", 1)
            continue
        start = i == 0 or not lines[i - 1].strip() or (out and out[-1].kind != "text")
        if start:
            j = i
            while j < n and lines[j].strip() and not _prefix.match(lines[j]):
                j += 1
            para = " ".join(x.strip() for x in lines[i:j])
            low = para.lower()
            cues = [c for c in _cues if c in low]
            if len(cues) >= 2 and sum(map(low.count, cues)) * CUE_SPAN >= len(low):
                add("notice", j - i)
                state = "after"
                continue
        if _device.match(s) and len(s) <= 70 and s[0].isupper() and ". " not in s and start:
            add("signature", 1)
            state = "after"
            continue
        if _is_signoff(line) and seen and (i + 1 >= n or not lines[i + 1].strip() or _looks_signed(lines[i + 1])):
            add("signature", 1)
            state = "signature"
            if i < n and not lines[i].strip() and i + 1 < n and _looks_signed(lines[i + 1]) and len(lines[i + 1].strip()) <= 40 and _name.match(lines[i + 1].strip()):
                add("blank", 1)
            continue
        if seen and _dash_name.match(s) and (i + 1 >= n or not lines[i + 1].strip()):
            add("signature", 1)
            state = "signature"
            continue
        if state == "after" and _contact.search(s) and len(s) <= 60 and not re.search(r"[.!?]$", s):
            add("signature", 1)
            state = "signature"
            continue
        seen = True
        state = "text"
        add("text", 1)
    return out


class Reader:
    """counts: see mojibake.model; None judges lines as they stand."""

    def __init__(self, counts: dict[str, int] | None = None):
        self.speller = lookalikes.Speller(counts) if counts else None

    def tree(self, body: str) -> list[Node]:
        lines = [x.rstrip("\r") for x in body.split("\n")]
        if self.speller and not body.isascii():
            fixed = body
            if mojibake._ODD.search(body):
                fixed, _ = self.speller.repairer.repair(body)
            if lookalikes._ANY.search(fixed):
                fixed = self.speller.spell(fixed)
            again = [x.rstrip("\r") for x in fixed.split("\n")]
            if len(again) == len(lines):
                lines = again
        return parse(lines, list(range(1, len(lines) + 1)))

    def old_lines(self, body: str | None) -> list[int]:
        """Numbers of the lines that are neither blank nor newly written."""
        if not body:
            return []
        raw = body.split("\n")
        return [k for node in self.tree(body) if node.kind not in ("text", "blank") for k in node.lines if raw[k - 1].rstrip("\r").strip()]

    def new_text(self, body: str | None) -> str | None:
        """The newly written lines, blank lines between them kept single; null stays null, empty stays empty."""
        if not body:
            return body
        raw = body.split("\n")
        old = set(self.old_lines(body))
        kept = [x.rstrip("\r") for k, x in enumerate(raw, 1) if k not in old]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")


def _mapped(emails: DataFrame, schema: str, per_row) -> DataFrame:
    shared = emails.sparkSession.sparkContext.broadcast(mojibake.model(emails))
    rows = spread(emails.select("rec_id", "body_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            yield per_row(reader, b.column(0).to_pylist(), b.column(1).to_pylist())

    return rows.mapInArrow(run, schema)


def old_lines(emails: DataFrame) -> DataFrame:
    """(rec_id, line_no): lines that are neither blank nor new. Null and empty bodies give none."""

    def rows(reader: Reader, ids: list, bodies: list) -> pa.RecordBatch:
        found = [(i, k) for i, t in zip(ids, bodies) for k in reader.old_lines(t)]
        cols = list(zip(*found)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], ["rec_id", "line_no"])

    return _mapped(emails, "rec_id bigint, line_no bigint", rows)


def new_texts(emails: DataFrame) -> DataFrame:
    """(rec_id, new_text): every mail, with only its sender's new text; null for null bodies."""

    def rows(reader: Reader, ids: list, bodies: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([reader.new_text(t) for t in bodies], pa.string())], ["rec_id", "new_text"])

    return _mapped(emails, "rec_id bigint, new_text string", rows)


def p5_found(spark, sf_dir: str) -> DataFrame:
    return old_lines(spark.read.parquet(f"{sf_dir}/emails.parquet"))


def p5_new_text(spark, sf_dir: str) -> DataFrame:
    return new_texts(spark.read.parquet(f"{sf_dir}/emails.parquet"))
