"""Problem 9: personal data in free text, found and replaced by typed placeholders.

Method: anchor expansion. One Aho-Corasick pass finds the anchors: at-signs and their spelled-out forms, schemes, digit
groups, identifier and account labels, street words, and the phrases names stand next to. Only lines with an anchor are looked
at again, by deterministic parsers that expand from the anchor to the item's boundaries and validate it (check digits of
accounts and cards, impossible parts of social security numbers). A name found next to a cue is then found wherever else the
text has it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.arrow import map_with_ids

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME, ACCOUNT = "email", "phone", "id_number", "address", "name", "account"
#: What ``found`` lists; ``redacted`` also replaces account and card numbers.
KINDS = (EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME)
_AT, _DIGITS, _LABEL, _STREET, _CUE = 1, 2, 4, 8, 16

# Cues and labels.
AT_SIGNS = ("@", "(at)", "[at]", "(AT)", "[AT]")
SCHEMES = ("tel:", "sms:", "callto:")
ACCOUNT_LABELS = ("iban", "credit card", "card number", "card no", "visa", "mastercard", "amex")
SSN_LABELS = ("ssn", "social security")
ID_LABELS = (
    "ssn", "social security", "passport", "steuer-id", "steuer id", "tax id", "national insurance", "nino",
    "driver licence", "driver license", "driving licence", "driver's license", "id card", "personal id",
)
STREET_WORDS = (
    "Street", " St.", " St,", "Road", " Rd", "Lane", " Ln", "Avenue", " Ave", "Boulevard", "Blvd", "Drive", " Court",
    " Square", " Terrace", " Way,", "Calle ", "Avenida ", "Via ", "Rua ", "straße", "strasse", "weg ", "platz ", "allee ",
    "gasse ", " Box ", "rue ", "chemin ", "boulevard ", "avenue ", "place ",
)
NAME_CUES = (
    "-by:", "-By:", "Author:", "author:", "Committer:", "committer:", "maintainer:", "Maintainer:", "Reporter:",
    "reporter:", "reviewer:", "Reviewer:", "assignee:", "owner:", "Cc:", "CC:", "idea by ", "Thanks to ", "thanks to ",
    "airing with ", "aired with ", " asked for this", "TODO(", "FIXME(", "(c) ", "(C) ", "© ", "User(", "|",
)
#: Phrases and titles that a name written in capitalised words follows.
PROSE_CUES = (
    "spoke with", "speak with", "talked to", "talked with", "met with", "meeting with", "worked with", "reported by", "suggested by",
    "written by", "approved by", "requested by", "reviewed by", "proposed by", "found by", "on behalf of", "please contact", "reach out to",
    "kind regards,", "best regards,",
)
HONORIFICS = ("Mr", "Mrs", "Ms", "Dr", "Prof")
SERVICE_MAILBOXES = (
    "no-reply", "noreply", "donotreply", "do-not-reply", "git", "svc", "root", "ci", "bot", "mailer-daemon", "postmaster",
    "webmaster", "hostmaster", "abuse", "support", "info", "admin", "notifications", "security", "help", "sales", "team",
)
FILE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "svg", "webp", "pdf", "zip", "json", "yaml", "html", "css", "scss", "tsx")
SERVICE_HOST_LABELS = ("bots", "bot", "lists", "list", "noreply", "users")

_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@")
_SEPARATORS = "\"'`\\,;:=\t[](){}<>"

_UP = r"[A-ZÀ-ÖØ-Þ]"
_PROPER = rf"{_UP}[\w'’\-]{{0,60}}"
_CITY = rf"{_PROPER}(?: {_PROPER}){{0,2}}"
_ZIP = r"(?:,? (?:[A-Z]{2} )?\d{5}(?:-\d{4})?\b)?"
_KIND = (
    r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Court|Ct\.?|Square|Sq\.?"
    r"|Terrace|Place|Way)"
)
_ADDRESSES = re.compile(
    "|".join((
        rf"(?:(?:Apt|Apartment|Suite|Unit|Flat)\.? \w{{1,6}}, )?\b\d{{1,5}}[A-Za-z]? (?:{_PROPER} ){{1,3}}?{_KIND}, {_CITY}{_ZIP}",
        rf"\bP\. ?O\. ?Box \d+, {_CITY}{_ZIP}",
        rf"\bPO Box \d+, {_CITY}{_ZIP}",
        rf"\b(?:Calle|Avenida|Via|Rua) {_PROPER}(?: {_PROPER}){{0,2}} \d+[A-Za-z]?, (?:\d{{5}} )?{_CITY}{_ZIP}",
        rf"\b{_UP}[\w\-]{{0,60}}?(?:straße|strasse|str\.|weg|platz|allee|gasse) \d+[A-Za-z]?, \d{{5}} {_CITY}",
        rf"\b\d+(?: bis| ter)?, (?:rue|avenue|boulevard|place|chemin) (?:de la |de |du |des |d'|l')?{_PROPER}(?:[ \-]{_PROPER}){{0,2}}, \d{{5}} {_CITY}",
    ))
)
_AT_SIGN = re.compile(r"@| ?[(\[](?:at|AT)[)\]] ?")
_HOST_PART = r"[^\W_](?:[\w\-]{0,62}[^\W_])?"
_HOST = re.compile(rf"{_HOST_PART}(?:(?:\.| ?[(\[](?:dot|DOT)[)\]] ?){_HOST_PART}){{1,20}}")
LONGEST_MAILBOX = 64
_PATH = re.compile(r"[~\w.\-]*/|[\w.\-]+\.git\b")
_DOT = re.compile(r" ?[(\[](?:dot|DOT)[)\]] ?")
_PHONE = re.compile(
    r"(?<![\w.+/\-])(?:"
    r"\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{1,4}){2,6}"
    r"|00\d{10,13}"
    r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}"
    r"|\d{3}([.\-])\d{3}\1\d{4}"
    r"|0\d{2,4} \d{3,4} \d{3,4}"
    r")(?![\w/\-]|\.\d)"
)
_LABELS = re.compile(
    r"(?i)(?<!\w)(?P<label>" + "|".join(re.escape(x) for x in sorted(ID_LABELS, key=len, reverse=True)) + r")"
    r"(?:\s+(?:no\.?|nr\.?|number|num\.?))?[\s:='\",]*"
    r"(?P<value>(?-i:[A-Z]{1,2}[ \-]?)?\d[\d \-]*(?:(?-i:[ \-]?[A-Z])\b)?)"
)
_WORD = r"[^\W\d_][^\W\d_'’.\-]*(?:['’.\-][^\W\d_'’.\-]+)*\.?"
_TEL = re.compile(r"(?i)(?<!\w)(?:tel|sms|callto):(?P<value>\+?\(?\d[\d().\-]{5,20}\d)(?!\w)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.+\-])\d{4}(?:[ \-]?\d{2,6}){2,4}(?![\w\-]|\.\d)")
_CAPITALISED = rf"{_UP}[\w'’\-]{{1,40}}(?: {_UP}\.)?(?: {_UP}[\w'’\-]{{1,40}}){{1,2}}"
_NAME = re.compile(rf"{_WORD}(?:(?:,? |~){_WORD}){{1,5}}$")
_SIGNED = re.compile(
    r"^\W*(?:[\w\-]+-[Bb]y|[Aa]uthor|[Cc]ommitter|[Mm]aintainer|[Cc][Cc]|[Rr]eviewer|[Rr]eporter|[Aa]ssignee|[Oo]wner): *"
    r"(?P<name>[^<>@\d]{1,120}?) <"
)
_NEXT_TO = (
    re.compile(r"\bReporter: *(?P<name>[^@<>\d+(]{1,120}?), *[+(\d]"),
    re.compile(r"\bidea by (?P<name>[^<>@\d]{1,120}?)\.?$"),
    re.compile(r"\b[Tt]hanks to (?P<name>[^<>@\d]{1,120}?) for\b"),
    re.compile(r"\b[Pp]air(?:ing|ed) with (?P<name>[^<>@\d]{1,120}?)\.?$"),
    re.compile(r"^\W*(?P<name>[^<>@\d]{1,120}?) asked for this\b"),
    re.compile(r"\b(?:TODO|FIXME)\((?P<name>[^()<>@\d]{1,120}?)\)"),
    re.compile(r"(?:\([cC]\)|©) (?:\d{4}(?:-\d{4})? )?(?P<name>[^<>@\d]{1,120}?)$"),
    re.compile(r"\bUser\(\s*['\"](?P<name>[^'\"<>@\d]{1,60}(?:'[^'\"<>@\d]{1,60})?)['\"]"),
    re.compile(r"\b(?:reviewer|author|assignee|owner|maintainer|reporter)['\"]?: *(?P<q>['\"])(?P<name>[^\"<>@\d]{1,120}?)(?P=q)"),
    re.compile(rf"\b(?i:{'|'.join(PROSE_CUES)}) (?P<name>{_CAPITALISED})"),
    re.compile(rf"\b(?:{'|'.join(HONORIFICS)})\.? (?P<name>{_CAPITALISED})"),
)


def _automaton():
    import ahocorasick

    kinds: dict[str, int] = {}

    def put(words, kind: int) -> None:
        for w in words:
            kinds[w] = kinds.get(w, 0) | kind

    put(AT_SIGNS, _AT)
    put((f"{a}{s}{b}" for a in "0123456789" for s in " .-" for b in "0123456789"), _DIGITS)
    put((f"{a}{s}{b}" for a in ") " for s in " (" for b in "0123456789"), _DIGITS)
    put((f"+{a}" for a in "0123456789"), _DIGITS)
    put((f"00{a}" for a in "123456789"), _DIGITS)
    put((v for w in ID_LABELS for v in (w, w.upper(), w.capitalize(), w.title())), _LABEL)
    put(("Steuer-ID", "Steuer-Id", "Tax ID"), _LABEL)
    put(STREET_WORDS, _STREET)
    put(NAME_CUES, _CUE)
    put((v for w in PROSE_CUES for v in (w + " ", w.capitalize() + " ")), _CUE)
    put((h + end for h in HONORIFICS for end in (" ", ". ")), _CUE)
    put((v for w in (*SCHEMES, *ACCOUNT_LABELS) for v in (w, w.upper(), w.capitalize(), w.title())), _DIGITS)
    found = ahocorasick.Automaton()
    for w, k in kinds.items():
        found.add_word(w, k)
    found.make_automaton()
    return found


def _mail_spans(line: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end of the mailbox, start of the host, end) of all that has the form of an address."""
    for m in _AT_SIGN.finditer(line):
        host = _HOST.match(line, m.end())
        if host is None:
            continue
        start, stop = m.start(), m.start()
        while start and (line[start - 1].isalnum() or line[start - 1] in "._+-") and stop - start <= LONGEST_MAILBOX:
            start -= 1
        while start < stop and not line[start].isalnum():
            start += 1
        if 0 < stop - start <= LONGEST_MAILBOX and line[stop - 1].isalnum():
            yield start, stop, host.start(), host.end()


def _emails(line: str) -> Iterator[tuple[int, int]]:
    for start, stop, host_at, end in _mail_spans(line):
        host = _DOT.sub(".", line[host_at:end]).lower()
        labels = host.split(".")
        if not labels[-1].isalpha() or len(labels[-1]) < 2 or labels[-1] in FILE_SUFFIXES:
            continue  # a version or a file name
        local = line[start:stop].lower()
        if local.split("+")[0] in SERVICE_MAILBOXES or local.endswith(("-list", "-bot", "[bot]")):
            continue
        if any(x in SERVICE_HOST_LABELS for x in labels[:-1]):
            continue
        before = line[start - 1 : start]
        if before in (":", "/"):
            word = line.rfind(" ", 0, start) + 1
            if before == ":" and line.find("://", word, start) >= 0:
                continue  # the password of an address with credentials
            if before == "/" and line.find("@", word, start) >= 0:
                continue  # a package name
        if before == "@":
            continue  # a package name
        if line[end : end + 1] == ":" and _PATH.match(line, end + 1):
            continue  # user@host:path
        yield start, end


def _phones(line: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(line):
        digits = sum(ch.isdigit() for ch in m.group())
        if 10 <= digits <= 15:
            yield m.start(), m.end()
    for m in _TEL.finditer(line):
        if 7 <= sum(ch.isdigit() for ch in m["value"]) <= 15:
            yield m.span("value")


def _iban_holds(text: str) -> bool:
    """The check digits of an account number: its number, letters as 10 to 35, leaves 1 by 97."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(ch, 36)) for ch in plain[4:] + plain[:4])) % 97 == 1


def _luhn_holds(digits: str) -> bool:
    """The check digit of a card number."""
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0 and len(set(digits)) > 1


def _accounts(line: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(line):
        if _iban_holds(m.group()):
            yield m.span()
    for m in _CARD.finditer(line):
        digits = "".join(ch for ch in m.group() if ch.isdigit())
        if 13 <= len(digits) <= 19 and digits[0] in "3456" and _luhn_holds(digits):
            yield m.span()


def _ids(line: str) -> Iterator[tuple[int, int]]:
    for m in _LABELS.finditer(line):
        value = m["value"].rstrip(" -")
        if m["label"].lower() in SSN_LABELS and any(set(part) == {"0"} for part in re.split(r"[ \-]", value)):
            continue  # no part of such a number is zero
        if 7 <= sum(ch.isalnum() for ch in value) <= 16:
            yield m.start("value"), m.start("value") + len(value)


def _apart(found: Iterator[tuple[int, int]], line: str) -> Iterator[tuple[int, int]]:
    """Those that begin and end at a separator or an end of the line."""
    for a, b in found:
        if (a == 0 or line[a - 1] in _SEPARATORS) and (b == len(line) or line[b] in _SEPARATORS):
            yield a, b


def _is_name(text: str) -> bool:
    return 3 < len(text) <= 80 and bool(_NAME.match(text))


def _names(line: str) -> Iterator[tuple[int, int]]:
    m = _SIGNED.match(line)
    if m and _is_name(m["name"]):
        yield m.span("name")
        return
    if "|" in line:
        cells = line.split("|")
        if len(cells) > 2 and next(_mail_spans(line), None):
            at = 0
            for c in cells:
                word = c.strip("+- \t\"'")
                if _is_name(word) and not _ADDRESSES.search(c):
                    start = at + c.index(word)
                    yield start, start + len(word)
                at += len(c) + 1
            return
    for p in _NEXT_TO:
        for m in p.finditer(line):
            if _is_name(m["name"]):
                yield m.span("name")


class Finder:
    """Finds personal data; one per task, since the automaton is built once."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type), in order and without overlaps: identifiers first, then addresses, phones, mail, names."""
        lines: dict[int, int] = {}
        start, stop = -1, -1
        for end, kind in self.anchors.iter(text):
            if end >= stop:
                start = text.rfind("\n", 0, end) + 1
                stop = text.find("\n", end)
                stop = len(text) if stop < 0 else stop
            lines[start] = lines.get(start, 0) | kind
        out: list[tuple[int, int, str]] = []
        for start, kinds in lines.items():
            if m := _HUNK.match(text, start):  # the text behind a hunk's header
                start = m.end()
            stop = text.find("\n", start)
            line = text[start : len(text) if stop < 0 else stop].rstrip("\r")
            if line[:1] in ("+", "-") and not line[1:2].isdigit():
                start, line = start + 1, line[1:]
            # In encoded data and other lines without a space, numbers must stand between separators.
            dense = len(line) > 50 and " " not in line and "|" not in line and "@" not in line
            taken: list[tuple[int, int]] = []

            def take(found: Iterator[tuple[int, int]], kind: str, start=start, taken=taken) -> None:
                for a, b in found:
                    i = bisect_left(taken, (a, b))
                    if (i == len(taken) or b <= taken[i][0]) and (i == 0 or taken[i - 1][1] <= a):
                        taken.insert(i, (a, b))
                        out.append((start + a, start + b, kind))

            if kinds & _LABEL:
                take(_apart(_ids(line), line) if dense else _ids(line), ID_NUMBER)
            if kinds & _STREET:
                take((m.span() for m in _ADDRESSES.finditer(line)), ADDRESS)
            if kinds & _DIGITS:
                take(_accounts(line), ACCOUNT)
                take(_apart(_phones(line), line) if dense else _phones(line), PHONE)
            if kinds & _AT:
                take(_emails(line), EMAIL)
            if kinds & _CUE:
                take(_names(line), NAME)
        out.sort()
        return self._repeated(text, out)

    def _repeated(self, text: str, out: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """With the further places of the names that stand next to a cue somewhere."""
        names = {text[a:b] for a, b, kind in out if kind == NAME}
        more = []
        for m in re.finditer("|".join(map(re.escape, sorted(names, key=len, reverse=True))), text) if names else ():
            a, b = m.span()
            i = bisect_left(out, (a, b))
            free = (i == len(out) or b <= out[i][0]) and (i == 0 or out[i - 1][1] <= a)
            if free and not text[a - 1 : a].isalnum() and not text[b : b + 1].isalnum():
                more.append((a, b, NAME))
        return sorted(out + more) if more else out


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").filter(F.length("text") > 0)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, pii_text): each distinct piece of personal data of a document, as written there.

    NULL and empty texts have none; a document row that is repeated is reported once.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for pdf in batches:
            rows = [
                (d, k, x)
                for d, t in zip(pdf["doc_id"], pdf["text"])
                for k, x in sorted({(k, t[a:b]) for a, b, k in finder.spans(t) if k in KINDS})
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "pii_text"])

    schema = "pii_type string, pii_text string"
    return map_with_ids(_texts(documents), {"doc_id": kind}, ("text",), search, schema).distinct()


def redact_text(finder: Finder, text: str) -> str:
    out, at = [], 0
    for a, b, kind in finder.spans(text):
        out += (text[at:a], f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text, n_replaced): every document with typed placeholders; NULL stays NULL, all else stays as it is."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                spans = finder.spans(t) if t else []
                rows.append((d, redact_text(finder, t) if spans else t, len(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_replaced"])

    return map_with_ids(documents, {"doc_id": kind}, ("text",), replace, "text string, n_replaced int")
