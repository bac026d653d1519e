"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, the
schemes of addresses, and cues of identifiers. From each anchor a local parser expands to the
boundaries of a candidate, and a validator keeps or drops it; a dropped candidate is passed over.

Kinds: email, ip, card (Luhn), phone; and by schemes and cues: url (an address with user
information, or one behind ``mailto:``), iban (mod 97), ssn, account (digits behind a
cue), secret (a token, key or password behind a cue). A plain web address is nobody's and stays.

Defined cases: a null or empty text has no spans, and a null text stays null when redacted; each row is treated by itself,
so repeated rows have equal results; very long texts take time in proportion to their length; spans of different kinds may overlap, and are redacted as one;
an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "account", "secret")
BASE = KINDS[:4]

# What stands before an identifier.
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "ssh://", "mailto:")
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "konto", "compte", "cuenta", "passport", "routing"),
    "secret": ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "access_key", "private_key", "bearer"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_AFTER_PLUS = re.compile(r"[0-9][\x20().0-9-]+[0-9]")
_ADDRESS = re.compile(r"[^\x00-\x20\"'<>`{}|\\^]+")
_BETWEEN = re.compile(r"[\x20\t]{0,3}(?:(?:no|nr|number|num|id|is)\b\.?[\x20\t]{0,3})?[\"']?[\x20\t]{0,3}(?:[:=#][\x20\t]{0,3})?[\"']?", re.I)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9A-Za-z])")
_OPAQUE = re.compile(r"[A-Za-z0-9_+/=.~-]+")


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", (1, "@"))
    found.add_word("+", (1, "+"))
    for d in "0123456789":
        found.add_word(d, (1, "0"))
    for s in SCHEMES:
        found.add_word(s, (len(s), "scheme"))
    for kind, cues in CUES.items():
        for c in cues:
            found.add_word(c, (len(c), kind))
    found.make_automaton()
    return found


_machine: list = []
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(text: str) -> str:
    """The text with schemes and cues in lower case, no character moved."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


class Run:
    """The stretch of a text that a pattern of single characters matched last: an anchor inside it ends where it does, so no text is read twice."""

    def __init__(self, text: str, pattern: re.Pattern):
        self.text, self.pattern = text, pattern
        self.start = self.end = -1

    def end_from(self, at: int) -> tuple[int, bool]:
        """Where the stretch that holds ``at`` ends (``at`` if none does), and whether that is a new one."""
        if self.start <= at < self.end:
            return self.end, False
        m = self.pattern.match(self.text, at)
        self.start, self.end = at, m.end() if m else at
        return self.end, True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _mod97(x: str) -> bool:
    x = x.replace(" ", "").upper()
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) in code points of each kind, in order of start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return found
    if not _machine:
        _machine.append(_automaton())
    size = len(text)
    email_end = dotted_end = grouped_end = phone_end = 0
    address, opaque = Run(text, _ADDRESS), Run(text, _OPAQUE)
    tail = slash = host_end = at_sign = digit = letter = -1
    dotted = False
    for last, (length, kind) in _machine[0].iter(folded(text)):
        at = last + 1 - length
        if kind == "0":
            if at >= dotted_end:
                m = _DOTTED.match(text, at)
                dotted_end = m.end()
                runs = m.group().split(".")
                if len(runs) >= 4:
                    s = at
                    for k in range(0, len(runs) - 3, 4):
                        e = s + sum(map(len, runs[k : k + 4])) + 3
                        if all(len(r.lstrip("0")) <= 3 and int(r) <= 255 for r in runs[k : k + 4]):
                            found["ip"].append((s, e))
                        s = e + 1
            if at >= grouped_end:
                m = _GROUPED.match(text, at)
                grouped_end = m.end()
                if grouped_end - at >= 16:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, grouped_end))
        elif kind == "@":
            s = at
            while s > email_end and text[s - 1] in _LOCAL:
                s -= 1
            if s < at and (m := _DOMAIN.match(text, at + 1)):
                found["email"].append((s, m.end()))
                email_end = m.end()
        elif kind == "+":
            if at >= phone_end and (m := _AFTER_PLUS.match(text, at + 1)):
                phone_end = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found["phone"].append((at, m.end()))
        elif kind == "scheme":
            e, new = address.end_from(last + 1)
            if new:  # closing punctuation of the stretch
                tail = e
                while tail > last + 1 and text[tail - 1] in ".,;:!?)]'":
                    tail -= 1
                slash = host_end = -1
            e = tail
            if e <= last + 1 or (found["url"] and at < found["url"][-1][1]):
                continue
            if slash < last + 1:
                slash = text.find("/", last + 1, e)
                slash = slash if slash >= 0 else e
            if host_end != slash:
                host_end, at_sign = slash, text.rfind("@", last + 1, slash)
                dotted = at_sign >= 0 and text.find(".", at_sign + 1, slash) >= 0
            if at_sign > last and dotted:
                found["url"].append((at, e))
        else:
            if at and (text[at - 1].isalnum()) or last + 1 < size and text[last + 1].isalnum():
                continue  # part of a longer word
            s = _BETWEEN.match(text, last + 1).end()
            if s == last + 1:
                continue
            if kind == "iban":
                m = _IBAN.match(text, s)
                while m and not _mod97(m.group()):
                    shorter = text.rfind(" ", s, m.end())
                    m = _IBAN.fullmatch(text, s, shorter) if shorter > s else None
            elif kind == "ssn":
                m = _SSN.match(text, s)
            elif kind == "account":
                m = _DIGITS.match(text, s)
            else:
                e, new = opaque.end_from(s)
                if new:  # the last digit and letter of the stretch
                    digit = next((i for i in range(e - 1, s - 1, -1) if "0" <= text[i] <= "9"), -1)
                    letter = next((i for i in range(e - 1, s - 1, -1) if text[i].isalpha()), -1)
                named = e - s >= 16 or re.search(r"[:=][\x20\t\"']*$", text[last + 1 : s])
                if e - s >= 8 and digit >= s and letter >= s and named and (not found[kind] or s >= found[kind][-1][1]):
                    found[kind].append((s, e))
                continue
            if m and (not found[kind] or m.start() >= found[kind][-1][1]):
                found[kind].append((m.start(), m.end()))
    return found


def listed(found: dict, kinds=KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def redact(text: str, found: dict) -> str:
    """Replace each stretch of overlapping spans by the name of its first kind, as in <EMAIL>."""
    spans = sorted((s, e, k) for k, v in found.items() for s, e in v)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        s, e, k = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][1])
            i += 1
        out += [text[at:s], f"<{k.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        found = [find(t) for t in texts]
        base = [listed(f, BASE) for f in found]
        yield pa.record_batch([
            b.column(0), *[pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE],
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([listed(f) for f in found], pa.string()),
        ], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    return docs.select("doc_id", "text").mapInArrow(_spans, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _redact(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else redact(t, find(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.names[at], pa.array(texts, pa.string()))

    return run


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the spans of all kinds replaced in text; the other columns as they were."""
    return docs.mapInArrow(_redact(docs.columns.index("text")), docs.schema)


op8 = spans

_REGEX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The base of the contract, by regular expressions over the whole text, for tests."""
    out = {}
    for kind, pattern in _REGEX.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out
