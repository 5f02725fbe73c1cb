"""Personal data: base formats, and further spans that boosted trees pick from high-recall candidates.

Base kinds (email, ip, card, phone) are formats with a check each; they always
stay. Beside them, generators propose overlapping candidate spans of the
kinds of EXTRA; boosted trees judge each candidate by its format (length,
character classes, entropy, checksums) and its context (key words, assignment
signs and quotes before it), and a threshold, calibrated on held-out cases for
a precision, selects. Of selected spans one that lies in another of its kind goes, of
others that overlap the surest stays, and none overlaps a base span.

No labelled personal data exists in the tables, so the trees are trained here
on seeded, generated cases (see training_cases). They are fitted once on the
driver and sent with the tasks (some 100 KB).

One narrow pass; only texts with a digit, an @ or an assignment sign (= or :)
are looked at, as every kind needs one. A secret's run has no longest length.
Offsets are code points, ends exclusive.

What is never proposed: secrets of under 16 characters that no key word with an
assignment sign (or "is") announces, and announced ones of under 6; other names,
addresses and dates. National ids (of five countries) and phones without a country
code are proposed in any text, but mostly selected only after a key word, as their
digits alone look like any other number.

Defined results: null and empty texts have no spans; of equally sure candidates
the one proposed first stays; repeated rows are each searched. Work is linear in
the text, but for sorting its candidates.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .common import append_columns, row_sums, utf8

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "iban", "national_id", "local_phone")
KINDS = (*BASE, *EXTRA)

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), kind by kind leftmost and without overlap."""
    out: list[tuple[int, int, str]] = []
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


#: Proposals for each further kind; they overlap freely. Those of _DOTTED and _ASSIGNED come to them.
_PROPOSE = {
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:[\x20]?[A-Za-z0-9]{4}){2,7}(?:[\x20]?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_id": re.compile(
        r"(?<![0-9A-Za-z-])(?:[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}|[0-9]{8}[-\x20]?[A-Za-z]|[A-Za-z]{2}(?:[\x20]?[0-9]{2}){3}[\x20]?[A-Da-d]"
        r"|[12](?:[\x20]?[0-9]{2}){2}[\x20]?[0-9][0-9AB](?:[\x20]?[0-9]{3}){2}(?:[\x20]?[0-9]{2})?|[0-9]{2}(?:[\x20]?[0-9]{3}){3})(?![0-9A-Za-z-])"
    ),
    "local_phone": re.compile(r"(?<![0-9A-Za-z+])\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3}[\x20./-]?[0-9]{3,5}(?![0-9A-Za-z])"),
}
#: Key parts joined by dots, as signed tokens have them.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{4,}+(?:\.[A-Za-z0-9_+/-]{4,}+)++={0,2}")
#: A value that a key word announces: any characters but blanks and quotes.
_ASSIGNED = re.compile(
    r"(?i)(?:token|secret|passw|passphrase|pwd|api[_ -]?key|auth|bearer|credential|private[_ -]?key|access[_ -]?key|contrase[nñ]a|mot\x20de\x20passe|kennwort)"
    r"[A-Za-z_]{0,12}[\"'`]?[\x20\t]{0,2}(?:[=:]|\b(?:is|es|est|ist)\b)[\x20\t]{0,2}[\"'`]?([^\s\"'`]{6,}+)"
)
#: Words that announce each kind.
_KEYS = {
    "secret": re.compile(r"(?i)token|secret|passw|passphrase|pwd|api[_ -]?key|auth|bearer|credential|private[_ -]?key|access[_ -]?key|contrase[nñ]a|mot de passe|kennwort"),
    "iban": re.compile(r"(?i)iban|account|konto|cuenta|compte|bank"),
    "national_id": re.compile(r"(?i)ssn|social security|national id|national insurance|nino\b|tax id|steuer|dni\b|nif\b|insee|s[eé]curit[eé] sociale|identi(?:ty|dad)"),
    "local_phone": re.compile(r"(?i)phone|tel\b|tel[.:]|call|mobile|fax|cell|telefon|teléfono|téléphone"),
}
#: What a secret's run may hold before its first digit.
_UNDIGITED = re.compile(r"[A-Za-z_+/=-]*+")
_PASSWORD = re.compile(r"(?i)passw|passphrase|pwd|contrase[nñ]a|mot de passe|kennwort")
_LOWER_RUN = re.compile(r"[a-zà-ÿ]+")
_VOWELS = frozenset("aeiouAEIOU")
_HEX = frozenset("0123456789abcdefABCDEF")


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def national_ok(s: str) -> bool:
    """Whether a check letter or check number fits."""
    s = s.replace(" ", "").replace("-", "").upper()
    if len(s) == 9 and s[:8].isdigit():
        return s[8] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23]
    if len(s) == 15:
        body = s[:13].replace("2A", "19").replace("2B", "18")
        return body.isdigit() and s[13:].isdigit() and 97 - int(body) % 97 == int(s[13:])
    if len(s) == 11 and s.isdigit():
        rest = 10
        for c in s[:10]:
            rest = (rest + int(c)) % 10 or 10
            rest = rest * 2 % 11
        return (11 - rest) % 10 == int(s[10])
    return False


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate span."""
    s = text[start:end]
    n = len(s)
    before, after = text[max(0, start - 32) : start], text[end : end + 2]
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    digit = sum(v for c, v in counts.items() if "0" <= c <= "9")
    upper = sum(v for c, v in counts.items() if "A" <= c <= "Z")
    lower = sum(v for c, v in counts.items() if "a" <= c <= "z")
    turns = sum(("0" <= a <= "9") != ("0" <= b <= "9") for a, b in zip(s, s[1:]))
    tail = before.rstrip(" \"'`")
    run = max((m.end() - m.start() for m in _LOWER_RUN.finditer(s[:64])), default=0)
    return [
        n, digit / n, upper / n, lower / n, (n - digit - upper - lower) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()), len(counts) / min(n, 64), turns / n,
        sum(v for c, v in counts.items() if c in _VOWELS) / n, float(all(c in _HEX for c in counts)),
        float(bool(_KEYS[kind].search(before))), float(tail[-1:] in ("=", ":")), float(before[-1:] in ('"', "'", "`")), float(after[:1] in ('"', "'", "`")),
        float(kind == "iban" and iban_ok(s)), float(digit >= 13 and luhn(_digits(s))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(s[:1] == "0"),
        run / min(n, 64), float(bool(_PASSWORD.search(before))), float(n >= 6 and s[:1].isupper() and s[1:].islower()), sum(not c.isalnum() for c in counts), float(kind == "national_id" and national_ok(s)), float(KINDS.index(kind)),
    ]


def assigned(text: str, start: int, kind: str) -> bool:
    """Whether a key word and an assignment sign are before the span."""
    before = text[max(0, start - 32) : start]
    return before.rstrip(" \"'`")[-1:] in ("=", ":") and bool(_KEYS[kind].search(before))


class Taken:
    """Places that spans have taken, as disjoint intervals in order, so that a look-up is a bisection."""

    def __init__(self, spans: list[tuple[int, int, str]] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        """Takes a span that overlaps none."""
        k = bisect.bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Proposed spans of all further kinds that overlap no taken span; a secret without a digit must be assigned to a key word."""
    out, places = [], Taken(taken)
    for kind, rx in _PROPOSE.items():
        stop = -1
        for m in rx.finditer(text):
            if kind == "secret":
                if stop < m.start():  # else the last scan has passed this start
                    stop = _UNDIGITED.match(text, m.start()).end()
                if not ("0" <= text[stop : stop + 1] <= "9" or assigned(text, m.start(), kind)):
                    continue
            if not places.overlaps(m.start(), m.end()):
                out.append((m.start(), m.end(), kind))
    more = [(m.start(), m.end(), "secret") for m in _DOTTED.finditer(text) if m.end() - m.start() >= 20]
    for m in _ASSIGNED.finditer(text):
        start, end = m.span(1)
        bare = start + len(text[start:end].rstrip(".,;:"))  # these end a clause, others may belong to a password
        more += [(start, e, "secret") for e in {bare, start + len(text[start:bare].rstrip("!?)]}>*"))} if e - start >= 6]
    known = set(out)
    for c in sorted(set(more)):
        if c not in known and not places.overlaps(c[0], c[1]):
            out.append(c)
    return out


def training_cases(seed: int = 7, n: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in generated snippets, half of them personal data or secrets."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word() -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(2, 9)))

    def draw(alphabet: str, size: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(size))

    digits, hexes = "0123456789", "0123456789abcdef"

    def valid_iban() -> str:
        country, body = r.choice(["DE", "FR", "ES", "GB", "NL"]), draw(digits, 18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    def secret() -> str:
        s = r.choice([draw(hexes, r.choice([32, 40, 64])), draw(letters + letters.upper() + digits, r.randint(20, 64)), r.choice(["sk-", "ghp_", "key-"]) + draw(letters + digits, 32)])
        return s.upper() if r.random() < 0.2 else s

    def announced(key: str) -> str:
        return r.choice([f'{key} = "', f"{key}='", f"{key}: ", f"{key}=", f"{key} is ", f'"{key}": "'])

    positive = [
        lambda: (announced(r.choice(["token", "TOKEN", "api_key", "secret", "password", "access key", "auth"])), secret(), '"'),
        lambda: ("", secret(), " "),
        lambda: (announced(r.choice(["IBAN", "iban", "account"])) if r.random() < 0.6 else " ", valid_iban(), " "),
        lambda: (announced(r.choice(["SSN", "ssn", "social security number"])), f"{draw(digits, 3)}-{draw(digits, 2)}-{draw(digits, 4)}", " "),
        lambda: (announced(r.choice(["phone", "Tel.", "call", "mobile", "Telefon"])), r.choice([f"({draw(digits, 3)}) {draw(digits, 3)}-{draw(digits, 4)}", f"0{draw(digits, 3)} {draw(digits, 3)} {draw(digits, 4)}"]), "."),
    ]
    negative = [
        lambda: ("", "-".join(word() for _ in range(r.randint(3, 6))) + r.choice(digits), " "),
        lambda: ("", "/".join(word() for _ in range(r.randint(3, 6))) + "/" + draw(digits, r.randint(1, 4)), " "),
        lambda: ("", draw(digits, r.randint(16, 24)), " "),
        lambda: ("", word() * r.randint(4, 6) + r.choice(digits), " "),
        lambda: (r.choice(["version ", "id ", "in ", "", "page "]), f"{draw(digits, 3)}-{draw(digits, 2)}-{draw(digits, 4)}", " "),
        lambda: (r.choice(["from ", "about ", "sum ", ""]), f"{draw(digits, 3)} {draw(digits, 3)} {draw(digits, 4)}", " "),
        lambda: ("", f"{draw(letters, 2).upper()}{draw(digits, 2)}{draw(digits, 18)}", " "),
        lambda: ("", f"{draw(letters, 2)}{draw(digits, 2)} {word()[:4]:x<4} {word()[:4]:x<4} {word()[:4]:x<4}", " "),
        lambda: (r.choice(["token ", "secret ", "key "]), "_".join(word() for _ in range(r.randint(3, 5))) + "_1", " "),
    ]
    keys = ["token", "TOKEN", "api_key", "secret", "password", "access key", "auth"]

    def spoken() -> str:
        return "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "t"]) for _ in range(r.randint(2, 4)))

    #: Without a digit, after a key word and an assignment sign.
    letters_only = [
        lambda: (announced(r.choice(keys)), draw(letters, r.randint(16, 64)), r.choice(" \"")),
        lambda: (announced(r.choice(keys)), draw(letters + letters.upper() + r.choice(["", "+/"]), r.randint(20, 64)), r.choice(" \"")),
        lambda: (announced(r.choice(keys)), draw(letters + letters.upper(), r.randint(64, 900)) + r.choice(["", "=", "=="]), " "),
    ]
    words_only = [
        lambda: (announced(r.choice(keys)), r.choice("-_/").join(spoken() for _ in range(r.randint(3, 6))), " "),
        lambda: (announced(r.choice(keys)), "".join(spoken().capitalize() for _ in range(r.randint(3, 5))), " "),
        lambda: (announced(r.choice(keys)), "".join(spoken() for _ in range(r.randint(3, 5))), " "),
    ]
    #: Short values and other formats after a key word.
    signs = "!#$%&*?@_-+"
    keywords = ["password", "Password", "passwd", "pwd", "passphrase", "token", "api_key", "secret", "auth", "contraseña", "mot de passe", "Passwort", "Kennwort"]
    mixed_case = letters + letters.upper()

    def with_digit(alphabet: str, size: int) -> str:
        s = list(draw(alphabet, size))
        s[r.randrange(size)] = r.choice(digits)
        return "".join(s)

    def national() -> str:
        number, body = r.randrange(10**8), f"{r.choice('12')}{draw(digits, 2)}{r.randint(1, 12):02d}{r.randint(1, 95):02d}{draw(digits, 6)}"
        ten = draw("123456789", 1) + draw(digits, 9)
        check = next(c for c in digits if national_ok(ten + c)) if any(national_ok(ten + c) for c in digits) else "0"
        return r.choice([f"{number:08d}{'TRWAGMYFPDXBNJZSQVHLCKE'[number % 23]}", f"{draw('ABCEGHJKLMNPRSTWXYZ', 2)} {draw(digits, 2)} {draw(digits, 2)} {draw(digits, 2)} {r.choice('ABCD')}", f"{body}{97 - int(body) % 97:02d}", f"{body[0]} {body[1:3]} {body[3:5]} {body[5:7]} {body[7:10]} {body[10:]} {97 - int(body) % 97:02d}", f"{ten[:2]} {ten[2:5]} {ten[5:8]} {ten[8:]}{check}", ten + check])

    ids = ["DNI", "NIF", "NINO", "national insurance", "INSEE", "sécurité sociale", "Steuer-ID", "tax id", "national id", "SSN"]
    short = [
        lambda: (announced(r.choice(keywords)), with_digit(mixed_case + digits, r.randint(6, 24)), r.choice([" ", ".", '"'])),
        lambda: (announced(r.choice(keywords)), with_digit(mixed_case + digits + signs, r.randint(8, 24)), r.choice([" ", " ", '"'])),
        lambda: (announced(r.choice(keywords)), with_digit(letters + digits, r.randint(6, 15)), r.choice([" ", ".", '"'])),
        lambda: (announced(r.choice(keywords)), spoken().capitalize() + r.choice(["", "-", "_", "."]) + draw(digits, r.randint(2, 4)) + r.choice(["", r.choice(signs)]), " "),
        lambda: (announced(r.choice(["token", "api_key", "auth", "bearer"])), ".".join(draw(mixed_case + digits + "_-", r.choice([16, 30, 60])) for _ in range(3)), " "),
        lambda: (announced(r.choice(ids)), national(), r.choice([" ", "."])),
    ]
    plain = [
        lambda: (announced(r.choice(keywords)), r.choice([str, str.capitalize])(spoken() + r.choice(["", spoken()])), r.choice([" ", ".", ", ", "!", "?"])),
        lambda: (announced(r.choice(keywords)), word() + r.choice(["-", "_", "/", "."]) + word(), r.choice([" ", ".", ")"])),
        lambda: (announced(r.choice(keywords)), r.choice(["<", "[", "{", "$"]) + word() + r.choice([">", "]", "}", ""]), " "),
        lambda: (announced(r.choice(keywords)), f"https://{word()}.org/{word()}", " "),
        lambda: (announced(r.choice(["token count", "auth time", "secrets", "tokens"])), r.choice([f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 99)},{r.randint(100, 999)}", f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}"]), " "),
        lambda: (r.choice(["page ", "in ", "", "item "]), r.choice([draw(digits, 11), draw(digits, 8) + r.choice("ABC"), f"{draw(digits, 2)} {draw(digits, 3)} {draw(digits, 3)} {draw(digits, 3)}"]), " "),
        lambda: ("", ".".join(word() for _ in range(r.randint(3, 5))) + r.choice(["", digits[r.randrange(10)]]), " "),
    ]
    x, y = [], []
    for k in range(4 * n):
        truth = k % 2
        before, span, after = r.choice((positive if truth else negative) if k < n else (letters_only if truth else words_only) if k < 2 * n else short if truth else plain)()
        lead = " ".join(word() for _ in range(r.randint(0, 6)))
        text = f"{lead} {before}{span}{after}{word()} {word()}."
        at = len(lead) + 1 + len(before)
        for start, end, kind in candidates(text, []):
            inside = start <= at and end >= at + len(span) if truth else False
            if truth and not inside and start < at + len(span) and end > at:
                continue  # a part of the true span is neither right nor wrong
            x.append(features(text, start, end, kind))
            y.append(float(inside))
    return np.array(x), np.array(y)


@functools.lru_cache(maxsize=4)
def fitted(precision: float = 0.98, seed: int = 7) -> tuple[boosting.Trees, dict[str, float]]:
    """The trees, and for each kind the least threshold that holds the precision on held-out cases (0.5 at least)."""
    x, y = training_cases(seed)
    held = np.arange(len(y)) % 4 == 3
    trees = boosting.fit(x[~held], y[~held], rounds=100, depth=4)
    p, kind = trees.probability(x[held]), x[held][:, -1]
    threshold = {}
    for k in EXTRA:
        mine = kind == KINDS.index(k)
        order = np.argsort(-p[mine], kind="stable")
        right = np.cumsum(y[held][mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(right >= precision)
        threshold[k] = float(max(0.5, p[mine][order][good[-1]])) if len(good) else 1.1
    return trees, threshold


def extra_spans(text: str, taken: list[tuple[int, int, str]], trees: boosting.Trees, threshold: dict[str, float]) -> list[tuple[int, int, str]]:
    proposed = candidates(text, taken)
    if not proposed:
        return []
    p = trees.probability(np.array([features(text, *c) for c in proposed]))
    sure = [k for k in range(len(proposed)) if p[k] >= threshold[proposed[k][2]]]
    chosen: list[tuple[int, int, str]] = []
    places = Taken()
    for k in sorted(outermost(proposed, sure), key=lambda k: -p[k]):
        a, b, kind = proposed[k]
        if not places.overlaps(a, b):
            chosen.append(proposed[k])
            places.add(a, b)
    return chosen


def outermost(spans: list[tuple[int, int, str]], among: list[int]) -> list[int]:
    """Those spans that lie in no other one of their kind; of equal ones the first. In their order."""
    reach: dict[str, int] = {}
    kept = []
    for k in sorted(among, key=lambda k: (spans[k][0], -spans[k][1], k)):
        _, end, kind = spans[k]
        if end > reach.get(kind, -1):
            reach[kind] = end
            kept.append(k)
    return sorted(kept)


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as in KINDS."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


FIELDS = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]
_HINT = np.zeros(256, bool)
_HINT[48:58] = True
_HINT[64] = True
#: Assignment signs, for secrets without a digit.
_HINT[[58, 61]] = True


def find(docs: DataFrame, text_col: str = "text", precision: float = 0.98) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base and spans (kind:start:end, comma-joined)."""
    trees, threshold = fitted(precision)

    def make():
        def work(column: pa.Array) -> dict:
            data, off = utf8(column)
            raw = data.tobytes()
            out = {f.name: [0 if f.name[:2] == "n_" else ""] * len(column) for f in FIELDS}
            for i in np.flatnonzero(row_sums(_HINT[data], off)):
                text = raw[off[i] : off[i + 1]].decode()
                base = base_spans(text)
                for k in BASE:
                    out[f"n_{k}"][i] = sum(s[2] == k for s in base)
                out["base"][i] = joined(base)
                out["spans"][i] = joined(base + extra_spans(text, base, trees, threshold))
            return out

        return work

    return append_columns(docs, text_col, FIELDS, make)


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """found with each span of the text replaced by its kind in brackets; of overlapping spans the union, named by the first."""
    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, joined_spans in zip(text, spans):
            if t is None or not joined_spans:
                out.append(t)
                continue
            kept, at = [], 0
            for kind, a, b in (s.split(":") for s in joined_spans.split(",")):
                a, b = int(a), int(b)
                if a >= at:
                    kept += [t[at:a], f"[{kind}]"]
                at = max(at, b)
            out.append("".join([*kept, t[at:]]))
        return pd.Series(out, dtype=object)

    return found.withColumn(text_col, cut(text_col, "spans"))
