"""Personal data and secrets by fixed patterns and a semi-Markov conditional random field.

The base patterns find plain e-mail addresses, IPv4 addresses, payment cards and international phone numbers. The field
adds what they miss: numbers in other forms, disguised addresses, account numbers, and secrets such as access keys and
passwords. Round digits, at signs and words that announce such things it scores whole candidate spans by features of the
span (its form, digits, checksums) and of its surroundings (words before and after it), and dynamic programming chooses
boundaries and kinds jointly. It is trained by maximum likelihood on made-up sentences, in which numbers of the same
forms also stand for orders, parts, versions and dates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.arrowtext import map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++((?:\.[0-9]++){3})")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
#: Words that announce personal data, words that announce other numbers, and words before a secret.
_PERSONAL = "call phone tel telephone fax mobile mobil cell handy ruf telefon telefono teléfono llame appelez mail email contact card visa mastercard iban account konto compte cuenta ssn social security"
_OTHER = "order orders part no nr number item ref invoice version build id units pieces page pages isbn serial model article commit md5 sha sha1 sha256 hash checksum revision ticket case total sum date on from since until"
_SECRET = "password passwd passwort pwd token secret apikey key credential credentials bearer auth"
_CUES = frozenset(f"{_PERSONAL} {_OTHER} {_SECRET}".split())
_SECRETS = frozenset(_SECRET.split())
_AT = r"(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\s+dot\s+)"
_MAIL = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+")
_LABEL = re.compile(rf"(?i){_DOT}")
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_+/~.-]*")
#: What a text must hold for the field to look at it at all: a digit, an at sign, or one of these.
_WORDS = re.compile(rf"(?i)[(\[]\s?(?:at|dot)\s?[)\]]|\sdot\s|(?:{'|'.join(sorted(_SECRETS))})[\s\"']{{0,3}}[=:]")
_MARKS = re.compile(r"[0-9@][0-9]*")
_CHUNK = re.compile(r"\S*")
_WORD = re.compile(r"[^\W\d_]+")
_TRIGGER_BYTES = np.zeros(256, bool)
_TRIGGER_BYTES[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in BASE, then start; leftmost and apart within each kind. Linear in the text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            last = domain.end()
            found.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


@dataclass(frozen=True)
class Settings:
    longest: int = 16  # tokens of a number; addresses and secrets have no such bound
    digits: int = 34  # of a number, at most: the longest account number
    sentences: int = 1500  # made-up training sentences
    epochs: int = 4
    rate: float = 0.25
    decay: float = 1e-4
    seed: int = 61


def _iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _kind(token: str) -> str:
    """The class of a token: digits by their number, words, heads of account numbers, keys, other mixtures by length."""
    n = len(token)
    if not token[0].isalnum() or not token.isascii():
        return token if n == 1 and token.isascii() else "?"
    if token.isdigit():
        return "9" * min(n, 20)
    if token.isalpha():
        return token.lower() if token.lower() in ("at", "dot") else "w" if n < 16 else "W"
    if n == 20 and token.startswith("AKIA") and token.upper() == token:
        return "K"
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}", token):
        return "I"
    if 15 <= n <= 34 and re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]*", token):
        return "J"
    if n >= 12 and not token.lower().strip("0123456789abcdef"):
        return "h"
    return "M" if n >= 12 else "m"


@lru_cache(maxsize=1 << 16)
def _of_form(form: str) -> tuple[str, ...]:
    """Features that depend on a span's form alone."""
    digits = form.count("9")
    thin = re.sub(r"9+", "9", form)
    groups = "-".join(str(len(g)) for g in re.findall(r"9+", form))
    return ("bias", "form=" + form[:48], "thin=" + thin[:24], "groups=" + groups[:16], f"digits={min(digits, 24)}", "head=" + form[0])


def _of_value(s: str, digits: str, form: str) -> tuple[str, ...]:
    """Features that need the span's characters: checksums, ranges, a leading zero."""
    out = []
    if form[0] in "IJ":
        out.append(f"iban={_iban(s)}")
    else:
        if 13 <= len(digits) <= 19:
            out.append(f"luhn={luhn(digits)}")
        if digits[0] == "0":
            out.append("zero")
        if form[:4] == "9999" and re.match(r"(?:19|20)[0-9]{2}[-/.][01][0-9][-/.][0-3][0-9]", s):
            out.append("date")
    return tuple(out)


def _before(text: str, start: int) -> tuple[str, ...]:
    """Features of what stands before a span: the last two words, how the last one is joined to it, what it touches."""
    before = text[max(0, start - 32) : start]
    out, words = [], list(_WORD.finditer(before))[-2:]
    for m in words:
        if m.group().lower() in _CUES:
            out.append("before=" + m.group().lower())
    if words and ("=" in before[words[-1].end() :] or ":" in before[words[-1].end() :]):
        out.append(f"given={words[-1].group().lower() in _SECRETS}")
    out.append("left=" + _edge(before[-1:]))
    return tuple(out)


def _after(text: str, end: int) -> tuple[str, ...]:
    """Features of what stands after a span: the next word, what it touches."""
    word = _WORD.match(text, end + 1, end + 24) if text[end : end + 1] == " " else None
    right = "right=" + _edge(text[end : end + 1])
    return ("after=" + word.group().lower(), right) if word and word.group().lower() in _CUES else (right,)


def _edge(c: str) -> str:
    return "o" if not c or c.isspace() else "a" if c.isalnum() else c


def _lattice(text: str, lo: int, hi: int, settings: Settings) -> tuple[list[tuple[int, int]], dict[tuple[int, int], tuple]]:
    """Tokens of text[lo:hi] and the features of every candidate span of them, in four groups, by (first token, end token).

    Candidates are runs of number tokens with the marks between them, disguised addresses, and values: keys, long
    mixtures, and whatever follows a word for a secret and an equals sign or colon.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    words = [text[a:b] for a, b in tokens]
    kinds = [_kind(w) for w in words]
    first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    found: dict[tuple[int, int], tuple] = {}
    after: dict[int, tuple[str, ...]] = {}

    def add(i: int, j: int, form: str, before: tuple, value: tuple = ()) -> None:
        if j not in after:
            after[j] = _after(text, tokens[j - 1][1])
        found[i, j] = (_of_form(form), before, after[j], value)

    for i, kind in enumerate(kinds):
        if kind[0] not in "9+(IJ":
            continue
        form, digits, account, before = "", "", kind in "IJ", None
        for j in range(i, min(len(tokens), i + settings.longest)):
            k, gap = kinds[j], text[tokens[j - 1][1] : tokens[j][0]] if j > i else ""
            number = k[0] == "9" or account and (k in "Im" or k == "w" and len(words[j]) <= 4)
            if not (number or k in "+().-/" or j == i) or len(gap) > 1 or gap == "\n" or len(words[j]) > settings.digits:
                break
            form += gap + k
            if not number and k != "J":
                continue
            digits += words[j] if k[0] == "9" else "".join(c for c in words[j] if c in "0123456789")
            if len(digits) > settings.digits:
                break
            if len(digits) >= 7:
                before = before or _before(text, tokens[i][0])
                add(i, j + 1, form, before, _of_value(text[tokens[i][0] : tokens[j][1]], digits, form))
    at = lo
    while m := _MAIL.search(text, at, hi):
        mark = "".join(c for c in re.sub(r"(?i)[^@]*?(\sat\s|[(\[]\s?at|@).*", r"\1", m.group(), flags=re.DOTALL).lower() if c in "@([")
        dots = list(_LABEL.finditer(m.group()))
        mark = f"@{mark}{'w' if dots[-1].group().isspace() or dots[-1].group().strip().lower() == 'dot' else '.'}"
        before = _before(text, m.start())
        for end, form in ((m.end(), mark), (m.start() + dots[-1].start(), mark + "-")):
            if m.start() in first and end in last:
                add(first[m.start()], last[end], form, before)
        at = m.end()
    for m in _VALUE.finditer(text, lo, hi):
        end = m.end()
        while text[end - 1] in ".-_/+~" and end > m.start() + 1:
            end -= 1
        i, j = first.get(m.start()), last.get(end)
        if i is None or j is None or (i, j) in found:
            continue
        key, before = kinds[i] if j == i + 1 else "V", None
        if key in "KhMJ" or "given=True" in (before := _before(text, m.start())):
            add(i, j, key if key in "KhMVJ" else "v", before or _before(text, m.start()))
    return tokens, found


class Field:
    """Weights by feature, one for each kind, and the sums of groups of features that many spans share."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self._sums = weights, {}

    def __getstate__(self):
        return self.weights

    def __setstate__(self, weights):
        self.__init__(weights)

    def sums(self, group: tuple[str, ...]) -> tuple[np.ndarray, float]:
        """Scores of a group for each kind, and the largest."""
        found = self._sums.get(group)
        if found is None:
            if len(self._sums) > 1 << 16:
                self._sums.clear()
            total = sum((self.weights[x] for x in group if x in self.weights), np.zeros(len(KINDS)))
            found = self._sums[group] = total, float(total.max())
        return found


def _decode(n: int, spans: dict[tuple[int, int], tuple], field: Field) -> list[tuple[int, int, int]]:
    """The best segmentation: (first token, end token, kind); a token outside spans scores 0."""
    ends: dict[int, list[tuple[int, float, int]]] = {}
    for (i, j), groups in spans.items():
        (a, p), (b, q), (c, r), (d, t) = map(field.sums, groups)
        if p + q + r + t > 0:  # else no kind can have a score above 0
            score = a + b + c + d
            kind = int(score.argmax())
            if score[kind] > 0:
                ends.setdefault(j, []).append((i, float(score[kind]), kind))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, score, kind in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
    return out[::-1]


def _shares(n: int, keys: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of each (span, kind) over all segmentations of n tokens, and the log of their total weight."""
    by_end, by_start = {}, {}
    for k, (i, j) in enumerate(keys):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    mass = np.logaddexp.reduce(scores, axis=1)
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[keys[k][0]] + mass[k] for k in by_end.get(j, ()))])
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([beta[i + 1], *(mass[k] + beta[keys[k][1]] for k in by_start.get(i, ()))])
    first, end = np.array(keys, int).reshape(-1, 2).T
    return np.exp(np.minimum(alpha[first][:, None] + scores + beta[end][:, None] - alpha[n], 0)), float(alpha[n])


def _made_up(rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with some made-up items, and the spans of those that are personal data or secrets."""
    d = lambda n: "".join(rng.choice(list("0123456789"), n))
    w = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))
    of = lambda letters, n: "".join(rng.choice(list(letters), n))
    one = lambda *x: str(rng.choice(list(x)))

    def card(good: bool) -> str:
        body = d(15)
        last = next(c for c in "0123456789" if luhn(body + c) == good)
        s = body + last
        return s if rng.random() < 0.5 else one(" ", "-").join(s[k : k + 4] for k in range(0, 16, 4))

    def iban(good: bool) -> str:
        body, country = of("0123456789", 17) + one("0", "1", "M", "X"), one("DE", "FR", "ES", "GB", "IT", "NL")
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        s = f"{country}{(check if good else (check + 7) % 90 + 2):02d}{body}"
        return s if rng.random() < 0.4 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    at, dot = [("@", "."), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), (" (At) ", " (Dot) "), (" ( at ) ", " ( dot ) ")][rng.integers(9)]
    mixed = lambda n: one("a", "f", "x") + of("0123456789", 2) + of("0123456789abcdefghijkXYZ", n)
    plain = one(*_PERSONAL.split()) if rng.random() < 0.3 else ""
    forms = {  # numbers of one form, as personal data and as something else
        "phone": [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"0{d(2)} {d(7)}", lambda: f"0{d(3)} {d(6)}", lambda: f"0{d(2)}/{d(7)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(3)}-{d(7)}"],
        "ssn": [lambda: f"{d(3)}-{d(2)}-{d(4)}"],
    }
    phone, social = one(*"call phone tel telephone fax mobile telefon llame".split()), one("ssn", "social security", "ssn:", "ssn")
    other = one(*"order part no nr item ref invoice serial model article ticket case id number".split()) + one("", "", " no", ":")
    number = forms[one("phone", "ssn")]
    same = number[rng.integers(len(number))]
    pick = lambda kind: forms[kind][rng.integers(len(forms[kind]))]()
    secret = lambda: one(mixed(14), of("0123456789abcdef", 18), of("0123456789abcdef", 40), mixed(6) + "_" + mixed(5), of("abcdefghXYZ0189", 9))
    choices = [  # (kind, words before, item, words after)
        ("email", "", lambda: f"{w()}.{w()}{at}{w()}{dot}com", ""), ("email", "", lambda: f"{w()}{d(2)}{at}{w()}{dot}{w()}{dot}org", ""), ("email", plain, lambda: f"{w()}{at}{w()}{dot}{w()}", ""),
        ("ip", "", lambda: ".".join(str(rng.integers(1, 255)) for _ in range(4)), ""), ("card", plain, lambda: card(True), ""), ("iban", plain, lambda: iban(True), ""), ("iban", "iban", lambda: iban(True), ""),
        ("phone", phone, lambda: pick("phone"), ""), ("phone", "", lambda: pick("phone"), ""), ("phone", "", lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", ""),
        ("ssn", social, lambda: pick("ssn"), ""), ("ssn", "", lambda: pick("ssn"), ""),
        ("secret", one("password=", "password: ", "token = \"", "secret: ", "api_key=", "apikey = ", "pwd=", "PASSWORD="), secret, ""), ("secret", "", lambda: "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), ""),
        ("", other, same, ""), ("", other, same, ""), ("", "", same, one("units", "pieces", "pages")), ("", other, same, one("units", "pieces", "")),
        ("", one("", "", plain), lambda: card(False), ""), ("", "", lambda: iban(False), ""), ("", "", lambda: d(int(rng.integers(7, 13))), ""),
        ("", one("", "on", "since"), lambda: f"{one('19', '20')}{d(2)}-{one('01', '05', '12')}-{one('03', '17', '28')}", ""), ("", "", lambda: f"{one('19', '20')}{d(2)}-{one('02', '09', '11')}-{one('04', '12', '30')} {d(2)}:{d(2)}:{d(2)}", ""),
        ("", one("", "hash", "md5", "commit", "sha"), lambda: of("0123456789abcdef", int(one("12", "20", "32", "40"))), ""), ("", "", lambda: f"{d(3)}.{d(3)}.{d(3)}", ""), ("", "", lambda: f"{d(5)}-{d(5)}", ""), ("", "", lambda: f"@{w()}{d(8)}", ""),
        ("", "", lambda: " ".join(d(int(rng.integers(1, 5))) for _ in range(6)), ""), ("", one("", "isbn"), lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", ""), ("", "", lambda: f"{w()} @ {w()} {d(3)}", ""), ("", "", lambda: f"{w()} at {w()}", ""), ("", "", lambda: f"/{w()}/{mixed(12)}/{w()}", ""),
        ("", one("version", "build"), lambda: f"{d(1)}.{d(2)}.{d(4)}", ""), ("", "", lambda: f"{mixed(14)}", ""), ("", "token", w, ""), ("", "password", w, ""),
    ]
    text, gold = w() + " ", []
    for at_ in rng.choice(len(choices), rng.integers(1, 3), replace=False):
        kind, before, make, after = choices[at_]
        text += before + (" " if before and before[-1] not in "=\" " else "")
        item = make()
        if kind:
            gold.append((kind, len(text), len(text) + len(item)))
        text += item + ("\"" if before.endswith("\"") else "") + (f" {after} " if after else one(" ", ". ", ", ")) + " ".join(w() for _ in range(rng.integers(1, 4))) + " "
    return text, gold


@lru_cache(maxsize=4)
def train(settings: Settings = Settings()) -> Field:
    """The field: gradient ascent on the log likelihood, by forward and backward sums."""
    rng = np.random.default_rng(settings.seed)
    examples = []
    for _ in range(settings.sentences):
        text, gold = _made_up(rng)
        tokens, spans = _lattice(text, 0, len(text), settings)
        spans = {key: [f for group in groups for f in group] for key, groups in spans.items()}
        where = {(tokens[i][0], tokens[j - 1][1]): (i, j) for i, j in spans}
        examples.append((len(tokens), spans, {where[a, b]: KINDS.index(k) for k, a, b in gold if (a, b) in where}))
    names = sorted({f for _, spans, _ in examples for fs in spans.values() for f in fs})
    number = {f: i for i, f in enumerate(names)}
    packed = [(n, list(spans), [np.array([number[f] for f in fs]) for fs in spans.values()], gold) for n, spans, gold in examples]
    weights, seen = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-2)
    for _ in range(settings.epochs):
        for at in rng.permutation(len(packed)):
            n, keys, features, gold = packed[at]
            if not keys:
                continue
            share, _ = _shares(n, keys, np.array([weights[f].sum(0) for f in features]))
            for k, key in enumerate(keys):
                g = -share[k]
                if key in gold:
                    g[gold[key]] += 1
                if np.abs(g).max() > 1e-4:
                    g = g - settings.decay * weights[features[k]]
                    seen[features[k]] += g * g
                    weights[features[k]] += settings.rate * g / np.sqrt(seen[features[k]])
    return Field({f: weights[i] for f, i in number.items()})


def _may_hold_words(text) -> bool:
    """Whether _WORDS could find something in a text or its bytes; false for most, at the cost of a few plain searches."""
    low = text.lower()
    dot, at, brackets, equals = ("dot", "at", "([", "=:") if isinstance(text, str) else (b"dot", b"at", (b"(", b"["), (b"=", b":"))
    return dot in low or (at in low and any(c in text for c in brackets)) or any(c in text for c in equals)


def _triggers(text: str) -> list[tuple[int, int]]:
    """Spans of what the field must look at, in order."""
    found = [m.span() for m in _MARKS.finditer(text)]
    return sorted(found + [m.span() for m in _WORDS.finditer(text)]) if _may_hold_words(text) else found


def _regions(text: str) -> list[tuple[int, int]]:
    """Runs of neighbouring words that hold a trigger, with two words on either side; runs that then touch are one.

    Words before a run are looked at only as far as the run before it reaches, so the whole is linear in the text.
    """
    out: list[list[int]] = []
    end, n = 0, len(text)
    for start, stop in _triggers(text):
        if start < end:
            continue
        a, floor = start, out[-1][1] if out else 0
        while a > floor and not text[a - 1].isspace():
            a -= 1
        for _ in range(2):  # parts of a disguised address need not hold a trigger
            while a > floor and text[a - 1].isspace():
                a -= 1
            while a > floor and not text[a - 1].isspace():
                a -= 1
        end = b = _CHUNK.match(text, stop).end()
        for _ in range(2):
            if b < n:
                b = _CHUNK.match(text, b + 1).end()
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def all_spans(text: str, field: Field, settings: Settings = Settings()) -> tuple[list, list]:
    """(base spans, base and added spans); an added span touches no base span. Order: kind as in KINDS, then start.

    Time and memory are linear in the text: each token begins at most ``settings.longest`` candidates.
    """
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []
    added = []
    for lo, hi in _regions(text):
        tokens, spans = _lattice(text, lo, hi, settings)
        for i, j, kind in _decode(len(tokens), spans, field) if spans else ():
            a, b = tokens[i][0], tokens[j - 1][1]
            k = int(np.searchsorted(starts, b)) - 1
            if k < 0 or reach[k] <= a:
                added.append((KINDS[kind], a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, base, spans) for every row: base spans and all spans as kind:start:end lists, ends exclusive, in code points.

    A null text is empty and has no spans. Repeated rows get equal spans. Only key and text are read.
    """
    field = train(settings)

    def work(batch, texts):
        base, every = np.full(len(texts), "", object), np.full(len(texts), "", object)
        for i in _triggered(texts):
            found = all_spans(texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode(), field, settings)
            base[i], every[i] = map(written, found)
        return pa.RecordBatch.from_arrays([batch.column("k"), pa.array(base, pa.string()), pa.array(every, pa.string())], ["k", "base", "spans"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_texts(rows, "t", work, f"k {docs.schema[key].dataType.simpleString()}, base string, spans string").toDF(key, "base", "spans")


def _triggered(texts) -> np.ndarray:
    """Rows with an ASCII digit, an at sign, or what _WORDS finds."""
    some = np.concatenate([[0], np.cumsum(_TRIGGER_BYTES[texts.data])])
    hit = some[texts.offsets[1:]] > some[texts.offsets[:-1]]
    for i in np.flatnonzero(~hit):
        raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
        hit[i] = _may_hold_words(raw) and _WORDS.search(raw.decode()) is not None
    return np.flatnonzero(hit)


def redact(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; null texts stay null, all columns stay."""
    field = train(settings)
    names, schema = docs.columns, docs.schema

    def work(batch, texts):
        column = batch.column(names.index(text))
        out = column.to_pylist()
        for i in _triggered(texts):
            out[i] = _redacted(out[i], all_spans(out[i], field, settings)[1])
        columns = [pa.array(out, column.type) if n == text else batch.column(c) for c, n in enumerate(names)]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_texts(docs, text, work, schema)
