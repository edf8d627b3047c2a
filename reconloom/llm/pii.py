"""Personal data by patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field adds spans that the patterns miss, such as an address written
out with "at" and "dot", a phone number without its plus, an account number with letters. It scores whole
segments: the features of a candidate see the span as one (its groups of digits, checksums, the word in
front), and dynamic programming over segments of bounded length chooses boundaries and types jointly.

Every kind needs an anchor (a run of digits, a head of two capitals and two digits, an @, a spelled-out @, the sign before a
secret), so segments are looked for around anchors only, up to LONGEST tokens to either side or the end of the line. That
is as far as a segment with the anchor can reach, so nothing is lost by it, and long texts cost what their anchors cost.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import slices, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the field's segments, in the order in which spans are listed; the last two have no pattern.
TYPES = (*KINDS, "account", "secret")
OUT = len(TYPES)
#: Tokens at most in a segment: 19 digits one by one, or an address of 14 parts with bracketed dots.
LONGEST = 40
QUOTES = "\"'`"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A run of digits and what may join them.
_RUN = re.compile(r"[0-9+(][0-9 ().+-]*")
_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
_AT = r"(?:\[|\(|\{|\b)at(?:\]|\)|\}|\b)"
_SPELLED = re.compile(rf"(?i)@|{_AT}(?=\s*[\w-]+\s*(?:\[|\(|\{{|\b)dot(?:\]|\)|\}}|\b))")
_WORD = re.compile(r"[A-Za-z0-9_-]{20,}")
#: A long word with a letter is one token, however often its letters and digits change.
_TOKEN = re.compile(r"(?=[0-9_-]{0,40}[A-Za-z])[A-Za-z0-9_-]{20,}|[0-9]+|[^\W0-9_]+|[^\w\s]|_")
#: An address that goes on behind its span, or began in front of it.
_GOES_ON = re.compile(r"(?i)\s?[\[({]?\s?(?:dot|at)[\])}\s]\s*\w|\.\w|@")
_CAME = re.compile(r"(?i)\w[\])}]?\s?[\[({]?(?:dot|at)[\])}]?\s?$|\w[.@]$")
_HINTS = {
    "email": frozenset(("mail", "email", "courriel", "correo", "contact", "write")),
    "ip": frozenset(("ip", "host", "server", "from")),
    "card": frozenset(("card", "visa", "karte", "carte", "tarjeta", "credit")),
    "phone": frozenset(("phone", "tel", "call", "telefon", "fax", "mobile", "cell")),
    "secret": frozenset(("token", "secret", "key", "password", "passwort", "apikey", "api_key", "bearer")),
    "account": frozenset(("iban", "account", "ssn", "konto", "compte", "cuenta", "passport")),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The account number check over letters and digits: the first four moved behind, letters as 10 to 35, mod 97 is 1."""
    s = text[4:] + text[:4]
    return s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by pattern, leftmost and non-overlapping for each kind, in time linear in the text."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    if "@" in text:
        at, done = text.find("@"), 0
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append((0, start, m.end()))
            done = m.end() if m else at + 1
            at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _features(text: str, tokens: list[tuple[int, int]], i: int, j: int, y: int) -> list[str]:
    """Names of the features of tokens i to j - 1 as a segment of type y; they see the whole span."""
    start, end = tokens[i][0], tokens[j - 1][1]
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = "-".join(str(len(g)) for g in re.findall(r"[0-9]+", span)[:6])
    low = span.lower()
    glued_left = start > 0 and (text[start - 1].isalnum() or text[start - 1] in "._@#/-+=\"'$€£")
    glued_right = end < len(text) and (text[end].isalnum() or text[end] in "@#/_%=" or (text[end] in ".,-:" and text[end + 1 : end + 2].isdigit()))
    name = TYPES[y]
    f = [f"{name}|bias"]
    if glued_left:
        f.append(f"{name}|left")
    if glued_right:
        f.append(f"{name}|right")
    near = text[max(0, start - 16) : start].lower().split()
    if any(w.strip(":.#()='\"") in _HINTS[name] for w in near[-2:] if y == 5 or w == near[-1]):
        f.append(f"{name}|hint")
    letters = any(c.isalpha() for c in span)
    f.append(f"{name}|" + ("letters" if letters else "figures"))
    if "\n" in span:
        f.append(f"{name}|newline")
    if y == 0:
        spelled = re.search(r"[\[({\s]at[\])}\s]", low) is not None
        sign = low.count("@")
        dots = len(re.findall(r"[\[({\s]dot[\])}\s]", low)) + span.count(".")
        f.append(f"email|{'spelled' if spelled else 'sign' if sign == 1 else 'none'}|{min(dots, 3)}")
        if _GOES_ON.match(text, end):
            f.append("email|goes_on")
        if _CAME.search(text[max(0, start - 12) : start]):
            f.append("email|came")
        host = re.split(r"[\[({\s]at[\])}\s]|@", low)[-1]
        words = [w for w in re.split(r"[\[({\s]+dot[\])}\s]+|\.", host) if w.strip()]
        f.append(f"email|hostparts|{min(len(words), 4)}")
        local = re.split(r"[\[({\s]+at[\])}\s]+|@", low)[0]
        if re.fullmatch(r"[\w%+-]+(?:(?:\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+|\.)[\w%+-]+)*", local.strip() or " "):
            f.append("email|local")
        if words and all(re.fullmatch(r"[a-z0-9-]+", w.strip("[](){} ")) for w in words) and words[-1].strip("[](){} ").isalpha():
            f.append("email|host")
    elif y == 1:
        parts = re.findall(r"[0-9]+", span)
        f.append(f"ip|parts|{len(parts) if len(parts) < 6 else 6}|{all(len(p) < 4 and int(p) < 256 for p in parts)}")
        f.append(f"ip|joined|{re.sub('[0-9]+', '', span)[:6]}")
    elif y == 2:
        f.append(f"card|digits|{16 <= len(digits) <= 19}|{luhn(digits) if digits else False}")
        f.append(f"card|shape|{'plain' if groups == str(len(digits)) else 'fours' if re.fullmatch('4-4-4-4(-[1-3])?', groups) else 'other'}")
        f.append(f"card|joined|{len(set(re.sub('[0-9]+', '', span)))}")
    elif y == 3:
        f.append(f"phone|digits|{min(len(digits), 16)}")
        f.append(f"phone|shape|{'(' if '(' in span else ''}{')' if ')' in span else ''}{groups if len(groups) < 12 else 'long'}")
        f.append(f"phone|joined|{''.join(sorted(set(re.sub('[0-9]+', '', span))))[:5]}")
    elif y == 5:
        before = text[max(0, start - 4) : start].strip(" \"'")
        f.append(f"secret|sign|{before[-1:] in ('=', ':')}")
        f.append(f"secret|quoted|{start > 0 and text[start - 1] in QUOTES and text[end : end + 1] == text[start - 1]}")
        f.append(f"secret|hex|{re.fullmatch('[0-9a-f]+|[0-9A-F]+', span) is not None}|{min(len(span) // 8, 8)}")
        f.append(f"secret|digits|{min(9, 10 * len(digits) // len(span))}")
    else:
        body = re.sub(r"[ -]", "", span)
        f.append(f"account|length|{15 <= len(body) <= 34}|{mod97(body) if 15 <= len(body) <= 34 and body.isalnum() else False}")
        f.append(f"account|head|{re.fullmatch('[A-Z]{2}[0-9]{2}.*', body) is not None}|{groups == '3-2-4' and not letters}")
    return f


def _mixed(word: str) -> bool:
    """A word of letters and digits."""
    return _DIGIT.search(word) is not None and any(c.isalpha() for c in word)


def tokens_of(text: str, left: int = 0, right: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, left, len(text) if right is None else right)]


def _candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(i, j, type): segments of at most LONGEST tokens that a kind can have at all, by what the kind is, so independent of weights.

    ip, card, phone, account in digits: a run of digits and joiners, as many digits as the kind has. account with
    letters: two capitals, two digits, 15 to 34 letters and digits. email: words around an @ or a spelled-out one.
    secret: a word of 20 letters and digits or more, with both. None crosses a line or two joined blanks.
    """
    if not tokens:
        return []
    out: list[tuple[int, int, int]] = []
    left, right = tokens[0][0], tokens[-1][1]
    start_at, end_at = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
    joined = [k > 0 and tokens[k][0] - tokens[k - 1][1] <= 1 and text[tokens[k - 1][1] : tokens[k][0]] != "\n" for k in range(len(tokens))]

    for m in _RUN.finditer(text, left, right):
        i0 = start_at.get(m.start())
        if i0 is None:  # the run begins inside a word
            i0 = next((start_at[p] for p in range(m.start() + 1, m.end()) if p in start_at), None)
        if i0 is None or sum("0" <= c <= "9" for c in m[0]) < 8 and m[0].count(".") < 3:
            continue
        stop = i0
        while stop < len(tokens) and tokens[stop][1] <= m.end():
            stop += 1
        for i in range(i0, stop):
            head = text[tokens[i][0]]
            if head not in "(+" and not head.isdigit():
                continue
            digits = dots = 0
            for j in range(i + 1, min(stop, i + LONGEST) + 1):
                a, b = tokens[j - 1]
                if j > i + 1 and not joined[j - 1]:
                    break
                if not text[a].isdigit():
                    dots += text[a] == "."
                    continue
                digits += b - a
                if digits > 19:
                    break
                if dots == 3 and head.isdigit():
                    out.append((i, j, 1))
                if 13 <= digits and head.isdigit():
                    out.append((i, j, 2))
                if 8 <= digits <= 15:
                    out.append((i, j, 3))
                if digits == 9 and head.isdigit():
                    out.append((i, j, 4))
    for m in _HEAD.finditer(text, left, right):
        i = start_at.get(m.start())
        if i is None:
            continue
        size = 0
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            a, b = tokens[j - 1]
            if j > i + 1 and not joined[j - 1]:
                break
            if text[a].isalnum():
                size += b - a
                if size > 34:
                    break
                if size >= 15:
                    out.append((i, j, 4))
    signs = [(start_at[m.start()], end_at[m.end()]) for m in _SPELLED.finditer(text, left, right) if m.start() in start_at and m.end() in end_at]
    seen: set[tuple[int, int]] = set()
    for a, b in signs:
        i = a - 1
        while i >= 0 and joined[i + 1] and b - i < LONGEST:
            if text[tokens[i][0]].isalnum() and joined[a] and (b == len(tokens) or joined[b]):
                for j in range(b + 1, min(len(tokens), i + LONGEST) + 1):
                    if not joined[j - 1]:
                        break
                    if text[tokens[j - 1][1] - 1].isalpha() and all(joined[a + 1 : b]) and (i, j) not in seen:
                        seen.add((i, j))
                        out.append((i, j, 0))
            i -= 1
    out += [(k, k + 1, 5) for k, (a, b) in enumerate(tokens) if b - a >= 20 and _mixed(text[a:b])]
    return out


class Field:
    """A semi-Markov field: weights of segment features and of one label following another (OUT: a token outside)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, follow: np.ndarray):
        self.index, self.weights, self.follow = index, weights, follow

    def segment_score(self, text, tokens, i, j, y) -> float:
        known = [self.index.get(f) for f in _features(text, tokens, i, j, y)]
        return float(sum(self.missing if k is None else self.weights[k] for k in known))

    #: Weight of a feature never seen in training: what is unlike the examples is not marked.
    missing = -3.0

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best (type, start, end) of all ways to cut the tokens into segments and outside tokens."""
        ends: dict[int, list[tuple[int, int, float]]] = {}
        for i, j, y in set(_candidates(text, tokens)):
            ends.setdefault(j, []).append((i, y, self.segment_score(text, tokens, i, j, y)))
        if not ends:
            return []
        n, labels = len(tokens), OUT + 1
        best = np.full((n + 1, labels), -np.inf)
        best[0, OUT] = 0.0
        back: list[list] = [[None] * labels for _ in range(n + 1)]
        for j in range(1, n + 1):
            into = best[j - 1] + self.follow[:, OUT]
            k = int(np.argmax(into))
            best[j, OUT], back[j][OUT] = into[k], (j - 1, k)
            for i, y, s in ends.get(j, ()):
                into = best[i] + self.follow[:, y] + s
                k = int(np.argmax(into))
                if into[k] > best[j, y]:
                    best[j, y], back[j][y] = into[k], (i, k)
        out, j, y = [], n, int(np.argmax(best[n]))
        while j:
            i, k = back[j][y]
            if y != OUT:
                out.append((y, tokens[i][0], tokens[j - 1][1]))
            j, y = i, k
        return out[::-1]


def _examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n made-up lines with their spans, from a seeded generator: personal data of each kind, and things that look like it."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(["ka", "lo", "mi", "ter", "en", "su", "va", "ri", "the", "on"]) for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        s = d(15)
        s += next(str(c) for c in range(10) if luhn(s + str(c)))
        return pick([s, " ".join(s[i : i + 4] for i in range(0, 16, 4)), "-".join(s[i : i + 4] for i in range(0, 16, 4))])

    def account() -> str:
        if rng.random() < 0.4:
            return f"{d(3)}-{d(2)}-{d(4)}"
        body = d(18)
        head = pick(["DE", "FR", "ES", "IT"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + head + "00")) % 97
        s = f"{head}{check:02d}{body}"
        return pick([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])

    def email() -> str:
        dot, at = pick([(".", "@"), (" dot ", " at "), (" [dot] ", " [at] "), (" (dot) ", " (at) ")])
        return word() + (dot + word() if rng.random() < 0.5 else "") + (d(2) if rng.random() < 0.4 else "") + at + word() + dot + (word() + dot if rng.random() < 0.3 else "") + pick(["com", "net", "org", "de"])

    def secret() -> str:
        n, letters = pick([(40, "0123456789abcdef"), (32, "0123456789abcdef"), (24, "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789")])
        while True:
            s = "".join(pick(letters) for _ in range(int(n)))
            if _mixed(s):
                return s

    def ip() -> str:
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))

    def phone() -> str:
        return pick([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)} {d(4)}"])

    def other() -> str:
        return pick([
            f"{d(4)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}.", f"{d(1)}.{d(1)}.{d(2)}", f"{d(3)},{d(3)}.{d(2)}", d(int(rng.integers(1, 14))), d(16), f"{d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}.{d(1)}", f"{300 + int(d(2))}.{d(3)}.{d(2)}.{d(2)}",
            f"commit {secret()}", f"{word()}/{secret()}", f"{word()}{word()}{word()}{word()}-{word()}{word()}{word()}{d(1)}", f"{word()}@{word()}", f"{word()} at {word()}", f"({d(4)})", f"{d(2)}-{d(2)}", f"pp. {d(3)}-{d(3)}", f"{d(5)} {d(5)} {d(5)}", f"{word()}{d(8)}{word()}", f"{d(3)}/{d(3)}/{d(4)}", f"ISBN 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"$ {d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}", f"#{d(9)}", d(9), d(10), f"{d(2)}.{d(2)}.{d(4)}", f"{d(3)}-{d(4)}-{d(2)}",
        ])

    make = (email, ip, card, phone, account, secret)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += " ".join(word() for _ in range(int(rng.integers(1, 4)))) + pick([" ", " ", ": ", ", "])
            if rng.random() < 0.55:
                y = int(rng.integers(len(make)))
                quote = ""
                if y == 5:  # what makes a secret of it is the name in front
                    quote = pick(["", *QUOTES])
                    text += pick(sorted(_HINTS["secret"])) + pick([" = ", "=", ": ", " "]) + quote
                elif rng.random() < 0.3:
                    text += pick(sorted(_HINTS[TYPES[y]])) + pick([" ", ": "])
                s = make[y]()
                spans.append((y, len(text), len(text) + len(s)))
                s += quote
            else:
                s = other()
            text += s + pick([" ", ". ", ", ", " "])
        text += word()
        out.append((text, spans))
    return out


@functools.cache
def train(examples: int = 500, rounds: int = 40, seed: int = 0) -> Field:
    """Fit by gradient ascent on the log likelihood of whole segmentations, over a bounded number of made-up lines; once a session."""
    index: dict[str, int] = {}
    lines = []
    for text, spans in _examples(examples, seed):
        tokens = tokens_of(text)
        first, last = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
        gold = {(first[s], last[e], y) for y, s, e in spans}
        cand = sorted(set(_candidates(text, tokens)) | gold, key=lambda c: (c[1], c[0], c[2]))
        feats = [np.array([index.setdefault(f, len(index)) for f in _features(text, tokens, i, j, y)]) for i, j, y in cand]
        lines.append((len(tokens), cand, feats, [c in gold for c in cand], sorted(gold)))
    w, follow = np.zeros(len(index)), np.zeros((OUT + 1, OUT + 1))
    square_w, square_f = np.full(len(index), 1e-6), np.full((OUT + 1, OUT + 1), 1e-6)
    for _ in range(rounds):
        gw, gf = -1e-2 * w, -1e-2 * follow
        for n, cand, feats, is_gold, gold in lines:
            s = np.array([w[f].sum() for f in feats])
            ends: dict[int, list[int]] = {}
            starts: dict[int, list[int]] = {}
            for k, (i, j, _) in enumerate(cand):
                ends.setdefault(j, []).append(k)
                starts.setdefault(i, []).append(k)
            fwd = np.full((n + 1, OUT + 1), -np.inf)
            fwd[0, OUT] = 0
            for j in range(1, n + 1):
                fwd[j, OUT] = np.logaddexp.reduce(fwd[j - 1] + follow[:, OUT])
                for k in ends.get(j, ()):
                    i, _, y = cand[k]
                    fwd[j, y] = np.logaddexp(fwd[j, y], np.logaddexp.reduce(fwd[i] + follow[:, y]) + s[k])
            bwd = np.full((n + 1, OUT + 1), -np.inf)
            bwd[n] = 0
            for j in range(n - 1, -1, -1):
                bwd[j] = follow[:, OUT] + bwd[j + 1, OUT]
                for k in starts.get(j, ()):
                    _, e, y = cand[k]
                    bwd[j] = np.logaddexp(bwd[j], follow[:, y] + s[k] + bwd[e, y])
            z = np.logaddexp.reduce(fwd[n])
            for j in range(n):
                gf[:, OUT] -= np.exp(fwd[j] + follow[:, OUT] + bwd[j + 1, OUT] - z)
            for k, (i, j, y) in enumerate(cand):
                p = np.exp(fwd[i] + follow[:, y] + s[k] + bwd[j, y] - z)
                gf[:, y] -= p
                gw[feats[k]] += is_gold[k] - p.sum()
            at, before = 0, OUT
            for i, j, y in [*gold, (n, n, None)]:
                while at < i:
                    gf[before, OUT] += 1
                    before, at = OUT, at + 1
                if y is not None:
                    gf[before, y] += 1
                    before, at = y, j
        square_w += gw * gw
        square_f += gf * gf
        w += 0.5 * gw / np.sqrt(square_w)
        follow += 0.5 * gf / np.sqrt(square_f)
    return Field(index, w, follow)


def _anchors(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what a segment can't do without, in order, unless a base span has it."""
    found = [m.span() for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            if m.end() - m.start() >= 7 and (sum("0" <= c <= "9" for c in m[0]) >= 8 or m[0].count(".") >= 3):
                found.append((m.start(), m.start() + len(m[0].rstrip(" ().+-"))))
        found += [m.span() for m in _HEAD.finditer(text)]
        found += [m.span() for m in _WORD.finditer(text) if _mixed(m[0])]
    out, k = [], 0
    for a, b in sorted(found):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not (k < len(taken) and taken[k][0] <= a and b <= taken[k][1]):
            out.append((a, b))
    return out


def _reach(text: str, at: int, end: int, step: int) -> int:
    """The place LONGEST tokens from `at` towards `end` (the line's), or `end` if there are fewer."""
    width = 8 * LONGEST
    while True:
        stop = max(end, at - width) if step < 0 else min(end, at + width)
        spans = tokens_of(text, stop, at) if step < 0 else tokens_of(text, at, stop)
        if step < 0 and stop > end:
            spans = spans[1:]  # may be cut
        elif step > 0 and stop < end:
            spans = spans[:-1]
        if len(spans) >= LONGEST:
            return spans[-LONGEST][0] if step < 0 else spans[LONGEST - 1][1]
        if stop == end:
            return end
        width *= 4


def _regions(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches of text around anchors, each within a line, merged where they meet."""
    open_at = close = -1
    for a, b in _anchors(text, taken):
        if b <= close and "\n" not in text[a:b]:
            far = text.find("\n", b)
            close = max(close, _reach(text, b, far if far >= 0 else len(text), 1))
            continue
        line = text.rfind("\n", 0, a) + 1
        far = text.find("\n", a)
        far = far if far >= 0 else len(text)
        left, right = _reach(text, a, line, -1), _reach(text, min(b, far), far, 1)
        if left <= close:
            close = max(close, right)
        else:
            if open_at >= 0:
                yield open_at, close
            open_at, close = left, right
    if open_at >= 0:
        yield open_at, close


def find(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) of a whole text as (kind, start, end). Added spans overlap no base span and no other."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added, at = [], 0
    for a, b in _regions(text, taken):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        inside, k = [], at
        while k < len(taken) and taken[k][0] < b:
            inside.append(taken[k])
            k += 1
        for left, right in _gaps(a, b, inside):
            added += field.decode(text, tokens_of(text, left, right))
    return base, added


def _gaps(a: int, b: int, inside: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for s, e in inside:
        if s > a:
            yield a, s
        a = max(a, e)
    if a < b:
        yield a, b


def written(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    return ",".join(f"{TYPES[k]}:{s}:{e}" for k, s, e in sorted(spans))


def personal_data(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, base and added as arrays of (kind, start, end), in code points, end exclusive.

    Null and empty texts have no spans; texts are read whole; an empty table gives no rows. Other columns of df play no part.
    """
    small_batches(df.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    rows = lambda x: [{"kind": TYPES[k], "start": s, "end": e} for k, s, e in sorted(x)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [find(t, field) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rows(x) for x, _ in found], pa.list_(span)), pa.array([rows(x) for _, x in found], pa.list_(span))], names=["id", "base", "added"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    id_type = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, base {kind}, added {kind}")
    return out.withColumnRenamed("id", id_col)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    if text is None:
        return None
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{TYPES[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind of the base spans, their sha256, and all spans written out."""
    order = F.create_map(*[x for i, k in enumerate(TYPES) for x in (F.lit(k), F.lit(i))])

    def join(spans):
        by_kind = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(by_kind, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(n, KINDS), F.sha2(join(F.col("base")), 256).alias("base_sha256"), join(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
