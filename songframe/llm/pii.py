"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers in their
usual forms. The field adds what they miss (a phone number without +, an address
with [at]): it scores candidate segments of at most MOST_TOKENS tokens by features
of the whole span (digit groups, separators, check sum, neighbours, words before)
and by the labels that follow each other; dynamic programming chooses boundaries
and types together. Spans of the patterns stay as they are and no segment may
touch one. A candidate has one at-sign (or a word for it), or FEWEST_DIGITS to
MOST_DIGITS digits in MOST_GROUPS groups at most with marks and blanks between, or
four short groups of digits with dots in some disguise; it never spans a line end.
Away from these the best path is all "outside", so a text falls apart into the
regions that candidates cover, with the same result as if it were decoded whole.
Decoding goes from left to right and holds a bounded number of scores; spans without
letters are scored once for all numbers of their form.

The field is trained here, on lines that a seeded generator writes, by stochastic
gradient ascent on the conditional log-likelihood (forward-backward over
segments). The weights do not depend on the input.

Null text counts as empty: no spans. Rows may repeat; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.common import small_batches, table, text_of
from songframe.llm.words import Recent

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, MOST_CHARS, FEWEST_DIGITS = 24, 80, 7
#: Without at-sign: at most so many digits, in so many groups, so many marks apart.
MOST_DIGITS, MOST_GROUPS, GAP = 19, 7, 3
SENTENCES, EPOCHS, RATE, DECAY, SEED = 720, 4, 0.3, 1e-4, 11

Span = tuple[int, int, int]  # kind, start, end

# ------------------------------------------------------------- fixed patterns

#: A digit run, dot and so on are matched possessively and from the run's start:
#: what cannot match from there cannot match from its middle either, and long
#: runs take linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    bare = digits.lstrip("0")
    return len(bare) < 3 or len(bare) == 3 and bare <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, by kind, then by start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        at = text.find("@", at + 1)
    out += [(1, *m.span()) for m in IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ------------------------------------------------------------------ the field

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[\s\S]")
AT = re.compile(r"@|[\[({<]\x20?at\x20?[\])}>]", re.IGNORECASE)
#: Four groups of up to three digits with dots in some disguise, such as 10[.]0[.]0[.]1.
DOT = r"(?:\x20?[\[({<]\x20?(?:\.|dot)\x20?[\])}>]\x20?|\x20?\.\x20?|\x20dot\x20)"
QUAD = re.compile(rf"(?<![0-9])(?=([0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}})(?![0-9]))", re.IGNORECASE)
#: Digits with at most GAP marks or blanks between groups; every candidate without
#: at-sign or disguised dots lies in such a run, but for marks before it.
RUN = re.compile(rf"[0-9](?:(?:[^\w\n]|_){{0,{GAP}}}[0-9])*+")
ZEROS = str.maketrans("123456789", "000000000")
#: A dot, or a word for it, and another part of a domain.
MORE = re.compile(r"(?:\.|\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?|\x20dot\x20)[A-Za-z0-9]", re.IGNORECASE)
CUE = re.compile(r"(?i)\b(tel|phone|call|fax|mobile|e-?mail|mail|contact|ip|host|server|address|card|visa|account|order|invoice|date|version|isbn|total|id)\b\W*$")


class Line:
    """Tokens of a text between lo and hi, and the candidate segments that begin at one."""

    def __init__(self, text: str, lo: int = 0, hi: int | None = None):
        self.text, self.hi = text, len(text) if hi is None else hi
        self.at = [m.start() for m in TOKEN.finditer(text, lo, self.hi)] + [self.hi]
        self.signs = [m.span() for m in AT.finditer(text, lo, self.hi)]
        self.begins = [s for s, _ in self.signs]
        self.quads = {m.start(1): m.end(1) for m in QUAD.finditer(text, lo, self.hi)}

    def ends(self, i: int) -> list[int]:
        """Tokens before which a candidate that begins at token i may end, ascending."""
        text, at, a = self.text, self.at, self.at[i]
        c = text[a]
        if not (c.isalnum() or c in "+(") or a and c.isalnum() and text[a - 1].isalnum():
            return []
        n = bisect.bisect_right(self.begins, a)
        signs = self.signs[n : n + 2] if not (n and self.begins[n - 1] == a) else []
        quad = self.quads.get(a, -1)
        digits = groups = gap = 0
        run, out = True, []  # run: digits and marks only so far
        for j in range(i + 1, min(len(at) - 1, i + MOST_TOKENS) + 1):
            begin, b = at[j - 1], at[j]
            c = text[begin]
            if c == "\n" or b - a > MOST_CHARS:
                break
            if "0" <= c <= "9":
                digits, groups, gap = digits + b - begin, groups + 1, 0
            elif c.isalnum():
                run = False
            else:
                gap += 1
            run = run and gap <= GAP and digits <= MOST_DIGITS and groups <= MOST_GROUPS
            one = bool(signs) and signs[0][0] >= a and (len(signs) < 2 or b <= signs[1][0])
            if not (run or one or b <= quad):
                break
            if text[b - 1].isalnum() and not (b < len(text) and text[b].isalnum()) and b - a >= 7:
                if run and digits >= FEWEST_DIGITS or one and signs[0][1] < b or b == quad:
                    out.append(j)
        return out

    @functools.cached_property
    def segments(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(len(self.at) - 1) for j in self.ends(i)]

    @functools.cached_property
    def features(self) -> list[list[str]]:
        return [span_features(*context(self.text, self.at[i], self.at[j], cue_before(self.text, self.at[i]))) for i, j in self.segments]


def _class(c: str) -> str:
    return "none" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c if c in "+-.,@#=\"':/()[]<>" else "other"


def cue_before(text: str, a: int) -> str:
    found = CUE.search(text[max(0, a - 24) : a])
    return found[1].lower() if found else "none"


def context(text: str, a: int, b: int, cue: str) -> tuple:
    """What the features of the span a to b depend on. Without letters, digits count by
    their number and by what their check sums say, so most spans of a table are alike."""
    span = text[a:b]
    digits = _digits(span)
    sound = luhn(digits) if len(digits) >= 12 else False
    octets = len(digits) <= 12 and all(map(_octet, re.findall("[0-9]+", span)))
    sign = AT.search(span)
    more = sign is not None and MORE.match(text, b) is not None
    # of a zero, only whether the number begins with it is kept
    shape = span if sign else ("0" if span[0] == "0" else "") + "|" + span.translate(ZEROS)
    return shape, _class(text[a - 1 : a]), _class(text[b : b + 1]), cue, sound, octets, more


def span_features(shape: str, left: str, right: str, cue: str, sound: bool, octets: bool, more: bool) -> list[str]:
    """Names of the features of a span from its context()."""
    sign = AT.search(shape)
    lead, span = ("", shape) if sign else shape.split("|", 1)
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    letters = sum(map(str.isalpha, span))
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    form = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), span))
    lengths = "-".join(str(min(len(g), 9)) for g in groups[:6])
    out = ["bias", f"digits {min(len(digits), 20)}", f"groups {min(len(groups), 8)}", f"marks {marks[:8]}", f"letters {min(letters, 12) // 3}"]
    out += [f"shape {form[:24]}", f"first {_class(span[0])}", f"left {left}", f"right {right}"]
    out += [f"lengths {lengths}", f"spaces {min(sum(map(str.isspace, span)), 5)}"]
    if sign:
        out.append(f"sign {'@' if sign[0] == '@' else 'word'}")
        rest = re.sub(r"[\[({<]\x20?dot\x20?[\])}>]|\x20dot\x20", ".", span[sign.end() :], flags=re.IGNORECASE)
        out += [f"domain {bool(re.fullmatch(r'\x20?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', rest))}", f"local {bool(re.fullmatch(r'[A-Za-z0-9._%+-]+\x20?', span[: sign.start()]))}"]
        out.append(f"goes on {more}")
    else:
        out += [f"zero first {lead == '0'}", f"zero first {lead == '0'} {min(len(digits), 20)}", f"cue {cue} {min(len(groups), 8)}"]
    if len(digits) >= 12:
        out += [f"luhn {sound}", f"luhn {sound} {min(len(digits), 20)}", f"luhn {sound} {lengths}"]
    if len(groups) == 4 and not letters:
        out.append(f"octets {octets} {marks[:4]}")
    if len(digits) <= 12 and (quad := QUAD.match(span)) and quad.end(1) == len(span):
        out.append(f"quad {octets} {marks[:4]} {letters > 0}")
    return [*out, f"cue {cue}"]


def _sum(x: np.ndarray) -> float:
    top = x.max()
    return top + np.log(np.exp(x - top).sum())


class SemiCrf:
    def __init__(self):
        self.names: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS) + 1))  # 0 is outside
        self.recent = Recent(self.of, 50_000)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "recent"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, recent=Recent(self.of, 50_000))

    def scores(self, line: Line) -> np.ndarray:
        if not line.segments:
            return np.zeros((0, len(KINDS)))
        return np.array([self.weights[[self.names[f] for f in fs if f in self.names]].sum(axis=0) for fs in line.features])

    def of(self, key: tuple) -> list[float]:
        """Score of each kind for a span's context()."""
        at = [self.names[f] for f in span_features(*key) if f in self.names]
        return self.weights[at].sum(axis=0).tolist()

    def best(self, line: Line) -> list[Span]:
        """The highest path over segments and outside tokens, from left to right: what is
        held are the scores of tokens that a candidate may still end at, and two numbers
        for each token and kind to find the way back. What follows the line counts as
        outside, be it text or its end."""
        at, text, recent = line.at, line.text, self.recent
        n, follow, states = len(at) - 1, self.follow.tolist(), range(len(KINDS) + 1)
        low = [-math.inf] * len(states)
        now, open_, back = [0.0, *low[1:]], {}, array("q", bytes(8 * len(states) * (n + 1)))
        for p in range(n):
            ends = line.ends(p)
            if ends:
                into = [max((now[s] + follow[s][k], s) for s in states) for k in states]
                cue = cue_before(text, at[p])
                for j in ends:
                    own, scores = open_.setdefault(j, low.copy()), recent[context(text, at[p], at[j], cue)]
                    for k in states[1:]:
                        value = into[k][0] + scores[k - 1]
                        if value > own[k]:
                            own[k] = value
                            back[j * len(states) + k] = p * len(states) + into[k][1]
            out = max((now[s] + follow[s][0], s) for s in states)
            now = open_.pop(p + 1, None) or low.copy()
            now[0] = out[0]
            back[(p + 1) * len(states)] = p * len(states) + out[1]
        k = max(states, key=lambda s: now[s] + follow[s][0])
        out, p = [], n
        while p:
            i, before = divmod(back[p * len(states) + k], len(states))
            if k:
                out.append((k - 1, at[i], at[p]))
            p, k = i, before
        return out[::-1]

    def _climb(self, line: Line, truth: list[Span], rate: float) -> None:
        """One step up the log-likelihood of a line."""
        n, s, segments = len(line.at) - 1, self.scores(line), line.segments
        ending: dict[int, list[int]] = {}
        for c, (_, j) in enumerate(segments):
            ending.setdefault(j, []).append(c)
        states = len(KINDS) + 1
        a, b = np.full((n + 1, states), -1e30), np.full((n + 1, states), -1e30)
        a[0, 0] = 0
        for p in range(1, n + 1):
            a[p, 0] = _sum(a[p - 1] + self.follow[:, 0])
            parts = [[_sum(a[segments[c][0]] + self.follow[:, k]) + s[c, k - 1] for k in range(1, states)] for c in ending.get(p, ())]
            if parts:
                a[p, 1:] = [_sum(x) for x in np.array(parts).T]
        b[n] = self.follow[:, 0]  # the end of a line counts as outside
        into: dict[int, list[tuple[int, int]]] = {}
        for c, (i, j) in enumerate(segments):
            into.setdefault(i, []).append((c, j))
        for p in range(n - 1, -1, -1):
            parts = [self.follow[:, 0] + b[p + 1, 0]]
            for c, j in into.get(p, ()):
                parts += [self.follow[:, k] + s[c, k - 1] + b[j, k] for k in range(1, states)]
            b[p] = [_sum(x) for x in np.array(parts).T]
        z = _sum(a[n] + b[n])
        follow, found = np.zeros_like(self.follow), np.zeros_like(s)
        follow[:, 0] -= np.exp(np.minimum(0, a[n] + b[n] - z))
        for p in range(1, n + 1):
            follow[:, 0] -= np.exp(np.minimum(0, a[p - 1] + self.follow[:, 0] + b[p, 0] - z))
        for c, (i, j) in enumerate(segments):
            likely = np.exp(np.minimum(0, a[i][:, None] + self.follow[:, 1:] + s[c] + b[j, 1:] - z))
            follow[:, 1:] -= likely
            found[c] -= likely.sum(axis=0)
        last, at = 0, {(line.at[i], line.at[j]): c for c, (i, j) in enumerate(segments)}
        ends = {x: p for p, x in enumerate(line.at)}
        p = 0
        for kind, start, end in [*truth, (-1, len(line.text), 0)]:
            while p < ends[start]:
                follow[last, 0] += 1
                last, p = 0, p + 1
            if kind >= 0:
                found[at[start, end], kind] += 1
                follow[last, kind + 1] += 1
                last, p = kind + 1, ends[end]
        follow[last, 0] += 1
        self.follow += rate * follow
        for c, fs in enumerate(line.features):
            if np.abs(found[c]).max() > 1e-4:
                self.weights[[self.names[f] for f in fs]] += rate * found[c]

    def fit(self, examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> SemiCrf:
        lines = [(Line(text), truth) for text, truth in examples]
        for line, _ in lines:
            for fs in line.features:
                for f in fs:
                    self.names.setdefault(f, len(self.names))
        self.weights = np.zeros((len(self.names), len(KINDS)))
        order, rng = list(range(len(lines))), random.Random(seed)
        for e in range(epochs):
            rng.shuffle(order)
            for i in order:
                self._climb(*lines[i], rate / (1 + e))
            self.weights *= 1 - DECAY * len(lines)
        return self


# ----------------------------------------------------------- lines to learn from


def examples(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """The lines to learn from: what no candidate covers (too many tokens, say) is no
    lesson."""
    out = []
    for text, truth in written(n, seed):
        line = Line(text)
        known = {(line.at[i], line.at[j]) for i, j in line.segments}
        if all((s, e) in known for _, s, e in truth):
            out.append((text, truth))
    return out


def written(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Lines with personal data in many forms, and with numbers that are none; all of
    them, whether candidates cover their truth or not."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def email() -> str:
        at, dot = rng.choice(("@", " @ ", "[at]", " [at] ", "(at)", " (at) ")), rng.choice((".", ".", "[dot]", " [dot] ", " dot ", " (dot) "))
        return word() + rng.choice(("", ".", "_")) + word() + rng.choice(("", number(2))) + at + dot.join(word() for _ in range(rng.randint(2, 3)))

    def ip() -> str:
        dot = rng.choice((".", ".", "[.]", " . ", "(.)", "[.]", "[dot]", " [dot] ", "(dot)"))
        return dot.join(str(rng.randint(0, rng.choice((9, 99, 255, 255)))) for _ in range(4))

    def card(good: bool = True) -> str:
        size = rng.choice((16, 16, 16, 15, 19))
        while luhn(digits := str(rng.randint(3, 6)) + number(size - 1)) != good:
            pass
        mark = rng.choice(("", " ", "-", ".", "/"))
        return mark.join(digits[i : i + 4] for i in range(0, size, 4))

    def phone() -> str:
        a, b, c = str(rng.randint(2, 9)) + number(2), number(3), number(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"00{rng.randint(30, 59)} {a} {b} {c}", f"+{rng.randint(30, 59)} {a} {b}{c}",
                           f"0{a} {c} {number(4)}", f"0{number(1)} {' '.join(number(2) for _ in range(4))}", f"0{number(2)} {c} {number(4)}", f"(0{a}) {b}{b}", f"0{a}/{b}{c}", f"0{a}-{b}{c}"))

    def none() -> str:
        year = rng.randint(1950, 2030)
        return rng.choice(
            (*[" ".join(str(rng.randint(1, 9)) + number(rng.randint(0, 4)) for _ in range(rng.randint(3, 12))) for _ in range(3)],
             " ".join(f"{rng.random():.3f}" for _ in range(3)), f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}, {rng.randint(1, 9)},{number(3)},{number(3)}.{number(2)}", f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{year} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}",
             f"{year}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{year}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}", f"{rng.randint(1, 9)},{number(3)},{number(3)}.{number(2)}", number(rng.randint(7, 14)),
             card(False), card(False), f"{year}-{year + 3} {number(4)}", f"{number(3)}.{number(5)}, {number(2)}.{number(5)}", f"978-3-{number(3)}-{number(5)}-{number(1)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)),
             f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{number(3)}.{number(3)}", f"{number(4)} {number(4)}", f"{number(2)} {number(2)} {number(2)} {number(2)}", f"@{word()}", f"{word()} @ {number(2)}", f"{number(8)}-{number(4)}",
             " ".join(f"{i}." for i in range(1, rng.randint(5, 9))), f"{rng.randint(256, 999)}[.]{rng.randint(0, 9)}[.]{rng.randint(0, 9)}[.]{rng.randint(0, 9)}")
        )

    cues = {0: ("email", "mail", "contact", ""), 1: ("host", "server", "ip", ""), 2: ("card", "visa", "account", ""), 3: ("tel", "phone", "call", "fax", ""), -1: ("order", "invoice", "date", "isbn", "total", "")}
    out = []
    for _ in range(n):
        text, truth = " ".join(word() for _ in range(rng.randint(1, 3))), []
        for _ in range(rng.randint(1, 2)):
            kind = rng.choice((-1, -1, 0, 1, 2, 3))
            cue = rng.choice(cues[kind]) if rng.random() < 0.4 else ""
            text += rng.choice((" ", ", ", ". ", " (")) + (cue + rng.choice((" ", ": ")) if cue else "")
            made = (email, ip, card, phone, none)[kind]()
            if kind >= 0:
                truth.append((kind, len(text), len(text) + len(made)))
            text += made
            if kind > 0 and rng.random() < 0.5:  # a number next to it, which patterns run into
                other = rng.choice((-1, -1, 1, 2))
                made = (None, ip, card, None, lambda: number(rng.randint(2, 11)))[other]()
                text += " "
                if other >= 0:
                    truth.append((other, len(text), len(text) + len(made)))
                text += made
            text += rng.choice((" ", ", ", ". ", ") ")) + " ".join(word() for _ in range(rng.randint(1, 3)))
        out.append((text, truth))
    return out


@functools.lru_cache(maxsize=1)
def trained() -> SemiCrf:
    return SemiCrf().fit(examples())


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of a text that hold all its candidates; between two of them lies a token
    that none covers. No part spans a line end."""
    found = [(*m.span(), GAP, 0) for m in RUN.finditer(text) if m.end() - m.start() >= FEWEST_DIGITS and sum(map(len, DIGITS.findall(m[0]))) >= FEWEST_DIGITS]
    if found or DIGITS.search(text):
        found += [(*m.span(1), 0, 0) for m in QUAD.finditer(text)]
    found += [(*m.span(), MOST_CHARS, MOST_CHARS) for m in AT.finditer(text)]
    spans = []
    for start, end, before, after in found:
        lo = max(0, start - before, text.rfind("\n", max(0, start - before), start) + 1) if before else start
        line_end = text.find("\n", end, end + after)
        spans.append((lo, line_end if line_end >= 0 else min(len(text), end + after)))
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def added_spans(text: str, base: list[Span], model: SemiCrf) -> list[Span]:
    """What the field finds beside the spans of the patterns."""
    rest, at = [], 0
    for start, end in sorted((s, e) for _, s, e in base):
        if start > at:
            rest.append(text[at:start])
        if end > at:
            rest.append("\n" * (end - max(at, start)))
            at = end
    rest = "".join([*rest, text[at:]]) if base else text
    return [span for lo, hi in regions(rest) for span in model.best(Line(rest, lo, hi))]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, counts and digest of the patterns' spans, and all spans, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())  # some thousand weights, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for x in batches:
            rows = []
            for t in x["t"]:
                base = base_spans(t)
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added_spans(t, base, model))))
            yield pd.concat((x[["id"]].reset_index(drop=True), pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])), axis=1)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("string").alias("id"), text_of(text).alias("t"))
    return rows.mapInPandas(run, "id string, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).select(F.col("id").cast("long").alias("doc_id"), *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
