"""Personal data: a semi-Markov conditional random field over words, with whole-span features.

A text is a sequence of words; a segmentation cuts it into single words labelled *none* and spans of one to ``LONGEST``
words labelled with a kind of personal data.  Its score is the sum over segments of the label's weights times the features
of the *whole span* (is it all an address with valid octets, how many digits has it, does it begin with a key word and an
equals sign, ...) and of a weight for each pair of neighbouring labels.  Decoding is the exact dynamic programme over ends,
lengths and labels, which chooses boundaries and kinds jointly.

The model is trained here by maximum likelihood (exact gradients by the forward and backward recursions) on sequences that
a seeded generator makes of the kinds and of things that resemble them: dates, versions, prices, licence lines, formulas, and
long numbers whose check digit is wrong, so that a number counts as a card's only if Luhn's rule holds.  Training takes some
seconds, so its result lies beside this file (``pii_weights``, written by ``python -m nearfold.llm.pii``); a test trains again.

Candidate spans contain a digit, ``@``, ``=``, a word of ``CAPITALS`` capitals, a key's prefix (``ghp_``) or a key word with a
colon (``password:``): that is part of the model.  A word further than ``LONGEST`` from any such word is *none* in every
segmentation, so the programme runs over the stretches around them only, and gives what it would give on the whole text.
Everything happens where a text is read; nothing is shuffled.
"""

from __future__ import annotations

import functools
import os
import random
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfold.llm import textkernel as tk

KINDS = ("none", "email", "phone", "card", "ip", "key", "secret", "iban", "ssn")
LONGEST = 9
SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), ord("@"), ord("=")]] = True
_JOINT = np.zeros(256, bool)
_JOINT[[ord(c) for c in ":_-"]] = True
CAPITALS = 14
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">", '"': '"', "'": "'", "`": "`", "«": "»", "“": "”", "„": "“"}
_OPENED = {close: open_ for open_, close in _PAIRS.items()}
_EMAIL = re.compile(r"[\w.+%-]+@(?:[\w-]+\.)+[A-Za-z]{2,}")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}|\+\d{8,14}|\+\d{1,3}(?: \d{1,4}){4,5}")
_CARD = re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{4}\2\d{4}\2\d{4}\2\d{1,3}|\d{4}([ -])\d{6}\3\d{5}|\d{13,19}")
_KEY = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk-|sk_|xox[bp]-|AIza)[\w-]{12,}")
_SECRET = re.compile(r"(?i)[\"']?[\w.-]*(?:password|passwd|pwd|secret|token|api_?key|apikey|auth|credential)[\w.-]*[\"']?\s?[=:]\s?[\"']?([^\s\"']{6,})[\"']?")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
#: A key word with a colon after it, in one word or with the colon as the next.
_NAMED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api_?key|apikey|auth|credential)[\w.-]*[\"']?:")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}.*|\d{1,2}[./]\d{1,2}[./]\d{2,4}")
#: What stands before the number of a version or a section.
_NUMBERED = re.compile(r"(?i)(?:versions?|ver\.?|v\.?|release|rev\.?|section|sec\.?|chapter|build|firmware)")
_HEX = re.compile(r"[0-9a-f]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def core(span: str) -> tuple[int, int]:
    """The part of a span without the punctuation around it; brackets and quotes stay if both are within."""
    a, b = 0, len(span)
    while a < b:
        first, last = span[a], span[b - 1]
        if last in ".,;:!?":
            b -= 1
        elif b - a > 1 and _PAIRS.get(first) == last:
            a, b = a + 1, b - 1
        elif last in _OPENED and (span.count(last, a, b) == 1 if _OPENED[last] == last else span.count(_OPENED[last], a, b) < span.count(last, a, b)):
            b -= 1
        elif first in _PAIRS and (span.count(first, a, b) == 1 if _PAIRS[first] == first else span.count(first, a, b) > span.count(_PAIRS[first], a, b)):
            a += 1
        else:
            break
    return a, b


FEATURES = (
    "bias", *(f"length {k}" for k in range(2, LONGEST + 1)), "email", "ip", "ip octets", "phone", "card", "card luhn", "key", "secret",
    "secret mixed", "iban", "ssn", "date", "hex", "no digits", "digits 1-4", "digits 5-9", "digits 10-12", "digits 13+",
    "at sign", "equals", "full match of some kind", "no full match", "long, no full match", "letters only at an end", "dots", "part of a match",
    "card, luhn fails", "ip after a version word", "begins with a version word",
    "digits beside", "digits beside, full match",
)
_AT = {name: k for k, name in enumerate(FEATURES)}


@functools.lru_cache(maxsize=50_000)
def features(span: str, words: int, numbered: bool = False, beside: bool = False) -> tuple[int, ...]:
    """The indices of the features that a whole span has.

    numbered: the word before it is one like *version*; beside: a word next to it is a number.
    """
    out = ["bias"]
    if words > 1:
        out.append(f"length {words}")
    a, b = core(span)
    s = span[a:b]
    matched = False

    def full(name: str, pattern: re.Pattern) -> re.Match | None:
        nonlocal matched
        if m := pattern.fullmatch(s):
            out.append(name)
            matched = True
        return m

    full("email", _EMAIL)
    if (m := full("ip", _IP)) and all(int(g) < 256 for g in m.groups()):
        out.append("ip octets")
    if m and numbered:
        out.append("ip after a version word")
    digits = sum(c.isdigit() for c in s)
    full("phone", _PHONE)
    if full("card", _CARD):
        out.append("card luhn" if luhn("".join(c for c in s if c.isascii() and c.isdigit())) else "card, luhn fails")
    full("key", _KEY)
    if m := full("secret", _SECRET):
        v = m.group(1)
        if any(c.isdigit() for c in v):
            out.append("secret mixed")
    if full("iban", _IBAN) and digits < 10:
        out.remove("iban")
    full("ssn", _SSN)
    if _DATE.fullmatch(s):
        out.append("date")
    if _HEX.search(s):
        out.append("hex")
    out.append("no digits" if digits == 0 else "digits 1-4" if digits < 5 else "digits 5-9" if digits < 10 else "digits 10-12" if digits < 13 else "digits 13+")
    if "@" in s:
        out.append("at sign")
    if "=" in s:
        out.append("equals")
    if beside:
        out.append("digits beside, full match" if matched else "digits beside")
    if matched:
        out.append("full match of some kind")
    else:
        out.append("no full match")
        if words > 4:
            out.append("long, no full match")
        if any(p.search(s) for p in (_EMAIL, _IP, _PHONE, _CARD, _KEY, _SECRET)):
            out.append("part of a match")
    ends = s.split(" ")
    if words > 1 and (ends[0].isalpha() and "=" not in ends[min(1, len(ends) - 1)] or ends[-1].isalpha()):
        out.append("letters only at an end")
    if s.count(".") > 1:
        out.append("dots")
    if words > 1 and _NUMBERED.fullmatch(ends[0]):
        out.append("begins with a version word")
    return tuple(_AT[x] for x in out)


def triggers(word: str) -> bool:
    """Whether a span with this word is a candidate."""
    return any(c in "0123456789@=" for c in word) or sum("A" <= c <= "Z" for c in word) >= CAPITALS or bool(":" in word and _NAMED.search(word)) or bool(("_" in word or "-" in word) and _KEY.search(word))


def span_features(words: list[str], begin: int, end: int) -> tuple[int, ...]:
    """Of the span of words from ``begin`` to before ``end``."""
    before, after = words[begin - 1] if begin else "", words[end] if end < len(words) else ""
    return features(" ".join(words[begin:end]), end - begin, _NUMBERED.fullmatch(before.lstrip("([")) is not None, before.lstrip("([").isdigit() or after.rstrip(".,;:!?)]").isdigit())


class Model:
    """Weights of label and feature, and of neighbouring labels (the last row: at the beginning)."""

    def __init__(self, weight: np.ndarray, chain: np.ndarray):
        self.weight, self.chain = weight, chain

    def lattice(self, words: list[str]) -> np.ndarray:
        """score[end, length, label] of the span of ``length`` + 1 words that ends with word ``end``; impossible: -inf."""
        n = len(words)
        out = np.full((n, LONGEST, len(KINDS)), -np.inf)
        has = [triggers(w) for w in words]
        for e in range(n):
            for d in range(min(LONGEST, e + 1)):
                trigger = any(has[e - d : e + 1])
                if d and not trigger:
                    continue
                s = self.weight[:, span_features(words, e - d, e + 1)].sum(axis=1)
                if trigger:
                    out[e, d] = s
                if d == 0:
                    out[e, 0, 0] = s[0]
                else:
                    out[e, d, 0] = -np.inf
        return out

    def decode(self, words: list[str]) -> list[tuple[int, int, int]]:
        """The best segmentation's spans (first word, word after the last, label) that aren't none; ties: shorter first."""
        score = self.lattice(words)
        n, k = len(words), len(KINDS)
        best = np.full((n + 1, k), -np.inf)
        back: list[list[tuple[int, int]]] = [[(0, 0)] * k for _ in range(n + 1)]
        for e in range(n):
            for d in range(min(LONGEST, e + 1)):
                if not np.isfinite(score[e, d]).any():
                    continue
                b = e - d
                if b == 0:
                    via, prev = self.chain[k], np.zeros(k, np.int64)
                else:
                    through = best[b][:, None] + self.chain[:k]
                    prev = through.argmax(axis=0)
                    via = through[prev, np.arange(k)]
                total = via + score[e, d]
                for y in np.flatnonzero(total > best[e + 1]):
                    best[e + 1, y] = total[y]
                    back[e + 1][y] = (d + 1, int(prev[y]))
        out, at, y = [], n, int(best[n].argmax()) if n else 0
        while at:
            length, before = back[at][y]
            if y:
                out.append((at - length, at, y))
            at, y = at - length, before
        return out[::-1]

    def gradient(self, words: list[str], gold: list[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """The log-likelihood of a segmentation and its gradient."""
        score = self.lattice(words)
        n, k = len(words), len(KINDS)
        f = np.full((n + 1, k), -np.inf)
        g = np.full((n + 1, k), -np.inf)
        g[n] = 0
        inner = self.chain[:k]
        into = lambda b: self.chain[k] if b == 0 else np.logaddexp.reduce(f[b][:, None] + inner, axis=0)
        for e in range(n):
            terms = [into(e - d) + score[e, d] for d in range(min(LONGEST, e + 1))]
            f[e + 1] = np.logaddexp.reduce(terms, axis=0)
        onward = np.full((n + 1, k), -np.inf)  # of what follows a boundary, by the label after it
        for b in range(n - 1, -1, -1):
            terms = [score[b + d, d] + g[b + d + 1] for d in range(min(LONGEST, n - b))]
            onward[b] = np.logaddexp.reduce(terms, axis=0)
            g[b] = np.logaddexp.reduce(inner + onward[b][None, :], axis=1)
        z = np.logaddexp.reduce(f[n])
        dw, dc = np.zeros_like(self.weight), np.zeros_like(self.chain)
        for e in range(n):
            for d in range(min(LONGEST, e + 1)):
                if np.isfinite(score[e, d]).any():
                    p = np.exp(into(e - d) + score[e, d] + g[e + 1] - z)
                    dw[:, span_features(words, e - d, e + 1)] -= p[:, None]
        for b in range(1, n):
            dc[:k] -= np.exp(f[b][:, None] + inner + onward[b][None, :] - z)
        dc[k] -= np.exp(self.chain[k] + onward[0] - z)
        like, at, y = -z, 0, k
        for b, e, label in [*gold, (n, n, -1)]:
            for a in range(at, b):
                dw[0, span_features(words, a, a + 1)] += 1
                dc[y, 0] += 1
                like += score[a, 0, 0] + self.chain[y, 0]
                y = 0
            if label > 0:
                dw[label, span_features(words, b, e)] += 1
                dc[y, label] += 1
                like += score[e - 1, e - 1 - b, label] + self.chain[y, label]
                y = label
            at = e
        return float(like), dw, dc


def _card(rng: random.Random, valid: bool = True) -> str:
    """A card's number of 13, 15, 16 or 19 digits; not valid: with a wrong check digit."""
    n = rng.choice([16, 16, 16, 16, 15, 13, 19])
    head = rng.choice(["34", "37"] if n == 15 else ["4", "51", "52", "6011", str(rng.randint(10, 99))])
    head += "".join(rng.choices(string.digits, k=n - 1 - len(head)))
    return head + rng.choice([d for d in string.digits if luhn(head + d) == valid])


def _grouped(rng: random.Random, c: str) -> str:
    """A long number in one piece or in groups."""
    if rng.random() < 0.5:
        return c
    at = [4, 10] if len(c) == 15 else list(range(4, len(c), 4))
    return rng.choice([" ", " ", "-"]).join(c[i:j] for i, j in zip([0, *at], [*at, len(c)]))


def examples(n: int, seed: int) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Sequences of words with the spans that are personal data, made by a seeded generator."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuvwéüñö", k=rng.randint(1, 10)))
    digits = lambda k: "".join(rng.choices(string.digits, k=k))
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    letters = lambda k: "".join(rng.choices(string.ascii_lowercase, k=k))
    name = lambda: rng.choice(["password", "token", "secret", "api_key", "passwd", "auth_token", "pwd"])

    makers = {
        1: lambda: f"{word()}{rng.choice(['.', '_', ''])}{digits(rng.randint(0, 3))}@{word()}{rng.choice(['', digits(1)])}.{rng.choice(['example.com', 'org', 'co.uk', 'net'])}".encode("ascii", "ignore").decode(),
        2: lambda: rng.choice([f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+{rng.randint(1, 99)} {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{rng.randint(1, 99)} {digits(2)} {digits(3)} {digits(2)} {digits(2)}"]),
        3: lambda: _grouped(rng, _card(rng)),
        4: lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        5: lambda: rng.choice(["AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)), "ghp_" + "".join(rng.choices(string.ascii_letters + string.digits, k=36)), "ghp_" + "".join(rng.choices(string.ascii_letters, k=36)), "sk-" + hexes(32)]),
        6: lambda: rng.choice([f"{name()}={hexes(rng.randint(8, 40))}", f'{name()} = "{hexes(rng.randint(16, 40))}"', f"{name()}: {hexes(rng.randint(12, 40))}", f"{name()}={word()}{digits(4)}!", f"{name()}: {letters(rng.randint(8, 20))}", f"{name()} = {letters(rng.randint(8, 20))}"]),
        7: lambda: rng.choice(["DE", "FR", "ES", "GB"]) + digits(2) + rng.choice([digits(18), " ".join([""] + [digits(4) for _ in range(2)]), digits(16), " ".join(["", *(digits(4) for _ in range(rng.randint(3, 7))), digits(rng.randint(1, 3))]), " " + " ".join(["".join(rng.choices(string.ascii_uppercase, k=4)), *(digits(4) for _ in range(3)), digits(2)])]),
        8: lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    others = [
        lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 40)}",
        lambda: f"version {rng.randint(1, 9)}.", lambda: f"CC BY-NC {rng.randint(1, 4)}.0.", lambda: digits(rng.randint(1, 9)), lambda: f"${digits(3)},{digits(3)}.{digits(2)}",
        lambda: f"x={rng.randint(0, 9)}", lambda: f"{word()} = {rng.randint(0, 99)}", lambda: f"{word()}={word()}", lambda: f"@{word()}", lambda: f"{rng.randint(1, 12)}:{digits(2)}", lambda: f"{rng.randint(1, 31)}/{rng.randint(1, 12)}/20{digits(2)}",
        *[lambda: f"{rng.randint(300, 999)}.{digits(3)}.{digits(3)}.{digits(3)}"] * 3, lambda: f"{digits(4)}-{digits(4)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"token {word()}", lambda: f"{digits(2)}%", lambda: f"{word()}{digits(2)}", lambda: f"No. {digits(5)}",
        lambda: " ".join(f"{word()}{digits(rng.randint(1, 4))}" for _ in range(rng.randint(1, 4))), lambda: " ".join(digits(rng.randint(1, 6)) for _ in range(rng.randint(2, 4))),
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", lambda: f"{digits(2)} {word()} {digits(3)}", lambda: f"{digits(5)}{word()}", lambda: f"{word()}-{digits(4)}-{word()}", lambda: f"https://{word()}.org/{word()}?id={digits(3)}",
        lambda: " ".join(f"{rng.randint(0, 99)}.{digits(2)}" for _ in range(rng.randint(1, 4))), lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"a@b {digits(2)}", lambda: f"ISBN {digits(3)}-{digits(1)}",
        lambda: " ".join(f"{word()}{digits(rng.randint(1, 2))}" for _ in range(rng.randint(5, LONGEST))),
        *[lambda: _grouped(rng, _card(rng, valid=False))] * 3, *[lambda: f"{rng.choice(['version', 'v', 'release', 'Version', 'section', 'build'])} {'.'.join(str(rng.randint(0, 40)) for _ in range(rng.choice([3, 4, 4])))}"] * 2,
        lambda: f"version: {word()}", lambda: f"{word()}-{word()}_{word()}",
    ]
    out = []
    for _ in range(n):
        words: list[str] = []
        gold = []
        for _ in range(rng.randint(1, 3)):
            words += [word() + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(0, 4))]
            kind = rng.choice([0, 0, *range(1, 9)])
            made = (rng.choice(others) if kind == 0 else makers[kind])()
            span = (rng.choice([made, made, made + ".", made + ",", f"({made})"]) if kind != 6 else made).split(" ")
            if kind:
                gold.append((len(words), len(words) + len(span), kind))
            words += span
            if len(span) > LONGEST:
                raise AssertionError(made)
        words += [word() for _ in range(rng.randint(0, 3))]
        out.append((words, gold))
    return out


EXAMPLES, EPOCHS, SEED = 1200, 5, 20041213


def train(n: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """The model after ``epochs`` of adaptive gradient steps on ``n`` generated sequences; the same for equal arguments."""
    k = len(KINDS)
    model = Model(np.zeros((k, len(FEATURES))), np.zeros((k + 1, k)))
    sw, sc = np.full(model.weight.shape, 1e-2), np.full(model.chain.shape, 1e-2)
    data = examples(n, seed)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for words, gold in data:
            _, dw, dc = model.gradient(words, gold)
            dw -= 1e-3 * model.weight
            dc -= 1e-3 * model.chain
            sw += dw * dw
            sc += dc * dc
            model.weight += 0.4 * dw / np.sqrt(sw)
            model.chain += 0.4 * dc / np.sqrt(sc)
    return model


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    """The model that ``train`` gives, from the file that holds its weights."""
    from nearfold.llm import pii_weights

    return Model(np.array(pii_weights.WEIGHT), np.array(pii_weights.CHAIN))


def save() -> None:
    """Trains and writes the file of weights."""
    model = train()
    rows = lambda a: "".join("    [" + ", ".join(f"{x:.4f}" for x in r) + "],\n" for r in a)
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.py"), "w", encoding="utf-8") as f:
        f.write(f'"""Weights that pii.train gives: a row for each kind by feature; then for each kind before by kind."""\n\nWEIGHT = [\n{rows(model.weight)}]\nCHAIN = [\n{rows(model.chain)}]\n')


def _stretches(trigger: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words that spans with a trigger can reach, with one word more at each side, within one text."""
    at = np.flatnonzero(trigger)
    if not len(at):
        return []
    # Two triggers share a stretch if the words within reach of both, and the ones beside them, touch.
    apart = np.flatnonzero((np.diff(at) > 2 * LONGEST + 1) | (np.diff(row[at]) > 0))
    begin, end = at[np.concatenate([[0], apart + 1])], at[np.concatenate([apart, [len(at) - 1]])]
    first, last = np.searchsorted(row, row[begin]), np.searchsorted(row, row[end], side="right")
    return list(zip(np.maximum(begin - LONGEST, first).tolist(), np.minimum(end + LONGEST + 1, last).tolist()))


def spans_of(data: np.ndarray, offsets: np.ndarray, model: Model) -> list[tuple[int, int, int, int]]:
    """(text, first byte, byte after the last, label) of the personal data in texts that lie one after another."""
    out = []
    for a, b in tk.chunks(offsets):
        base = int(offsets[a])
        words = tk.Words(data[base : offsets[b]], offsets[a : b + 1] - base)
        marked, capital = (np.concatenate([[0], np.cumsum(sort[words.data])]) for sort in (_TRIGGER, _CAPITAL))
        trigger = (marked[words.end] > marked[words.start]) | (capital[words.end] - capital[words.start] >= CAPITALS)
        joints = np.concatenate([[0], np.cumsum(_JOINT[words.data])])
        for k in np.flatnonzero(~trigger & (joints[words.end] > joints[words.start])).tolist():
            trigger[k] = triggers(bytes(words.data[words.start[k] : words.end[k]]).decode("utf-8", "replace"))
        for lo, hi in _stretches(trigger, words.row):
            start, end = words.start[lo:hi].tolist(), words.end[lo:hi].tolist()
            text = [bytes(words.data[s:e]).decode("utf-8", "replace") for s, e in zip(start, end)]
            for i, j, kind in model.decode(text):
                # Spans are found on words joined by blanks; only the punctuation at the ends is taken off.
                head, tail = core(" ".join(text[i:j]))
                joined = " ".join(text[i:j])
                begin = start[i] + len(joined[:head].encode())
                stop = end[j - 1] - len(joined[tail:].encode())
                out.append((a + int(words.row[lo]), base + begin, base + stop, kind))
    return out


def redact(docs: DataFrame, column: str = "text", spans: str = "spans", length: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``column`` replaced by its kind in brackets, like ``[email]``.

    ``spans`` (an existing column of that name is replaced) lists what was found: characters of the original text from
    ``begin`` to before ``end``, and the kind.  ``length`` may name a column of whole numbers that gets the new length.

    Defined results: a null text stays null and has null spans; a text without personal data is unchanged and has an
    empty list; all rows, repeated ones each, and all other columns are kept; texts are searched whole, however long; of
    segmentations of equal score the one whose spans are shorter is taken; an empty table gives an empty result.
    """
    model = trained()
    others = [f for f in docs.schema.fields if f.name.lower() != spans.lower()]
    names = [f.name for f in others]
    schema = T.StructType([*others, T.StructField(spans, SPAN_TYPE)])
    kind_of = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = tk.text_buffer(batch.column(column))
            missing = batch.column(column).is_null().to_numpy(zero_copy_only=False)
            texts, lists = {}, [None if m else [] for m in missing]
            by_row: dict[int, list[tuple[int, int, int]]] = {}
            for row, begin, stop, kind in spans_of(data, offsets, model):
                by_row.setdefault(row, []).append((begin - int(offsets[row]), stop - int(offsets[row]), kind))
            for row, found in by_row.items():
                raw = bytes(data[offsets[row] : offsets[row + 1]])
                parts, at = [], 0
                for begin, stop, kind in found:
                    parts += [raw[at:begin], f"[{KINDS[kind]}]".encode()]
                    at = stop
                    lists[row].append({"begin": len(raw[:begin].decode()), "end": len(raw[:stop].decode()), "kind": KINDS[kind]})
                texts[row] = (b"".join(parts) + raw[at:]).decode()
            columns = [batch.column(n) for n in names]
            if texts:
                spot = names.index(column)
                mask = np.zeros(batch.num_rows, bool)
                mask[list(texts)] = True
                fresh = pa.array([texts[r] for r in sorted(texts)], columns[spot].type)
                columns[spot] = pc.replace_with_mask(columns[spot], pa.array(mask), fresh)
                if length:
                    spot = names.index(length)
                    fresh = pa.array([len(texts[r]) for r in sorted(texts)], columns[spot].type)
                    columns[spot] = pc.replace_with_mask(columns[spot], pa.array(mask), fresh)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, kind_of)], names=[*names, spans])

    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


if __name__ == "__main__":
    save()
