"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds what they miss.

The patterns (email, ip, card, phone) find the base spans. The CRF labels white-space tokens with one of the
kinds or O; its features are the token's shape, digits, signs and key words, and the coarse shapes of its
neighbours. It is trained here, from a small labelled table (tokens and labels), by full forward-backward
gradients, and decoded by Viterbi in numpy batches. The table is the caller's, read by labelled(), or the one that
training_table() writes out by rule. Its spans are added where they overlap no base span: addresses written out
(name at host dot com), numbers without a plus sign, grouped otherwise or run together, addresses of the newer kind.

Most tokens are plain words among plain words. For such runs the model itself tells at how many tokens from
both ends a token is O on the best path whatever stands around the run. Those tokens split the chain exactly, and
only the stretches between them are decoded: the result is that of decoding whole texts. A span the model adds
must also look like its kind (signs, digits, check sum).

Every text is read whole, in one pass without a shuffle; the patterns are matched by scans whose cost is
linear in the text, whatever its digits and signs.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive; repeated rows are
searched each; other columns are ignored by find() and kept by redact(); an empty table gives no rows.
"""

from __future__ import annotations

import functools
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import read_table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their @: the local part is the run before it, back to the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        run = text[floor:at]
        local = len(run) - len(run.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            yield "email", at - local, m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns, by kind and then start."""
    if not text:
        return []
    out = list(emails(text)) if "@" in text else []
    if DIGITS.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- the tokens' features

LABELS = ("o", *KINDS)
TOKEN = re.compile(r"\S+")
EDGE_LEFT, EDGE_RIGHT = "\"'<[{#*%$&!|,;:", "\"'>]}#*%$&!|,;:.?"
KEYS = {w: k for k, ws in {"tel": "tel phone call fax mobile cell dial", "mail": "mail email e-mail contact write", "card": "card visa mastercard amex", "ip": "ip host server address", "at": "at (at) [at]", "dot": "dot (dot) [dot]"}.items() for w in ws.split()}
CELLS = 60_000
COARSE = ("edge", "word", "tel", "mail", "card", "ip", "at", "dot", "d1-2", "d3", "d4", "d5+", "(d3)", "d3-d4", "mixed", "tld")
TLDS = {"com", "org", "net", "edu", "io"}
_RUN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")


def strip_edges(token: str) -> str:
    return token.lstrip(EDGE_LEFT).rstrip(EDGE_RIGHT)


@functools.lru_cache(maxsize=10_000)
def _shape(body: str) -> str:
    out = []
    for run in _RUN.findall(body):
        if run[0].isdigit():
            out.append(f"d{min(len(run), 5)}")
        elif run[0].isascii() and run[0].isalpha():
            out.append("a")
        else:
            out.append(run if run in "@.-+()/:_[]" else "#")
    return "".join(out)


def features(token: str) -> tuple[str, tuple[str, ...]]:
    """(coarse shape, feature names) of one token."""
    body = strip_edges(token)
    low = body.lower()
    if low in KEYS:
        return KEYS[low], (f"key={KEYS[low]}",)
    if not body or body.isalpha():
        return ("tld", ("tld",)) if low in TLDS else ("word", ("word",))
    digits = [c for c in body if "0" <= c <= "9"]
    n = len(digits)
    shape = _shape(body) if len(body) <= 40 else "long:" + "".join(sorted(set(_shape(body))))
    bucket = "0" if n == 0 else "1-2" if n < 3 else str(n) if n in (3, 4) else "5-6" if n < 7 else "7" if n == 7 else "8-9" if n < 10 else "10" if n == 10 else "11-12" if n < 13 else "13-19" if n < 20 else "20+"
    names = [f"shape={shape}", f"digits={bucket}"]
    if "@" in body or "(at)" in low or "[at]" in low:
        names.append("has-at")
        if "." in body or "(dot)" in low or "[dot]" in low:
            names.append("at-and-dot")
    if n and n == len(body):
        names.append("all-digits")
    if 13 <= n <= 19 and luhn("".join(digits)):
        names.append("luhn")
    if any(c.isalpha() for c in body) and n:
        names.append("letters-and-digits")
    if shape.count(":") >= 3 and all(c in string.hexdigits + ":" for c in body):
        names.append("colons")
    if "=" in body:
        names.append("equals")
    if shape.startswith("+"):
        names.append("plus")
    coarse = "mixed"
    if shape in ("d1", "d2"):
        coarse = "d1-2"
    elif shape in ("d3", "d4"):
        coarse = shape
    elif shape == "d5":
        coarse = "d5+"
    elif shape in ("(d3)", "+d1", "+d2", "+d1(d3)"):
        coarse = "(d3)"
    elif shape in ("d3-d4", "d3.d4"):
        coarse = "d3-d4"
    return coarse, tuple(names)


# ---- the model


@dataclass
class Crf:
    """Weights by feature, by neighbour's coarse shape, and of transitions, for the labels in LABELS."""

    index: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def __post_init__(self):
        self._kinds: dict[tuple, int] = {}
        self._coarse: list[int] = []
        self._scores = np.zeros((64, len(LABELS)))
        self.margin = self._margin()

    def _margin(self, most: int = 40) -> int | None:
        """The least h such that a plain word between h plain words on either side is O on every best path,
        whatever the labels beyond them; None if there is none up to `most`."""
        word = COARSE.index("word")
        plain = self.own[self.index["word"]] + self.before[word] + self.after[word]
        left, right = self.moves + plain[None], self.moves.copy()  # to the word from outside, and from it to outside
        for h in range(most + 1):
            ways = left[:, :, None] + right[None, :, :]
            if (ways[:, :1] > ways[:, 1:] + 1e-6).all():
                return h
            left = (left[:, :, None] + (self.moves + plain[None])[None]).max(axis=1)
            right = ((self.moves + plain[None])[:, :, None] + right[None]).max(axis=1)
        return None

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("index", "own", "before", "after", "moves")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def kind_of(self, token: str) -> int:
        """Number of the token's feature set; its scores are kept once computed."""
        coarse, names = features(token)
        key = (coarse, names)
        found = self._kinds.get(key)
        if found is None:
            if len(self._kinds) >= 100_000:  # shapes are many in junk; start afresh rather than grow
                return self._fresh(key)
            found = self._add(key)
        return found

    def _fresh(self, key) -> int:
        self._kinds.clear()
        self._coarse.clear()
        return self._add(key)

    def _add(self, key) -> int:
        coarse, names = key
        i = self._kinds[key] = len(self._kinds)
        if i == len(self._scores):
            self._scores = np.vstack([self._scores, np.zeros_like(self._scores)])
        self._scores[i] = sum((self.own[self.index[x]] for x in names if x in self.index), np.zeros(len(LABELS)))
        self._coarse.append(COARSE.index(coarse))
        return i

    def emissions(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by token and label, and whether a token is a plain word among plain words."""
        if len(self._kinds) + len(tokens) >= 100_000:
            self._kinds.clear()
            self._coarse.clear()
        words: dict[str, int] = {}
        get, kind_of = words.get, self.kind_of
        ids = []
        for t in tokens:
            i = get(t)
            if i is None:
                i = words[t] = kind_of(t)
            ids.append(i)
        ids = np.array(ids)
        coarse = np.concatenate(([0], np.array(self._coarse)[ids], [0]))
        word = COARSE.index("word")
        plain = (coarse[:-2] == word) & (coarse[1:-1] == word) & (coarse[2:] == word)
        return self._scores[ids] + self.before[coarse[:-2]] + self.after[coarse[2:]], plain

    def stretches(self, plain: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) of the runs of tokens that are not O for certain; plain: plain words among plain words."""
        n = len(plain)
        if self.margin is None:
            return [(0, n)]
        odd = np.concatenate(([-1], np.flatnonzero(~plain), [n]))
        if len(odd) == 2 and n <= 2 * self.margin:
            return [(0, n)]
        near = np.zeros(n + 1, dtype=np.int32)  # tokens within the margin of one that isn't plain, or of an end
        np.add.at(near, np.maximum(odd - self.margin, 0), 1)
        np.add.at(near, np.minimum(odd + self.margin + 1, n), -1)
        open_ = np.cumsum(near[:n]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], open_.astype(np.int8), [0]))))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))

    def viterbi(self, batch: list[tuple[np.ndarray, bool, bool]]) -> list[np.ndarray]:
        """Best labels of each stretch. The flags say whether an O stands before it and after it."""
        out: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(batch)
        order = sorted(range(len(batch)), key=lambda i: len(batch[i][0]))
        lo = 0
        while lo < len(order):
            hi = lo + 1  # as many stretches as keep the padded batch small
            while hi < len(order) and (hi - lo + 1) * len(batch[order[hi]][0]) <= CELLS:
                hi += 1
            part, lo = order[lo:hi], hi
            longest = len(batch[part[-1]][0])
            n = np.array([len(batch[i][0]) for i in part])
            e = np.zeros((len(part), longest, len(LABELS)))
            for row, i in enumerate(part):
                e[row, longest - n[row] :] = batch[i][0]  # right-aligned: all end together
            first = np.array([batch[i][1] for i in part])
            last = np.array([batch[i][2] for i in part])
            best = np.zeros((len(part), len(LABELS)))
            back = np.zeros((longest, len(part), len(LABELS)), dtype=np.int8)
            for t in range(longest):
                begins, inside = longest - n == t, longest - n < t
                if inside.any():
                    ways = best[inside][:, :, None] + self.moves[None]
                    back[t, inside] = ways.argmax(axis=1)
                    best[inside] = ways.max(axis=1) + e[inside, t]
                if begins.any():
                    best[begins] = e[begins, t] + np.where(first[begins][:, None], self.moves[0][None], 0.0)
            end = best + np.where(last[:, None], self.moves[:, 0][None], 0.0)
            label = end.argmax(axis=1)
            path = np.zeros((len(part), longest), dtype=int)
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                if t:
                    label = np.where(longest - n < t, back[t, np.arange(len(part)), label], label)
            for row, i in enumerate(part):
                out[i] = path[row, longest - n[row] :]
        return out

    def label(self, texts: list[str]) -> list[list[Span]]:
        """The CRF's spans in each text."""
        jobs, where = [], []
        for k, text in enumerate(texts):
            tokens = text.split()
            if not tokens:
                continue
            scores, plain = self.emissions(tokens)
            for a, b in self.stretches(plain):
                jobs.append((scores[a:b], a > 0, b < len(tokens)))
                where.append((k, a))
        labels: dict[int, dict[int, int]] = {}
        for (k, a), path in zip(where, self.viterbi(jobs), strict=True):
            for i in np.flatnonzero(path):
                labels.setdefault(k, {})[a + int(i)] = int(path[i])
        out: list[list[Span]] = [[] for _ in texts]
        for k, at in labels.items():
            out[k] = _spans(texts[k], at)
        return out


def _spans(text: str, at: dict[int, int]) -> list[Span]:
    """Spans of neighbouring tokens with one label, without the signs around them."""
    out: list[list] = []
    for i, m in enumerate(_tokens(text)):
        if (label := at.get(i)) is None:
            continue
        if out and out[-1][3] == i - 1 and out[-1][0] == label:
            out[-1][2:] = [m[1], i]
        else:
            out.append([label, m[0], m[1], i])
    spans = []
    for label, start, end, _ in out:
        part = text[start:end]
        start += len(part) - len(part.lstrip(EDGE_LEFT))
        end -= len(part) - len(part.rstrip(EDGE_RIGHT))
        if label == 1 and (m := re.search(r"[^\s@]+(?:\s*[(\[]at[)\]]|\s+at\s)", text[start:end], re.I)):
            start += m.start()  # an address has one word before its sign
        if start < end and plausible(KINDS[label - 1], text[start:end]):
            spans.append((KINDS[label - 1], start, end))
    return spans


def plausible(kind: str, part: str) -> bool:
    """What any span of the kind has, whatever its words."""
    digits = "".join(c for c in part if "0" <= c <= "9")
    if kind == "email":
        return bool(re.search(r"\w\s*(@|[(\[]at[)\]]|\sat\s)\s*\w.*\w\s*(\.|[(\[]dot[)\]]|\sdot\s)\s*\w", part, re.I | re.S))
    if kind == "ip":
        return part.count(":") >= 3 and re.fullmatch(r"[0-9A-Fa-f:]+", part) is not None or part.count(".") == 3
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", part)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Offsets of the tokens that str.split() gives."""
    at = 0
    for token in text.split():
        at = text.index(token, at)
        yield at, at + len(token)
        at += len(token)


# ---- training


def training_table(n: int = 900, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: sentences as tokens, with a label for each."""
    rnd = random.Random(seed)
    parts = "an be co da el fi go hu in ja ko la mi no or pa qu re si to un vi wo ex ya ze".split()

    def word():
        w = "".join(rnd.choices(parts, k=rnd.randrange(1, 4)))
        w = w.capitalize() if rnd.random() < 0.15 else w.upper() if rnd.random() < 0.05 else w
        return w + rnd.choice(["", "", "", "", ",", ".", "###", "%%%", "!!"])

    def d(k):
        return "".join(rnd.choices(string.digits, k=k))

    def card():
        body = rnd.choice("3456") + d(14)
        return next(body + c for c in string.digits if luhn(body + c))

    def email():
        user, host, end = "".join(rnd.choices(parts, k=2)) + rnd.choice(["", d(2), "." + rnd.choice(parts)]), "".join(rnd.choices(parts, k=2)), rnd.choice(sorted(TLDS))
        return rnd.choice([
            [f"{user}@{host}.{end}"], [f"{user}@{host}{d(1)}.example.{end}"], [f"{user}(at){host}.{end}"], [f"{user}[at]{host}[dot]{end}"], [f"{user}(at){host}(dot){end}"],
            [user, "at", host, "dot", end], [user, "(at)", host, "(dot)", end], [user, "[at]", host, "[dot]", end],
        ])

    def phone():
        a, b, c = d(3), d(3), d(4)
        return rnd.choice([[f"+1 ({a}) {b}-{c}"], [f"({a}) {b}-{c}"], [f"({a}) {b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a}){b}-{c}"], [f"+{d(2)} {a} {b} {c}"], [f"1-{a}-{b}-{c}"]])

    def ip():
        return rnd.choice([[".".join(str(rnd.randrange(256)) for _ in range(4))], [":".join(f"{rnd.randrange(65536):x}" for _ in range(8))], [f"2001:db8::{rnd.randrange(65536):x}:{rnd.randrange(65536):x}:{rnd.randrange(65536):x}"]])

    def card_text():
        c = card()
        return rnd.choice([[c], [" ".join(c[i : i + 4] for i in range(0, 16, 4))], ["-".join(c[i : i + 4] for i in range(0, 16, 4))], [".".join(c[i : i + 4] for i in range(0, 16, 4))]])

    def other():
        return rnd.choice([
            lambda: f"20{d(2)}-0{rnd.randrange(1, 10)}-1{d(1)}", lambda: f"1{d(1)}/0{d(1)}/20{d(2)}", lambda: f"{rnd.randrange(24)}:{d(2)}", lambda: f"1{d(1)}:{d(2)}:{d(2)}", lambda: f"${d(2)}.{d(2)}", lambda: f"${d(1)},{d(3)}",
            lambda: f"{d(1)}.{d(1)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"19{d(2)}", lambda: d(3), lambda: d(4), lambda: d(2), lambda: d(7), lambda: d(10), lambda: d(12), lambda: d(16) + "1", lambda: d(24),
            lambda: "".join(rnd.choices("0123456789abcdef", k=rnd.choice([8, 16, 32, 40]))), lambda: f'"{"".join(rnd.choices("0123456789abcdef", k=40))}"', lambda: f"#{d(5)}", lambda: f"{d(3)}-{d(3)}", lambda: f"{d(2)}-{d(2)}", lambda: f"({d(4)})", lambda: f"({d(1)})",
            lambda: f"{d(3)}-{d(4)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(3)},{d(3)}", lambda: f"{d(2)}%", lambda: f"{word()}_{d(2)}", lambda: f"{d(3)}.{d(2)}", lambda: f"@{rnd.choice(parts)}{rnd.choice(parts)}", lambda: "=", lambda: "|", lambda: f"http://{rnd.choice(parts)}.org/{d(3)}",
            lambda: f"337-{d(4)}", lambda: f"{d(3)}.{d(3)}", lambda: f"({d(3)})", lambda: f"{d(3)} {d(3)}", lambda: f"{d(1)} {d(4)} {d(2)}", lambda: f"at {word()}", lambda: f"a dot {word()}", lambda: f"card {d(3)}", lambda: f"call {word()}", lambda: f"tel {word()}", lambda: f"address {d(3)}", lambda: rnd.choice(["at", "dot", "com", "mail", "ip", "card", "server"]), lambda: f"at {word()} at {word()}", lambda: "at at at", lambda: f"at {word()} dot",
            lambda: f"password={''.join(rnd.choices('0123456789abcdef', k=18))}", lambda: f"{rnd.choice(parts)}={d(4)}", lambda: f"{word()} at {word()} of", lambda: f"{word()} at at {word()}",
        ])()

    kinds = {"email": email, "ip": ip, "card": card_text, "phone": phone}
    table = []
    for _ in range(n):
        tokens, labels = [], []
        for _ in range(rnd.randrange(1, 4)):
            for _ in range(rnd.randrange(1, 5)):
                tokens.append(word())
                labels.append("o")
            if rnd.random() < 0.55:
                kind = rnd.choice(KINDS)
                if rnd.random() < 0.25:
                    tokens.append({"email": "email:", "ip": "ip", "card": "card", "phone": "tel:"}[kind])
                    labels.append("o")
                new = [t for piece in kinds[kind]() for t in piece.split()]
                tokens += new[:-1] + [new[-1] + rnd.choice(["", "", "", ".", ",", "%%%"])]
                labels += [kind] * len(new)
            else:
                new = other().split()
                tokens += new
                labels += ["o"] * len(new)
        tokens.append(word())
        labels.append("o")
        table.append((tokens, labels))
    return table


def labelled(rows: DataFrame, tokens: str = "tokens", labels: str = "labels", most: int = 5000) -> list[tuple[list[str], list[str]]]:
    """A labelled table as training rows: arrays of tokens and of labels (o or a kind, one for each token).

    At most `most` rows are taken, those that hash lowest, each once; rows that are null, empty, of unequal lengths or
    with a label that is none are left out."""
    known = F.array(*[F.lit(x) for x in LABELS])
    fit = rows.select(F.col(tokens).alias("t"), F.col(labels).alias("y")).filter("size(t) > 0 AND size(t) = size(y)").filter((F.size(F.array_except("y", known)) == 0) & ~F.exists("t", lambda x: x.isNull()))
    drawn = fit.distinct().withColumn("h", F.xxhash64("t", "y")).orderBy("h").limit(most).collect()  # at most `most` rows
    return [(list(r.t), list(r.y)) for r in drawn]


@functools.lru_cache(maxsize=1)
def train() -> Crf:
    """The CRF that fits training_table()."""
    return fit(training_table())


def fit(table: list[tuple[list[str], list[str]]], steps: int = 160, rate: float = 0.15, ridge: float = 2e-4) -> Crf:
    """The CRF that fits a labelled table: Adam on the regularised log likelihood, over all sentences at once."""
    if not table:
        raise ValueError("no labelled rows")
    seen = [[features(t) for t in tokens] for tokens, _ in table]
    index = {name: i for i, name in enumerate(sorted({"word", *(x for s in seen for _, names in s for x in names)}))}
    n, width, k = len(table), max(len(s) for s in seen), len(LABELS)
    x = np.zeros((n, width, len(index)))
    ctx = np.zeros((n, width, 2 * len(COARSE)))
    mask = np.zeros((n, width), dtype=bool)
    y = np.zeros((n, width), dtype=int)
    for i, (s, (_, labels)) in enumerate(zip(seen, table, strict=True)):
        coarse = [0, *(COARSE.index(c) for c, _ in s), 0]
        for t, (_, names) in enumerate(s):
            x[i, t, [index[name] for name in names]] = 1
            ctx[i, t, coarse[t]] = ctx[i, t, len(COARSE) + coarse[t + 2]] = 1
            mask[i, t], y[i, t] = True, LABELS.index(labels[t])
    inputs = np.concatenate([x, ctx], axis=2)[mask]
    gold = np.eye(k)[y] * mask[:, :, None]
    both = mask[:, 1:]
    gold_moves = np.einsum("bti,btj->ij", gold[:, :-1] * both[:, :, None], gold[:, 1:])
    weights, moves = np.zeros((inputs.shape[1], k)), np.zeros((k, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]

    def lse(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = np.zeros((n, width, k))
        e[mask] = inputs @ weights
        alpha, beta = np.zeros((n, width, k)), np.zeros((n, width, k))
        alpha[:, 0] = e[:, 0]
        for t in range(1, width):
            alpha[:, t] = np.where(mask[:, t, None], e[:, t] + lse(alpha[:, t - 1][:, :, None] + moves[None], 1), alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], lse(moves[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + moves[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        for j, (w, grad) in enumerate(((weights, inputs.T @ (gold - p)[mask] / n - ridge * weights), (moves, (gold_moves - pair.sum(axis=(0, 1))) / n - ridge * moves))):
            m, v = state[2 * j], state[2 * j + 1]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    f, c = len(index), len(COARSE)
    return Crf(index, weights[:f], weights[f : f + c], weights[f + c :], moves)


# ---- over tables


def all_spans(texts: list[str | None], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base and added spans) of each text, by kind and then start."""
    plain = [t or "" for t in texts]
    out = []
    for text, more in zip(plain, model.label(plain), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        added = [s for s in more if not any(a < s[2] and s[1] < b for a, b in taken)]
        out.append((base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if added else base))
    return out


def _slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batch in parts of bounded text."""
    texts, start, held = batch.column(column), 0, 0
    for i in range(batch.num_rows):
        held += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
        if held >= most or i + 1 == batch.num_rows:
            part = batch.slice(start, i + 1 - start)
            yield part, part.column(column).to_pylist()
            start, held = i + 1, 0


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, key: str, text: str, model: Crf | None = None) -> DataFrame:
    """id, base and spans: the patterns' spans, and all spans, of each row."""
    model = model or train()
    rows = docs.select(F.col(key).alias("id"), text_or_empty(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch, 1):
                found = all_spans(texts, model)
                cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[i]] for x in found], _ARROW) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["id", "base", "spans"])

    from pyspark.sql.types import StructType

    shape = StructType([*rows.select("id").schema.fields, *StructType.fromDDL(f"base {SPANS}, spans {SPANS}").fields])
    return rows.mapInArrow(run, shape)


def blank(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str, length: str | None = None, model: Crf | None = None) -> DataFrame:
    """All rows and columns of docs, the text without personal data; length names a column with its length."""
    model, names = model or train(), docs.columns
    at = names.index(text)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch, at):
                clean = [None if t is None else blank(t, spans) for t, (_, spans) in zip(texts, all_spans(texts, model), strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(clean, part.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    out = inner.mapInArrow(run, inner.schema).toDF(*names)
    return out.withColumn(length, F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType)) if length else out


def digest(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return digest(find(read_table(spark, sf_dir, "documents"), "doc_id", "text"))
