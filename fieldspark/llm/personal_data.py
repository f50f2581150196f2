"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

The field works on windows of tokens around marks: digits, @ signs and the word at. Every stretch of up to ``MAX_TOKENS`` tokens is a candidate
segment, and every longer one of an open-ended shape (``LONG``); features of
the whole span (its shape, digit groups, checks such as Luhn's, neighbours and the word before) score it for each kind, and tokens outside
any segment have their own score. A dynamic program over the window finds the best segmentation, so boundaries and kinds are chosen together;
longer stretches are the matches of ``LONG``, which do not overlap, so the work is linear in the text. The field is trained here, by maximum likelihood on sentences
from a seeded generator (``TRAINING`` of them): forward-backward over segments gives the gradient.

Exact spans always stay; found spans are added where they touch none of them. Offsets are code points, end exclusive.

Odd inputs: null texts are empty and have no spans; repeated rows each give their row; an empty table gives an empty result. Columns that
clash with the new ones are replaced.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.common import table
from fieldspark.llm.queries import query
from fieldspark.llm.words import text_buffers, with_columns

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 14
#: Tokens between two marks (digits, @, at) of one window, and tokens around them.
GAP, MARGIN = 3, 2
TRAINING, EPOCHS, SEED = 260, 18, 11

# a run of the first class that does not lead to an @ is passed over in one step, so long texts stay linear
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?P<host>@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the exact patterns."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text) if m["host"]]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m[0])]
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start():
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- windows and candidate segments ---------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W_]+|_|[^\w\s]|\s")
MARK = re.compile(r"[0-9@]|(?i:\bat\b)")
#: Spelled addresses and international numbers of any length; linear, as runs are passed over in one step.
LONG = re.compile(
    r"(?<![\w.-])[.-]*+(?P<spelled>\w[\w.-]*+ ?[\[( ]at[\]) ] ?[\w-]++(?: ?[\[( ]dot[\]) ] ?\w++|\.\w++)++)"
    r"|(?<!\w)(?P<number>(?:\+|00)[0-9]{1,3}(?:[ .()-]++[0-9]++)++)", re.I)  # fmt: skip


def windows(text: str):
    """Lists of (start, end) of tokens: stretches around marks, with the whole of a long shape that they touch."""
    stretch_end = -1
    spans = []
    for m in MARK.finditer(text):
        if m.start() < stretch_end:
            continue
        lo, hi = max(0, m.start() - 48), m.end()
        # on to the last mark that is near the one before
        while True:
            nxt = MARK.search(text, hi, hi + 24)
            if not nxt:
                break
            hi = nxt.end()
        stretch_end = hi
        spans.append((lo, min(len(text), hi + 48), hi))
    shapes = [m.span(m.lastgroup) for m in LONG.finditer(text)] if spans else []
    at = 0
    for lo, upto, last in spans:
        while lo > 0 and not text[lo].isspace() and lo > upto - 4096:
            lo -= 1
        while at < len(shapes) and shapes[at][1] <= lo:
            at += 1
        k = at
        while k < len(shapes) and shapes[k][0] < last:
            lo, upto = min(lo, shapes[k][0]), max(upto, shapes[k][1])
            k += 1
        yield [(lo + m.start(), lo + m.end()) for m in TOKEN.finditer(text[lo:upto])]


CUES = {"tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "cell": "phone", "mail": "email", "email": "email",
        "contact": "email", "write": "email", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "server": "ip", "address": "ip",
        "version": "number", "v": "number", "page": "number", "order": "number", "no": "number", "id": "number", "year": "number", "eur": "number"}
SHAPES = [
    ("email", re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+")),
    ("spelled email", re.compile(r"[\w.-]+ ?[\[( ]at[\]) ] ?[\w-]+( ?[\[( ]dot[\]) ] ?\w+|\.\w+)+", re.I)),
    ("four parts", re.compile(r"[0-9]+(\.[0-9]+){3}")),
    ("grouped", re.compile(r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}")),
    ("area", re.compile(r"\([0-9]{2,4}\) ?[0-9]{3,4}[- .][0-9]{3,4}")),
    ("international", re.compile(r"(\+|00)[0-9]{1,3}([ .()-]+[0-9]+)+")),
    ("fours", re.compile(r"[0-9]{4}([ .-][0-9]{4}){3}")),
    ("plain", re.compile(r"[0-9]+")),
    ("date", re.compile(r"[0-9]{1,4}([-./])[0-9]{1,2}\1[0-9]{1,4}")),
]
def _bucket(n: int) -> str:
    return str(n) if n <= 4 else "5-6" if n <= 6 else "7-8" if n <= 8 else str(n) if n <= 16 else "17-19" if n <= 19 else "more"


def segment_features(text: str, tokens: list, i: int, j: int, cue: str) -> tuple[str, ...]:
    """Features of the span of tokens i to j (exclusive)."""
    start, end = tokens[i][0], tokens[j - 1][1]
    s = text[start:end]
    d = _digits(s)
    shape = next((name for name, rule in SHAPES if rule.fullmatch(s)), "none")
    before = text[start - 1] if start else " "
    after = text[end : end + 2] + "  "
    dirty_left = before.isalnum() or before in "+@_-./=\"'" or (before == "(" and not s.startswith("(") and ")" in s)
    dirty_right = after[0].isalnum() or after[0] in "@_=" or (after[0] in "-./:" and after[1].isalnum())
    check = "none"
    if shape == "four parts":
        check = "small" if small_parts(s) else "large"
    elif 12 <= len(d) <= 19 and len(d) + s.count(" ") + s.count("-") + s.count(".") == len(s):
        check = "luhn" if luhn(d) else "no luhn"
    return ("bias", f"shape {shape}", f"digits {_bucket(len(d))}", f"check {check}", f"left {dirty_left}", f"right {dirty_right}",
             f"cue {cue}", f"shape {shape} cue {cue}", f"shape {shape} check {check}", f"plus {s[0] == '+'}", f"end {s[-1].isalnum()}",
             f"begin {s[0].isalnum() or s[0] in '+('}", f"spaces {min(3, s.count(' '))}", f"tokens {min(12, j - i)}",
             f"letters {any(c.isalpha() for c in s)}")


def candidate_segments(text: str, tokens: list, names: dict[str, int], grow: bool = False):
    """(i, j, feature numbers) of all segments that may be an entity: they hold a digit, an @ or the word at, and no line break; long shapes last."""
    flags = [bool(MARK.search(text[a:b])) for a, b in tokens]
    upto = np.concatenate(([0], np.cumsum(flags)))
    blank = [text[a].isspace() for a, _ in tokens]
    cue = "none"
    cues = []
    for a, b in tokens:
        cues.append(cue)
        word = text[a:b].lower()
        if word in CUES:
            cue = CUES[word]
        elif word.isalnum() and not word.isdigit() and len(word) > 1:
            cue = "none"
    for i in range(len(tokens)):
        if blank[i] or text[tokens[i][0]] in ".,;:)]-=\"'/":
            continue
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            if text[tokens[j - 1][0]] in "\n\r":
                break
            if blank[j - 1] or upto[j] == upto[i] or not text[tokens[j - 1][1] - 1].isalnum():
                continue
            found = segment_features(text, tokens, i, j, cues[i])
            # a feature that training never saw counts like the bias
            yield i, j, [names.setdefault(f, len(names)) if grow else names.get(f, 0) for f in found]
    if len(tokens) <= MAX_TOKENS:
        return
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: j for j, (_, b) in enumerate(tokens, 1)}
    for m in LONG.finditer(text, tokens[0][0], tokens[-1][1]):
        i, j = starts.get(m.start(m.lastgroup), -1), ends.get(m.end(), -1)
        if i >= 0 and j > i + MAX_TOKENS:
            found = segment_features(text, tokens, i, j, cues[i])
            yield i, j, [names.setdefault(f, len(names)) if grow else names.get(f, 0) for f in found]


class Field:
    """Weights of kinds by feature, and of tokens outside (with a mark or without)."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weights = np.zeros((len(KINDS), len(names)))
        self.outside = np.zeros(2)

    def scores(self, segments) -> np.ndarray:
        return self.weights[:, np.array([f for _, _, f in segments])].sum(2).T if segments else np.zeros((0, len(KINDS)))

    def outside_scores(self, text: str, tokens: list) -> np.ndarray:
        return self.outside[[int(bool(MARK.search(text[a:b]))) for a, b in tokens]]

    def best(self, text: str, tokens: list) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the best segmentation of a window."""
        segments = list(candidate_segments(text, tokens, self.names))
        if not segments:
            return []
        scores = self.scores(segments)
        top, kind = scores.max(1), scores.argmax(1)
        ending: dict[int, list[int]] = {}
        for k, (_, j, _) in enumerate(segments):
            ending.setdefault(j, []).append(k)
        outside = self.outside_scores(text, tokens)
        value, choice = [0.0], [-1]
        for j in range(1, len(tokens) + 1):
            v, c = value[j - 1] + outside[j - 1], -1
            for k in ending.get(j, ()):
                w = value[segments[k][0]] + top[k]
                if w > v:
                    v, c = w, k
            value.append(v)
            choice.append(c)
        out, j = [], len(tokens)
        while j:
            if (k := choice[j]) < 0:
                j -= 1
            else:
                i = segments[k][0]
                out.append((tokens[i][0], int(kind[k]), tokens[j - 1][1]))
                j = i
        return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(np.exp(np.array(values) - top).sum()))


def gradient(field: Field, text: str, tokens: list, segments: list, gold: set) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the log likelihood of one window by forward-backward over segments."""
    scores, outside = field.scores(segments), field.outside_scores(text, tokens)
    n = len(tokens)
    into, out = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    total = np.array([_log_sum(list(r)) for r in scores]) if len(scores) else np.zeros(0)
    for k, (i, j, _) in enumerate(segments):
        into[j].append(k)
        out[i].append(k)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = _log_sum([alpha[j - 1] + outside[j - 1], *[alpha[segments[k][0]] + total[k] for k in into[j]]])
    for i in range(n - 1, -1, -1):
        beta[i] = _log_sum([beta[i + 1] + outside[i], *[beta[segments[k][1]] + total[k] for k in out[i]]])
    z = alpha[n]
    dw, do = np.zeros_like(field.weights), np.zeros(2)
    covered, likelihood = np.zeros(n, bool), -z
    for k, (i, j, f) in enumerate(segments):
        p = np.exp(alpha[i] + scores[k] + beta[j] - z)
        for kind in range(len(KINDS)):
            g = -p[kind]
            if (tokens[i][0], kind, tokens[j - 1][1]) in gold:
                g += 1
                covered[i:j] = True
                likelihood += scores[k, kind]
            if abs(g) > 1e-6:
                np.add.at(dw[kind], f, g)
    for t, (a, b) in enumerate(tokens):
        mark = int(bool(MARK.search(text[a:b])))
        do[mark] += (not covered[t]) - np.exp(alpha[t] + outside[t] + beta[t + 1] - z)
        likelihood += (not covered[t]) * outside[t]
    return dw, do, likelihood


# --- training sentences ----------------------------------------------------------------------------------------------------------


def _luhn_number(rng: random.Random, n: int, good: bool) -> str:
    while True:
        s = "4" + "".join(rng.choice("0123456789") for _ in range(n - 1))
        if luhn(s) == good:
            return s


def sentence(rng: random.Random) -> tuple[str, set]:
    """A line with entities and look-alikes, and the (start, kind number, end) of its entities."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 7)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    area = lambda: rng.choice("23456789") + num(2)
    entity = [
        (0, lambda: f"{word()}.{num(2)}@{word()}.{word()}.com"), (0, lambda: f"{word()}@{word()}.org"),
        (0, lambda: f"{word()} at {word()} dot com"), (0, lambda: f"{word()}.{word()} [at] {word()}.org"),
        (0, lambda: f"{word()}.{word()} [at] {word()} [dot] com"), (0, lambda: f"{word()} (at) {word()} (dot) {word()} (dot) org"),
        (1, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        (2, lambda: _luhn_number(rng, 16, True)), (2, lambda: (s := _luhn_number(rng, 16, True)) and " ".join(s[k : k + 4] for k in range(0, 16, 4))),
        (2, lambda: (s := _luhn_number(rng, 16, True)) and ".".join(s[k : k + 4] for k in range(0, 16, 4))),
        (3, lambda: f"+1 ({area()}) {num(3)}-{num(4)}"), (3, lambda: f"+{num(2)} {num(3)} {num(6)}"),
        (3, lambda: f"({area()}) {num(3)}-{num(4)}"), (3, lambda: f"{area()}-{num(3)}-{num(4)}"), (3, lambda: f"{area()}.{num(3)}.{num(4)}"),
    ]
    other = [
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1900, 2030)}", lambda: num(rng.randint(1, 8)),
        lambda: f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)}", lambda: _luhn_number(rng, 16, False), lambda: f"{num(2)}:{num(2)}",
        lambda: f"{rng.randint(256, 999)}.{num(2)}.{num(2)}.{num(3)}", lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(3)},{num(3)}.{num(2)}",
        lambda: f"{word()}={word()}{num(5)}{word()}{num(3)}", lambda: f"AK{num(3)}B{num(2)}CD", lambda: f"@{word()}", lambda: f"{word()} at {word()}",
        lambda: f"{num(3)}-{num(2)}", lambda: f"{num(4)}-{num(4)}", lambda: f"{num(10)}", lambda: f"{word()} at {rng.randint(1, 12)}",
        lambda: _luhn_number(rng, 16, False)[:4] + " " + num(4) + " " + num(3), lambda: f"{num(3)} {num(2)} {num(4)}",
    ]
    cues = [["mail", "contact", "write"], ["ip", "host", "server"], ["card", "visa"], ["tel", "phone", "call", "fax"]]
    text, gold = " ".join(word() for _ in range(rng.randint(1, 4))) + " ", set()
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.55:
            kind, make = rng.choice(entity)
            if rng.random() < 0.4:
                text += rng.choice(cues[kind]) + rng.choice([" ", ": "])
            elif rng.random() < 0.2:
                text += rng.choice(["order", "page", "no"]) + " " + num(2) + " " + word() + " "
            s = make()
            gold.add((len(text), kind, len(text) + len(s)))
        else:
            s = rng.choice(other)()
            if rng.random() < 0.3:
                s = rng.choice(["version", "order", "page", "id", "year"]) + " " + s
        text += s + rng.choice([" ", " ", ", ", ". ", "\n"]) + " ".join(word() for _ in range(rng.randint(1, 4))) + " "
    return text, gold


@functools.cache
def train(n: int = TRAINING, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """Maximum likelihood with adaptive steps and a small quadratic penalty."""
    rng = random.Random(seed)
    examples, names = [], {"bias": 0}
    for _ in range(n):
        text, gold = sentence(rng)
        for tokens in windows(text):
            examples.append((text, tokens, list(candidate_segments(text, tokens, names, grow=True)), gold))
    field = Field(names)
    field.outside[:] = 1.0, 0.5
    sums, sums_outside = np.full(field.weights.shape, 1e-2), np.full(2, 1e-2)
    for _ in range(epochs):
        rng.shuffle(examples)
        for example in examples:
            dw, do, _ = gradient(field, *example)
            dw -= 1e-4 * field.weights
            sums += dw * dw
            sums_outside += do * do
            field.weights += 0.3 * dw / np.sqrt(sums)
            field.outside += 0.3 * do / np.sqrt(sums_outside)
    return field


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """(exact spans, all spans) as (start, kind number, end)."""
    base = base_spans(text)
    taken = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in taken]
    added = set()
    for tokens in windows(text):
        for s, kind, e in field.best(text, tokens):
            k = np.searchsorted(starts, e)
            if all(not (s < b and a < e) for a, b in taken[max(0, k - 4) : k]) and all(e <= a or b <= s for a, _, b in added if a < e):
                added.add((s, kind, e))
    return base, sorted([*base, *added])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("base_spans", SPAN), T.StructField("all_spans", SPAN)]
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base_spans (exact patterns) and all_spans (with those of the field), by start, then kind as listed."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def scan(column):
        field = shared.value
        raw, at = text_buffers(column)
        marks = np.concatenate(([0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64))))
        rows = marks[at[1:]] > marks[at[:-1]]  # without a digit, an @ or the word at there is nothing to find
        rows |= pc.fill_null(pc.match_substring_regex(column, r"(?i)\bat\b"), False).to_numpy(zero_copy_only=False)
        base, every = [[] for _ in rows], [[] for _ in rows]
        for r in np.flatnonzero(rows):
            base[r], every[r] = ([(KINDS[k], s, e) for s, k, e in spans] for spans in all_spans(column[int(r)].as_py(), field))
        return [pa.array(base, _ARROW), pa.array(every, _ARROW)]

    return with_columns(docs, text, FIELDS, scan)


def joined(spans: str):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans")
    )
