"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

Base spans are the leftmost non-overlapping matches of one pattern a kind (email, ip, card, phone); a match that fails
its check (parts of an ip at most 255, 16 to 19 digits of a card that pass Luhn, 8 to 15 digits of a phone) is
dropped without another try. The patterns are matched in time linear in the text.

The field looks at regions: runs of tokens around a digit or an at sign, also a spelt one, to both sides as far as CONTEXT tokens. A
segment is up to LONGEST tokens of a region with one label (email, ip, card, phone, id, secret, or other for one token).
Its score is the sum of weights of features of the whole span: number of digits and of tokens, Luhn, an IBAN's check, the
mask of separators, form of an address with spelt or spaced dots, words before it. A run of 20 or more letters and digits
is one token, a code: no number is looked for in it, and it is a secret where the words before it say so. Viterbi over end, length and label chooses
boundaries and types together, over a whole region in one pass. Weights are fitted by maximum likelihood (forward-backward over segments) on TRAIN
regions that a seeded generator writes and labels; no document is learned from. Added spans don't overlap base spans
and end at letters or digits of the text. A region goes on until no digit or at sign follows near, and is decoded whole,
in time linear in its tokens; texts are searched whole.

Null and empty texts have no spans. Each row gives one row, repeated rows too; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "secret")
LONGEST, CONTEXT, TRAIN, SEED = 11, 3, 240, 7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _IP_RUN.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(int(p) <= 255 if len(p) < 10 else not p[:-3].strip("0") and int(p[-3:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each base kind in code points, end exclusive."""
    digits = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


# The field.

#: A code needs a letter and a digit; the look-behind makes a run of letters and digits one try.
_CODE = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{20,}+(?![A-Za-z0-9])"
_TOKEN = re.compile(rf"{_CODE}|[^\W\d_]+|[0-9]+|[^\w\s]|_")
#: What opens a region: a digit, an at sign, such a sign spelt in brackets, or a bare one with a spelt dot within four
#: words ("point", as in "at some point", only with a domain's ending after it).
_OPEN = re.compile(r"[0-9@]|[\[({<]\s*at\s*[\])}>]|(?<![^\W_])at(?=(?:[\W_]{1,3}[^\W_]++){1,4}?[\W_]{1,3}(?:(?:dot|punkt|punto)(?![^\W_])|point[\W_]{1,3}(?:com|org|net|edu|gov|info|fr|de|eu|es)(?![^\W_])))", re.IGNORECASE)
_LABELS = ("other", *KINDS)
_CUES = {"email": "email mail contact courriel correo", "phone": "phone tel call mobile fax telefon téléphone teléfono cell", "card": "card visa mastercard karte carte tarjeta", "ip": "ip host server address", "id": "ssn passport id social insurance identity ausweis iban", "secret": "token secret key apikey password passwort bearer clave"}
_CUE = {w: k for k, ws in _CUES.items() for w in ws.split()}
_SPELT = {"at": "@", "dot": ".", "punkt": ".", "point": ".", "punto": "."}


#: Endings of domains that tell an address from words that only look like one.
_ENDINGS = frozenset("com org net edu gov info io de fr es eu uk".split())


def _code(token: str) -> bool:
    return len(token) >= 20 and not token.isdigit() and not token.isalpha()


def _iban(joined: str) -> bool:
    """Whether joined is a country, two check digits and 11 to 30 more, whose remainder is 1."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", joined):
        return False
    return int("".join(str(int(c, 36)) for c in joined[4:] + joined[:4])) % 97 == 1


def _shape(token: str) -> str:
    low = token.lower()
    if _code(token):
        return "k"
    if token.isdigit():
        return "d"
    if low in _SPELT:
        return _SPELT[low]
    return "w" if token[0].isalpha() else token


def features(tokens: list[tuple[str, int, int]], a: int, b: int) -> list[str]:
    """Of the segment tokens[a:b]: a fixed number of features of the whole span, for any label but other."""
    part = tokens[a:b]
    digits = "".join(t for t, _, _ in part if t.isdigit())
    shape = [_shape(t) for t, _, _ in part]
    # two words with a gap between them are no part of an address
    gap = [False, *(x in "wd" and y in "wd" and q[1] > p[2] for x, y, p, q in zip(shape, shape[1:], part, part[1:]))]
    bare = "".join(" " * g + x for g, x in zip(gap, shape) if x not in "[](){}<>")
    inner = "".join(sorted({x for x in shape[1:-1] if x not in "dw"}))
    n = len(digits)
    groups = [len(t) for t, _, _ in part if t.isdigit()]
    solid = all(y[1] - x[2] <= 1 for x, y in zip(part, part[1:]))
    joined = "".join(t for t, _, _ in part)
    code = shape == ["k"]
    out = [
        f"tokens={min(b - a, 9)}", f"digits={n if n < 20 else 20}", f"inner={inner}", f"solid={solid}", f"ends={shape[0]}{shape[-1]}", f"words={min(2, shape.count('w'))}",
        f"mask={'-'.join(map(str, groups)) if len(groups) < 6 and n and len(part) > 1 else ''}",
        f"address={bool(re.fullmatch(r'[wd]([._+-]?[wd])*@[wd](-?[wd])*(\.[wd]+)+', bare))}",
        f"luhn={n >= 12 and luhn(digits)}", f"quad={len(groups) == 4 and shape[1::2] == ['.'] * 3 and all(len(t) < 4 and int(t) < 256 for t, _, _ in part[::2])}",
        f"iban={_iban(joined)}", f"code={min(len(joined), 64) // 8 if code else ''}", f"ending={part[-1][0].lower() in _ENDINGS}",
    ]
    cues = [_CUE.get(t.lower(), "") for t, _, _ in tokens[max(0, a - CONTEXT) : a]]
    out.append("cue=" + next((c for c in reversed(cues) if c), ""))
    out.append("next=" + _shape(tokens[b][0]) if b < len(tokens) and tokens[b][1] == part[-1][2] else "next=end")
    out.append("before=" + (_shape(tokens[a - 1][0]) if a and tokens[a - 1][2] == part[0][1] else "none"))
    return out


def _fits(kind: str, fs: list[str]) -> bool:
    """What a segment of this kind must be, whatever its weights: the field chooses among forms, it doesn't loosen them."""
    n = int(fs[1][7:])
    if "iban=True" in fs:
        return kind == "id"
    if "code=" not in fs:
        return kind == "secret"
    if kind == "email":
        return "address=True" in fs
    if kind == "ip":
        return "quad=True" in fs
    if "words=0" not in fs or "before=w" in fs or "next=w" in fs:
        return False  # part of a longer run of letters and digits
    if kind == "card":
        return "luhn=True" in fs and 13 <= n <= 19
    if kind == "phone":
        return 7 <= n <= 15 and "address=False" in fs
    return kind == "id" and 7 <= n <= 12 and "mask=" not in fs


class Field:
    """A semi-Markov conditional random field of order 0: labels of neighbouring segments are tied by their boundaries."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights or {}

    def ending(self, tokens, b: int) -> list[tuple[int, str, list[str]]]:
        """Start, label and features of each segment that ends at b. An entity starts and ends with a letter or digit, or
        starts with a plus or bracket, has no gap over two characters, and is a code, or holds an at sign or six digits
        (and letters too only as an IBAN)."""
        here = [(b - 1, "other", [])]
        if not tokens[b - 1][0][-1].isalnum():
            return here
        n, at, words = 0, False, False
        for a in range(b - 1, max(0, b - LONGEST) - 1, -1):
            t, _, end = tokens[a]
            if a < b - 1 and tokens[a + 1][1] - end > 2:
                break
            code = _code(t)
            if code and a < b - 1:
                break
            if t.isdigit():
                n += len(t)
            elif t == "@" or t.lower() == "at":
                at = True
            elif t[0].isalpha():
                words = True
            if (t[0].isalnum() or t[0] in "+(") and (code or at or n >= 6 and (not words or len(t) == 2 and t.isupper())):
                fs = features(tokens, a, b)
                here += [(a, k, fs) for k in KINDS if _fits(k, fs)]
            if code:
                break
        return here

    def segments(self, tokens) -> list[list[tuple[int, str, list[str]]]]:
        """By end: start, label and features of each segment."""
        return [self.ending(tokens, b) for b in range(1, len(tokens) + 1)]

    def scored(self, by_end):
        get = self.weights.get
        return [[(a, k, sum([get((k, f), 0.0) for f in fs]), fs) for a, k, fs in here] for here in by_end]

    def decode(self, tokens) -> list[tuple[str, int, int]]:
        """Kind, start and end (in tokens) of the entities of the best segmentation."""
        best, back = [0.0], [None]
        for b in range(1, len(tokens) + 1):
            (here,) = self.scored([self.ending(tokens, b)])
            score, seg = max(((best[a] + s, (a, k)) for a, k, s, _ in here), key=lambda x: x[0])
            best.append(score)
            back.append(seg)
        out, b = [], len(tokens)
        while b:
            a, k = back[b]
            if k != "other":
                out.append((k, a, b))
            b = a
        return out[::-1]

    def gradient(self, segments, gold: list[tuple[str, int, int]]) -> tuple[float, dict]:
        """Log-likelihood of gold and its gradient, by forward-backward over segments."""
        by_end = self.scored(segments)
        n = len(by_end)
        log_add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
        forward = [0.0]
        for here in by_end:
            forward.append(log_add([forward[a] + s for a, _, s, _ in here]))
        ahead: list[list[float]] = [[] for _ in range(n + 1)]
        backward = [0.0] * (n + 1)
        for b in range(n, 0, -1):
            if b < n:
                backward[b] = log_add(ahead[b])
            for a, _, s, _ in by_end[b - 1]:
                ahead[a].append(s + backward[b])
        grad: dict = defaultdict(float)
        want = {(a, b): k for k, a, b in gold}
        total = -forward[n]
        for b, here in enumerate(by_end, 1):
            for a, k, s, fs in here:
                if not fs:
                    continue
                p = math.exp(forward[a] + s + backward[b] - forward[n])
                hit = want.get((a, b)) == k
                if hit:
                    total += s
                if abs(hit - p) > 1e-6:
                    for f in fs:
                        grad[k, f] += hit - p
        return total, grad


def tokenise(text: str, start: int = 0, stop: int | None = None) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, start, len(text) if stop is None else stop)]


def examples(n: int = TRAIN, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with the character spans of their entities, from a seeded generator: each kind in several written forms,
    and numbers that are none (dates, sums, versions, counts, codes)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrstmdk") for _ in range(rng.randint(2, 8)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        body = rng.choice("3456") + digits(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice(["", " ", "-", "."]).join([number[i : i + 4] for i in range(0, 16, 4)])

    def email():
        at, dot = rng.choice([("@", "."), (" @ ", " . "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot ")])
        return f"{word()}{rng.choice(['', '.' + word(), digits(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"

    def phone():
        return rng.choice([lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"0{digits(2)} {digits(3)} {digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"])()

    def iban():
        country, body = rng.choice(["DE", "FR", "ES", "GB"]), digits(rng.randint(14, 20))
        number = next(x for c in range(2, 99) if _iban(x := f"{country}{c:02d}{body}"))
        return rng.choice(["", " "]).join([number[i : i + 4] for i in range(0, len(number), 4)])

    def code():
        return "".join(rng.choice(rng.choice(["0123456789abcdef", "0123456789abcdefghijkLMNOPQRSTUVWXYZ"])) for _ in range(rng.choice([20, 24, 32, 40, 64])))

    def secret():
        mark = rng.choice([("", ""), ('"', '"'), ("'", "'")])
        return rng.choice(_CUES["secret"].split()) + rng.choice([" ", ": ", " = ", "="]) + mark[0], code(), mark[1]

    make = {"card": card, "email": email, "phone": phone, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "id": lambda: rng.choice([iban, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"])()}
    plain = [lambda: f"{rng.choice(['commit', 'sha', 'file', 'see'])} {code()}", lambda: f"{word()} at {digits(2)} dot {word()}", lambda: f"{word()} at {word()} dot {word()}",
             lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: digits(rng.randint(1, 12)), lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"{digits(2)},{digits(3)}.{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(5)}-{digits(4)}", lambda: f"{word()} at {word()}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(4)} {digits(4)}", lambda: digits(rng.randint(16, 24))]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", ", ", ": "])
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                if kind == "secret":
                    before, x, after = secret()
                    text += before
                    spans.append((kind, len(text), len(text) + len(x)))
                    text += x + after + rng.choice([" ", ". ", ", "])
                    continue
                if rng.random() < 0.5:
                    text += rng.choice(_CUES[kind].split()) + rng.choice([" ", ": "])
                x = make[kind]()
                spans.append((kind, len(text), len(text) + len(x)))
            else:
                x = rng.choice(plain)()
            text += x + rng.choice([" ", ". ", ", "])
        out.append((text + word(), spans))
    return out


def learn(n: int = TRAIN, seed: int = SEED, rounds: int = 12, rate: float = 0.5) -> Field:
    """Weights by adaptive gradient ascent on the likelihood of examples(); the same for the same arguments."""
    field, power = Field(), defaultdict(lambda: 1e-3)
    data = []
    for text, spans in examples(n, seed):
        tokens = tokenise(text)
        start, end = {t[1]: i for i, t in enumerate(tokens)}, {t[2]: i + 1 for i, t in enumerate(tokens)}
        gold = [(k, start[a], end[b]) for k, a, b in spans]
        if any(b - a > LONGEST for _, a, b in gold):
            raise ValueError(f"an entity of the examples has over {LONGEST} tokens: {text}")
        data.append((field.segments(tokens), gold))
    for _ in range(rounds):
        for segments, gold in data:
            _, grad = field.gradient(segments, gold)
            for k, g in grad.items():
                power[k] += g * g
                field.weights[k] = field.weights.get(k, 0.0) + rate * g / math.sqrt(power[k])
    return field


def regions(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Tokens of each region, whole however long; regions whose surroundings touch are one."""
    end = 0
    m = _OPEN.search(text)
    while m:
        start = max(m.start() - 48, end)
        # not within a word
        while start > end and text[start - 1].isalnum():
            start -= 1
        stop = m.start()
        while m and m.start() - 48 <= stop:
            if m.end() + 48 > stop:
                stop = min(len(text), m.end() + 48)
                while stop < len(text) and text[stop].isalnum():
                    stop += 1
            m = _OPEN.search(text, m.end())
        end = stop
        yield tokenise(text, start, stop)


def spans_of(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base ones and those that the field adds. By kind in the order of KINDS, then start."""
    found = base_spans(text)
    base = [(k, a, b) for k in BASE for a, b in found[k]]
    taken = sorted((a, b) for _, a, b in base)
    added = set()
    if "@" in text or _OPEN.search(text):
        for tokens in regions(text):
            if not any(map(str.isdigit, "".join([t for t, _, _ in tokens]))) and not any(t == "@" or t.lower() == "at" for t, _, _ in tokens):
                continue
            for kind, a, b in field.decode(tokens):
                added.add((tokens[a][1], tokens[b - 1][2], kind))
    end, extra, k = -1, [], 0
    for a, b, kind in sorted(added, key=lambda x: (x[0], -x[1], x[2])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= end and not any(x < b and a < y for x, y in taken[max(0, k - 1) : k + 4]):
            extra.append((kind, a, b))
            end = b
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + extra, key=lambda x: (order[x[0]], x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of base spans), spans (all) and n_spans of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(field or learn())
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every, n = [], [], []
            for text in b.column(1).to_pylist():
                x, y = spans_of(text or "", shared.value)
                base.append(x)
                every.append(joined(y))
                n.append(len(y))
            counts = [pa.array([sum([k == kind for k, _, _ in x]) for x in base], pa.int64()) for kind in BASE]
            sha = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array(n, pa.int64())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
