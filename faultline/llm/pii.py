"""Personal data in texts: strict patterns first, then candidates that boosted trees accept.

What a strict pattern matches is always a finding. Beside these, generators of high recall propose
spans in looser writing, which may overlap: spelt-out or bracketed addresses, parted or bracketed
IP numbers, card numbers inside longer runs of digits, telephone numbers without a plus sign.
Boosted trees judge a candidate by its format and its surroundings; its probability, calibrated on
rows that the trees have not seen, is held against a threshold per kind that is chosen for
precision. The trees are fitted on the driver, on writings of each kind and on lookalikes, set into
passages from a bounded sample of the corpus.
"""

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import boosting
from faultline.llm.batches import by_bytes, texts

KINDS = ("email", "ip", "card", "phone")
#: The fit sees this many passages of this many characters.
PASSAGES, PASSAGE_CHARS = 400, 2000
PRECISION = 0.99
#: Examples for the trees and their calibration, and further ones for the limits.
FITTED, UNSEEN = 4000, 4000
SLICE_BYTES = 2 << 20
NEAR = 40

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# A match can only begin where a run of digits does, and giving digits back never helps: these find
# what the plain patterns find, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: what may stand before an at sign reaches back to the end of the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while start > free and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if domain and start < at:
            yield "email", start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def strict(text: str) -> list[Span]:
    """Matches of the strict patterns by kind, then start."""
    out = list(emails(text))
    if not HAS_DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


HAS_DIGIT = re.compile(r"[0-9]")
#: Generators: an at word, what follows it, a name before it; clusters of digits and their groups.
AT = re.compile(r" ?[\[({] ?at ?[\])}] ?| at | @ |@", re.I)
AFTER = re.compile(r"[a-z0-9-]{1,63}(?:(?: ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot | \. |\.)[a-z0-9-]{1,63}){1,4}", re.I)
CLUSTER = re.compile(r"\(?[0-9](?:[ ().\[\]-]{0,3}[0-9])++")
LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}(?![0-9])")
GROUP = re.compile(r"[0-9]+")
CUES = {
    "email": re.compile(r"mail|contact|write|address|courriel|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|addr", re.I),
    "card": re.compile(r"card|visa|credit|carte|tarjeta|karte", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|cell", re.I),
}


def candidates(text: str) -> Iterator[Span]:
    """Loosely written spans; they may overlap each other and strict ones."""
    for at in AT.finditer(text):
        after = AFTER.match(text, at.end())
        if after:
            before = LOCAL.search(text, max(0, at.start() - 64), at.start())
            if before and before.start() < before.end():
                yield "email", before.start(), after.end()
    if not HAS_DIGIT.search(text):
        return
    for c in CLUSTER.finditer(text):
        if c.end() - c.start() < 7:
            continue
        for m in LOOSE_IP.finditer(text, *c.span()):
            yield "ip", *m.span()
        groups = [(m.start(), m.end()) for m in GROUP.finditer(text, *c.span())]
        total = sum(e - s for s, e in groups)
        if 8 <= total <= 15 and len(groups) > 1:
            yield "phone", *c.span()
        for i, (start, _) in enumerate(groups):
            size = 0
            for s, e in groups[i : i + 19]:
                size += e - s
                if size > 19:
                    break
                if size >= 16:
                    yield "card", start, e


FEATURES = 22


def features(text: str, span: Span) -> list[float]:
    """Format of a span and of what is around it."""
    kind, start, end = span
    own, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
    digits = digits_of(own)
    groups = [len(g) for g in GROUP.findall(own)]
    parts = GROUP.findall(own)
    octets = len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    domain = re.split(r"[^A-Za-z0-9-]+", own)
    near = before + after
    return [
        *(kind == k for k in KINDS), len(own), len(digits), luhn(digits) if digits else 0, octets, len(groups), max(groups, default=0), groups[-1] if groups else 0,
        own.startswith("("), len(set(re.sub(r"[A-Za-z0-9]", "", own))), bool(re.search(r"[\[({]", own)), bool(re.search(r"\bat\b.*\bdot\b", own, re.I)),
        bool(re.search(r" ?@ ?", own)), len(domain[-1]) if domain else 0, bool(CUES[kind].search(before)), before[-1:].isalnum() or after[:1].isalnum(),
        sum(c.isdigit() for c in near), before[-1:] in "+.-_/=#" and before != "", bool(re.search(r"dot|\.", own, re.I)),
    ]


class Clear:
    """Spans in order of start, to ask whether another one overlaps any of them."""

    def __init__(self, spans: list[Span]):
        # strict spans of different kinds may overlap each other: what they cover together
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def of(self, span: Span) -> bool:
        at = bisect.bisect_left(self.starts, span[2])
        return at == 0 or self.ends[at - 1] <= span[1]

    def add(self, span: Span) -> None:
        at = bisect.bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


@dataclass
class Model:
    trees: boosting.Trees
    limits: dict[str, float] = field(default_factory=dict)

    def accepted(self, text: str, known: list[Span]) -> list[tuple[str, int, int, float]]:
        """Candidates over their threshold, the likeliest first where they overlap, clear of ``known``."""
        clear = Clear(known)
        rows = [c for c in dict.fromkeys(candidates(text)) if clear.of(c)]
        # no tree accepts a card number with a wrong check digit; long tables of digits are full of them
        rows = [c for c in rows if c[0] != "card" or luhn(digits_of(text[c[1] : c[2]]))]
        if not rows:
            return []
        p = self.trees.probability(np.array([features(text, c) for c in rows], float))
        taken = []
        for k in np.lexsort((np.arange(len(rows)), -p)):
            if p[k] >= self.limits[rows[k][0]] and clear.of(rows[k]):
                clear.add(rows[k])
                taken.append((*rows[k], float(p[k])))
        return taken


def card_number(rng: random.Random, size: int = 16) -> str:
    body = "".join(rng.choices("0123456789", k=size - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def writings(rng: random.Random, kind: str) -> tuple[str, str, str]:
    """A span of the kind in loose writing, with what goes before and after it."""
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    if kind == "email":
        name, host, top = (rng.choice(["ana", "j.doe", "info", "k_w", "max"]) + n(rng.randint(0, 3)), rng.choice(["mail", "corp", "web"]) + n(1), rng.choice(["com", "org", "net", "de", "fr"]))
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[.]"), (" @ ", " . "), (" (at) ", " (dot) ")])
        return "", name + at + host + dot + top, ""
    if kind == "ip":
        return "", rng.choice(["[.]", " . ", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4)), ""
    if kind == "card":
        own = card_number(rng)
        own = rng.choice([own, " ".join(own[i : i + 4] for i in range(0, 16, 4)), "-".join(own[i : i + 4] for i in range(0, 16, 4))])
        return rng.choice([("", own, " " + n(rng.randint(1, 5))), (n(rng.randint(1, 5)) + " ", own, ""), ("", own, " " + card_number(rng))])
    return "", rng.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"00{n(2)} {n(2)} {n(7)}", f"0{n(3)} {n(3)} {n(4)}"]), ""


def lookalike(rng: random.Random) -> str:
    """Writing that a generator may propose and that is nothing personal."""
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    return rng.choice([
        lambda: n(16), lambda: n(rng.randint(7, 19)), lambda: " ".join(n(2) for _ in range(rng.randint(4, 9))), lambda: f"{n(1)}.{n(1)}.{n(1)}.{rng.randint(256, 999)}",
        lambda: f"20{n(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} {rng.randint(10, 23)}.{rng.randint(10, 59)}", lambda: f"{n(4)} {n(4)} {n(4)} {n(4)}",
        lambda: f"{n(2)}.{n(3)} {n(2)}.{n(3)}", lambda: f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", lambda: f"{n(3)}[.]{n(1)}[.]{rng.randint(256, 999)}[.]{n(2)}", lambda: f"{n(7)} {n(7)}",
        lambda: "look at " + rng.choice(["the end. Then", "this. And", "a.b"]), lambda: f"user{n(2)}@localhost", lambda: f"{n(16)} {n(16)}",
    ])()


def examples(rng: random.Random, passages: list[str], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, truth and kind of the candidates in passages into which writings and lookalikes are set."""
    xs, ys, kinds = [], [], []
    for n in range(count):
        words = rng.choice(passages).split(" ")
        at = rng.randint(0, len(words))
        left, right = " ".join(words[max(0, at - 12) : at]), " ".join(words[at : at + 12])
        if n % 2:
            kind = KINDS[n // 2 % 4]
            before, own, after = writings(rng, kind)
        else:
            kind, before, own, after = "", "", lookalike(rng), ""
        cue = rng.choice(["", "", "", " tel", " mail", " card", " host"])
        text = f"{left}{cue} {before}{own}{after} {right}"
        start = len(left) + len(cue) + 1 + len(before)
        clear = Clear(strict(text))
        for c in dict.fromkeys(candidates(text)):
            if clear.of(c):
                xs.append(features(text, c))
                ys.append(c == (kind, start, start + len(own)))
                kinds.append(c[0])
    return np.array(xs, float), np.array(ys, float), np.array(kinds)


def fit(passages: list[str], seed: int = 5) -> Model:
    """A model from passages into which writings of every kind and lookalikes are set.

    The limit of a kind is the least probability from which on PRECISION of the candidates are
    right, among examples that neither the trees nor their calibration have seen.
    """
    rng = random.Random(seed)
    passages = [p for p in passages if p.strip()] or ["some plain words without any number in them " * 5]
    trees = boosting.fit(*examples(rng, passages, FITTED)[:2])
    x, y, kinds = examples(rng, passages, UNSEEN)
    p, limits = trees.probability(x), {}
    for kind in KINDS:
        order = np.flatnonzero(kinds == kind)
        order = order[np.argsort(-p[order], kind="stable")]
        right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(right >= PRECISION)
        limits[kind] = float(p[order[enough[-1]]]) if len(enough) else 2.0
    return Model(trees, limits)


def learn(docs: DataFrame, passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> Model:
    """A model for this corpus from a passage of each of ``passages`` documents, those with the least text hash.

    The passage begins at a place drawn from the hash of the text, so any part of a text may be seen.
    """
    text = F.col("text").cast("string")
    place = F.pmod(F.xxhash64(F.lit("place"), text), F.greatest(F.length(text) - chars, F.lit(0)) + 1) + 1
    some = docs.filter("text IS NOT NULL").select(F.xxhash64(text).alias("mark"), F.substr(text, place.cast("int"), F.lit(chars)).alias("text"))
    # Gathered in a task: a bare limit would send that many rows of every partition to the driver.
    return fit(sorted(some.orderBy("mark").limit(passages).agg(F.collect_list("text")).first()[0]))


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``spans`` (kind, start, end, strict, score) and ``redacted`` for every row.

    Positions count code points, the end is exclusive; spans are in order of kind, as in ``KINDS``,
    and start. In ``redacted`` every span is replaced by its kind in brackets, overlapping spans by
    the kind of the first. Null texts are empty; repeated rows, null ids and further columns change
    nothing; an empty table gives an empty result.
    """
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = wanted.schema["id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", SLICE_BYTES):
            found, clean = [], []
            for data in texts(part):
                text = data.decode()
                base = strict(text)
                spans = [(*s, True, 1.0) for s in base] + [(*s[:3], False, s[3]) for s in model.accepted(text, base)]
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                found.append([dict(zip(("kind", "start", "end", "strict", "score"), s, strict=True)) for s in spans])
                clean.append(redact(text, spans))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, spans_type), pa.array(clean, pa.string())], ["id", "spans", "redacted"])

    fields = f"id {kind}, spans array<struct<kind:string,start:long,end:long,strict:boolean,score:double>>, redacted string"
    return wanted.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def redact(text: str, spans: list) -> str:
    out, done = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
