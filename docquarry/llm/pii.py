"""PII: rules for four kinds of personal data, and a semi-Markov CRF that adds to them.

The rules find plain e-mail addresses, IP addresses, card and phone numbers.
The semi-Markov conditional random field scores whole candidate segments:
runs of atoms (digit runs, letter runs, single signs) of at most MAX_CHARS
characters whose form could be an entity, written plainly or not ("(at)",
"[.]", other separators, no plus sign).  Features see the whole span: its shape, counts,
check digit, neighbours, length.  A segment of a kind may follow another
directly, with a weight for the two kinds.  All else is text that scores 0, so
dynamic programming over segment ends, bounded by the longest entity, finds
the best boundaries and kinds together.  Of its segments those that overlap no
rule span are added.

The field is trained on distinct windows around digits and at signs, in which
rule spans are the truth, each also rewritten in the ways that plain rules
miss: at most SAMPLE windows (the smallest by hash of their text) of each
stratum, a stratum being the kind of a window's first rule span, or none.  So
windows with personal data are learned from however few they are among windows
with numbers, and long regions, cut between spans, as well as short ones.
Gradients are exact, from the forward and backward sums over all segmentations.

Mapping is narrow; time is linear in the text whatever stands in it.
Defined cases: null text has no spans; empty text has none; without a rule
span in the corpus nothing is learned or added; offsets are code points, ends
exclusive; equal scores take the segmentation with fewer of the last segments;
repeated rows are each searched; very long texts are searched region by region;
an empty table gives no rows; other columns stay, and those named base_pii or
pii are replaced by detect().
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import sliced, small_batches, with_columns

KINDS = ("email", "ip", "card", "phone")
#: Training windows of a stratum at most.
SAMPLE = 200
REACH = 60
#: Characters of a training window, but for one rule span more.
WINDOW = 360
MAX_CHARS = 80
EPOCHS = 6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match can only begin where a run of digits does: from within one it would fail as from its start.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Spans of the rules, by kind and then start."""
    if not text:
        return []
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- candidates

_ATOM = re.compile(r"[0-9]+|[A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{] ?(?:at|dot) ?[)\]}]|(?<= )dot(?= )", re.I)
_AT = r" ?(?:@|[(\[{] ?at ?[)\]}]) ?"
_DOT = r"(?:\.| ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot )"
_FORM = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+(?:{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot )[A-Za-z][A-Za-z0-9-]*", re.I),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.I),
    "card": re.compile(r"[0-9](?:[ ._/-]?[0-9])+"),
    "phone": re.compile(r"(?:\+|\()?[0-9][0-9 ()./-]*[0-9]"),
}
_DIGITS_OF = {"card": (13, 19), "phone": (7, 15)}


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text around triggers that hold every candidate; each within one line."""
    begin = end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < end - REACH:
            continue
        a = max(text.rfind("\n", max(0, m.start() - REACH), m.start()) + 1, m.start() - REACH, 0)
        b = text.find("\n", m.end(), m.end() + REACH)
        b = min(len(text), m.end() + REACH) if b < 0 else b
        if end >= 0 and a <= end:
            end = max(end, b)
            continue
        if end >= 0:
            yield begin, end
        begin, end = a, b
    if end >= 0:
        yield begin, end


def candidates(text: str, begin: int, end: int) -> Iterator[Span]:
    """Segments of a region whose form could be an entity."""
    atoms = [m.span() for m in _ATOM.finditer(text, begin, end)]
    for i, (a, _) in enumerate(atoms):
        first = text[a]
        if not (first.isalnum() or first in "+(._%-"):
            continue
        letters = digits = 0
        for j in range(i, len(atoms)):
            x, y = atoms[j]
            if y - a > MAX_CHARS:
                break
            c = text[x]
            if c.isdigit() and c.isascii():
                digits += y - x
            elif c.isalpha():
                letters += 1
            elif c in "\n\r\t\"'<>;:!?|=*&#$":
                break
            if not c.isalnum():
                continue
            if digits >= 4 or letters:
                s = text[a:y]
                for kind, form in _FORM.items():
                    if (kind == "email") != (letters > 0) and kind != "ip":
                        continue
                    if kind == "email" and "@" not in s and "at" not in s.lower():
                        continue
                    if kind in _DIGITS_OF and not _DIGITS_OF[kind][0] <= digits <= _DIGITS_OF[kind][1]:
                        continue
                    if form.fullmatch(s):
                        yield kind, a, y


def _class(c: str) -> str:
    return "w" if c.isalnum() else "s" if c.isspace() else c


def span_features(text: str, span: Span) -> list[str]:
    """Whole-span features of a candidate."""
    kind, a, b = span
    s = text[a:b]
    shape = re.sub(r"[A-Za-z0-9-]+" if kind == "email" else r"[0-9]+", "9", s)
    digits = "".join(c for c in s if "0" <= c <= "9")
    before, after = _class(text[a - 1 : a] or "\n"), _class(text[b : b + 1] or "\n")
    groups = re.findall(r"[0-9]+", s)
    out = ["bias", f"shape={shape if len(shape) < 24 else len(shape)}", f"before={before}", f"after={after}", f"first={_class(s[0])}{s[0] if s[0] in '+(' else ''}"]
    out.append(f"signs={''.join(sorted(set(shape) - {'9'}))}")
    if kind != "email":
        out += [f"digits={len(digits)}", f"groups={len(groups)}", f"widest={max(map(len, groups))}"]
    if kind == "card":
        out += [f"luhn={luhn(digits)}", f"luhn={luhn(digits)},{len(digits) >= 16}"]
    if kind == "ip":
        out.append(f"bytes={all(int(g) <= 255 for g in groups)}")
    if kind == "phone":
        out += [f"plus={s[0] == '+'}", f"closed={s.count('(') == s.count(')')}", f"tail={len(groups[-1])}", f"luhn={luhn(digits)},{len(digits) >= 13}"]
    if kind == "email":
        out.append(f"parts={min(6, len(groups))}")
    return [f"{kind}:{x}" for x in out]


# --------------------------------------------------------------------- model


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    follow: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, text: str, span: Span) -> float:
        return sum(self.weight.get(f, 0.0) for f in span_features(text, span))

    def best(self, text: str, begin: int, end: int) -> list[Span]:
        """The segmentation of a region with the highest score."""
        spans = sorted(set(candidates(text, begin, end)), key=lambda s: (s[2], s[1], s[0]))
        # best value of what ends at a place or before it, and of what ends with a kind exactly there
        ends: list[int] = [begin - 1]
        top: list[tuple[float, tuple | None]] = [(0.0, None)]
        exact: dict[tuple[int, str], tuple[float, tuple]] = {}
        for span in spans:
            kind, a, b = span
            k = len(ends) - 1
            while ends[k] >= a:
                k -= 1
            value, chain = top[k]  # nothing ends exactly at a
            for other in KINDS:
                if (a, other) in exact and exact[a, other][0] + self.follow.get((other, kind), 0.0) > value:
                    value, chain = exact[a, other][0] + self.follow.get((other, kind), 0.0), exact[a, other][1]
            value += self.score(text, span)
            if value > exact.get((b, kind), (-math.inf,))[0]:
                exact[b, kind] = value, (span, chain)
            if value > top[-1][0]:
                if ends[-1] == b:
                    top[-1] = value, (span, chain)
                else:
                    ends.append(b)
                    top.append((value, (span, chain)))
        out, chain = [], top[-1][1]
        while chain is not None:
            out.append(chain[0])
            chain = chain[1]
        return out[::-1]


def _add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def expectations(model: Model, text: str, spans: list[Span]) -> tuple[float, list[float], dict[tuple[str, str], float]]:
    """log Z, the probability of each candidate, and of each pair of kinds directly one after the other.

    A place carries the sum over all segmentations of what lies before it;
    separately, of those in which a segment of a kind ends exactly there.
    """
    scores = [model.score(text, s) for s in spans]
    places = sorted({p for _, a, b in spans for p in (a, b)})
    at = {p: i for i, p in enumerate(places)}
    n = len(places)
    starts: list[list[int]] = [[] for _ in range(n)]
    stops: list[list[int]] = [[] for _ in range(n)]
    for i, (_, a, b) in enumerate(spans):
        starts[at[a]].append(i)
        stops[at[b]].append(i)
    ninf = -math.inf
    fore = [ninf] * n  # all
    kinds: list[dict[str, float]] = [{} for _ in range(n)]  # ending there in a kind
    inside = [ninf] * len(spans)
    for p in range(n):
        fore[p] = fore[p - 1] if p else 0.0
        for i in stops[p]:
            k = spans[i][0]
            kinds[p][k] = _add(kinds[p].get(k, ninf), inside[i] + scores[i])
            fore[p] = _add(fore[p], inside[i] + scores[i])
        for i in starts[p]:
            k = spans[i][0]
            total = fore[p]
            for other, value in kinds[p].items():  # replace the plain continuation by the weighted one
                w = model.follow.get((other, k), 0.0)
                if w:
                    total = _sub(total, value)
                    total = _add(total, value + w)
            inside[i] = total
    z = fore[-1] if n else 0.0
    back = [0.0] * n
    behind = [ninf] * len(spans)
    pairs: dict[tuple[str, str], float] = {}
    rest: list[dict[str, float]] = [{} for _ in range(n)]
    for p in range(n - 1, -1, -1):
        back[p] = back[p + 1] if p + 1 < n else 0.0
        skip = back[p]
        for i in starts[p]:
            k = spans[i][0]
            value = scores[i] + behind[i]
            rest[p][k] = _add(rest[p].get(k, ninf), value)
            back[p] = _add(back[p], value)
        for i in stops[p]:
            k = spans[i][0]
            total = skip
            for other, value in rest[p].items():
                total = _add(total, value + model.follow.get((k, other), 0.0))
            behind[i] = total
        for k, before in kinds[p].items():
            for other, value in rest[p].items():
                pairs[k, other] = pairs.get((k, other), 0.0) + math.exp(before + value + model.follow.get((k, other), 0.0) - z)
    return z, [math.exp(inside[i] + scores[i] + behind[i] - z) for i in range(len(spans))], pairs


def _sub(x: float, y: float) -> float:
    return -math.inf if y >= x else x + math.log1p(-math.exp(y - x))


def rewritten(kind: str, s: str, rng: random.Random) -> str:
    """A form of an entity that the rules do not know."""
    if kind == "email":
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" @ ", ".")])
        name, host = s.split("@")
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return s.replace(".", rng.choice(["[.]", "(.)", " dot ", "[dot]"]))
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "card":
        sep = rng.choice([".", "/", "_"])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, rest = digits[:-7][-3:], digits[-7:]
    return rng.choice(["00{0} {1} {2} {3}", "({1}) {2}-{3}", "{1}-{2}-{3}", "{1}.{2}.{3}"]).format(digits[:-10] or "1", area, rest[:3], rest[3:])


def examples(text: str, rng: random.Random) -> list[tuple[str, list[Span]]]:
    """A region with its rule spans as truth, and again with one of them rewritten."""
    truth: list[Span] = []
    for span in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
        if not truth or span[1] >= truth[-1][2]:
            truth.append(span)
    out = [(text, truth)]
    for i, (kind, a, b) in enumerate(truth):
        new = rewritten(kind, text[a:b], rng)
        d = len(new) - (b - a)
        moved = [s if j < i else (kind, a, a + len(new)) if j == i else (s[0], s[1] + d, s[2] + d) for j, s in enumerate(truth)]
        out.append((text[:a] + new + text[b:], moved))
    return out


def fit(texts: list[str], epochs: int = EPOCHS, l2: float = 1e-4) -> Model | None:
    """The field of some regions; None if the rules find nothing in them."""
    rng = random.Random(11)
    data = []
    for text in sorted(texts):
        for t, truth in examples(text, rng):
            spans = sorted({s for a, b in regions(t) for s in candidates(t, a, b)}, key=lambda s: (s[1], s[2], s[0]))
            gold = {s for s in truth if s in spans}
            if spans:
                data.append((t, spans, gold, [span_features(t, s) for s in spans]))
    if not any(gold for _, _, gold, _ in data):
        return None
    model, seen = Model(), {}
    for _ in range(epochs):
        rng.shuffle(data)
        for t, spans, gold, feats in data:
            _, p, pairs = expectations(model, t, spans)
            slope: dict = {}
            for s, q, fs in zip(spans, p, feats, strict=True):
                d = (s in gold) - q
                if abs(d) > 1e-4:
                    for f in fs:
                        slope[f] = slope.get(f, 0.0) + d
            line = sorted(gold, key=lambda s: s[1])
            for x, y in zip(line, line[1:], strict=False):
                if x[2] == y[1]:
                    slope[x[0], y[0]] = slope.get((x[0], y[0]), 0.0) + 1
            for k, q in pairs.items():
                slope[k] = slope.get(k, 0.0) - q
            for f, d in slope.items():
                table = model.follow if isinstance(f, tuple) else model.weight
                d -= l2 * table.get(f, 0.0)
                seen[f] = seen.get(f, 1e-2) + d * d
                table[f] = table.get(f, 0.0) + 0.5 * d / math.sqrt(seen[f])
    return model


def windows(text: str) -> Iterator[tuple[str, str]]:
    """(stratum, window) of all regions; long ones are cut outside rule spans."""
    for a, b in regions(text):
        spans = sorted((x, y, k) for k, x, y in base_spans(text[a:b]))
        at, i = 0, 0
        while at < b - a:
            cut, first = min(at + WINDOW, b - a), ""
            while i < len(spans) and spans[i][0] < cut:
                first = first or spans[i][2]
                cut = max(cut, spans[i][1])
                i += 1
            yield first or "none", text[a + at : a + cut]
            at = cut


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` windows of each stratum of docs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Smallest(sample)
        for batch in sliced(batches):
            for t in batch.column("text").to_pylist():
                for stratum, window in windows(t or ""):
                    held.add(stratum, _place(window), window)
        yield held.rows()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Smallest(sample)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("stratum", "o", "region")), strict=True):
                held.add(*row)
        yield held.rows()

    small_batches(docs)
    texts = docs.select(F.col(f"`{text}`").alias("text")).where(F.col("text").rlike("[0-9@]"))
    # the smallest of each task, then of each of MERGES tasks: the driver gets at most MERGES times the samples
    near = texts.mapInArrow(cut, _Smallest.SCHEMA).repartition(MERGES)
    few = _Smallest(sample)
    for row in near.mapInArrow(least, _Smallest.SCHEMA).collect():
        few.add(*row)
    return fit(few.rows().column("region").to_pylist())


class _Smallest:
    """The distinct windows with the smallest places, so many of each stratum."""

    SCHEMA = "stratum string, o bigint, region string"

    def __init__(self, most: int):
        self.most = most
        self.held: dict[str, set[tuple[int, str]]] = {}

    def add(self, stratum: str, place: int, window: str) -> None:
        own = self.held.setdefault(stratum, set())
        own.add((place, window))
        if len(own) > 8 * self.most:
            self.held[stratum] = set(sorted(own)[: self.most])

    def rows(self) -> pa.RecordBatch:
        kept = [(k, *x) for k in sorted(self.held) for x in sorted(self.held[k])[: self.most]]
        stratum, place, window = zip(*kept, strict=True) if kept else ((), (), ())
        return pa.RecordBatch.from_pydict({"stratum": pa.array(stratum, pa.string()), "o": pa.array(place, pa.int64()), "region": pa.array(window, pa.string())})


#: Tasks in which the samples of all tasks meet.
MERGES = 64


def _place(region: str) -> int:
    """A hash of the text: its place in the sample's order."""
    return int.from_bytes(hashlib.blake2b(region.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def find(text: str | None, model: Model | None) -> tuple[list[Span], list[Span]]:
    """The rule spans, and all spans with those that the field adds, both by kind and start."""
    base = base_spans(text)
    if not text or model is None:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for begin, end in regions(text):
        near = [(a, b) for a, b in taken if a < end and b > begin] if taken else []
        added += [s for s in model.best(text, begin, end) if not any(s[1] < b and a < s[2] for a, b in near)]
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with base_pii and pii: arrays of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def kernel(m: Model | None, texts: list) -> dict[str, pa.Array]:
        found = [find(t, m) for t in texts]
        made = [[[{"kind": k, "start": a, "end": b} for k, a, b in part] for part in parts] for parts in zip(*found, strict=True)] if found else [[], []]
        return {"base_pii": pa.array(made[0], kind), "pii": pa.array(made[1], kind)}

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return with_columns(docs, text, kernel, f"base_pii {span}, pii {span}", lambda: shared.value)


def masked(text: str | None, model: Model | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, and then the longest."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(find(text, model)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        elif b <= at:
            continue
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """docs with personal data masked in the text; columns as given."""
    model = model or train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(m: Model | None, texts: list) -> dict[str, pa.Array]:
        return {text: pa.array([masked(t, m) for t in texts], pa.string())}

    return with_columns(docs, text, kernel, f"`{text}` string", lambda: shared.value).select(*[F.col(f"`{c}`") for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the rule spans, and all spans."""
    found = detect(docs.select("doc_id", "text"), train(docs))
    of_kind = lambda k: F.filter("base_pii", lambda s: s["kind"] == k)
    count = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *count, F.sha2(joined("base_pii"), 256).alias("base_sha256"), joined("pii").alias("spans"))


def sha256_of(spans: list[Span]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
