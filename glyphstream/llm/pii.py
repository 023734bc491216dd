"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

The base patterns find e-mail addresses, IPv4 addresses, card numbers that pass Luhn's test
and international phone numbers. The model finds other writings of the same four kinds (a
phone number without its plus, dots between the groups of a card, "name (at) host (dot)
com"). It scores whole candidate segments of at most MAX_TOKENS tokens by features of the
span: its shape, the number and grouping of digits, checksums, the word before. Dynamic
programming over segments picks boundaries and kinds of a zone together. A segment must hold
seven digits or four groups of them or a written-out at sign and no other plain words, so tokens elsewhere can only
be outside of any entity, and decoding zone by zone is exact. Weights are trained here, by
gradient ascent on the conditional likelihood of made-up zones; they are a few thousand
numbers, the same in every run.

Base spans always stay; a span of the model that overlaps a base span is dropped. Starts and
ends count code points, ends are exclusive. Null texts count as empty and have no spans;
repeated rows repeat their spans; null ids are carried along; other columns stay behind in
``find`` and are kept by ``redact``. Patterns take time in proportion to the text, the model in
proportion to the tokens of its zones, times MAX_TOKENS segments of at most MAX_CHARS each.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import table, texts

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 18
MAX_CHARS = 400  # of a candidate segment; 19 digits and their marks, or an address of the longest legal size
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# What stands in a run of digits can't match where the run's beginning doesn't.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@... finds from the left, looking only at the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (found := DOMAIN.match(text, at)):
            done = found.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# Zones: stretches that can hold an entity.
NUMBERS = re.compile(r"[+(]?(?<![0-9A-Za-z])[0-9][0-9\x20().+/-]{5,}[0-9]")
AT = re.compile(r"[(\[{][Aa][Tt][)\]}]|(?<=[A-Za-z0-9])\x20[Aa][Tt]\x20(?=[A-Za-z0-9-]+\x20[(\[{]?[Dd][Oo][Tt]\b)")
LEFT = re.compile(r"\x20?[A-Za-z0-9._%+-]+")  # over the reversed text
RIGHT = re.compile(r"\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[{][Dd][Oo][Tt][)\]}]\x20?|\x20[Dd][Oo][Tt]\x20)[A-Za-z0-9-]+)+")
GROUP = re.compile(r"[0-9]+")
AT_WORD = re.compile(r"[Aa][Tt]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\S")
BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")


def zones(text: str) -> Iterator[tuple[int, int]]:
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            if sum(map(str.isdigit, m[0])) >= 7 or len(GROUP.findall(m[0])) >= 4:
                yield m.span()
    turned = None
    for m in AT.finditer(text):
        if right := RIGHT.match(text, m.end()):
            turned = turned or text[::-1]
            if left := LEFT.match(turned, len(text) - m.start()):
                yield m.start() - len(left[0]), right.end()


def _shape(piece: str) -> str:
    out = []
    for token in TOKEN.finditer(piece):
        word = token[0].lower()
        out.append("d" if word.isdigit() else word if word in ("at", "dot") else "w" if word.isalpha() else word)
    return "".join(out)[:32]


class Zone:
    """The tokens of a zone and its candidate segments (i, j, features, kinds allowed)."""

    def __init__(self, text: str, begin: int, end: int) -> None:
        self.tokens = [(begin + m.start(), begin + m.end()) for m in TOKEN.finditer(text[begin:end])]
        found = BEFORE.search(text[max(0, begin - 24) : begin])
        before, n = found[1].lower() if found else "-", len(self.tokens)
        self.segments, self.outside = [], []
        for i, (a, b) in enumerate(self.tokens):
            token = text[a:b]
            self.outside.append([f"o:{'d' + str(min(len(token), 5)) if token.isdigit() else 'w' if token.isalpha() else token}"])
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                piece = text[a : self.tokens[j - 1][1]]
                allowed = self._allowed(piece)
                if len(piece) > MAX_CHARS:
                    break
                if any(allowed):
                    edges = f"{text[a - 1] if i and a else '^'}{text[self.tokens[j - 1][1]] if j < n else '$'}"
                    self.segments.append((i, j, self._features(piece, before if i == 0 else "-", edges), allowed))

    @staticmethod
    @lru_cache(maxsize=1 << 14)
    def _allowed(piece: str) -> tuple[bool, bool, bool, bool]:
        digits = sum(map(str.isdigit, piece))
        email = bool(re.search(r"\b[Aa][Tt]\b", piece))
        plain = not re.search(r"[A-Za-z]", piece) and piece[-1].isdigit() and piece[0] in "+(0123456789"
        return email, plain and 4 <= digits <= 12 and len(re.findall(r"[0-9]+", piece)) == 4, plain and 13 <= digits <= 19, plain and 7 <= digits <= 15

    @staticmethod
    @lru_cache(maxsize=1 << 14)
    def _features(piece: str, before: str, edges: str) -> list[str]:
        groups = re.findall(r"[0-9]+", piece)
        digits = "".join(groups)
        marks = "".join(sorted(set(re.findall(r"[^A-Za-z0-9\s]", piece))))
        return [
            "bias",
            f"shape:{_shape(piece)}",
            f"digits:{len(digits)}",
            f"groups:{'-'.join(str(len(g)) for g in groups[:6])}",
            f"marks:{marks}",
            f"luhn:{13 <= len(digits) <= 19 and luhn(digits)}:{len(digits) >= 13}",
            f"octets:{len(groups) == 4 and all(int(g) <= 255 for g in groups)}",
            f"before:{before}",
            f"edges:{edges}",
            f"spaces:{'  ' in piece}",
        ]


class Model:
    """Weights of (feature, label); label 0 is outside, then KINDS."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((5, 5))

    def _sum(self, features: list[str]) -> np.ndarray:
        out = np.zeros(5)
        for f in features:
            if (w := self.weights.get(f)) is not None:
                out += w
        return out

    def _scored(self, zone: Zone) -> list[list[tuple[int, np.ndarray]]]:
        """For each end: (begin, score of each label)."""
        ends: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(len(zone.tokens) + 1)]
        for i, features in enumerate(zone.outside):
            ends[i + 1].append((i, np.where([True, False, False, False, False], self._sum(features), -np.inf)))
        for i, j, features, allowed in zone.segments:
            ends[j].append((i, np.where([False, *allowed], self._sum(features), -np.inf)))
        return ends

    def decode(self, zone: Zone) -> list[tuple[int, int, int]]:
        """The best segmentation: (label, first token, end) of its entities."""
        n, ends = len(zone.tokens), self._scored(zone)
        best, back = np.full((n + 1, 5), -np.inf), {}
        best[0, 0] = 0
        for j in range(1, n + 1):
            for i, scores in ends[j]:
                through = best[i][:, None] + self.moves
                value = through.max(axis=0) + scores
                for y in np.flatnonzero(value > best[j]):
                    best[j, y] = value[y]
                    back[j, int(y)] = (i, int(through[:, y].argmax()))
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, before = back[j, y]
            if y:
                out.append((y, i, j))
            j, y = i, before
        return out[::-1]

    def step(self, zone: Zone, gold: set[tuple[int, int, int]], rate: float, decay: float) -> float:
        """One gradient step on a zone; the log-likelihood before it."""
        n, ends = len(zone.tokens), self._scored(zone)
        alpha, into = np.full((n + 1, 5), -np.inf), np.full((n + 1, 5), -np.inf)
        alpha[0, 0] = 0
        for j in range(n + 1):
            for i, scores in ends[j]:
                alpha[j] = np.logaddexp(alpha[j], into[i] + scores)
            into[j] = np.logaddexp.reduce(alpha[j][:, None] + self.moves, axis=0)
        total = np.logaddexp.reduce(alpha[n])
        beta, onward = np.full((n + 1, 5), -np.inf), np.full((n + 1, 5), -np.inf)
        beta[n] = 0
        starts: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, scores in ends[j]:
                starts[i].append((j, scores))
        for i in range(n - 1, -1, -1):
            for j, scores in starts[i]:
                onward[i] = np.logaddexp(onward[i], scores + beta[j])
            beta[i] = np.logaddexp.reduce(self.moves + onward[i], axis=1)
        chosen, covered, path = {(i, j): y for y, i, j in gold}, set(), []
        for (i, j), _y in chosen.items():
            covered.update(range(i, j))
        chosen |= {(t, t + 1): 0 for t in range(n) if t not in covered}
        path = [0] + [chosen[k] for k in sorted(chosen)]
        moves = np.zeros((5, 5))
        np.add.at(moves, (path[:-1], path[1:]), 1)
        for i in range(n):
            moves -= np.exp(np.clip(alpha[i][:, None] + self.moves + onward[i][None, :] - total, -700, 0)) * np.isfinite(alpha[i])[:, None]
        likelihood = sum(float(self.moves[a, b]) for a, b in zip(path, path[1:], strict=False)) - total
        features = {(i, i + 1, "o"): f for i, f in enumerate(zone.outside)} | {(i, j, "s"): f for i, j, f, _ in zone.segments}
        for j in range(1, n + 1):
            for i, scores in ends[j]:
                outside = np.isfinite(scores[0])
                gradient = -np.exp(np.clip(into[i] + scores + beta[j] - total, -700, 0)) * np.isfinite(scores)
                y = chosen.get((i, j))
                if y is not None and (y == 0) == outside:
                    gradient[y] += 1
                    likelihood += float(scores[y])
                if np.abs(gradient).max() > 1e-6:
                    for f in features[i, j, "o" if outside else "s"]:
                        w = self.weights.setdefault(f, np.zeros(5))
                        w += rate * (gradient - decay * w)
        self.moves += rate * moves
        return likelihood


def _number(rng: random.Random, *sizes: int) -> list[str]:
    return ["".join(rng.choice("0123456789") for _ in range(n)) for n in sizes]


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + "".join(_number(rng, 14))
    return next(body + c for c in "0123456789" if luhn(body + c))


def made_up(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A line with one zone, and the entities in it."""
    name, host = ("".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(2))
    card, sep = _card(rng), rng.choice("./ -")
    octets = [str(rng.randint(0, rng.choice((9, 99, 255)))) for _ in range(4)]
    a, b, c, d = _number(rng, 3, 3, 4, 2)
    at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."), (" [at] ", " [dot] "), ("{at}", ".")])
    entities = {
        "phone": [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{d} {b} {c}", f"00{d} {a} {b} {c}", f"({a}) {b} {c}", f"+{d}/{a}/{b}{c}"],
        "card": [sep.join(card[i : i + 4] for i in range(0, 16, 4)), ".".join(card[i : i + 4] for i in range(0, 16, 4)), f"{card[:4]}  {card[4:10]}  {card[10:]}"],
        "ip": [" . ".join(octets), "-".join(octets) if min(map(len, octets)) > 1 else " . ".join(octets)],
        "email": [f"{name}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de'])}", f"{name}.{d}{at}{host}{dot}co{dot}uk"],
    }
    words = {"phone": "call tel phone mobile fax at".split(), "card": "card visa pay number".split(), "ip": "ip host server address".split(), "email": "mail email contact write".split()}
    others = [
        f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1900, 2030)}/{rng.randint(10, 12)}/{rng.randint(10, 28)} {rng.randint(10, 23)}",
        f"{rng.randint(1, 99)} {a} {b}", f"{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}.{c}{c}", "".join(_number(rng, rng.randint(7, 20))), f"{a}{b}.{c}", f"{a} - {b} - {d}{d}{d}",
        f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", f"{a}.{a}.{b}.{c}{d}", f"978-{d[0]}-{c}-{c}-{d[1]}", " ".join(_number(rng, 2, 2, 2, 2, 2, 2)), f"{c} {c} {c} {c} {c}",
    ]
    kind = rng.choice([*KINDS, "phone", "none", "none", "none"])
    filler = [rng.choice("the of order und page la total version on year isbn".split()) for _ in range(3)]
    if kind == "none":
        return f"{' '.join(filler)} {rng.choice(others)} {filler[0]}", []
    lead = " ".join(filler) + " " + (rng.choice(words[kind]) + rng.choice([" ", ": "]) if rng.random() < 0.5 else "")
    piece = rng.choice(entities[kind])
    return f"{lead}{piece}{rng.choice([' ', '. ', ', '])}{filler[1]}", [(kind, len(lead), len(lead) + len(piece))]


@lru_cache(maxsize=1)
def trained(examples: int = 500, epochs: int = 4, seed: int = 11) -> Model:
    rng, model, data = random.Random(seed), Model(), []
    for _ in range(examples):
        text, entities = made_up(rng)
        for a, b in zones(text):
            zone, gold = Zone(text, a, b), set()
            for kind, begin, end in entities:
                inside = [t for t, (x, y) in enumerate(zone.tokens) if x >= begin and y <= end]
                fits = inside and zone.tokens[inside[0]][0] == begin and zone.tokens[inside[-1]][1] == end
                if fits and any((i, j) == (inside[0], inside[-1] + 1) and allowed[KINDS.index(kind)] for i, j, _, allowed in zone.segments):
                    gold.add((KINDS.index(kind) + 1, inside[0], inside[-1] + 1))
            data.append((zone, gold))
    for epoch in range(epochs):
        rng.shuffle(data)
        for zone, gold in data:
            model.step(zone, gold, 0.3 / (1 + epoch), 1e-3)
    return model


def all_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that the model adds)."""
    base = base_spans(text)
    added: list[tuple[str, int, int]] = []
    taken: list[list[int]] = []  # what base spans cover, as intervals apart from each other
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    begins, ends = [a for a, _ in taken], [b for _, b in taken]
    covered = lambda a, b: taken[bisect_right(ends, a) : bisect_left(begins, b)]
    for a, b in zones(text):
        inside, at, rest = covered(a, b), a, []
        for x, y in inside:
            rest.append(text[at:x])
            at = y
        left = "".join([*rest, text[at:b]])
        if inside and sum(map(str.isdigit, left)) < 7 and len(GROUP.findall(left)) < 4 and not AT_WORD.search(left):
            continue  # every segment of this zone overlaps a base span
        zone = Zone(text, a, b)
        for y, i, j in model.decode(zone):
            span = KINDS[y - 1], zone.tokens[i][0], zone.tokens[j - 1][1]
            if not covered(*span[1:]):
                added.append(span)
    added = [s for n, s in enumerate(added) if not any(x[1] < s[2] and x[2] > s[1] for x in added[max(0, n - 2) : n])]
    return base, added


def by_kind(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


SPAN = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType()).add("base", T.BooleanType())


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (kind, start, end, base) in order of kind and start."""
    source = texts(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(trained())
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = all_spans(text, model.value)
                of_base = set(base)
                rows.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in of_base} for k, a, b in by_kind(base + added)])
            yield pa.record_batch([batch.column(0).cast(arrow[0].type), pa.array(rows, type=arrow[1].type)], schema=arrow)

    return source.mapInArrow(run, schema)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base, added = all_spans(text, model.value)
        out, done = [], 0
        for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"[{kind}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t) for t in batch.column(at).to_pylist()], type=batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the personal data of every document."""
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
