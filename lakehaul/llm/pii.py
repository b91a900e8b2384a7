"""Personal data in texts: generators propose spans, boosted trees choose among them.

Spans of the base patterns are always taken.  Besides, generators of high recall propose
spans that may overlap them and one another: addresses with a spelled-out or bracketed
"at" and "dot", and runs of digits with any usual separators, as phone or card numbers.
Each proposal is described by its format (lengths, digit groups, separators, check digit)
and its context (what stands before and behind it).  Gradient-boosted trees give it a
probability, and proposals above their kind's threshold are taken, the likeliest first, if they
overlap nothing taken before.

There are no labels, so the trees learn from the base patterns of all documents, and of
the invented texts of ``seeds``, so that a table with few base spans has examples too.
Positive are base spans rewritten in the ways that the generators allow; negative are
proposals that cannot be what they are proposed as (``plausible``: check digit, groups of
digits, dates, parts of longer runs).  A proposal that could be personal data is not
labelled: nobody knows, and there may be many.  One half of the texts trains: Spark takes
each feature's quantiles as its cuts and counts equal examples, and for each level of a
tree every task adds up the gradients by node, feature and cut; only these sums, of fixed
size, reach the driver.  They are whole numbers, so that no division into tasks changes the
trees.  On the other half each kind's threshold is set: the least at which the share of
negatives among all accepted falls under ``MISTAKES``, in steps of 1 / ``STEPS``.
Implausible proposals are never taken.  Numbers that as often mean something else (without
separators, grouped by thousands, or all of two digits) are phones only behind a word for one.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehaul.llm.shared import written

#: Trees, their depth, learning rate, and examples of a kind that are enough.
TREES, DEPTH, RATE, ENOUGH = 40, 3, 0.2, 30
#: Share of wrong spans that a threshold may let through.
MISTAKES = 0.01
#: Quantiles that are tried as cuts of a feature, at most; steps of probability that
#: thresholds tell apart; units of a gradient, whose sums stay exact in doubles.
QUANTILES, STEPS, UNITS = 33, 1 << 16, 1 << 20
#: Characters of context on either side.
CONTEXT = 24

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9._%+-]{1,64}){0,8} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}"
    r"(?:(?:\.| \. | ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]{1,64})+"
)
NUMBER = re.compile(r"\(?[0-9]{1,20}\)?(?:[ ./-]{1,2}\(?[0-9]{1,20}\)?){1,7}|[0-9]{9,19}")
DIGITS = re.compile(r"[0-9]+")
#: Words before a number that make it a phone's.
CUE = re.compile(r"(?i)phone|fon\b|\bt[eé]l|\bfax|mobil|handy|m[oó]vil|portable|whatsapp|\bcall|\bcell|\bsms")
#: The last label of an address.
TOP = re.compile(r"[.)\]\s][A-Za-z]{2,24}$")
DATE = re.compile(
    r"(?<!\d)(?:(?:19|20)\d\d[ ./-]+(?:0?[1-9]|1[0-2])[ ./-]+(?:0?[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])[ ./-]+(?:0?[1-9]|[12]\d|3[01])[ ./-]+(?:19|20)\d\d)(?!\d)"
)
FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
                out.append((3, *m.span()))
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Spans that may be personal data; a number may be proposed as two kinds."""
    out = []
    if "@" in text or "(at)" in text or "[at]" in text:
        out += [(0, *m.span()) for m in SPELLED.finditer(text)]
    for m in NUMBER.finditer(text):
        n = sum(map(len, DIGITS.findall(m[0])))
        if 9 <= n <= 15:
            out.append((3, *m.span()))
        if 13 <= n <= 19:
            out.append((2, *m.span()))
    return out


def features(kind: int, span: str, before: str, behind: str) -> list[float]:
    groups = DIGITS.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]

    def share(text: str, test: Callable[[str], bool]) -> float:
        return sum(map(test, text)) / len(text) if text else 0.0

    near, next_ = before[-1:] or " ", behind[:1] or " "
    return [
        float(kind),
        len(span),
        len(digits),
        len(groups),
        sizes[0],
        sizes[-1],
        max(sizes),
        min(sizes),
        span.count(" "),
        span.count("-"),
        span.count("."),
        span.count("("),
        span.count("/"),
        float(bool(digits) and luhn(digits)),
        len(set(digits)),
        float("at" in span and "@" not in span),
        float(near.isalnum()),
        float(next_.isalnum()),
        float(near in "+\"'=#:"),
        share(before, str.isdigit),
        share(behind, str.isdigit),
        share(before, str.isalpha),
        share(behind, str.isalpha),
        share(before, str.isspace),
        float(bool(CUE.search(before))),
        float(digits.startswith("0")),
        float(bool(TOP.search(span))),
    ]


def plausible(kind: int, span: str, before: str, behind: str) -> bool:
    """Whether a proposal can be what it is proposed as."""
    if before[-1:].isalnum() or behind[:1].isalnum():
        return False
    if kind == 0:
        return bool(TOP.search(span))
    if re.search(r"[0-9][ .,:/-]$", before) or re.match(r"[.,:/-][0-9]", behind):
        return False  # part of a longer number
    groups = DIGITS.findall(span)
    digits, sizes = "".join(groups), [len(g) for g in groups]
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and "(" not in span and min(sizes[:-1], default=4) >= 4
    if not 9 <= len(digits) <= 15 or len(groups) > 6 or DATE.search(span):
        return False
    if ("(" in span or ")" in span) and not re.fullmatch(r"(?:[0-9]{1,5}[ .-]?)?\([0-9]{1,5}\)[^()]*", span):
        return False
    if len(groups) > 1 and (max(sizes) > 8 or sizes[-1] < 2 or min(sizes[2:], default=2) < 2):
        return False
    if len(groups) > 1 and all(re.fullmatch("(?:19|20)[0-9]{2}", g) for g in groups):
        return False
    often_else = "(" not in span and (
        len(groups) == 1
        or (all(n == 3 for n in sizes[1:]) and sizes[0] <= 3 and "-" not in span and digits[0] != "0")
        or (all(n == 2 for n in sizes) and digits[0] != "0")
        or (len(groups) == 4 and max(sizes) <= 3 and span.count(".") == 3)
    )
    return not often_else or bool(CUE.search(before))


def rewritten(kind: int, span: str) -> list[str]:
    """A base span as a generator might have to find it."""
    if kind == 0:
        name, host = span.split("@", 1)
        spelled_out = [f"{name}{at}{host}" for at in (" (at) ", "(at)", " [at] ", "[at]", " @ ")]
        return [
            *spelled_out,
            f"{name}[at]{host.replace('.', '[dot]')}",
            f"{name} [at] {host.replace('.', ' [dot] ')}",
            f"{name} (at) {host.replace('.', ' (dot) ')}",
        ]
    if kind == 2:
        digits = "".join(DIGITS.findall(span))
        sizes = [4, 6, 5] if len(digits) == 15 else [4] * 5
        ends = np.cumsum([0, *sizes])
        groups = [g for a, b in zip(ends[:-1], ends[1:], strict=True) if (g := digits[a:b])]
        return [span, *(gap.join(groups) for gap in (" ", "-", ".", "/", "  "))]
    if kind == 3:
        whole = span.lstrip("+")
        inland = re.sub(r"^[0-9]{1,4}(?:[ .-]+|(?=\())", "", whole)
        forms = [whole, f"00{whole}", inland]
        for part in (whole, inland):
            groups = DIGITS.findall(part)
            forms += [gap.join(groups) for gap in (" ", "-", ".", "/", "")]
        if not inland.startswith(("(", "0")):
            forms.append(f"0{inland}")
        return list(dict.fromkeys(f for f in forms if 9 <= sum(map(len, DIGITS.findall(f))) <= 15))
    return []


def described(text: str) -> list[tuple[list[float], int]]:
    """Examples of a text: what base spans look like rewritten (1), and what cannot be (0)."""
    out = []
    base = base_spans(text)

    def add(kind: int, span: str, start: int, end: int, label: int) -> None:
        around = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        if plausible(kind, span, *around) == bool(label):
            out.append((features(kind, span, *around), label))

    for kind, start, end in base:
        for span in rewritten(kind, text[start:end]):
            add(kind, span, start, end, 1)
    for kind, start, end in proposals(text):
        if not any(start < e and s < end for _, s, e in base):
            add(kind, text[start:end], start, end, 0)
    return out


def half(text: str) -> int:
    """0: the text trains; 1: thresholds are set on it.  Copies of a text are in one half."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % 2


def seeds() -> list[str]:
    """Invented texts with personal data, and with numbers that are none; the same each time."""
    rng = random.Random(2)

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def filled(form: str) -> str:
        return re.sub("9", lambda _: digits(1), form)

    words = ["ask", "Call", "tel.", "write to", "and", "of the", "Kontakt:", "le", "para", "(", "", "\n", "x,", "=", "12"]
    ends = ["", ".", ", or", " and more", ")", "\n", " today", " 7 of", "; then"]
    names, hosts, tops = ["a", "info", "jo.berg", "m_lenz-"], ["host", "mail", "post-box"], ["org", "example.com", "de", "co.uk"]
    phones = ["+1 (999) 999-9999", "+1-999-999-9999", "+44 99 9999 9999", "+49 999 9999999", "+33 6 99 99 99 99", "+34 699 999 999"]
    wrong = [
        "9999999999", "999999999999", "9 999 999 999", "20 31 42 53 64", "2021-03-04 12 30", "04.05.2019 - 12.45",
        "978-3-16-999999-0", "1.12.123.1234.5", "2019 2020 2021", "9999 99 9 9 9 9", "3 @ 4.99", "a (at) 1.99",
    ]
    out = []
    for _ in range(240):
        card = digits(rng.choice((14, 15)))
        card += next(d for d in "0123456789" if luhn(card + d))
        other = str((int(card[-1]) + rng.randint(1, 9)) % 10)
        spans = [
            f"{rng.choice(names)}{rng.choice(('', digits(2)))}@{rng.choice(hosts)}{rng.choice(('', digits(1)))}.{rng.choice(tops)}",
            card,
            filled(rng.choice(phones)),
            card[:-1] + other,
            filled(rng.choice(wrong)),
            f"c{digits(rng.randint(9, 15))}e{digits(3)}",
        ]
        out += [f"{rng.choice(words)} {span}{rng.choice(ends)}".removeprefix(" ") for span in spans]
    return out


def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, labels, halves = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            for x, y in described(text):
                rows.append(x)
                labels.append(y)
                halves.append(half(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32()), pa.array(halves, pa.int32())],
            ["x", "y", "half"],
        )


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


@dataclass
class Model:
    trees: list[Tree]
    start: float
    thresholds: dict[int, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = self.start + RATE * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-total))


def to_places(cuts: list[np.ndarray]) -> Callable:
    """For each example its kind and, per feature, how many cuts lie below its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(cuts))
            places = np.empty(x.shape, np.uint8)
            for feature, values in enumerate(cuts):
                places[:, feature] = np.searchsorted(values, x[:, feature])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row.tobytes() for row in places], pa.binary()),
                    pa.array(x[:, 0].astype(np.int32)),
                    batch.column("y"),
                    batch.column("half"),
                ],
                ["places", "kind", "y", "half"],
            )

    return run


def of_places(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.uint8).reshape(-1, features)
    return places, batch.column("y").to_numpy(), batch.column("n").to_numpy()


def gradient_sums(model: Model, tree: Tree, level: int, features: int) -> Callable:
    """Sums of gradients and weights by node of a level, feature and place: a row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2**level * features * QUANTILES), np.int64)
        for batch in batches:
            places, y, n = of_places(batch, features)
            p = model.probability(places)
            node = tree.leaves(places, level) - (2**level - 1)
            at = ((node[:, None] * features + np.arange(features)) * QUANTILES + places).ravel()
            for total, part in zip(sums, (y - p, p * (1 - p)), strict=True):
                each = np.repeat(np.rint(part * UNITS) * n, features)
                total += np.bincount(at, each, len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    return run


def grown(fit: DataFrame, model: Model, cuts: list[np.ndarray]) -> Tree:
    """A full tree of fixed depth, by places; each split has the largest gain of all cuts."""
    size = 2 ** (DEPTH + 1) - 1
    tree = Tree(np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size))
    for level in range(DEPTH):
        parts = fit.mapInArrow(gradient_sums(model, tree, level, len(cuts)), "sums binary").collect()
        total = np.sum([np.frombuffer(row["sums"], np.int64) for row in parts], axis=0)
        sums = total.reshape(2, 2**level, len(cuts), QUANTILES) / UNITS
        for number in range(2**level):
            node = 2**level - 1 + number
            (g, h), best = sums[:, number, 0].sum(axis=1), 1e-6
            left = g, h  # without a split all rows go to the left
            for feature, values in enumerate(cuts):
                if not len(values):
                    continue
                left_g, left_h = np.cumsum(sums[:, number, feature], axis=1)[:, : len(values)]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                if gain.max() > best:
                    best, at = gain.max(), int(gain.argmax())
                    tree.feature[node], tree.cut[node] = feature, at
                    left = left_g[at], left_h[at]
            if level == DEPTH - 1:
                tree.value[2 * node + 1] = left[0] / (left[1] + 1)
                tree.value[2 * node + 2] = (g - left[0]) / (h - left[1] + 1)
    return tree


def to_scores(model: Model, features: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, _, _ = of_places(batch, features)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), pa.array(model.probability(places)), batch.column("y"), batch.column("n")],
                ["kind", "score", "y", "n"],
            )

    return run


def train(shown: DataFrame) -> Model:
    """Boosted trees from the rows of half 0, thresholds from those of half 1."""
    fit = shown.where("half = 0")
    width = len(features(0, "", "", ""))
    shares = [float(q) for q in np.linspace(0, 1, QUANTILES)]
    found = fit.agg(
        F.avg("y").alias("mean"), *(F.percentile(F.col("x")[i], shares).alias(f"x{i}") for i in range(width))
    ).first()
    model = Model([], 0.0, {})
    if found["mean"] is None or not 0 < found["mean"] < 1:
        return model
    cuts = [np.unique(found[f"x{i}"])[:-1] for i in range(width)]
    counted = written(
        shown.mapInArrow(to_places(cuts), "places binary, kind int, y int, half int")
        .groupBy("places", "kind", "y", "half")
        .agg(F.count(F.lit(1)).alias("n")),
        "counted-examples",
    )
    fit = counted.where("half = 0")
    model.start = float(np.log(found["mean"] / (1 - found["mean"])))
    for _ in range(TREES):
        model.trees.append(grown(fit, model, cuts))
    score = F.col("score")
    steps = (
        counted.where("half = 1")
        .mapInArrow(to_scores(model, width), "kind int, score double, y int, n bigint")
        .groupBy("kind", F.floor(score * STEPS).alias("step"))
        .agg(F.min(score).alias("score"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("right"))
        .orderBy("kind", F.desc("step"))
        .collect()  # at most STEPS + 1 rows of a kind
    )
    for kind in (0, 2, 3):
        n = right = 0
        for row in steps:
            if row["kind"] != kind:
                continue
            n, right = n + row["n"], right + row["right"]
            if n - right <= MISTAKES * n and right >= ENOUGH:
                model.thresholds[kind] = max(row["score"], 0.5)
    for tree in model.trees:  # places become values
        for node in np.flatnonzero(np.isfinite(tree.cut)).tolist():
            tree.cut[node] = cuts[tree.feature[node]][int(tree.cut[node])]
    return model


def chosen(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    offered = [
        (k, s, e)
        for k, s, e in proposals(text)
        if k in model.thresholds and plausible(k, text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT])
    ]
    if not offered:
        return base
    taken = sorted((s, e) for _, s, e in base)
    free = []
    for k, s, e in offered:
        at = np.searchsorted([t[1] for t in taken], s, side="right") if taken else 0
        if at == len(taken) or taken[at][0] >= e:
            free.append((k, s, e))
    if not free:
        return base
    x = np.array([features(k, text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]) for k, s, e in free])
    likely = model.probability(x)
    more: list[tuple[int, int, int]] = []
    for i in np.argsort(-likely, kind="stable"):
        kind, start, end = free[i]
        if likely[i] >= model.thresholds[kind] and all(end <= s or e <= start for _, s, e in more):
            more.append(free[i])
    return sorted([*base, *more])


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def find_all(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                own = base_spans(text)
                every = chosen(text, own, trees) if trees.thresholds else own
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for k, _, _ in own))
                base.append(spelled(own))
                spans.append(spelled(every))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(base, pa.string()),
                    pa.array(spans, pa.string()),
                ],
                ["id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text.

    Returns the id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (spans of the base
    patterns), ``base`` and ``spans`` (base spans and all spans, as ``kind:start:end`` in
    code points, end exclusive, joined by commas, by kind and start).  A null text is
    empty and has no span.  Rows are looked at one by one: ids may repeat or be null.
    Other columns are not looked at.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    own = [([float(v) for v in x], y, half(text)) for text in seeds() for x, y in described(text)]
    columns = "x array<double>, y int, half int"
    found = rows.select("text").mapInArrow(examples, columns)
    model = train(written(found.union(docs.sparkSession.createDataFrame(own, columns)), "examples"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(find_all(shared), f"id bigint, {FOUND}").withColumnRenamed("id", id_col)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        *(f"n_{kind}" for kind in KINDS),
        F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"),
        "spans",
    )
