"""Personal data: fixed patterns, and boosted trees over high-recall candidates.

Base spans come from four patterns with checks. Further generators propose overlapping spans that
look like an e-mail address, an IP address, a card or a phone number in a looser way. Features of
format and context describe each candidate; boosted trees, trained here, score it, and a threshold
per kind, calibrated for precision on rows the trees have not seen, decides. Base spans always
stay; a chosen candidate is added where it overlaps none of them.

The trees learn from a bounded sample of documents: base spans are positive examples, so are the
same spans rewritten in looser forms; candidates that are neither, and dates and other numbers put
in a span's place, are negative ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engram.llm import kernels

KINDS = ("email", "ip", "card", "phone")
#: Candidates that the trees are trained and calibrated on.
SAMPLE = 40_000
#: Documents read for that, about.
TEXTS = 20_000
PRECISION = 0.98

# fixed values: the base patterns
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# looser forms that only generate candidates
_LOOSE_AT = re.compile(r" ?(?:@|\(at\)|\[at\]| at ) ?(?=[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot )))")
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63})+")
_LOOSE_DIGITS = re.compile(r"\+?\(?[0-9](?:[ ()./-]{0,2}[0-9])*")
_DIGIT = re.compile("[0-9]+")
_NEXT = re.compile("[ ()./-]{0,2}([0-9]+)")
#: What every candidate holds: a digit, or one of the forms of the sign in ``_LOOSE_AT``.
_MARKS = (b"(at)", b"[at]", b" at ")
_MARK = r"[0-9@]|\(at\)|\[at\]| at "
_WORDS = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "iban"), "phone": ("tel", "phone", "call", "fax", "mobile"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four patterns, leftmost and not overlapping per kind, in linear time."""
    out, reach = [], 0
    for m in _AT.finditer(text):
        # what stands before the @ is the longest run of its characters: walk back instead of trying each start
        start = m.start()
        while start > reach and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            reach = m.end()
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(len, _DIGIT.findall(m.group()))) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data, overlapping and of several kinds for one place."""
    out = []
    for m in _LOOSE_AT.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        end = _LOOSE_DOMAIN.match(text, m.end())
        if start < m.start() and end:
            out.append(("email", start, end.end()))
    for m in _LOOSE_DIGITS.finditer(text):
        # numbers may stand next to each other: every span from group to group, linear as digits are few
        groups = [g.span() for g in _DIGIT.finditer(text, m.start(), m.end())]
        for i, (first, _) in enumerate(groups):
            start = m.start() if i == 0 else first - (text[first - 1] == "(")
            n = 0
            for a, end in groups[i : i + 19]:  # each has a digit
                n += end - a
                if n > 19:
                    break
                if 4 <= n <= 12 and text.count(".", start, end) == 3:
                    out.append(("ip", start, end))
                if n >= 13:
                    out.append(("card", start, end))
                if 7 <= n <= 15:
                    out.append(("phone", start, end))
    return out


def _covered(text: str, spans: list[tuple[str, int, int]]) -> bytearray:
    """A mark per character that a span covers."""
    out = bytearray(len(text))
    for _, start, end in spans:
        out[start:end] = b"\1" * (end - start)
    return out


def _beside(text: str) -> int:
    """Digits of the number that goes on at the start of ``text``, if one does."""
    m = _NEXT.match(text)
    return len(m[1]) if m else 0


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 30) : start].lower(), text[end : end + 30]
    groups = _DIGIT.findall(body)
    digits = "".join(groups)
    return [
        *(float(kind == k) for k in KINDS), float(len(body)), float(len(digits)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(len(digits) > 1 and luhn(digits)),
        float(body.startswith("+")), float(body.startswith("00")), float("(" in body), float(body.count(".")), float(body.count("-")),
        float(body.count(" ")), float(body.count("/")), float("@" in body), float("(at)" in body or "[at]" in body), float("dot" in body),
        float(bool(groups) and all(map(_small, groups))), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(before[-1:] in "#=\"'"), float(sum(c.isdigit() for c in before + after)), float(_beside(before[::-1])), float(_beside(after)),
        *(float(any(w in before for w in _WORDS[k])) for k in KINDS),
    ]


@dataclass
class Trees:
    """Gradient-boosted trees of logistic loss: per tree, nodes of (feature, cut, left, right) or a leaf value."""

    bias: float = -8.0
    trees: list[list[tuple]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.bias)
        for tree in self.trees:
            node = np.zeros(len(rows), np.int64)
            for at, step in enumerate(tree):  # children follow their parents
                here = node == at
                if len(step) == 1:
                    total[here] += step[0]
                else:
                    node[here] = np.where(rows[here, step[0]] <= step[1], step[2], step[3])
        return 1 / (1 + np.exp(-total))


def boost(rows: np.ndarray, labels: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> Trees:
    """Newton boosting with exact cuts at up to 32 quantiles per feature."""
    if not len(rows) or labels.min() == labels.max():
        return Trees()
    model = Trees(bias=float(np.log(labels.mean() / (1 - labels.mean()))))
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, 33), method="lower"))[:-1] for f in range(rows.shape[1])]
    bins = [np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)]
    total = np.full(len(rows), model.bias)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = labels - chance, chance * (1 - chance)
        tree: list[tuple] = [()]
        todo = [(0, np.arange(len(rows)), 0)]
        while todo:
            at, own, level = todo.pop(0)
            g, h = slope[own].sum(), bend[own].sum()
            best = (1e-6, None)
            for f in range(rows.shape[1] if level < depth else 0):
                gl, hl = (np.cumsum(np.bincount(bins[f][own], w[own], len(cuts[f]) + 1))[:-1] for w in (slope, bend))
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, float(cuts[f][int(gain.argmax())])))
            if best[1] is None:
                tree[at] = (rate * g / (h + 1),)
                total[own] += tree[at][0]
                continue
            f, cut = best[1]
            tree += [(), ()]
            tree[at] = (f, cut, len(tree) - 2, len(tree) - 1)
            side = rows[own, f] <= cut
            todo += [(len(tree) - 2, own[side], level + 1), (len(tree) - 1, own[~side], level + 1)]
        model.trees.append(tree)
    return model


def _looser(kind: str, body: str) -> list[str]:
    """The same datum in forms that the base patterns don't take."""
    if kind == "email":
        name, _, domain = body.partition("@")
        return [f"{name} (at) {domain}", f"{name} [at] {domain.replace('.', ' [dot] ')}", f"{name} at {domain.replace('.', ' dot ')}"]
    if kind == "card":
        digits = body.replace(" ", "").replace("-", "")
        return ["/".join(digits[i : i + 4] for i in range(0, len(digits), 4)), ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    if kind == "phone":
        return ["00" + body[1:], body[1:].partition(" ")[2] or body]
    return []


# numbers of everyday formats, which are no personal data wherever they stand
_DECOYS = (
    "2024-01-31", "31.12.2024", "12-31-1999", "31/12/2024", "1914-1918", "2001 - 2010", "978-3-16-148410-0", "10.1000.182.7", "1.20.300.4000",
    "1234567", "100 000 000", "3.14159265", "12:30 2024-06-01", "20240131", "20240131123000", "0000000000000", "v 1.2.3-4567", "5 10 15 20 25",
)


def _grouped(kind: str, body: str) -> list[str]:
    """A card or phone number as it is, in usual groups, and in looser forms."""
    groups = _DIGIT.findall(body)
    if kind == "card":
        digits = "".join(groups)
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [body, " ".join(groups), "-".join(groups), *_looser(kind, body)]
    local = groups[1:] or groups
    return [body, "+" + " ".join(groups), "-".join(local), " ".join(local), *_looser(kind, body)]


# numbers put before and after a card or phone number, in turn
_NEIGHBOURS = (("2024-01-31 ", ""), ("", " 12/27"), ("31.12.2024 ", " 12"), ("", " 2024-01-31"), ("17 ", " 250"))


def _examples(text: str) -> Iterator[tuple[list[float], float, str]]:
    base = base_spans(text)
    known, taken = set(base), _covered(text, base)
    for span in candidates(text):
        hit = span in known
        if hit or 1 not in taken[span[1] : span[2]]:
            yield features(text, span), float(hit), span[0]
    for at, (kind, start, end) in enumerate(base):
        head, tail = text[max(0, start - 60) : start], text[end : end + 60]
        loose = [("", body, "") for body in _looser(kind, text[start:end])]
        if kind in ("card", "phone"):
            forms = _grouped(kind, text[start:end])
            for i in range(start + at, start + at + 3):
                a, b = _NEIGHBOURS[i // len(forms) % len(_NEIGHBOURS)]
                loose.append((a, forms[i % len(forms)], b))
        for a, body, b in loose:
            whole, first, last = head + a + body + b + tail, len(head) + len(a), len(head) + len(a) + len(body)
            for span in candidates(whole):
                if span[1] < last and span[2] > first:  # the datum, or a span with wrong borders
                    right = span[0] == kind and abs(span[1] - first) <= 1 and abs(span[2] - last) <= 1
                    yield features(whole, span), float(right), span[0]
        for body in _DECOYS:
            for span in candidates(head + body + tail):
                if span[1] < len(head) + len(body) and span[2] > len(head):
                    yield features(head + body + tail, span), 0.0, span[0]


def train(docs: DataFrame, text: str = "text") -> Trees:
    """Trees from at most ``SAMPLE`` candidates, of one document in so many that about ``TEXTS`` are read.

    Which documents are read depends on their texts; equal texts count once.
    """
    one_of = max(1, docs.count() // TEXTS)
    chosen = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("mark")).where(F.pmod("mark", F.lit(one_of)) == 0)
    some = chosen.groupBy("mark").agg(F.any_value("text").alias("text")).where(F.col("text").rlike(_MARK))
    # rows of features only, so that long texts don't crowd the driver
    examples = some.select("text", "mark").mapInArrow(_rows, "mark bigint, row binary, label double, kind string")
    rows = examples.orderBy("mark", "row").limit(SAMPLE).toArrow()
    width = len(features("", ("email", 0, 0)))
    x = np.array([np.frombuffer(r, np.float32) for r in rows.column("row").to_pylist()], np.float64).reshape(rows.num_rows, width)
    y, mark = rows.column("label").to_numpy(), rows.column("mark").to_numpy()
    kind = np.array(rows.column("kind").to_pylist(), object)
    apart = mark % 4 == 0
    model = boost(x[~apart], y[~apart])
    scores = model.scores(x[apart]) if len(x) else np.zeros(0)
    for k in KINDS:
        model.thresholds[k] = _threshold(scores[kind[apart] == k], y[apart][kind[apart] == k])
    return model


def _threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The least score from which on the share of positives is high enough; 2 (never) without any."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(labels[order]) / np.arange(1, len(order) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True)[: len(order)]
    fine = np.flatnonzero((right >= PRECISION) & last & (scores[order] >= 0.5))
    return float(scores[order][fine[-1]]) if len(fine) else 2.0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, rows, labels, kinds = [], [], [], []
        for text, mark in zip(batch.column(0), batch.column(1).to_pylist()):
            for row, label, kind in _examples(text.as_py()):
                marks.append(mark)
                rows.append(np.array(row, np.float32).tobytes())
                labels.append(label)
                kinds.append(kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(marks, pa.int64()), pa.array(rows, pa.binary()), pa.array(labels, pa.float64()), pa.array(kinds, pa.string())],
            names=["mark", "row", "label", "kind"])


def find(text: str, model: Trees) -> list[tuple[str, int, int, bool]]:
    """Base spans, and candidates chosen by the trees where no base span is."""
    base = base_spans(text)
    taken = _covered(text, base)
    out = [(*b, True) for b in base]
    loose = [c for c in candidates(text) if 1 not in taken[c[1] : c[2]]]
    if loose:
        parts = (loose[i : i + 4096] for i in range(0, len(loose), 4096))
        scores = np.concatenate([model.scores(np.array([features(text, c) for c in part])) for part in parts])
        for i in np.argsort(-scores, kind="stable"):
            kind, start, end = loose[i]
            if scores[i] >= model.thresholds.get(kind, 2.0) and 1 not in taken[start:end]:
                taken[start:end] = b"\1" * (end - start)
                out.append((kind, start, end, False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_MAYBE = np.zeros(256, bool)
_MAYBE[[*range(48, 58), 64]] = True
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = kernels.texts(batch.column(1))
            spans: list[list[dict]] = []
            for a, b in kernels.pieces(offsets):
                piece = data[int(offsets[a]) : int(offsets[b])]
                marks = np.concatenate([[0], np.cumsum(_MAYBE[piece])])
                some = np.diff(marks[offsets[a : b + 1] - offsets[a]]) > 0
                for i in range(a, b):
                    body = data[int(offsets[i]) : int(offsets[i + 1])].tobytes()
                    maybe = some[i - a] or any(x in body for x in _MARKS)
                    found = find(body.decode("utf-8"), model) if maybe else []
                    spans.append([{"kind": k, "start": s, "stop": e, "base": f} for k, s, e, f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["id", "spans"])

    return run


def personal_data(docs: DataFrame, model: Trees | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row: ``array<struct<kind, start, stop, base>>`` sorted by start, then kind.

    Offsets count code points, ``stop`` is exclusive. Null and empty texts have no spans; null ids
    and repeated rows are returned as they are; other columns are ignored; an empty table gives an
    empty result. Without a model one is trained on ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id bigint, spans array<struct<kind: string, start: int, stop: int, base: boolean>>"
    return rows.mapInArrow(_search(shared), schema).withColumnRenamed("id", doc_id)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first stands."""
    out, reach = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= reach:
            out += [text[reach:start], f"[{kind.upper()}]"]
        reach = max(reach, stop)
    return "".join([*out, text[reach:]])
