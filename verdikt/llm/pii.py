"""Personal data: spans by fixed patterns, and more by boosted trees over candidates.

Generators with high recall propose spans, which may overlap: digits grouped in any way, and spelled-out addresses. Each
is described by its format and its surroundings; a gradient-boosted ensemble of small trees for each kind scores it, and
those over a threshold become spans too, the surest first where they overlap. The trees learn from the corpus itself: spans that the
fixed patterns are sure of, in the ways people rewrite them, against other numbers and words in the same texts. The
thresholds are calibrated on texts held out from the trees.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import bounded_batches

#: The kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9][0-9 .()-]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def covered(text: str, spans: Iterable[Span]) -> bytearray:
    """A byte for each character, 1 within spans: a span is tried against any number of others in the time of its length."""
    marks = bytearray(len(text))
    for a, b in spans:
        marks[a:b] = b"\1" * (b - a)
    return marks


def touches(marks: bytearray, span: Span) -> bool:
    return marks.find(1, *span) >= 0


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches: a match starts where its run of local characters does, or where the last match ended."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the fixed patterns, leftmost and not overlapping within a kind; failing matches are dropped."""
    spans: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        spans["email"] = emails(text)
    for region in _NUMBERS.finditer(text):
        a, b = region.span()
        if b - a < 7:
            continue
        for m in _DOTTED.finditer(text, a, b):
            parts, at = m.group().split("."), m.start()
            while len(parts) >= 4:
                size = sum(map(len, parts[:4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[:4]):
                    spans["ip"].append((at, at + size))
                at, parts = at + size + 1, parts[4:]
        for m in _GROUPED.finditer(text, a, b):
            if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                spans["card"].append(m.span())
    if "+" in text:
        spans["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return spans


#: What generators propose. Every pattern is linear: repeated parts can't be split in two ways.
_NUMBER_LIKE = re.compile(r"[0-9]+(?:[ ./()_-]{1,3}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_SPELLED = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)* ?(?:\[at\]|\(at\)|\{at\}|<at>| at |@) ?[A-Za-z0-9-]+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}|<dot>| dot |\.) ?)[A-Za-z0-9-]+)+", re.IGNORECASE)
_SPELLED_HINT = re.compile(r"[\[({<]at[\])}>]| at [A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|<dot>)| dot |\.[A-Za-z0-9])", re.IGNORECASE)
_AT_WORD = re.compile(r"[\[({<]at[\])}>]| at ", re.IGNORECASE)

#: Words near personal data, by kind.
CUES = {
    "email": ("mail", "e-mail", "contact", "write", "reach", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login", "from"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "number", "telefon", "téléphone", "teléfono"),
}
FEATURES = ("digits", "length", "groups", "longest group", "shortest group", "dots", "dashes", "blanks", "parentheses", "slashes", "plus", "luhn", "parts up to 255", "first digit", "spelled at", "dots of host", "letter before", "letter after", "cue", "digit before", "digit after", "group of three", "group of four", "date-like", "last word", "capitals")


def candidates(text: str) -> list[tuple[str, Span]]:
    """Proposed spans with the kinds each might be; they may overlap, and may be fixed patterns' spans too."""
    found = []
    for m in _NUMBER_LIKE.finditer(text):  # every row of digit groups in it, as far as digits go: linear in the groups
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        for i, (first, _) in enumerate(groups):
            start, n = first - (first > 0 and text[first - 1] in "+("), 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                for kind, least, most in (("phone", 9, 15 + 2 * text.startswith("00", first)), ("card", 13, 19), ("ip", 4, 12)):
                    if least <= n <= most and (kind != "ip" or j - i == 3):
                        found.append((kind, (start, groups[j][1])))
    end = 0
    for hint in _SPELLED_HINT.finditer(text):
        last = start = hint.start() - (text[hint.start() - 1 : hint.start()] == " ")
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < last and (m := _SPELLED.match(text, start)) and m.end() > hint.start():
            found.append(("email", m.span()))
            end = m.end()
    return found


def describe(text: str, kind: str, span: Span) -> list[float]:
    a, b = span
    part, digits = text[a:b], _digits(text[a:b])
    if kind == "email":  # its digits say nothing
        digits = ""
    numbers = re.findall(r"[0-9]+", part) if digits else []
    groups = [len(g) for g in numbers] or [0]
    around = (text[max(0, a - 40) : a] + " " + text[b : b + 20]).lower()
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    return [
        len(digits), b - a if digits else 0, len(groups), max(groups), min(groups), part.count("."), part.count("-"), part.count(" "), part.count("(") + part.count(")"), part.count("/"), part.startswith("+"),
        luhn(digits) if digits else 0, all(len(g) < 4 and int(g) < 256 for g in numbers), int(digits[0]) if digits else -1, bool(_AT_WORD.search(part)), len(re.findall(r"dot|\.", part.lower())),
        before.isalpha(), after.isalpha(), any(c in around for c in CUES[kind]), before.isdigit(), after.isdigit(), groups.count(3), groups.count(4), bool(re.fullmatch(r"(19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}.*|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](19|20)[0-9]{2}.*", part)),
        len(re.split(r"[^A-Za-z]+", part.rstrip(")]}>"))[-1]), any("A" <= c <= "Z" for c in part) if kind == "email" else 0,
    ]


def _rewritten(kind: str, value: str, lot: int) -> list[str]:
    """Ways in which people write what a fixed pattern has found."""
    d = _digits(value)
    if kind == "email":
        local, _, host = value.partition("@")
        ats, dots = (" at ", " [at] ", "(at)", " (at) "), (" dot ", " [dot] ", ".", "(dot)")
        return [local + ats[lot % 4] + host.replace(".", dots[(lot // 4) % 4])]
    if kind == "phone":
        c, e, f, g = d[:-10], d[-10:-7], d[-7:-4], d[-4:]
        return [(f"({e}) {f}-{g}", f"{e}-{f}-{g}", f"{e}.{f}.{g}", f"{c}-{e}-{f}-{g}", f"00{c} {e} {f} {g}", f"{e} {f} {g}")[lot % 6]] if len(d) >= 10 else []
    if kind == "card":
        return [(".", "/", "_", "  ")[lot % 4].join(d[i : i + 4] for i in range(0, len(d), 4))]
    return [value.replace(".", (" . ", "-", ". ", "_")[lot % 4])]


def _decoys(kind: str, lot: int, digits: str) -> list[str]:
    """Numbers and words of like form that aren't personal data."""
    d = (digits * 20)[lot % 7 : lot % 7 + 19] or "0"
    if kind == "email":
        return [("look at this.And", "meet at noon.Then", "was at the place. It", "stopped at nine.Later")[lot % 4]]
    if kind == "phone":
        return [(d[:11], f"2019-{int(d[:2]) % 12 + 1:02}-{int(d[2:4]) % 28 + 1:02} 10.30", f"{d[:2]}.{d[2:5]}.{d[5:9]}", f"{d[:6]}/{d[6:11]}", f"{d[:1]} {d[1:2]} {d[2:3]} {d[3:9]}", f"{d[:5]}-{d[5:10]}")[lot % 6]]
    if kind == "card":
        bad = d[:15] + str((int(d[15]) + 1) % 10 if luhn(d[:16]) else d[15])
        return [(bad, ".".join(bad[i : i + 4] for i in range(0, 16, 4)), d[:14] if not luhn(d[:14]) else d[:13] + "0", "-".join(d[i : i + 5] for i in range(0, 15, 5)))[lot % 4]]
    return [(f"{d[:3]}-{d[3:6]}-{d[6:9]}-{d[9:12]}", f"9{d[:2]}-{d[2:4]}-{d[4:6]}-{d[6:8]}", f"1 . {d[:4]} . {d[4:6]} . 7", f"{d[:4]}_{d[4:8]}_{d[8:9]}_{d[9:10]}")[lot % 4]]


def examples(text: str, row: int) -> Iterator[tuple[str, list[float], int]]:
    """Candidates from one text: kind, features, and 1, 0 or -1. Each base span gives a rewritten one in its place and a
    decoy; other candidates of the text aren't labelled, and count as negatives but for those that settled() leaves out."""
    spans = base_spans(text)
    taken = covered(text, (s for k in KINDS for s in spans[k]))
    for kind in KINDS:
        for n, (a, b) in enumerate(spans[kind]):
            lot = row + n
            for label, values in ((1, _rewritten(kind, text[a:b], lot)), (0, _decoys(kind, lot, _digits(text[a:b]) or "4071"))):
                for value in values:
                    placed = text[max(0, a - 60) : a] + value + text[b : b + 60]
                    yield kind, describe(placed, kind, (min(a, 60), min(a, 60) + len(value))), label
    for kind, (a, b) in candidates(text):
        if not touches(taken, (a, b)):
            yield kind, describe(text, kind, (a, b)), -1


#: Features of the surroundings and the digits' values; the others are of the form.
_NOT_FORM = ("luhn", "first digit", "letter before", "letter after", "cue", "digit before", "digit after")
_FORM = [i for i, name in enumerate(FEATURES) if name not in _NOT_FORM]


def settled(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which examples are learnt from: all but unlabelled ones (-1) in the form of a known positive, which may be personal data."""
    forms = {tuple(row) for row in x[y == 1][:, _FORM]}
    return np.array([label >= 0 or tuple(row) not in forms for row, label in zip(x[:, _FORM], y, strict=True)])


class Trees:
    """Gradient boosting for two classes: trees of depth three on sorted cuts, Newton steps, shrunk."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.2, depth: int = 3, least: float = 2.0) -> None:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start, self.rate, self.depth, self.trees = float(np.log(share / (1 - share))), rate, depth, []
        cuts = [(f, c) for f in range(x.shape[1]) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1], method="inverted_cdf"))]
        below = np.stack([x[:, f] <= c for f, c in cuts], 1) if cuts else np.zeros((len(x), 0), bool)
        margin = np.full(len(x), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.zeros(len(x), np.int64), {}
            for level in range(depth):
                for k in range(1 << level):
                    rows = np.flatnonzero(node == k)
                    left_g, left_h = slope[rows] @ below[rows], curve[rows] @ below[rows]
                    g, h = slope[rows].sum(), curve[rows].sum()
                    gain = left_g**2 / (left_h + least) + (g - left_g) ** 2 / (h - left_h + least)
                    tree[level, k] = cuts[int(gain.argmax())] if len(rows) and len(cuts) else (0, np.inf)
                f, c = (np.array([tree[level, k][i] for k in range(1 << level)]) for i in (0, 1))
                node = node * 2 + (x[np.arange(len(x)), f[node].astype(int)] > c[node])
            leaves = np.bincount(node, slope, 1 << depth) / (np.bincount(node, curve, 1 << depth) + least)
            self.trees.append((tree, leaves * rate))
            margin += rate * leaves[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                f, c = (np.array([tree[level, k][i] for k in range(1 << level)]) for i in (0, 1))
                node = node * 2 + (x[np.arange(len(x)), f[node].astype(int)] > c[node])
            total += leaves[node]
        return total


def threshold(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Half-way between the least margin above which the held-out candidates have that precision and the next margin
    below; infinite if there is none."""
    order = np.argsort(-margin, kind="stable")
    right, cut = np.cumsum(y[order]) / np.arange(1, len(y) + 1), margin[order]
    good = np.flatnonzero((right >= precision) & np.r_[cut[1:] != cut[:-1], True])
    if not len(good):
        return float("inf")
    return float(cut[good[-1] : good[-1] + 2].mean())


def learn(documents: DataFrame, text_column: str = "text", sample_rows: int = 4000, precision: float = 0.98) -> dict[str, tuple[Trees, float]]:
    """Trees and their threshold for each kind, from about sample_rows texts at most that hold digits or @, chosen by
    hash; every third one's candidates calibrate and aren't learnt from. Kinds without examples of both labels have none."""
    rows = documents.select(F.col(f"`{text_column}`").alias("text")).filter("text RLIKE '[0-9@]'").select("text", F.xxhash64("text").alias("h"))
    n = rows.count()
    if not n:
        return {}
    part = min(1.0, sample_rows / n)
    chosen = rows.filter(F.col("h") <= F.lit(int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1)).dropDuplicates(["h"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, marks, labels, hashes = [], [], [], []
            for text, h in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for kind, x, y in examples(text.as_py(), h % 97):
                    kinds.append(kind), marks.append([float(v) for v in x]), labels.append(y), hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(marks, pa.list_(pa.float64())), pa.array(labels, pa.int32()), pa.array(hashes, pa.int64())], names=["kind", "x", "y", "h"])

    seen = chosen.mapInArrow(look, "kind string, x array<double>, y int, h long").toPandas().sort_values(["h", "kind", "y"], kind="stable")
    model = {}
    for kind in KINDS:
        own = seen[seen["kind"] == kind]
        if not ((own["y"] == 1).any() and (own["y"] < 1).any()):
            continue
        x, y, held = np.stack(own["x"].to_numpy()), own["y"].to_numpy(float), (own["h"] % 3 == 0).to_numpy()
        clear = settled(x, y)
        x, y, held = x[clear], np.maximum(y[clear], 0), held[clear]
        if len(set(y)) < 2:
            continue
        if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
            held = np.zeros(len(y), bool)
        trees = Trees(x[~held], y[~held])
        check = held if held.any() else ~held
        model[kind] = (trees, max(0.0, threshold(trees.margin(x[check]), y[check], precision)))
    return model


def added_spans(texts: list[str], base: list[dict[str, list[Span]]], model: dict[str, tuple[Trees, float]]) -> list[list[tuple[str, Span]]]:
    """For each text the candidates over their threshold that touch no base span, the surest first where they overlap."""
    marks = [covered(text, (s for k in KINDS for s in own[k])) for text, own in zip(texts, base, strict=True)]
    proposed = [(i, kind, span) for i, text in enumerate(texts) for kind, span in candidates(text) if kind in model and not touches(marks[i], span)]
    added: list[list[tuple[str, Span]]] = [[] for _ in texts]
    sure = []
    for kind in model:
        own = [p for p in proposed if p[1] == kind]
        if own:
            trees, least = model[kind]
            margins = trees.margin(np.array([describe(texts[i], kind, span) for i, _, span in own], float))
            sure += [(-m, i, kind, span) for m, (i, _, span) in zip(margins, own, strict=True) if m >= least]
    for _, i, kind, span in sorted(sure):
        if not touches(marks[i], span):
            marks[i][span[0] : span[1]] = b"\1" * (span[1] - span[0])
            added[i].append((kind, span))
    return added


def joined(spans: list[tuple[str, Span]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, (a, b) in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = 4000, redact: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), base_sha256, spans (all), n_added and redacted (the text
    with each span replaced by its kind in brackets, if redact) of every row. Null texts are empty (redacted stays null), equal
    rows get equal results, an empty table gives none, other columns aren't read. A very long text takes time and memory in
    proportion to its length."""
    bounded_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(learn(documents, text_column, sample_rows))  # some hundred nodes

    schema = f"doc_id {documents.schema[id_column].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long" + ", redacted string" * redact
    names = [column.split()[0] for column in schema.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                ids, column = (batch.column(i).slice(at, 500) for i in (0, 1))
                raw = column.to_pylist()
                texts = [t or "" for t in raw]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, model.value)
                flat = [[(k, s) for k in KINDS for s in b[k]] for b in base]
                hidden = []
                for text, spans, extra in zip(raw, flat, more, strict=True) if redact else ():
                    parts, end = [], 0
                    for kind, (a, b) in sorted(spans + extra, key=lambda s: s[1]):
                        if b > end:
                            parts += [text[end : max(a, end)], f"[{kind}]"]
                            end = b
                    hidden.append(text if text is None else "".join([*parts, text[end:]]))
                columns = [ids, *(pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS), pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in flat]), pa.array([joined(s + e) for s, e in zip(flat, more, strict=True)]), pa.array([len(e) for e in more], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(hidden, pa.string())] * redact, names=names)

    return documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")).mapInArrow(search, schema)
