"""Personal data: pattern spans plus a character-level BiLSTM-CRF that adds what the patterns miss.

Every kind holds a digit or an at-sign, so the network reads regions of `REACH` characters around those. A region is
covered by overlapping windows; the windows' tag scores are averaged, weighted by the distance from the window's
edge, and one Viterbi pass over the whole region reconciles them, however long the region is.

The network learns from labelled windows: pattern spans of a bounded sample (`SAMPLE` windows, those with the least
content hash), half of them with the span's marks disturbed (no plus sign, dots inside a card number), so that it
learns the surroundings and the make of a span rather than one mark.

Defined results: a null or empty text has no span; ties between spans cannot arise, as spans of one kind never
overlap; an added span never overlaps a pattern span; without any labelled window only pattern spans are returned.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.llm import lstm_crf
from aislemetry.llm.common import field_name

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
STRIDE = 32
REACH = 32
SAMPLE = 3_000
SPARE = 2                   # texts looked at for each window of the sample, in the first look
BATCH = 512                 # windows of one network call, regions of one decoding call

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run either starts a match or none of its digits does, hence the look-behind keeps scans linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    spans, free, last = [], 0, -1
    at = text.find("@")
    while at >= 0:
        begin = max(free, last + 1)
        local = len(text[begin:at]) - len(text[begin:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            spans.append((0, at - local, domain.end()))
            free = domain.end()
        last, at = at, text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            spans.append((3, *m.span()))
    return spans


def codes(text: str) -> np.ndarray:
    """Symbol codes: ASCII as it is, 128 for other characters, of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, 128).astype(np.int16)


def regions(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of all digits and at-signs."""
    merged: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


# ---------------------------------------------------------------- learning

def _disturbed(piece: str, tag: np.ndarray, kind: int) -> tuple[str, np.ndarray]:
    inside = np.flatnonzero(tag)
    a, b = int(inside[0]), int(inside[-1]) + 1
    if kind == 3 and piece[a] == "+" and b - a > 1:
        tag = np.delete(tag, a)
        tag[a] = 2 * kind + 1
        return piece[:a] + piece[a + 1:], tag
    if kind == 2:
        return piece[:a] + piece[a:b].replace(" ", ".").replace("-", ".") + piece[b:], tag
    return piece, tag


def _labelled(batches):
    """(order, symbols, tags) windows around every span and around every other digit group."""
    for batch in batches:
        order, symbols, tags = [], [], []
        for text in batch.column("text").to_pylist():
            if not text or not _TRIGGER.search(text):
                continue
            spans = pattern_spans(text)
            tag = np.zeros(len(text), np.int8)
            for kind, a, b in reversed(spans):
                tag[a:b] = 2 * kind + 2
                tag[a] = 2 * kind + 1
            anchors = [(a, kind) for kind, a, b in spans if b - a < WINDOW]
            anchors += [(a + REACH, None) for a, b in regions(text) if not tag[a:b].any()][:len(anchors) + 2]
            for a, kind in anchors:
                digest = hashlib.blake2b(text[max(0, a - WINDOW):a + WINDOW].encode("utf-8", "surrogatepass"),
                                         digest_size=8).digest()
                lead = 4 + digest[0] % 24
                begin = max(0, a - lead)
                piece, own = text[begin:begin + WINDOW], tag[begin:begin + WINDOW].copy()
                if kind is not None and digest[1] % 2 and len({int(x + 1) // 2 for x in own if x}) == 1 \
                        and (own % 2).sum() == 1:
                    piece, own = _disturbed(piece, own, kind)
                coded = np.full(WINDOW, 32, np.int16)
                padded = np.zeros(WINDOW, np.int8)
                coded[:len(piece)], padded[:len(own)] = codes(piece), own
                order.append(int.from_bytes(digest, "little", signed=True))
                symbols.append(coded.tobytes())
                tags.append(padded.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(symbols, pa.binary()),
                                          pa.array(tags, pa.binary())], names=["o", "symbols", "tags"])


def learn(docs: DataFrame, text="text", sample=SAMPLE, steps=260) -> dict | None:
    """Train on the `sample` labelled windows with the least content hash; None without any.

    Every task sends its least windows to the driver. A first look keeps the share of all hashes that holds several
    times the sample, so what they send does not grow with the tasks; where that share is too small after all, a second
    look takes all windows. The sample is the same in both.
    """
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    windows = texts.mapInArrow(_labelled, "o long, symbols binary, tags binary")

    def least(some):
        return some.orderBy("o", "symbols", "tags").limit(sample).collect()

    share = min(1.0, SPARE * sample / max(texts.count(), 1))
    below = int(share * 2.0 ** 64) - 2 ** 63
    rows = least(windows.where(F.col("o") < F.lit(below))) if share < 1 else []
    if len(rows) < sample:
        rows = least(windows)
    if not rows:
        return None
    rows = list({(bytes(r["symbols"]), bytes(r["tags"])): None for r in rows})
    symbols = np.stack([np.frombuffer(s, np.int16) for s, _ in rows])
    tags = np.stack([np.frombuffer(t, np.int8) for _, t in rows]).astype(np.int64)
    return lstm_crf.train(lstm_crf.init(129, 2 * len(KINDS) + 1), symbols, tags, steps=steps)


# ---------------------------------------------------------------- finding

def _scores(model, pieces: list[np.ndarray]) -> list[np.ndarray]:
    """Reconciled tag scores [length, K] of each region's symbols."""
    starts = [list(range(0, max(1, len(x) - STRIDE), STRIDE)) for x in pieces]
    owner = [(k, s) for k, own in enumerate(starts) for s in own]
    tags = len(model["c"])
    total = [np.zeros((len(x), tags), np.float32) for x in pieces]
    weight = [np.zeros((len(x), 1), np.float32) for x in pieces]
    edge = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    for g in range(0, len(owner), BATCH):
        part = owner[g:g + BATCH]
        symbols = np.full((WINDOW, len(part)), 32, np.int16)
        for col, (k, s) in enumerate(part):
            own = pieces[k][s:s + WINDOW]
            symbols[:len(own), col] = own
        scored = lstm_crf.emissions(model, symbols)
        for col, (k, s) in enumerate(part):
            n = min(WINDOW, len(pieces[k]) - s)
            total[k][s:s + n] += scored[:n, col] * edge[:n, None]
            weight[k][s:s + n, 0] += edge[:n]
    return [t / np.maximum(w, 1e-6) for t, w in zip(total, weight)]


def _decoded(model, scores: list[np.ndarray]) -> list[np.ndarray]:
    out: list = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
    g = 0
    while g < len(order):
        part = [order[g]]
        while (g + len(part) < len(order) and len(part) < BATCH
               and len(scores[order[g + len(part)]]) <= len(scores[part[0]]) + WINDOW):
            part.append(order[g + len(part)])
        lengths = np.array([len(scores[k]) for k in part])
        grid = np.zeros((lengths.max(), len(part), scores[part[0]].shape[1]), np.float32)
        for col, k in enumerate(part):
            grid[:lengths[col], col] = scores[k]
        path = lstm_crf.viterbi(model, grid, lengths)
        for col, k in enumerate(part):
            out[k] = path[:lengths[col], col]
        g += len(part)
    return out


def _plausible(kind: int, piece: str) -> bool:
    digits = len(_DIGITS.findall(piece))
    if kind == 0:
        name, _, rest = piece.partition("@")
        return bool(name) and len(rest) > 2 and not re.search(r"\s", piece)
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", piece) is not None
    if kind == 2:
        return 15 <= digits <= 19 and re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", piece) is not None
    return 8 <= digits <= 15 and re.fullmatch(r"[+(]?[0-9][ ().0-9-]*[0-9]", piece) is not None \
        and re.search(r"[ ()-]", piece) is not None


def _runs(path: np.ndarray):
    """(kind, start, end) of tagged runs."""
    kind, a = -1, 0
    for t, tag in enumerate([*path.tolist(), 0]):
        own = (tag + 1) // 2 - 1
        if kind >= 0 and (own != kind or tag % 2):
            yield kind, a, t
            kind = -1
        if own >= 0 and kind < 0:
            kind, a = own, t


def find(model, rows: list[str]) -> list[tuple[list, list]]:
    """(pattern spans, added spans) of each text."""
    found, pieces, where = [], [], []
    for k, text in enumerate(rows):
        if not _TRIGGER.search(text):
            found.append(([], []))
            continue
        found.append((pattern_spans(text), []))
        if model is not None:
            coded = codes(text)
            for a, b in regions(text):
                pieces.append(coded[a:b])
                where.append((k, a))
    if pieces:
        for (k, offset), path in zip(where, _decoded(model, _scores(model, pieces))):
            if not path.any():
                continue
            base, added = found[k]
            for kind, a, b in _runs(path):
                a, b = a + offset, b + offset
                text = rows[k]
                while a < b and text[a].isspace():
                    a += 1
                while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
                    b -= 1
                if _plausible(kind, text[a:b]) and not any(x < b and a < y for _, x, y in base) \
                        and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                    added.append((kind, a, b))
    return found


def _named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _groups(rows: list[str], limit=4 << 20):
    """Consecutive rows with at most `limit` characters, one row at least."""
    begin, held = 0, 0
    for k, text in enumerate(rows):
        if held and held + len(text) > limit:
            yield begin, rows[begin:k]
            begin, held = k, 0
        held += len(text) + 1
    if begin < len(rows):
        yield begin, rows[begin:]


def _reported(batches, model):
    for batch in batches:
        rows = [t or "" for t in batch.column("__text").to_pylist()]
        rest = batch.drop_columns(["__text"])
        for begin, part in _groups(rows):
            found = find(model, part)
            counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in range(len(KINDS))]
            base_text = [_named(base) for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [*rest.slice(begin, len(part)).columns, *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base_text]),
                 pa.array([_named(base + more) for base, more in found]),
                 pa.array([len(more) for _, more in found], pa.int64())],
                names=[*rest.schema.names, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


def report(docs: DataFrame, text="text", doc_id="doc_id", model="learn") -> DataFrame:
    """doc_id, pattern span counts and digest, all spans, and the number of added spans."""
    model = learn(docs, text) if isinstance(model, str) else model
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda it: _reported(it, model), f"doc_id {kind}, n_email long, n_ip long, n_card long, "
                             "n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    joined: list[list] = []
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b, kind])
    for a, b, kind in joined:
        out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def _masked(batches, model, column):
    for batch in batches:
        values = batch.column(column).to_pylist()
        k = batch.schema.get_field_index(column)
        new: list = []
        for _, part in _groups([t or "" for t in values]):
            new += [masked(t, base + more) for t, (base, more) in zip(part, find(model, part))]
        new = [None if old is None else t for old, t in zip(values, new)]
        columns = list(batch.columns)
        columns[k] = pa.array(new, batch.schema.field(k).type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def redact(docs: DataFrame, text="text", n_chars="n_chars", model="learn") -> DataFrame:
    """`docs` with all spans masked and, where it has the column, the new number of characters. Nulls stay null."""
    model = learn(docs, text) if isinstance(model, str) else model
    names = docs.columns
    body = field_name(docs, "__body")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("rest"),
                         F.col(f"`{text}`").cast("string").alias(body))
    schema = packed.schema
    out = packed.mapInArrow(lambda it: _masked(it, model, body), schema)
    columns = []
    for c in names:
        if c == text:
            columns.append(F.col(body).alias(c))
        elif c == n_chars and text != n_chars:
            columns.append(F.coalesce(F.length(body), F.col("rest").getField(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("rest").getField(c).alias(c))
    return out.select(*columns)
