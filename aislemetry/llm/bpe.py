"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

How far right can a text change the token boundary at a place? A boundary at k disappears only if a merge (s, c) with
c starting at k happens; whether c exists there depends on the boundary behind c, which in turn depends only on merges
of a *lower* rank whose left part ends like c. Following these chains through the merge list in rank order gives the
longest reach, `lookahead`. A token that ends at least that many symbols before the end of what has been read is
stable and is emitted; the rest stays in the buffer. The buffer never exceeds a block plus the lookahead, whatever the
length of a word. Short words, nearly all, are one block each: those that a cache of bounded words does not know are
merged together, one merge of every word per step, in arrays. Words of several texts share such steps; at most `PART`
words are held.

Decoding is a state machine over token bytes that emits text as soon as a character is complete.

The vocabulary file is a parameter: a JSON file in the format of the public tokenizers library with NFC, blank and
lower-case normalisation and word-end suffixes. The driver reads it once; its tables travel by broadcast, a size given
by the vocabulary, not the data.

Defined results: a null or empty text has no tokens and decodes to the empty text; special tokens inside a text are
single ids; equal texts have equal tokens; lone surrogates cannot occur in Spark strings.
"""
from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from aislemetry.llm.common import field_name

CACHE = 200_000             # words a worker remembers; the older half is forgotten when the newer one is full
REMEMBERED = 128            # characters of the longest word that is remembered
NARROW = 40                 # bytes of the longest word that is merged together with others
SLICE = 1 << 16             # characters that are cut into words at a time, up to the next blank
END = "</w>"
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_BLANK = regex.compile(r"\s")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 and up in order."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in kept else spare))
        spare += b not in kept
    return out


def _newer() -> str:
    """Code points that this Python's Unicode tables do not know."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")


def _ranges(chars: str) -> str:
    spans: list[list[int]] = []
    for point in map(ord, chars):
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def unicode_rules() -> tuple[regex.Pattern, dict]:
    """Word pattern and lower-case table of newer letters.

    Python, the regex module and the tokenizers library come with different Unicode versions. For the code points
    that Python does not know, the library's own character classes decide, so that later versions agree with it too.
    """
    newer = _newer()

    def of(kind):
        split = pre_tokenizers.Split(Regex(rf"[\p{{{kind}}}]"), "removed", invert=True)
        return "".join(piece for piece, _ in split.pre_tokenize_str(newer))

    both = {kind: of(kind) for kind in "LN"}
    less, more = _ranges(newer), {kind: _ranges(chars) for kind, chars in both.items()}
    letter, number = (rf"[[\p{{{kind}}}--[{less}]]{more[kind]}]" for kind in "LN")
    lowered = normalizers.Lowercase().normalize_str(newer)
    table = {ord(c): low for c, low in zip(newer, lowered) if low != c} if len(lowered) == len(newer) else {}
    table[ord("Σ")] = "σ"               # lower-casing is per character: a final sigma is no special case
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|(?:(?!{letter}|{number})\S)+",
                         regex.V1), table


class Tables:
    """Vocabulary, ranks and lookahead of one tokenizer file; plain data that can be shipped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {(a, b): (k, a + b) for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.lookahead = lookahead(pairs)
        # The same merges as arrays: pairs of ids in order with their ranks, and the token that each rank makes.
        self.base = max(self.ids.values()) + 1
        keys = np.array([self.ids[a] * self.base + self.ids[b] for a, b in self.ranks], np.int64)
        ranks = np.array([k for k, _ in self.ranks.values()], np.int32)
        self.keys, self.key_ranks = np.sort(keys), ranks[np.argsort(keys)]
        self.made = np.zeros(len(pairs), np.int32)
        self.made[ranks] = [self.ids[whole] for _, whole in self.ranks.values()]
        self.bytes = np.array([[self.ids[c], self.ids[c + END]] for c in byte_symbols()], np.int32)


def _width(token: str) -> int:
    return len(token.removesuffix(END))


def lookahead(pairs: list[tuple[str, str]]) -> int:
    """Symbols right of a place that can decide whether a token ends there."""
    by_left: dict[str, int] = {}        # longest reach of the merges so far with this left part
    by_ending: dict[str, int] = {}      # the same, for left parts that end like this
    most = longest = 0
    for a, b in pairs:
        reach = max([by_ending.get(b, 0), *(by_left.get(b[k:], 0) for k in range(1, len(b)))])
        reach += _width(b)
        by_left[a] = max(by_left.get(a, 0), reach)
        for k in range(len(a)):
            if by_ending.get(a[k:], 0) < reach:
                by_ending[a[k:]] = reach
        most, longest = max(most, reach), max(longest, _width(a) + _width(b))
    return most + longest


_NONE = (1 << 60, "")


def merge(symbols: list[str], ranks) -> list[str]:
    """Tokens of a complete run of symbols: least rank first, leftmost first."""
    if len(symbols) < 40:
        symbols = list(symbols)
        hits = [ranks.get(pair, _NONE) for pair in zip(symbols, symbols[1:])]
        while hits and (best := min(hits)) is not _NONE:
            k = hits.index(best)
            symbols[k:k + 2] = [best[1]]
            del hits[k]
            if k:
                hits[k - 1] = ranks.get((symbols[k - 1], best[1]), _NONE)
            if k < len(hits):
                hits[k] = ranks.get((best[1], symbols[k + 1]), _NONE)
        return symbols
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(hit[0], k, symbols[k], symbols[k + 1], hit[1]) for k in range(n - 1)
            if (hit := ranks.get((symbols[k], symbols[k + 1])))]
    heapq.heapify(heap)
    live: list = list(symbols)
    while heap:
        _, k, a, b, whole = heapq.heappop(heap)
        m = after[k]
        if live[k] != a or m >= n or live[m] != b:
            continue
        live[k], live[m] = whole, None
        after[k] = after[m]
        if after[m] < n:
            before[after[m]] = k
        for left, right in ((before[k], k), (k, after[k])):
            if left >= 0 and right < n:
                hit = ranks.get((live[left], live[right]))
                if hit:
                    heapq.heappush(heap, (hit[0], left, live[left], live[right], hit[1]))
    return [x for x in live if x is not None]


class Transducer:
    """Symbols in, stable tokens out; at most `block` + lookahead symbols are held."""

    def __init__(self, ranks, lookahead: int, block: int | None = None):
        self.ranks, self.reach = ranks, lookahead
        self.block = block or 2 * lookahead
        self.held: list[str] = []

    def feed(self, symbols):
        """Tokens that have become stable."""
        at = 0
        while at < len(symbols):
            room = self.block + self.reach - len(self.held)
            self.held += symbols[at:at + room]
            at += room
            if len(self.held) >= self.block + self.reach:
                yield from self._stable()

    def _stable(self):
        limit, end = len(self.held) - self.reach, 0
        for token in merge(list(self.held), self.ranks):
            if end + _width(token) > limit:
                break
            end += _width(token)
            yield token
        self.held = self.held[end:]

    def finish(self):
        """The tokens of what is left; the word ends here."""
        rest, self.held = self.held, []
        if rest:
            rest[-1] += END
            yield from merge(rest, self.ranks)


_NEVER = np.int32((1 << 31) - 1)


def merge_words(words: list[bytes], t: Tables) -> list[bytes]:
    """Ids of complete words as bytes; every step makes the next merge of each word that has one."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols = t.bytes[np.frombuffer(b"".join(words), np.uint8), 0]
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    last = np.cumsum(sizes) - 1
    symbols[last] = t.bytes[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8), 1]

    def ranks(at):
        """Ranks of the pairs that begin at these places."""
        next_ = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] * np.int64(t.base) + symbols[next_]
        k = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        return np.where((t.keys[k] == key) & (word[at] == word[next_]) & (next_ > at), t.key_ranks[k], _NEVER)

    rank, ready = ranks(np.arange(len(symbols))), []
    while len(symbols):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(word)))
        open_ = best != _NEVER
        if not open_.all():
            ready.append((word[~open_], symbols[~open_]))
            word, symbols, rank, best = word[open_], symbols[open_], rank[open_], best[open_]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == best)
        at = hit[np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))]
        symbols[at] = t.made[rank[at]]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        word, symbols, rank = word[stay], symbols[stay], rank[stay]
        at = at - np.arange(len(at))    # one symbol less per merge before it
        rank[at] = ranks(at)
        left = at[at > 0] - 1
        rank[left] = ranks(left)
    word, ids = (np.concatenate(x) for x in zip(*ready)) if ready else (np.zeros(0, np.int32), np.zeros(0, np.int32))
    blob = ids[np.argsort(word, kind="stable")].astype("<u4").tobytes()
    ends = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    def __init__(self, tables: Tables):
        self.t = tables
        self.symbols = byte_symbols()
        self.rules = None               # made at the first text that needs them
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(
            tables.special, key=len, reverse=True))) + ")") if tables.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, lists):
        """Make sure that all words of these lists are known."""
        if len(self.known) > CACHE // 2:
            self.older, self.known = self.known, {}
        new = set().union(*lists).difference(self.known)
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        fresh = [w for w in new if w not in self.older]
        raw = [w.encode("utf-8") for w in fresh]
        narrow = [k for k, w in enumerate(raw) if len(w) <= NARROW]
        if narrow:
            self.known.update(zip([fresh[k] for k in narrow], merge_words([raw[k] for k in narrow], self.t)))
        for k, w in enumerate(raw):
            if len(w) > NARROW:
                self.known[fresh[k]] = b"".join(self._long(fresh[k]))

    def _long(self, word: str):
        """Ids of one word of any length, some at a time."""
        stream = Transducer(self.t.ranks, self.t.lookahead)
        parts = (stream.feed([self.symbols[b] for b in word[k:k + PART].encode("utf-8")])
                 for k in range(0, len(word), PART))
        tokens = chain(chain.from_iterable(parts), stream.finish())
        while some := list(islice(tokens, PART)):
            yield np.array([self.t.ids[x] for x in some], "<u4").tobytes()

    @staticmethod
    def _words(plain: str, pattern, blank):
        """Lists of consecutive words; a part without blanks may be of any length, so its words come one by one."""
        at = 0
        while at < len(plain):
            gap = blank.search(plain, at + SLICE) if at + SLICE < len(plain) else None
            end = gap.start() if gap else len(plain)
            if end - at <= 2 * SLICE:
                yield pattern.findall(plain, at, end)
            else:
                for m in pattern.finditer(plain, at, end):
                    yield [m[0]]
            at = end

    def pieces(self, text: str):
        """(special token or None, lists of words) of consecutive parts of a text."""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.t.special:
                yield part, []
            elif part:
                # Blanks only part words, so how many there are does not matter. Lower-casing is per character: a
                # final sigma is no special case.
                if part.isascii():
                    yield None, self._words(part.lower(), _ASCII_WORD, _BLANK)
                    continue
                plain = unicodedata.normalize("NFC", part)
                if all(unicodedata.category(c) != "Cn" for c in set(plain)):
                    yield None, self._words(plain.replace("Σ", "σ").lower(), _WORD, _BLANK)
                else:
                    self.rules = self.rules or unicode_rules()
                    yield None, self._words(plain.translate(self.rules[1]).lower(), self.rules[0], _BLANK)

    def runs(self, texts):
        """The ids of texts as little-endian unsigned 32-bit integers, some at a time; None after each text."""
        held: list = []                 # lists of words, ids of special tokens, ends of texts
        size = 0
        for text in texts:
            for special, lists in self.pieces(text):
                if special is not None:
                    held.append(np.array([self.t.special[special]], "<u4").tobytes())
                for words in lists:
                    held.append(words)
                    size += len(words) + 1
                    if size >= PART:
                        yield from self._emit(held)
                        held, size = [], 0
            held.append(None)
        yield from self._emit(held)

    def _emit(self, held):
        long = {k for k, words in enumerate(held) if isinstance(words, list) and words
                and max(map(len, words)) > REMEMBERED}
        self._learn(words if k not in long else [w for w in words if len(w) <= REMEMBERED]
                    for k, words in enumerate(held) if isinstance(words, list))
        known = self.known.__getitem__
        for k, item in enumerate(held):
            if not isinstance(item, list):
                yield item
            elif k not in long:
                yield b"".join(map(known, item))
            else:
                for w in item:
                    if len(w) <= REMEMBERED:
                        yield known(w)
                    else:
                        yield from self._long(w)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the tokens joined by spaces."""
        ids = b"".join(x for x in self.runs([text]) if x is not None)
        return ids, Decoder(self.t).feed(np.frombuffer(ids, "<u4").tolist())


class Decoder:
    """Token ids in, text out, as soon as characters are complete.

    `plain` turns word ends into blanks and bytes into text; otherwise the tokens themselves are shown with blanks
    between them, which is what a tokenizer file without a decoder asks for.
    """

    def __init__(self, tables: Tables, plain=False):
        self.plain = plain
        self.special = {i: t for t, i in tables.special.items()}
        self.names = {i: t for t, i in tables.ids.items()} | self.special
        self.bytes = {s: b for b, s in enumerate(byte_symbols())}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids) -> str:
        if not self.plain:
            begun, self.begun = self.begun, self.begun or bool(ids)
            return " " * (begun and bool(ids)) + " ".join(map(self.names.__getitem__, ids))
        out = []
        for i in ids:
            name = self.names[i]
            if i in self.special:
                out.append(self.state.decode(b"", True) + name)
                self.state.reset()
            else:
                body = name.removesuffix(END)
                out.append(self.state.decode(bytes(self.bytes[c] for c in body)))
                if body != name:
                    out.append(self.state.decode(b"", True) + " ")
                    self.state.reset()
        return "".join(out)

    def finish(self) -> str:
        return self.state.decode(b"", True) if self.plain else ""


# ---------------------------------------------------------------- Spark side

PART = 32_768               # words encoded at a time, and symbols of a long word read at a time
_coders: dict = {}          # one per worker process and file, so that caches outlive a task


def _coded(batches, shared, key, wanted):
    if key not in _coders:
        _coders.clear()
        tables = shared.value
        _coders[key] = (Encoder(tables), Decoder(tables), Decoder(tables, plain=True))
    encoder, shown, plain = _coders[key]
    for batch in batches:
        rest = batch.drop_columns(["__text"])
        column = batch.column("__text")
        for begin in range(0, batch.num_rows, 256):
            part = column.slice(begin, 256)
            made: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            size, digest, back, held = 0, hashlib.sha256(), hashlib.sha256(), []
            shown.begun = False
            for ids in encoder.runs(value.as_py() or "" for value in part):
                if ids is not None:
                    size += len(ids) // 4
                    digest.update(ids)
                    if "decoded_sha256" in wanted:
                        back.update(shown.feed(np.frombuffer(ids, "<u4").tolist()).encode())
                    if "ids" in wanted or "decoded" in wanted:
                        held.append(ids)
                    continue
                back.update(shown.finish().encode())
                made["n_tokens"].append(size)
                made["ids_sha256"].append(digest.hexdigest())
                made["decoded_sha256"].append(back.hexdigest())
                whole = np.frombuffer(b"".join(held), "<u4")
                if "ids" in wanted:
                    made["ids"].append(whole.astype(np.int32))
                if "decoded" in wanted:
                    plain.state.reset()
                    made["decoded"].append(plain.feed(whole.tolist()) + plain.finish())
                size, digest, back, held = 0, hashlib.sha256(), hashlib.sha256(), []
                shown.begun = False
            yield pa.RecordBatch.from_arrays(
                [*rest.slice(begin, len(part)).columns, *(pa.array(made[c], _ARROW[c]) for c in wanted)],
                names=[*rest.schema.names, *wanted])


_ARROW = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
          "ids": pa.list_(pa.int32()), "decoded": pa.string()}
_SPARK = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>",
          "decoded": "string"}


def encode(docs: DataFrame, path: str, text="text", keep=("doc_id",),
           wanted=("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """The `keep` columns of every row with the wanted ones of: n_tokens, ids_sha256, decoded_sha256, ids, decoded.

    `decoded_sha256` digests the tokens as the file's own decoding shows them, `decoded` is plain text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Tables(path))
    body = field_name(docs, "__text")
    kept = [c for c in keep if c not in wanted]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(body))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != body),
                        *(f"{c} {_SPARK[c]}" for c in wanted)])
    return source.withColumnRenamed(body, "__text").mapInArrow(
        lambda it: _coded(it, shared, path, wanted), schema)
