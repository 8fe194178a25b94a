"""Secret scan with a recursive decoding worklist.

Each text is the first layer. Every layer is scanned, then unwrapped where it holds encoded parts:
percent-encoded runs, \\uXXXX and \\xXX escapes, base64 (plain or URL alphabet, also wrapped over lines
or as a part of a path), hex runs that hide a compressed stream, and zlib / gzip streams. A decoded part is a new layer that remembers which
characters of the text each of its characters came from, so a finding in any layer is reported as a
span of the text. The worklist ends at a fixpoint: a layer (content and place) that was seen before
is not opened again, so cycles and self-reproducing archives end. Of a decoded part that is no clean text
(under 95 % printable, or no UTF-8: archives, binary records, Latin-1, UTF-16) every run of 12 or more printable
characters is a layer.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: A decompressed layer above this many bytes is reported, as kind ``oversize``, and scanned in windows of so many.
LAYER_BYTES = 64 << 20
_PIECE = 1 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"[^\s%]*(?:%[0-9A-Fa-f]{2}[^\s%]*)+")
_PERCENT_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE_UNIT = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
_ESCAPED = re.compile(rf"(?:[^\s\\]*(?:{_ESCAPE_UNIT.pattern}))+[^\s\\]*")
#: Every hex or base64 run of some length is a part of one of these.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs on neighbouring lines: all but the first begin their line, all but the last end it.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]++)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_LETTERS = str.maketrans("-_", "+/")
#: Signs of the base64 alphabets that also part the words of a path or a name.
_CUT = re.compile(r"[+/_-]")
_LEAST = 16
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")


def base_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind: leftmost non-overlapping matches of each kind, failing ones dropped."""
    found = []
    runs = list(_RUN.finditer(text)) if runs is None else runs
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if any(r.end() - r.start() >= 24 for r in runs):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(start, end, KINDS[k]) for start, k, end in sorted(found)]


@dataclass
class Layer:
    """Text and, piecewise, its place in the document: from text position ``starts[k]`` on, either copied
    character by character from place[k][0] on, or as a whole decoded from place[k][0] to place[k][1]."""

    text: str
    path: str
    starts: list[int]
    place: list[tuple[int, int, bool]]  # source start, source end, one to one

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """Characters of the document that text[start:end] came from."""
        a, b = self._at(start)[0], self._at(end - 1)[1]
        return a, max(a + 1, b)

    def _at(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.starts, i) - 1
        a, b, same = self.place[k]
        return (a + i - self.starts[k], a + i - self.starts[k] + 1) if same else (a, b)


def _inner(outer: Layer, how: str, units: list[tuple[str, int, int, bool]]) -> Layer:
    """A layer from (decoded text, start, end in ``outer``, copied as is) units."""
    text, starts, place, at = [], [], [], 0
    for piece, a, b, same in units:
        if not piece:
            continue
        if same:  # a copied run may itself lie over several places of the document
            i = a
            while i < b:
                k = bisect_right(outer.starts, i) - 1
                stop = min(b, outer.starts[k + 1]) if k + 1 < len(outer.starts) else b
                s, e, one = outer.place[k]
                off = i - outer.starts[k]
                starts.append(at + i - a)
                place.append((s + off, s + off + stop - i, True) if one else (s, e, False))
                i = stop
        else:
            starts.append(at)
            place.append((*outer.origin(a, b), False))
        text.append(piece)
        at += len(piece)
    return Layer("".join(text), f"{outer.path}{how}>", starts, place)


def _readable(raw: bytes) -> str | None:
    try:
        s = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if s and sum(c.isprintable() or c in "\t\r\n" for c in s) >= 0.95 * len(s) else None


#: Printable ASCII of the length of the shortest secret, alone or with a zero byte after or before each character.
_RUNS = [(re.compile(rb"[\t\r\n\x20-\x7e]{12,}"), 1, 0), (re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){12,}"), 2, 0),
         (re.compile(rb"(?:\x00[\t\r\n\x20-\x7e]){12,}"), 2, 1)]


def _runs(raw: bytes) -> list[tuple[str, int, int, int]]:
    """(text, start, end, bytes per character) of what can be read of bytes that are no clean text: archives,
    binary records, Latin-1, UTF-16 of either byte order."""
    return [(m[0][first::width].decode("ascii"), *m.span(), width) for run, width, first in _RUNS for m in run.finditer(raw)]


def _stream(raw: bytes) -> str | None:
    if raw[:2] == b"\x1f\x8b":
        return "gzip"
    return "zlib" if len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0 else None


def _inflated(source):
    """Content, in pieces, of the compressed streams that stand one after another in the pieces of ``source``.

    What follows the last stream is left; an error in the first one is raised, a later one ends."""
    d, data, first = None, b"", True
    for piece in chain(source, [None]):
        data += piece or b""
        while data:
            if d is None:
                if piece is not None and len(data) < 3:
                    break
                if (how := _stream(data)) is None:
                    return
                d = zlib.decompressobj(31 if how == "gzip" else 15)
            try:
                out = d.decompress(data, _PIECE)
                data = d.unused_data if d.eof else d.unconsumed_tail
                while out:
                    yield out
                    out = d.decompress(b"", _PIECE) if not data and not d.eof else b""
            except zlib.error:
                if first:
                    raise
                return
            if d.eof:
                d, first, data = None, False, d.unused_data


def _inflate(raw: bytes) -> tuple[str, bytes] | None:
    """(how, content) of one or more compressed streams; None if it is none; content over LAYER_BYTES is cut there."""
    if (how := _stream(raw)) is None:
        return None
    parts, n = [], 0
    try:
        for out in _inflated([raw]):
            parts.append(out)
            if (n := n + len(out)) > LAYER_BYTES:
                break
    except zlib.error:
        return None
    return (how, b"".join(parts)) if n else None


def _scan_large(outer: Layer, how: str, a: int, b: int, source, big: list) -> None:
    """Adds to ``big`` what a large stream holds, window by window; each overlaps half of the one before.

    A span at an open end of a window is cut there: the next window holds it whole."""
    window, start, seen = b"", True, set()
    pieces = _inflated(source)
    while True:
        more = True
        while len(window) <= LAYER_BYTES and more:
            try:
                out = next(pieces, None)
            except zlib.error:
                out = None
            more = out is not None
            window += out or b""
        if start and _stream(window):
            try:
                nested = next(_inflated([window]), None)
            except zlib.error:
                nested = None
            if nested:
                _scan_large(outer, f"{how}>{_stream(window)}", a, b, chain([window], pieces), big)
                return
        part, window = window[:LAYER_BYTES], window[LAYER_BYTES // 2:]
        last = not more and len(part) <= LAYER_BYTES and len(window) <= LAYER_BYTES // 2
        mark = hashlib.blake2b(part, digest_size=16).digest()
        if mark not in seen:
            seen.add(mark)
            lead = 0
            while not start and lead < min(3, len(part)) and part[lead] & 0xC0 == 0x80:  # the rest of a cut character
                lead += 1
            n = lead + _valid(part[lead:])
            text = _readable(part[lead:] if last or n + 4 <= len(part) else part[lead:n])
            for text, first, final in [(text, True, True)] if text else [(r[0], r[1] == 0, r[2] == len(part)) for r in _runs(part)]:
                base, decoded = find_secrets(text)
                for x, y, kind in base + decoded:
                    if (start or not first or x > 0) and (last or not final or y < len(text)):
                        big.append((*outer.origin(a, b), f"{outer.path}{how}>{kind}"))
        if last:
            return
        start = False


def _bytes_layers(outer: Layer, how: str, a: int, b: int, raw: bytes, big: list) -> list[Layer]:
    seen = set()
    while (packed := _inflate(raw)) is not None:  # streams in streams: each step is one layer of the path
        how, inner = f"{how}>{packed[0]}", packed[1]
        if len(inner) > LAYER_BYTES:
            big.append((*outer.origin(a, b), f"{outer.path}{how}>oversize"))
            _scan_large(outer, how, a, b, [raw], big)
            return []
        raw, mark = inner, hashlib.blake2b(inner, digest_size=16).digest()
        if mark in seen:  # a stream that contains itself
            return []
        seen.add(mark)
    s = _readable(raw)
    return [_inner(outer, how, [(t, a, b, False)]) for t in ([s] if s else [r[0] for r in _runs(raw)])]


class _Base64:
    """Base64 letters that stand in pieces (start, end) of a layer's text."""

    def __init__(self, outer: Layer, pieces: list[tuple[int, int]]):
        self.outer, self.pieces, self.firsts = outer, pieces, []
        self.size = 0
        for a, b in pieces:
            self.firsts.append(self.size)
            self.size += b - a
        self.letters = "".join(outer.text[a:b] for a, b in pieces).rstrip("=").translate(_LETTERS)

    def place(self, i: int) -> int:
        k = bisect_right(self.firsts, i) - 1
        return self.pieces[k][0] + i - self.firsts[k]

    def raw(self, s: int, e: int) -> bytes:
        body = self.letters[s:e]
        return base64.b64decode(body[:-1] if len(body) % 4 == 1 else body + "=" * (-len(body) % 4))

    def open(self, s: int, e: int, big: list) -> list[Layer]:
        """The layer of the letters s .. e as one whole."""
        if (e - s) % 4 == 1:
            return []
        raw = self.raw(s, e)
        end = self.size if e == len(self.letters) else e  # padding belongs to the last letters
        packed = _inflate(raw)
        text = None if packed else _readable(raw)
        if text is None:
            return _bytes_layers(self.outer, "base64", self.place(s), self.place(end - 1) + 1, raw, big) if packed else []
        units, done = [], 0
        for c in text:  # a character lies on the four-letter groups that hold its bytes
            n = len(c.encode())
            units.append((c, self.place(s + done // 3 * 4), self.place(min(end, s + (done + n + 2) // 3 * 4) - 1) + 1, False))
            done += n
        return [_inner(self.outer, "base64", units)]

    def whole(self, big: list) -> list[Layer]:
        return self.open(0, len(self.letters), big) if len(self.letters) >= _LEAST else []

    def binary(self) -> list[Layer]:
        """What can be read in the letters as bytes, at each alignment, where they are no clean text as a whole."""
        out = []
        for k in range(4):
            for text, a, b, width in _runs(self.raw(k, len(self.letters))):
                # a character lies on the four-letter groups that hold its bytes
                spots = [(k + i // 3 * 4, k + (i + width + 2) // 3 * 4) for i in range(a, b, width)]
                out.append(_inner(self.outer, "base64", [(c, self.place(s), self.place(min(self.size, e) - 1) + 1, False)
                                                         for c, (s, e) in zip(text, spots, strict=True)]))
        return out

    def parts(self, big: list) -> list[Layer]:
        """Layers from the start or a cut on, as far as they can be read, up to the end or a cut."""
        out, last, size, known = [], (0, 0), len(self.letters), {}
        ends = [m.start() for m in _CUT.finditer(self.letters)] + [size]
        for s in [0] + [e + 1 for e in ends[:-1]]:
            if size - s < _LEAST or s < last[1] and (s - last[0]) % 4 == 0:  # the latter: a part of what was opened
                continue
            head = self.raw(s, s + 24)
            if _stream(head):
                tries = [size]
            elif _valid(head) + 4 > len(head):
                if s % 4 not in known or s >= known[s % 4].stop:  # each alignment is decoded once
                    known[s % 4] = _Utf8(s, self.raw(s, size))
                good, stop = known[s % 4].readable, known[s % 4].stop
                tries = [ends[bisect_right(ends, stop) - 1] if stop < size else size, ends[min(bisect_right(ends, s + _LEAST - 1), len(ends) - 1)]]
            else:
                continue
            for e in dict.fromkeys(tries):
                if e - s >= _LEAST and (_stream(head) or good(s, e)) and (found := self.open(s, e, big)):
                    out, last = out + found, (s, e)
                    break
        return out


class _Utf8:
    """What base64 letters from ``start`` on hold until the first byte that is no UTF-8."""

    def __init__(self, start: int, raw: bytes):
        n = _valid(raw)
        self.start, self.stop = start, start + n // 3 * 4 + 4
        self.chars, self.odd, at = [], [], 0
        for c in raw[:n].decode("utf-8"):
            self.chars.append(at)
            if not (c.isprintable() or c in "\t\r\n"):
                self.odd.append(at)
            at += len(c.encode())
        self.chars.append(at)

    def readable(self, s: int, e: int) -> bool:
        """Whether the letters s .. e make a text by the rule of _readable."""
        lo, hi = (s - self.start) // 4 * 3, (e - self.start) * 3 // 4
        a, b = bisect_left(self.chars, lo), bisect_left(self.chars, hi)
        if b >= len(self.chars) or self.chars[b] != hi or a >= b:
            return False
        odd = bisect_left(self.odd, hi) - bisect_left(self.odd, lo)
        return b - a - odd >= 0.95 * (b - a)


def _valid(raw: bytes) -> int:
    """How many bytes from the start are UTF-8."""
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start
    return len(raw)


def _base64_layers(outer: Layer, runs: list[re.Match], big: list) -> list[Layer]:
    out, joined = [], []
    for m in _WRAPPED.finditer(outer.text) if "\n" in outer.text else ():
        lines = [x.span() for x in _LINE.finditer(outer.text, *m.span())]
        n = len(lines)
        if sum(b - a for a, b in lines) < _LEAST:
            continue
        if found := _Base64(outer, lines).whole(big):
            out += found
            joined.append(m.span())
            continue
        i = 0
        while i < n:  # lines of one length, with or without the rest of a line before and a shorter one after
            j = i
            while j + 1 < n and lines[j + 1][1] - lines[j + 1][0] == lines[i][1] - lines[i][0]:
                j += 1
            for a, b in ((i - 1, j + 1), (i - 1, j), (i, j + 1), (i, j)):
                if 0 <= a < b < n and (found := _Base64(outer, lines[a:b + 1]).whole(big)):
                    out += found
                    joined.append((lines[a][0], lines[b][1]))
                    break
            i = j + 1
        if not joined or joined[-1][0] < m.start():
            run = _Base64(outer, lines)
            out += run.parts(big) + run.binary()
    joined.sort()
    firsts = [a for a, _ in joined]
    for m in runs:
        k = bisect_right(firsts, m.start()) - 1
        if k >= 0 and m.end() <= joined[k][1]:  # a line of what was opened
            continue
        run = _Base64(outer, [m.span()])
        out += run.whole(big) or run.parts(big) + run.binary()
    return out


def _unit_layer(outer: Layer, how: str, m: re.Match, unit: re.Pattern, decode) -> list[Layer]:
    units, at = [], m.start()
    for u in unit.finditer(outer.text, m.start(), m.end()):
        piece = decode(u[0])
        if piece is None:
            continue
        if at < u.start():
            units.append((outer.text[at:u.start()], at, u.start(), True))
        if isinstance(piece, list):
            units += [(c, u.start() + i, u.start() + j, False) for c, i, j in piece]
        else:
            units.append((piece, *u.span(), False))
        at = u.end()
    if not units:
        return []
    if at < m.end():
        units.append((outer.text[at:m.end()], at, m.end(), True))
    return [_inner(outer, how, units)]


def _percent(s: str) -> list | None:
    """(character, start, end); a byte that is no UTF-8 gives U+FFFD. None if no byte is."""
    out, at, any_good = [], 0, False
    for c in bytes.fromhex(s.replace("%", "")).decode("utf-8", "surrogateescape"):
        bad = "\udc80" <= c <= "\udcff"
        any_good |= not bad
        n = 1 if bad else len(c.encode())
        out.append(("\ufffd" if bad else c, 3 * at, 3 * (at + n)))
        at += n
    return out if any_good else None


def _escape(s: str) -> str | None:
    code = int(s.strip("\\uUx{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def unwrap(layer: Layer, runs: list[re.Match], big: list) -> list[Layer]:
    t, out = layer.text, []
    if "%" in t:
        for m in _PERCENT.finditer(t):
            out += _unit_layer(layer, "url", m, _PERCENT_UNIT, _percent)
    if "\\" in t:
        for m in _ESCAPED.finditer(t):
            out += _unit_layer(layer, "unicode", m, _ESCAPE_UNIT, _escape)
    out += _base64_layers(layer, runs, big)
    if any(r.end() - r.start() >= 32 for r in runs):
        for m in _LONG_HEX.finditer(t):
            raw = bytes.fromhex(m[0])
            if _inflate(raw) or _runs(raw):
                out += _bytes_layers(layer, "hex", *m.span(), raw, big)
    return out


def find_secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, spans of decoded layers), each (start, end, kind) in the text; decoded kinds carry their path."""
    runs = list(_RUN.finditer(text))
    base = base_spans(text, runs)
    first = Layer(text, "", [0], [(0, len(text), True)])
    todo, seen, more = unwrap(first, runs, big := []), set(), set()
    while todo:
        layer = todo.pop()
        mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.place[0], layer.place[-1]
        if mark in seen:
            continue
        seen.add(mark)
        runs = list(_RUN.finditer(layer.text))
        for a, b, kind in base_spans(layer.text, runs):
            more.add((*layer.origin(a, b), layer.path + kind))
        todo += unwrap(layer, runs, big)
    plain = {(a, b, k) for a, b, k in base}
    return base, sorted(x for x in more | set(big) if (x[0], x[1], x[2].rpartition(">")[2]) not in plain)


def _write(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _all(base, more):
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(base + more, key=lambda x: (x[0], rank.get(x[2], 9), x[2], x[1]))


def _scan(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            counts, digests, spans = [[], [], []], [], []
            for v in b.column(1).slice(lo, 1000):
                base, more = find_secrets(v.as_py() or "")
                for column, kind in zip(counts, KINDS, strict=True):
                    column.append(sum(k == kind for _, _, k in base))
                digests.append(hashlib.sha256(_write(base).encode()).hexdigest())
                spans.append(_write(_all(base, more)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, 1000).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs`` (doc_id, text).

    spans lists kind:start:end of everything found (code points, end exclusive); a kind from a decoded
    layer is led by its path, as in ``base64>url>assign``. A null text is empty. Repeated rows are
    scanned one by one.
    """
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def redact(text: str, mark: str = "[secret]") -> str:
    """``text`` with every found span replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    base, more = find_secrets(text)
    for a, b, _ in _all(base, more):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the secrets of its text column replaced; all other columns and null texts stay."""
    at, schema = df.columns.index(text), df.schema

    def run(batches):
        for b in batches:
            col = pa.array([None if v.as_py() is None else redact(v.as_py()) for v in b.column(at)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), col)

    return df.mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
