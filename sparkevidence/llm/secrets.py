"""Secret scans through nested encodings: a worklist of decoded layers, each scanned, until nothing new unwraps.

A text is the first layer. Every layer is scanned for assignments, access keys and hex runs, then unwrapped:

* percent escapes, character escapes (backslash u, U, x; numeric character references) and full-width forms
  give one new layer of the whole text each, in which the rest stands unchanged, so a key in plain letters
  and an encoded value still meet;
* every base64 run (standard or URL alphabet, also wrapped over lines) that holds text or compressed bytes
  (gzip, zlib, bzip2, xz, zstd) gives a layer of its own.

A layer remembers for each of its characters where it comes from in the original text, so a find in any layer
has a span in the original text; what was compressed maps to its whole run. Unwrapping ends at a fixpoint:
a layer whose content stands already among those that it came from, or that was already read at the same
place, is not read again. Compressed layers of more than `inflate_limit` bytes are not read; each is reported
as a span of kind `oversize`, so none is passed over in silence.

Defined cases: a null text is the empty text (no spans, the digest of the empty list); rows are judged each for
themselves, so repeated rows and null ids pass through; equal spans of several layers are one span; an
empty table gives an empty result; texts are read whole whatever their length. Other columns are not read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Bytes that one compressed layer may unwrap to.
INFLATE_LIMIT = 64 << 20
# The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "oversize")
_assign = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_access = re.compile(r"AKIA[A-Z0-9]{16,}")
_hex = re.compile(r"[0-9a-f]{24,}")
_LEAST_VALUE = 6

_percent = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_escape = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#[xX]([0-9A-Fa-f]{1,6});?|&#([0-9]{1,7});?")
_wide = re.compile("[\uff01-\uff5e]")
_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_runs = (
    re.compile(r"(?:[A-Za-z0-9+/]{40,}\r?\n)+[A-Za-z0-9+/]+={0,2}"),
    re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"),
    re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"),
)
_control = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


class Oversize(ValueError):
    """A compressed layer holds more than the limit."""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain matches, leftmost and non-overlapping in each kind."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= _LEAST_VALUE]
    # Runs are maximal, so a run that is too short holds no later match of its kind.
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


class Layer:
    """A text with the place in the original text of each of its characters (None: itself)."""

    __slots__ = ("above", "text", "starts", "ends")

    def __init__(self, text: str, starts: np.ndarray | None, ends: np.ndarray | None, above: frozenset[bytes] = frozenset()) -> None:
        self.text, self.starts, self.ends, self.above = text, starts, ends, above

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Where text[start:end], not empty, stands in the original text."""
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many."""
        return (starts, ends) if self.starts is None else (self.starts[starts], self.ends[ends - 1])


def _replaced(layer: Layer, pieces: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The layer's text with pieces (start, end, new text, and its characters' starts and ends in the layer) put in."""
    texts, starts, ends, at = [], [], [], 0
    for start, end, new, own_starts, own_ends in pieces:
        texts += [layer.text[at:start], new]
        kept = np.arange(at, start)
        starts += [kept, own_starts]
        ends += [kept + 1, own_ends]
        at = end
    kept = np.arange(at, len(layer.text))
    texts.append(layer.text[at:])
    return ("".join(texts), *layer.spans(np.concatenate([*starts, kept]), np.concatenate([*ends, kept + 1])))


def _widths(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def _unescape_percent(layer: Layer) -> tuple[str, np.ndarray, np.ndarray] | None:
    pieces = []
    for m in _percent.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        try:
            new = raw.decode()
        except UnicodeDecodeError:
            new = raw.decode("latin-1")
            sizes = np.ones(len(new), np.int64)
        else:
            sizes = _widths(new)
        ends = m.start() + 3 * np.cumsum(sizes)
        pieces.append((m.start(), m.end(), new, ends - 3 * sizes, ends))
    return _replaced(layer, pieces) if pieces else None


def _unescape_characters(layer: Layer) -> tuple[str, np.ndarray, np.ndarray] | None:
    units: list[tuple[int, int, int]] = []  # start, end, code point
    for m in _escape.finditer(layer.text):
        code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
        if code > 0x10FFFF:
            continue
        if 0xDC00 <= code < 0xE000 and units and units[-1][1] == m.start() and 0xD800 <= units[-1][2] < 0xDC00:
            start, _, high = units.pop()
            units.append((start, m.end(), 0x10000 + ((high - 0xD800) << 10) + code - 0xDC00))
        else:
            units.append((m.start(), m.end(), code))
    # Half of a pair alone is no character and stays as it is written.
    pieces = [(s, e, chr(c), np.array([s]), np.array([e])) for s, e, c in units if not 0xD800 <= c < 0xE000]
    return _replaced(layer, pieces) if pieces else None


def _narrow(layer: Layer) -> tuple[str, np.ndarray, np.ndarray] | None:
    if not _wide.search(layer.text):
        return None
    own = np.arange(len(layer.text))
    return (layer.text.translate(_NARROW), *layer.spans(own, own + 1))


def inflate(raw: bytes, limit: int = INFLATE_LIMIT) -> bytes | None:
    """Bytes of a compressed stream; None if it is none or broken. Oversize if it holds more than the limit."""
    if raw[:2] == b"\x1f\x8b":
        make = lambda: zlib.decompressobj(31)
    elif raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0:
        make = zlib.decompressobj
    elif raw[:3] == b"BZh":
        make = bz2.BZ2Decompressor
    elif raw[:6] == b"\xfd7zXZ\x00":
        make = lambda: lzma.LZMADecompressor(memlimit=256 << 20)
    elif raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        try:
            with zstandard.ZstdDecompressor(max_window_size=128 << 20).stream_reader(raw) as reader:
                out = reader.read(limit + 1)
        except zstandard.ZstdError:
            return None
        if len(out) > limit:
            raise Oversize
        return out
    else:
        return None
    try:
        stream = make()
        out = stream.decompress(raw, limit + 1)
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return None
    if len(out) > limit:
        raise Oversize
    return out if stream.eof else None


def _text_of(raw: bytes) -> tuple[str, np.ndarray] | None:
    """Text that bytes hold, and the bytes of each of its characters; None if they hold none."""
    if len(raw) >= 8 and len(raw) % 2 == 0 and not any(raw[1::2]):
        text, sizes = raw.decode("utf-16-le"), np.full(len(raw) // 2, 2)
    else:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return None
        sizes = _widths(text)
    return None if not text or _control.search(text) else (text, sizes)


def _unwrap_base64(layer: Layer, limit: int) -> Iterator[tuple[str, np.ndarray, np.ndarray] | tuple[int, int]]:
    """Layers in the base64 runs; (start, end) in the original text where one holds too much."""
    seen: set[tuple[int, int]] = set()
    for pattern in _runs:
        for m in pattern.finditer(layer.text):
            if m.span() in seen:
                continue
            seen.add(m.span())
            symbols = np.frombuffer(m[0].encode(), np.uint8)
            places = m.start() + np.flatnonzero((symbols != 0x0A) & (symbols != 0x0D) & (symbols != 0x3D))
            body = m[0].replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")
            body = body[: len(body) - (len(body) % 4 == 1)]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            whole = layer.span(m.start(), m.end())
            try:
                packed = inflate(raw, limit)
            except Oversize:
                yield whole
                continue
            if packed is not None:
                if found := _text_of(packed):
                    n = len(found[0])
                    yield found[0], np.full(n, whole[0]), np.full(n, whole[1])
            elif found := _text_of(raw):
                ends = np.cumsum(found[1])
                first, last = places[(ends - found[1]) * 4 // 3], places[(ends * 4 + 2) // 3 - 1] + 1
                yield found[0], *layer.spans(first, last)


def all_spans(text: str, limit: int = INFLATE_LIMIT) -> list[tuple[int, int, int]]:
    """(start, kind, end) in the text of what any layer holds, sorted, each once."""
    found: set[tuple[int, int, int]] = set()
    read: set[tuple[bytes, int, int]] = set()
    work = [Layer(text, None, None)]
    while work:
        layer = work.pop()
        for start, kind, end in base_spans(layer.text):
            own = layer.span(start, end)
            found.add((own[0], kind, own[1]))
        derived: list[tuple[str, np.ndarray, np.ndarray]] = []
        for unwrap in (_unescape_percent, _unescape_characters, _narrow):
            if new := unwrap(layer):
                derived.append(new)
        for new in _unwrap_base64(layer, limit):
            if len(new) == 2:
                found.add((new[0], KINDS.index("oversize"), new[1]))
            else:
                derived.append(new)
        if not derived:
            continue
        digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
        above = layer.above | {digest(layer.text)}
        for new, starts, ends in derived:
            own = digest(new)
            place = (own, int(starts[0]), int(ends[-1])) if new else (own, 0, 0)
            # A cycle, or the same layer at the same place by another way.
            if new and own not in above and place not in read:
                read.add(place)
                work.append(Layer(new, starts, ends, above))
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of each, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", inflate_limit: int = INFLATE_LIMIT) -> DataFrame:
    """Per row: counts and digest of the plain spans, all spans, and how many of those only decoding shows."""

    def run(texts: list[str]) -> dict[str, list]:
        base = [base_spans(t) for t in texts]
        every = [all_spans(t, inflate_limit) for t in texts]
        counts = [[sum(k == kind for _, k, _ in spans) for spans in base] for kind in range(3)]
        return {
            "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
            "base_sha256": [hashlib.sha256(listed(s).encode()).hexdigest() for s in base],
            "spans": [listed(s) for s in every], "n_decoded": [len(set(e) - set(b)) for e, b in zip(every, base)],
        }

    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long"
    return map_texts(docs, [key], text, run, fields)
