"""Secret scan with a recursive decoding worklist.

Each text is scanned for assignments, access keys and long hexadecimal runs.
Then layers are unwrapped from a worklist: URL escapes, Unicode and hex
escapes, base64 runs and compressed data inside them, each layer scanned and
unwrapped again until nothing new appears; a layer seen before (by hash) is
not entered again. Every layer keeps, for each of its characters, the span of
the original text it came from, so all findings are spans of the original in
code points.

Decoded bytes are searched for the magic numbers of gzip, zlib, bzip2, xz, zstd
and zip members at every place, and what is unpacked from there is searched
again as it comes, over the borders of its blocks: each stream feeds the
streams found inside it, so an archive in an archive in an archive is read in
one pass with a block of each level in memory. Members that follow each other
are read as one stream. Text in UTF-16 or UTF-32 is read as well.

Defined results: a null text counts as empty; a span found in several layers
counts once; bytes that are not UTF-8 are read with a replacement character.
Unpacked data is read in blocks, cut at white space and overlapping, so that a
layer of any size is read whole with little memory; only a run without any
white space that itself unpacks to over RUN bytes is decoded piece by piece.
What a broken stream gave before it broke counts. Compressed data that begins
with the same CYCLE bytes as data it was unpacked from is a cycle and not
entered again. Rows that repeat are scanned each; kept columns may have any
name. Memory is about 20 bytes a character of a text or of one block, and time
goes with the bytes unpacked.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinloom.llm.common import SLICE, map_batches, own_names, with_text

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Unpacked data comes in blocks of so many bytes at most (zstd: STEP bytes of input at once), and parts of it overlap by so many.
BLOCK, STEP, OVERLAP = 1 << 18, 64, 1 << 12
#: A run without white space stays whole up to so many bytes of unpacked data, then it is read in blocks.
RUN = 1 << 23
#: Compressed data is known again by its first bytes.
CYCLE = 4096
#: Bytes of a stream that are kept until it has ended well.
KEPT = 1 << 22
SPACES = re.compile(rb"\x20{32,}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Runs that may hold compressed bytes: escapes with what an encoder leaves plain between them.
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+-])+")
URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|[\x20-\x7e]")
HEX_RUN = re.compile(r"(?:\\(?:x|u00)[0-9A-Fa-f]{2}|\\[nrt'\"\\]|[\x20-\x5b\x5d-\x7e])+")
HEX_BYTE = re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|\\[nrt'\"\\]|[\x20-\x5b\x5d-\x7e]")
PLAIN_ESCAPES = {"\\n": b"\n", "\\r": b"\r", "\\t": b"\t"}
MAGIC = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|PK\x03\x04")
#: The longest magic number less one, and the fixed part of a zip member's header.
BEFORE, ZIP_HEAD = 9, 30
#: UTF-16 or UTF-32 of ASCII characters, of either byte order.
WIDE = re.compile(r"(?:[\x01-\x7f]\x00{1,3}){11,}[\x01-\x7f]?")
#: A shorter run decodes to eleven bytes at most, fewer than any secret has.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
PLAIN64 = str.maketrans("-_", "+/")
BASE64_CHARS = re.compile(r"[A-Za-z0-9+/_-]")


#: What a secret or a further layer can't do without, in lower case or as it is, and as patterns that begin with a fixed byte or a class.
WORDS, CASED = (b"passw", b"secret", b"token", b"api"), (b"AKIA", b"&#")
SIGNS = tuple(re.compile(x) for x in (rb"%[0-9A-Fa-f]{2}", rb"\\[uUx]", rb"[A-Za-z0-9+/_-]{16}"))
WIDE_BYTES = re.compile(rb"(?:[\x01-\x7f]\x00{1,3}){11}")


def notable(data: bytes) -> bool:
    """Whether decoded bytes may hold a secret or a further layer of text."""
    if not data.strip(b"\0"):
        return False
    low = data.lower()
    return any(w in low for w in WORDS) or any(w in data for w in CASED) or any(x.search(data) for x in SIGNS) or (b"\0" in data and WIDE_BYTES.search(data) is not None)


def findings(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the matches in one layer, leftmost and non-overlapping within a kind."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


@dataclass
class Layer:
    """A decoded text; character i came from original code points [begin[i], end[i])."""

    text: str
    begin: np.ndarray
    end: np.ndarray

    def origin(self, start: int, stop: int) -> tuple[int, int]:
        return int(self.begin[start:stop].min()), int(self.end[start:stop].max())


def _text_of(data: bytes) -> tuple[str, np.ndarray]:
    """Bytes as text, one character a byte where they aren't UTF-8, and each character's first byte."""
    if data.isascii():
        return data.decode("ascii"), np.arange(len(data))
    text = data.decode("utf-8", "surrogateescape")
    size = [1 if "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text]
    return "".join("\ufffd" if "\udc80" <= c <= "\udcff" else c for c in text), np.cumsum([0, *size[:-1]])


def _opened(data: bytes, begin: np.ndarray, end: np.ndarray) -> Iterator[Layer]:
    """The layer of decoded bytes with their origins, and what is unpacked from them, again while there is a magic number."""
    text, first = _text_of(data)
    if text:
        last = np.append(first[1:], len(data)) - 1
        yield Layer(text, begin[first], end[last])
    yield from _inside(data, begin, end)


def _inside(data: bytes, begin: np.ndarray, end: np.ndarray) -> Iterator[Layer]:
    """What is unpacked from compressed data in the bytes, and from compressed data in that, and so on."""
    if MAGIC.search(data):
        for at, part in _unpacked(data):
            text = part.decode("utf-8", "replace")
            yield Layer(text, np.broadcast_to(begin[at], len(text)), np.broadcast_to(end[-1], len(text)))


class _Zstd:
    """zstd by small steps of input, which bounds what one step gives."""

    def __init__(self):
        import zstandard

        self.tool, self.eof, self.unused_data = zstandard.ZstdDecompressor().decompressobj(), False, b""

    def blocks(self, data: bytes) -> Iterator[bytes]:
        for s in range(0, len(data), STEP):
            yield self.tool.decompress(data[s : s + STEP])
            if self.tool.eof:
                self.eof, self.unused_data = True, self.tool.unused_data + data[s + STEP :]
                return


class _Bounded:
    """A decompressor of the standard library, by blocks of output."""

    def __init__(self, tool, skip: int = 0):
        self.tool, self.skip, self.eof, self.unused_data = tool, skip, False, b""

    def blocks(self, data: bytes) -> Iterator[bytes]:
        data, self.skip = data[self.skip :], max(0, self.skip - len(data))
        while True:
            out = self.tool.decompress(data, BLOCK)
            if out:
                yield out
            if self.tool.eof:
                self.eof, self.unused_data = True, self.tool.unused_data
                return
            data = getattr(self.tool, "unconsumed_tail", b"")
            if not data and len(out) < BLOCK:
                return


def _tool(head: bytes):
    """A decompressor by its magic number; None where there is none, False where more bytes are needed to tell."""
    m = MAGIC.match(head)
    if not m:
        return False if len(head) <= BEFORE else None
    if head[:1] == b"\x1f":
        return _Bounded(zlib.decompressobj(31))
    if head[:1] == b"\x78":
        return _Bounded(zlib.decompressobj())
    if head[:3] == b"BZh":
        return _Bounded(bz2.BZ2Decompressor())
    if head[:1] == b"\xfd":
        return _Bounded(lzma.LZMADecompressor())
    if head[:2] == b"PK":
        if len(head) < ZIP_HEAD:
            return False
        method, name, extra = (int.from_bytes(head[i : i + 2], "little") for i in (8, 26, 28))
        return _Bounded(zlib.decompressobj(-15), ZIP_HEAD + name + extra) if method == 8 else None
    return _Zstd()


class _Content:
    """The bytes of a layer as they come: cut into parts for the patterns, and searched for streams, which are fed.

    place is where the outermost stream begins; None for the bytes that hold
    it, which are no part themselves. Blocks are cut anew at white space and
    parts begin OVERLAP bytes earlier, so that what a pattern needs stands in
    one of them. A run of spaces is shortened to 32, which changes no match; a
    run without white space is kept whole up to RUN.

    A stream that ends well covers its bytes: what they hold as they are, they
    hold unpacked as well. So its bytes are searched only if it breaks off, or
    once it has taken more than KEPT bytes, which are kept that long.
    """

    def __init__(self, above: tuple[bytes, ...], place: int | None):
        self.above, self.place, self.held, self.size = above, place, [], 0
        self.buffer, self.start, self.live, self.loose = b"", 0, None, []

    def parts(self, block: bytes) -> Iterator[tuple[int, bytes]]:
        self.held.append(block)
        self.size += len(block)
        cut = max(block.rfind(b" "), block.rfind(b"\n"))
        if self.size >= BLOCK and cut >= 0 or self.size >= RUN:
            whole = SPACES.sub(b" " * 32, b"".join(self.held))
            cut = max(whole.rfind(b" "), whole.rfind(b"\n")) if cut >= 0 else len(whole)
            if notable(whole[:cut]):
                yield self.place, whole[:cut]
            self.held = [whole[max(0, cut - OVERLAP) :]]
            self.size = len(self.held[0])

    def feed(self, block: bytes) -> Iterator:
        """Parts, and generators of more of them, which run before this one goes on."""
        if self.place is not None:
            yield from self.parts(block)
        for stream in self.loose:
            yield stream.feed(block)
        self.loose = [s for s in self.loose if s.alive]
        self.buffer += block
        if self.live:
            yield self.live.feed(block)
        yield from self.search(False)

    def drop(self, n: int) -> None:
        self.buffer, self.start = self.buffer[n:], self.start + n

    def search(self, last: bool) -> Iterator:
        """Starts a stream at each magic number that no other covers."""
        while True:
            if self.live:
                if self.live.alive and not last and len(self.buffer) <= KEPT:
                    return
                if self.live.alive and last:
                    yield self.live.close()
                elif self.live.alive:
                    self.loose.append(self.live)
                self.drop(self.live.covered if not self.live.alive and self.live.covered else 1)
                self.live = None
            m = MAGIC.search(self.buffer)
            if not m:
                return self.drop(max(0, len(self.buffer) - BEFORE))
            self.drop(m.start())
            key = self.buffer[:CYCLE]
            if key in self.above:
                self.drop(1)
                continue
            at = self.start if self.place is None else self.place
            self.live = _Stream(_Content((*self.above, key), at))
            yield self.live.feed(self.buffer)

    def end(self) -> Iterator:
        yield from self.search(True)
        for stream in self.loose:
            yield stream.close()
        if self.place is not None and notable(whole := SPACES.sub(b" " * 32, b"".join(self.held))):
            yield self.place, whole
        self.held = []


class _Stream:
    """Compressed data, member after member; covered is how many of its bytes whole members take."""

    def __init__(self, content: _Content):
        self.content, self.alive, self.tool, self.head, self.taken, self.covered = content, True, None, b"", 0, 0

    def feed(self, data: bytes) -> Iterator:
        self.taken += len(data)
        data, self.head = self.head + data, b""
        try:
            while data:
                if self.tool is None:
                    self.tool = _tool(data)
                    if self.tool is False:
                        self.tool, self.head = None, data
                        return
                    if self.tool is None:
                        break
                for block in self.tool.blocks(data):
                    if block:
                        yield self.content.feed(block)
                if not self.tool.eof:
                    return
                data, self.tool = self.tool.unused_data, None
                self.covered = self.taken - len(data)
            if not data:
                return
        except (zlib.error, EOFError, OSError, ValueError, *_errors()):
            pass  # data that only looks compressed, or breaks off
        yield self.close()

    def close(self) -> Iterator:
        if self.alive:
            self.alive = False
            yield self.content.end()


def _errors() -> tuple[type[Exception], ...]:
    import zstandard

    return lzma.LZMAError, zstandard.ZstdError


def _unpacked(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(place of the outermost stream in data, part) of all that streams in the data unpack to, at any depth."""
    root = _Content((), None)

    def fed():
        for s in range(0, len(data), BLOCK):
            yield root.feed(data[s : s + BLOCK])
        yield root.end()

    running = [fed()]
    while running:
        found = next(running[-1], None)
        if found is None:
            running.pop()
        elif isinstance(found, tuple):
            yield found
        else:
            running.append(found)


def _replaced(layer: Layer, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """The layer with [start, stop) replaced by texts whose characters have the given origins."""
    texts, begins, ends, at = [], [], [], 0
    for start, stop, text, begin, end in parts:
        texts += [layer.text[at:start], text]
        begins += [layer.begin[at:start], begin]
        ends += [layer.end[at:start], end]
        at = stop
    texts.append(layer.text[at:])
    return Layer("".join(texts), np.concatenate([*begins, layer.begin[at:]]), np.concatenate([*ends, layer.end[at:]]))


def _url(layer: Layer) -> Iterator[Layer]:
    parts = []
    for m in URL.finditer(layer.text):
        data = bytes.fromhex(m.group().replace("%", ""))
        text, first = _text_of(data)
        stops = np.append(first[1:], len(data))
        parts.append((m.start(), m.end(), text, layer.begin[m.start() + 3 * first], layer.end[m.start() + 3 * stops - 1]))
    if parts:
        yield _replaced(layer, parts)
        yield from _escaped_bytes(layer, URL_RUN, URL_BYTE)


def _escapes(layer: Layer) -> Iterator[Layer]:
    parts = []
    for m in ESCAPE.finditer(layer.text):
        digits = next(x for x in m.groups() if x is not None)
        code = int(digits, 10 if m.lastindex == 6 else 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            parts.append((m.start(), m.end(), chr(code), layer.begin[m.start() : m.start() + 1], layer.end[m.end() - 1 : m.end()]))
    if parts:
        yield _replaced(layer, parts)
        yield from _escaped_bytes(layer, HEX_RUN, HEX_BYTE)


def _escaped_bytes(layer: Layer, run: re.Pattern, token: re.Pattern) -> Iterator[Layer]:
    """What compressed data in runs of escaped and plain bytes unpacks to; a run ends with its last escape."""
    for m in run.finditer(layer.text):
        parts = [(x.start(), x.end(), bytes.fromhex(x[1]) if x[1] else PLAIN_ESCAPES.get(x[0], x[0][-1:].encode())) for x in token.finditer(layer.text, m.start(), m.end())]
        while parts and parts[-1][1] - parts[-1][0] == 1:
            parts.pop()
        if parts:
            yield from _inside(b"".join(x[2] for x in parts), layer.begin[[x[0] for x in parts]], layer.end[[x[1] - 1 for x in parts]])


def _wide(layer: Layer) -> Iterator[Layer]:
    """Characters parted by zero bytes, without these."""
    parts = []
    for m in WIDE.finditer(layer.text):
        own = m.start() + np.flatnonzero(np.frombuffer(m.group().encode("latin-1"), np.uint8))
        parts.append((m.start(), m.end(), m.group().replace("\0", ""), layer.begin[own], layer.end[own]))
    if parts:
        yield _replaced(layer, parts)


def _base64(layer: Layer) -> Iterator[Layer]:
    """Runs, joined over line breaks, at all four alignments: a payload may stand behind a path or prefix of the same characters."""
    for m in BASE64.finditer(layer.text):
        body, place = "".join(m.group().rstrip("=").split()).translate(PLAIN64), None
        for a in range(4):
            chars = body[a:]
            chars = chars[: len(chars) - (len(chars) % 4 == 1)]
            data = binascii.a2b_base64(chars + "=" * (-len(chars) % 4))
            if not notable(data) and not MAGIC.search(data):
                continue
            if place is None:
                place = m.start() + np.array([x.start() for x in BASE64_CHARS.finditer(m.group())])
            own, first = place[a:], np.arange(len(data))
            yield from _opened(data, layer.begin[own[first * 4 // 3]], layer.end[own[np.minimum(((first + 1) * 4 + 2) // 3, len(chars)) - 1]])


def _layers(layer: Layer) -> Iterator[Layer]:
    for unwrap in (_url, _escapes, _wide, _base64):
        yield from unwrap(layer)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base findings of a text, and all findings with those of its layers; by start, then kind, then end."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (s[1], rank[s[0]], s[2])
    base = sorted(findings(text), key=order)
    may = ("%" in text and URL.search(text), "\\" in text or "&#" in text, "\0" in text, BASE64.search(text))
    if not any(may):
        return base, base
    spans, seen = set(base), {hash(text)}
    whole = Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))
    running = [_layers(whole)]
    while running:  # the newest layer first, so that large ones come and go block by block
        inner = next(running[-1], None)
        if inner is None:
            running.pop()
        elif inner.text and (h := hash((inner.text, int(inner.begin[0]), int(inner.end[-1])))) not in seen:
            seen.add(h)
            spans.update((kind, *inner.origin(s, e)) for kind, s, e in findings(inner.text))
            running.append(_layers(inner))
    return base, sorted(spans, key=order)


NAMES = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scanned(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` with n_assign, n_access, n_hex and base_sha256 of the base spans, and all spans."""
    rows, fields = with_text(df, keep, text)
    names = own_names(NAMES, keep)

    def kernel():
        def each(batch):
            found = [scan(x.as_py() or "") for x in batch.column(len(keep))]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *counts, pa.array(digest, pa.string()), pa.array([joined(spans) for _, spans in found], pa.string())], [*keep, *names])

        return each

    types = ["long"] * len(KINDS) + ["string", "string"]
    return map_batches(rows, kernel, ", ".join([*filter(None, [fields]), *(f"`{n}` {t}" for n, t in zip(names, types, strict=True))]))


MASK = "[secret]"


def redact(text: str) -> str:
    """The text with every span (overlapping ones as one) replaced by MASK."""
    _, spans = scan(text)
    out, at, last = [], 0, -1
    for s, e in sorted((s, e) for _, s, e in spans):
        if s >= last:
            out += [text[at:s], MASK]
        at = last = max(last, e)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df, all columns as they are, with the secrets in `text` masked."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                clean = pa.array([None if x is None else redact(x) for x in part.column(at).to_pylist()], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([clean if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)
