"""Secret scan with a worklist of decoded layers.

Each text is scanned as it is. Then encoded parts are unwrapped: percent
escapes, backslash and character-reference escapes give a layer in which the
rest of the text stands unchanged, so a secret half of which is escaped is
found too; a run of base64 gives layers of its own, one for each place in a group
of four where it may begin (a word or path may stand right before it), inflated first if they hold
gzip or zlib data. Lines of base64 are joined, so a run may be wrapped. Where all escapes of a layer are escaped
again (``%2525...``), their levels are resolved at once down to the first that gives a character: a text has as many such layers as
its escapes have different depths, fewer than twice the root of its length, and the levels between hold no new text but shorter runs of ``25``. Each new layer is scanned and put on the worklist until no
layer is new; a layer seen before from the same place is not opened again,
which ends cycles. A position in a layer is mapped to the span of the original
text that it came from.

Spans count code points, ends exclusive. A null text is empty and has no
spans; rows are independent, so repeated rows repeat; an empty table gives an
empty result; other columns are not read.

Compressed data is inflated until it is compressed no longer (all members, at any
depth; one that inflates to what it came from ends there) and scanned as a stream in parts
of about ``PART`` characters, cut where no pattern can go on, so memory grows with
the longest run without such a place and not with the document. No layer is left out for its size. Bytes that are not
UTF-8 are read as Latin-1: the patterns are ASCII. Zero bytes, as UTF-16 has them, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import chunks, documents, table

KINDS = ("assign", "access", "hex")
PART = 1_000_000
#: Bytes of an inflated layer that are held while the next is opened; larger ones are inflated again.
SPOOL = 16_000_000


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HINTS = ("password", "passwd", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: An escaped escape: the mark, what escapes the mark itself again and again, and the innermost escape.
_DEEP_PERCENT = re.compile(r"%((?:25)*)([0-9A-Fa-f]{2})")
_DEEP_ESCAPE = re.compile(
    r"\\((?:u005[cC]|u\{0{0,4}5[cC]\}|x5[cC]|U0000005[cC])*)(u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|x[0-9A-Fa-f]{2}|U[0-9A-Fa-f]{8})"
    r"|&((?:#[xX]0{0,4}26;|#0{0,5}38;)*)(#[xX][0-9A-Fa-f]{1,6};|#[0-9]{1,7};)"
)
_LINK = re.compile(r"u005[cC]|u\{0{0,4}5[cC]\}|x5[cC]|U0000005[cC]|#[xX]0{0,4}26;|#0{0,5}38;")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64, the last of which may be short. It begins where a run does and gives nothing back, so a long run is read once.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+\r?\n[ \t>]*+)++[A-Za-z0-9+/_-]++={0,2}")
_BREAK = re.compile(r"[\r\n \t>]+")
#: No pattern, escape or run of base64 holds one of these.
_APART = re.compile(r"""[^A-Za-z0-9+/_.=\-"' :%\\{};&#]""")

Span = tuple[int, int, int]  # start, end, index of the kind


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, the failing ones dropped."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return found


Piece = tuple[int, int, int, int, bool]  # start in the layer, length, start and end in the original, whether copied


class _Layer:
    """A text and, piece by piece, where it came from.

    Characters of a copied piece map one to one; each character of another
    stands for the whole original span.
    """

    def __init__(self, text: str, pieces: list[Piece]):
        self.text, self.pieces = text, pieces
        self.starts = [p[0] for p in pieces]

    def key(self) -> bytes:
        """Tells layers apart by text and origin."""
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass") + repr(self.pieces).encode(), digest_size=16).digest()

    def cut(self, start: int, end: int) -> Iterator[Piece]:
        """The pieces between two places."""
        for i in range(max(0, bisect_right(self.starts, start) - 1), bisect_left(self.starts, end)):
            at, n, a, b, copied = self.pieces[i]
            lo, hi = max(at, start), min(at + n, end)
            if lo < hi:
                yield (lo, hi - lo, *((a + lo - at, a + hi - at) if copied else (a, b)), copied)

    def origin(self, start: int, end: int) -> tuple[int, int]:
        found = list(self.cut(start, end))
        return min(p[2] for p in found), max(p[3] for p in found)

    def replaced(self, parts: list[tuple[int, int, str]]) -> _Layer:
        """A layer with these spans replaced."""
        text, pieces, at, done = [], [], 0, 0
        for start, end, new in [*parts, (len(self.text), len(self.text), "")]:
            if done < start:
                text.append(self.text[done:start])
                pieces += [(at + lo - done, n, a, b, copied) for lo, n, a, b, copied in self.cut(done, start)]
                at += start - done
            if new:
                text.append(new)
                pieces.append((at, len(new), *self.origin(start, end), False))
                at += len(new)
            done = end
        return _Layer("".join(text), pieces)


def _kind(data: bytes) -> int | None:
    """How zlib is to read data, if it looks compressed."""
    if data[:2] == b"\x1f\x8b":
        return zlib.MAX_WBITS | 16
    return zlib.MAX_WBITS if len(data) > 1 and data[0] & 0x0F == 8 and data[0] >> 4 < 8 and (data[0] << 8 | data[1]) % 31 == 0 else None


Source = Callable[[], Iterator[bytes]]  # starts the stream again at each call


def _inflated(source: Source, heads: list[bytes], broken: list[bool], only: int | None = None) -> Iterator[bytes]:
    """The contents of all members of compressed data, or of one; heads gets the first bytes of each, broken an entry if data is damaged.

    What follows the last member is given as it is.
    """
    heads.clear()
    broken.clear()
    member, inflate, rest = -1, None, b""
    for piece in source():
        rest += piece
        more = True
        while more:
            if inflate is None:
                if len(rest) < 2:
                    break
                if (kind := _kind(rest)) is None:
                    if only is None:
                        yield rest
                    rest = b""
                    break
                inflate, member = zlib.decompressobj(kind), member + 1
                heads.append(b"")
            try:
                out = inflate.decompress(rest, PART)
            except zlib.error:
                broken.append(True)
                return
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            more = bool(rest) or (len(out) == PART and not inflate.eof)  # what did not fit may be held back
            heads[-1] = (heads[-1] + out[:2])[:2]
            if out and only in (None, member):
                yield out
            if inflate.eof:
                inflate = None
    if inflate is None and rest and only is None:
        yield rest


def _digest(source: Source) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for piece in source():
        h.update(piece)
    return h.digest()


def _head(source: Source) -> bytes:
    head = b""
    for piece in source():
        head += piece[:2]
        if len(head) > 1:
            break
    return head


def _spooled(again: Callable[[], Source], first: Iterator[bytes]) -> Source:
    """first, read to its end: kept if it is small, else to be inflated again by ``again`` each time."""
    kept, size = [], 0
    for piece in first:
        size += len(piece)
        if size <= SPOOL:
            kept.append(piece)
        else:
            kept.clear()
    return (lambda: iter(kept)) if size <= SPOOL else again()


def _streams(source: Source) -> Iterator[Source]:
    """What is in source and compressed no longer. Damaged data also counts as it is. Each stream is to be read before the next.

    Layers are opened from a list, not by recursion, and a layer of up to SPOOL bytes is held while the next is
    opened, so that a chain of small layers costs what its layers hold together.
    """
    work: list[tuple[Callable[[], Source], tuple | None, bool]] = [(lambda: source, None, False)]
    while work:
        made, above, as_it_is = work.pop()
        here, own, up = made(), b"", above
        if as_it_is or _kind(_head(here)) is None:
            yield here
            continue
        own = _digest(here)
        while up is not None and up[0] != own:
            up = up[1]
        if up is not None:  # a layer that holds itself
            yield here
            continue
        heads: list[bytes] = []
        broken: list[bool] = []
        inner = _spooled(lambda here=here: lambda: _inflated(here, [], []), _inflated(here, heads, broken))
        if broken:
            work.append((lambda here=here: here, None, True))
        # Members after the first may hold compressed data of their own.
        for i in reversed([i for i, h in enumerate(heads) if i and _kind(h) is not None]):
            work.append((lambda here=here, i=i: _spooled(lambda: lambda: _inflated(here, [], [], i), _inflated(here, [], [], i)), (own, above), False))
        work.append((lambda inner=inner: inner, (own, above), False))


def _parts(source: Source) -> Iterator[str]:
    """A stream as texts, cut where no pattern goes on."""
    held, size = [], 0
    for piece in source():
        text = piece.decode("latin-1")
        held.append(text)
        size += len(text)
        if size >= PART:
            # Of the last place only the one in this piece counts: what stood before was held for want of one.
            at = next((m.start() for m in _APART.finditer(text[::-1])), None)
            if at is not None:
                joined, keep = "".join(held), at
                yield joined[: len(joined) - keep]
                held, size = [joined[len(joined) - keep :]] if keep else [], keep
    if size:
        yield "".join(held)


def _unbased(run: str) -> Iterator[str]:
    """The texts in a run of base64, wherever in its first group of four it begins."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for at in range(4):
        part = body[at:]
        part = part[: len(part) - (len(part) % 4 == 1)]  # a single character holds no byte
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        if _kind(data) is not None:
            for source in _streams(lambda data=data: iter((data,))):
                yield from _parts(source)
            continue
        if b"\0" in data:
            yield data.replace(b"\0", b"").decode("latin-1")
        try:
            yield data.decode("utf-8")
        except UnicodeDecodeError:
            yield data.decode("latin-1")


def _character(m: re.Match) -> str:
    digits = m[1] or m[2] or m[3] or m[4] or m[5]
    code = int(digits, 16) if digits else int(m[6])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _percents(text: str) -> list[tuple[int, int, str]]:
    """What percent escapes are replaced by: one level of them, or as many levels as all of them are nested before one becomes a character."""
    deep = [(m.start(), m.end(), len(m[1]) // 2) for m in _DEEP_PERCENT.finditer(text)]
    least = min((k for _, _, k in deep), default=0)
    if least == 0:
        return [(m.start(), m.end(), unquote(m[0], errors="replace")) for m in _PERCENT.finditer(text)]
    parts: list[tuple[int, int, str]] = []
    run, begin, stop = "", 0, 0  # neighbours may be bytes of one character
    for start, end, k in deep:
        if run and (k > least or start != stop):
            parts.append((begin, stop, unquote(run, errors="replace")))
            run = ""
        if k > least:
            parts.append((start, start + 3 + 2 * least, "%"))
        else:
            begin, stop, run = begin if run else start, end, run + "%" + text[end - 2 : end]
    return [*parts, (begin, stop, unquote(run, errors="replace"))] if run else parts


def _escapes(text: str) -> list[tuple[int, int, str]]:
    """The same for backslash escapes and character references."""
    deep = [(m, [x.end() for x in _LINK.finditer(m[1] or m[3] or "")]) for m in _DEEP_ESCAPE.finditer(text)]
    least = min((len(links) for _, links in deep), default=0)
    if least == 0:
        return [(m.start(), m.end(), _character(m)) for m in _ESCAPE.finditer(text)]
    parts = []
    for m, links in deep:
        mark = m[0][0]
        if len(links) > least:
            parts.append((m.start(), m.start() + 1 + links[least], mark))
        else:
            parts.append((m.start(), m.end(), _character(_ESCAPE.fullmatch(mark + (m[2] or m[4])))))
    return parts


def _layers(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    if "%" in text and (parts := _percents(text)):
        yield layer.replaced(parts)
    if ("\\" in text or "&#" in text) and (parts := _escapes(text)):
        yield layer.replaced(parts)
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(text):
            for inner in _unbased(_BREAK.sub("", m[0])):
                if inner:
                    yield _Layer(inner, [(0, len(inner), *layer.origin(m.start(), m.end()), False)])


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, whether the base patterns found it) of each secret, each span of a kind once, by start, then kind."""
    base = base_spans(text)
    found = {s: True for s in base}
    if not ("%" in text or "\\" in text or "&#" in text or _BASE64.search(text)):
        return _ordered(found)
    first = _Layer(text, [(0, len(text), 0, len(text), True)])
    seen = {first.key()}
    work = [_layers(first)]  # the innermost last, so that parts of a stream are not held together
    while work:
        if (new := next(work[-1], None)) is None:
            work.pop()
        elif new.text and (key := new.key()) not in seen:
            seen.add(key)
            work.append(_layers(new))
            for s, e, k in base_spans(new.text):
                found.setdefault((*new.origin(s, e), k), False)
    return _ordered(found)


def _ordered(found: dict[Span, bool]) -> list[tuple[int, int, int, bool]]:
    return [(s, e, k, found[s, e, k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


SPAN_TYPE = "array<struct<kind: string, start: int, end: int, base: boolean>>"
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        got = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, e, k, b in spans(t)] for t in texts]
        yield pa.record_batch([part.column(0), pa.array(got, _ARROW_SPAN)], names=["doc_id", "spans"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans of each row: kind, start, end, and whether the plain patterns found it."""
    return documents(df, id_col, text_col).mapInArrow(_run, f"doc_id long, spans {SPAN_TYPE}")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """text with the union of its spans replaced."""
    out, done = [], 0
    for s, e, _, _ in spans(text):
        if e <= done:
            continue
        if s >= done:
            out += [text[done:s], mark]
        done = e
    return "".join([*out, text[done:]]) if done else text


def redact(text: str | Column, mark: str = "[SECRET]") -> Column:
    """A column in which each secret of ``text`` is replaced by the mark; null stays null."""

    @F.pandas_udf("string")
    def secrets_redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: redacted(t, mark), na_action="ignore")

    return secrets_redacted(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each whole document: counts and digest of the base spans, and all spans."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = scan(table(spark, sf_dir, "documents")).withColumn("base", base)
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
