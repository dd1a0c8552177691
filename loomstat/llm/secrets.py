"""Secret scans with a recursive decoding worklist.

Every layer of a text is scanned; percent codes, Unicode escapes, base64 and hex runs, UTF-16 and compressed bytes in it make
new layers, until none is new. One set of digests holds all layers of a text, so that layers that are had in two ways count
once, and a layer that equals one that it was unwrapped from is a cycle and is left out. Each layer maps its characters to
spans of the original text by a few segments, so that findings point there.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import lzma
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words

#: Characters that the decompressed layers of one text may hold together. One beyond it is reported as an oversized_layer, not passed over.
MOST_DECODED = 64 << 20
#: Once decompressed layers hold MOST_DECODED together, or so many runs were too large, each further run may still hold a FLOOR-th of it.
MOST_BOMBS = 16
FLOOR = 64
#: Rewritten copies and decoded runs of one text may hold together MOST_DECODED and so many times its length.
COPIES = 64
#: Bytes of zstd data that are decompressed at once, as its output can't be bounded: about 8 MB at most.
FED = 256
#: By priority: a span goes to the first that finds it. The group of the number is the secret.
DETECTORS = [
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----.*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|\Z)", re.S), 0),
    ("aws_access_key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), 0),
    ("github_token", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})"), 0),
    ("slack_token", re.compile(r"xox[abeprs]-[A-Za-z0-9-]{10,}"), 0),
    ("google_key", re.compile(r"AIza[A-Za-z0-9_-]{35}"), 0),
    ("stripe_key", re.compile(r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"), 0),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0),
    ("bearer", re.compile(r"(?i)\bbearer\s+([A-Za-z0-9._~+/-]{16,}=*)"), 1),
    ("url_password", re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@]{1,128}:([^\s/@]{3,})@"), 1),
    ("assigned_secret", re.compile(r"""(?i)(?:api[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|private[_-]?key|auth[_-]?token|access[_-]?token|token|secret|password|passwd|pwd)["']?\s*(?::=|=>|=|:)\s*["'`]?([^\s"'`,;]{8,})"""), 1),
]
#: A text without a match has no secret and no layer. It is RE2's, so all of a column is tested at once.
TRIGGER = (
    r"-----BEGIN|AKIA|ASIA|gh[pousr]_|github_pat_|xox[abeprs]-|AIza|[rs]k_(live|test)_|eyJ|://[^\s/:@]+:|(?i:key|secret|token|passw|pwd|bearer)"
    r"|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#|[A-Za-z0-9+/_-]{16,}"
)
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_HEX = re.compile(r"(?<![0-9A-Wa-wY-Zy-z])(?:[0-9A-Fa-f]{2}){8,}(?![0-9A-Za-z])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/]{4}){15,19}\r?\n)*[A-Za-z0-9+/_-]{16,}={0,2}")
_MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\x28\xb5\x2f\xfd": "zstd", b"\xfd7zXZ": "xz", b"\x78\x01": "zlib", b"\x78\x5e": "zlib", b"\x78\x9c": "zlib", b"\x78\xda": "zlib"}


class Oversized(Exception):
    pass


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def _plausible(kind: str, value: str) -> bool:
    """Whether an assigned value looks random rather than like a word."""
    return kind not in ("assigned_secret", "bearer") or (_entropy(value) >= 2.5 and (any(c.isdigit() for c in value) or any(not c.isalnum() for c in value[:-1])))


def _inflate(data: bytes, kind: str, most: int) -> bytes | None:
    """The bytes inside of all members one after another, None if it isn't such data. What follows the last member is left out."""
    out, made = b"", False
    try:
        while data and len(out) <= most:
            if kind == "zstd":
                machine, at, some, size = zstandard.ZstdDecompressor().decompressobj(), 0, [], len(out)
                while at < len(data) and not machine.eof and size <= most:
                    some.append(machine.decompress(data[at : at + FED]))
                    size += len(some[-1])
                    at += FED
                out, data = out + b"".join(some), machine.unused_data + data[at:] if machine.eof else b""
            else:
                machine = {"gzip": lambda: zlib.decompressobj(31), "zlib": lambda: zlib.decompressobj(15), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]()
                out, data = out + machine.decompress(data, most + 1 - len(out)), machine.unused_data
            made, data = True, data.lstrip(b"\0")  # members may be padded
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
        if not made:
            return None
    if len(out) > most:
        raise Oversized
    return out


def _printable(text: str) -> bool:
    return len(text) >= 4 and sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.9 * len(text)


def _text(data: bytes) -> tuple[str, str] | None:
    """Text of bytes and the encoding's step: none for UTF-8. UTF-16 has a mark, or a zero in half of its high bytes."""
    try:
        text = data.decode()
        if _printable(text):
            return text, ""
    except UnicodeDecodeError:
        pass
    even = data[: len(data) // 2 * 2]
    for name, mark, high in (("utf-16-le", b"\xff\xfe", 1), ("utf-16-be", b"\xfe\xff", 0)):
        if len(even) >= 8 and (even.startswith(mark) or 4 * even[high::2].count(0) >= len(even)):
            text = even.decode(name, "replace").lstrip("\ufeff")
            if _printable(text):
                return text, "utf16"
    return None


def _unwrap(data: bytes, most: int) -> tuple[str, str, int] | None:
    """Text of bytes, how it was had (as it is, or out of compressed layers), and how many bytes were decompressed."""
    steps, seen, spent = [], {hashlib.blake2b(data, digest_size=16).digest()}, 0
    while kind := next((k for m, k in _MAGIC.items() if data.startswith(m)), None):
        inner = _inflate(data, kind, most - spent)
        if inner is None or (digest := hashlib.blake2b(inner, digest_size=16).digest()) in seen:
            break
        seen.add(digest)
        data = inner
        spent += len(data)
        steps.append(kind)
    got = _text(data)
    return got and (got[0], ">".join(steps + [got[1]] * bool(got[1])), spent)


class _Layer:
    """A text, how it was had, the digests of the texts around it, and segments that map its characters to spans of the original.

    Segment k holds the characters from at[k] on. Its first one has the span low[k], high[k]; the spans of the others are the
    same, or each one further if the segment is `moving`, as it is where nothing was decoded.
    """

    def __init__(self, text: str, at: np.ndarray, low: np.ndarray, high: np.ndarray, moving: np.ndarray, path: str, around: frozenset[bytes]):
        if len(at) > 1:  # a segment that goes on like the one before is part of it, so that equal maps are equal arrays
            by = np.diff(at) * moving[:-1]
            new = np.r_[True, (moving[1:] != moving[:-1]) | (low[1:] != low[:-1] + by) | (high[1:] != high[:-1] + by)]
            at, low, high, moving = at[new], low[new], high[new], moving[new]
        self.text, self.at, self.low, self.high, self.moving, self.path = text, at, low, high, moving, path
        digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16)
        self.known = digest.digest() in around
        self.around = around | {digest.digest()}
        for x in (at, low, high, moving):
            digest.update(x.tobytes())
        self.digest = digest.digest()

    @classmethod
    def whole(cls, text: str) -> _Layer:
        return cls(text, np.array([0]), np.array([0]), np.array([1]), np.array([True]), "", frozenset())

    def spans(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.at, i, "right") - 1
        by = (i - self.at[k]) * self.moving[k]
        return self.low[k] + by, self.high[k] + by

    def span(self, a: int, b: int) -> tuple[int, int]:
        low, high = self.spans(np.array([a, b - 1]))
        return int(low[0]), int(high[1])

    def _step(self, step: str) -> str:
        return f"{self.path}>{step}".strip(">")

    def blob(self, text: str, a: int, b: int, step: str) -> _Layer:
        x, y = self.span(a, b)
        return _Layer(text, np.array([0]), np.array([x]), np.array([y]), np.array([False]), self._step(step), self.around)

    def rewritten(self, pattern: re.Pattern, decode, step: str) -> _Layer | None:
        """All matches of a pattern replaced by decode(match): (text, its character's spans in the match) or None."""
        texts, kept, made, first, last, at, size = [], [], [], [], [], 0, 0
        for m in pattern.finditer(self.text):
            got = decode(m)
            if got is None:
                continue
            text, spans = got
            texts += [self.text[at : m.start()], _joined(text)]
            kept.append((size, at, m.start()))
            size += m.start() - at
            made += range(size, size + len(text))
            first += [a for a, _ in spans]
            last += [b - 1 for _, b in spans]
            size += len(text)
            at = m.end()
        if not texts:
            return None
        texts.append(self.text[at:])
        kept.append((size, at, len(self.text)))
        to, source, end = np.array(kept).T
        full = end > source
        to, source, end = to[full], source[full], end[full]
        # pieces that stay: where they begin, and where segments of this layer begin inside them
        piece = np.searchsorted(source, self.at, "right") - 1
        inside = (piece >= 0) & (self.at > source[np.maximum(piece, 0)]) & (self.at < end[np.maximum(piece, 0)]) if len(to) else np.zeros(len(self.at), bool)
        cut = np.concatenate([source, self.at[inside]])
        place = np.concatenate([to, (self.at - source[piece] + to[piece])[inside]]) if len(to) else to
        (low, high), chars = self.spans(cut), (self.spans(np.array(first, np.int64))[0], self.spans(np.array(last, np.int64))[1])
        moving = np.concatenate([self.moving[np.searchsorted(self.at, cut, "right") - 1], np.zeros(len(made), bool)])
        place, low, high = np.concatenate([place, np.array(made, np.int64)]), np.concatenate([low, chars[0]]), np.concatenate([high, chars[1]])
        order = np.argsort(place, kind="stable")
        return _Layer("".join(texts), place[order], low[order], high[order], moving[order], self._step(step), self.around)


def _percent(m: re.Match) -> tuple[str, list[tuple[int, int]]] | None:
    data, out, spans, at = bytes.fromhex(m[0].replace("%", "")), [], [], 0
    while at < len(data):
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        try:
            out.append(data[at : at + size].decode())
        except UnicodeDecodeError:
            size = 1
            out.append("�")
        spans.append((m.start() + 3 * at, min(m.start() + 3 * (at + size), m.end())))
        at += size
    return "".join(out), spans


def _escape(m: re.Match) -> tuple[str, list[tuple[int, int]]] | None:
    code = int(next(g for g in m.groups()[:4] if g), 16) if any(m.groups()[:4]) else int(m[5]) if m[5] else int(m[6], 16)
    return (chr(code), [m.span()]) if 0 < code < 0x110000 else None


def _joined(text: str) -> str:
    """Pairs of surrogates can't be in UTF-8; they are kept apart as U+FFFD each, so spans hold."""
    return re.sub("[\ud800-\udfff]", "�", text)


def scan(text: str, most: int = MOST_DECODED) -> list[tuple[str, int, int, int, str, str]]:
    """(kind, start, end, depth, path, value) of each secret, spans in characters of the text; the shallowest layer that shows a secret counts.

    Decompressed layers may hold `most` characters together, and beyond that a FLOOR-th of it each. A run that holds more is
    reported by its own span, and all else is scanned.
    """
    whole = _Layer.whole(_joined(text))
    todo, found, taken, seen = deque([whole]), [], {}, {whole.digest}
    spent = copied = bombs = 0
    while todo:
        layer = todo.popleft()
        depth = layer.path.count(">") + 1 if layer.path else 0
        accepted: list[tuple[int, int]] = []  # in order of their places; they don't overlap
        for kind, pattern, group in DETECTORS:
            for m in pattern.finditer(layer.text):
                a, b = m.span(group)
                k = bisect.bisect_left(accepted, (a, b))
                if any(a < y and x < b for x, y in accepted[max(k - 1, 0) : k + 1]) or not _plausible(kind, layer.text[a:b]):
                    continue
                accepted.insert(k, (a, b))
                value, span = layer.text[a:b], layer.span(a, b)
                if taken.setdefault((span, value), depth) < depth or (span, value, kind) in taken:
                    continue
                taken[(span, value, kind)] = depth
                found.append((kind, *span, depth, layer.path, value))

        def oversized(a: int, b: int) -> None:
            found.append(("oversized_layer", *layer.span(a, b), depth + 1, layer.path, ""))

        def add(new: _Layer, at: list[tuple[int, int]]) -> None:
            nonlocal copied
            if new.known or new.digest in seen:
                return
            seen.add(new.digest)
            copied += len(new.text)
            if copied > most + COPIES * len(text):
                for a, b in at:
                    oversized(a, b)
            else:
                todo.append(new)

        def unwrapped(data: bytes, at: tuple[int, int], step: str, packed_only: bool) -> None:
            nonlocal spent, bombs
            try:
                got = _unwrap(data, most // FLOOR if bombs >= MOST_BOMBS else max(most - spent, most // FLOOR))
            except Oversized:
                bombs += 1
                oversized(*at)
                return
            if got and (got[1] or not packed_only):
                spent += got[2]
                add(layer.blob(got[0], *at, f"{step}>{got[1]}".strip(">")), [at])

        def rewritten(pattern: re.Pattern, decode, step: str) -> None:
            if (new := layer.rewritten(pattern, decode, step)) is not None:
                add(new, [m.span() for m in pattern.finditer(layer.text)])

        if "%" in layer.text:
            rewritten(_PERCENT, _percent, "url")
            for m in _PERCENT.finditer(layer.text):
                data = bytes.fromhex(m[0].replace("%", ""))
                if any(data.startswith(x) for x in _MAGIC):
                    unwrapped(data, m.span(), "url", True)
        if "\\" in layer.text or "&#" in layer.text:
            rewritten(_ESCAPE, _escape, "unicode")
        for m in _HEX.finditer(layer.text):
            unwrapped(bytes.fromhex(m[0]), m.span(), "hex", False)
        for m in _BASE64.finditer(layer.text):
            run = re.sub(r"\s", "", m[0]).rstrip("=").replace("-", "+").replace("_", "/")
            if len(run) % 4 != 1:
                unwrapped(base64.b64decode(run + "=" * (-len(run) % 4)), m.span(), "base64", False)
    return found


def _suspects(column: pa.Array) -> list[int]:
    """Rows that may have a secret; a null has none."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, TRIGGER), False).to_numpy(zero_copy_only=False)).tolist()


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, depth, path, digest) of every secret; digest is the SHA-256 of its value, which isn't shown.

    start and end count characters of the text. Null and empty texts have none. A row without an id is scanned and reported
    without one. Repeated rows report repeated findings. A run of more than MOST_DECODED characters, or beyond COPIES of the
    text, gets an oversized_layer finding, and the others are scanned. No shuffle.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    fields = [("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("depth", T.LongType()), ("path", T.StringType()), ("digest", T.StringType())]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i in _suspects(batch.column(1)):
                some = scan(batch.column(1)[i].as_py())
                rows += [i] * len(some)
                found += some
            if rows:
                kind, start, end, depth, path, value = zip(*found, strict=True)
                digest = [hashlib.sha256(v.encode("utf-8", "replace")).hexdigest() for v in value]
                columns = [pa.array(kind), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(depth, pa.int64()), pa.array(path), pa.array(digest)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], ["doc_id", *[f for f, _ in fields]])

    return docs.mapInArrow(apply, T.StructType([docs.schema["doc_id"], *[T.StructField(*f) for f in fields]]))


def redacted(text: str, mark: str = "[REDACTED]") -> str:
    """The text with the spans of all secrets replaced; an oversized layer goes with what it was unwrapped from."""
    out, at = [], 0
    for start, end in sorted((f[1], f[2]) for f in scan(text)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """docs with each secret of text_column replaced, and length_column, if docs has it, set anew in rows that changed.

    All rows and columns stay, in their order and types. Nulls stay null.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            texts = {i: redacted(batch.column(at)[i].as_py()) for i in _suspects(batch.column(at))}
            texts = {i: t for i, t in texts.items() if t != batch.column(at)[i].as_py()}
            if texts:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(texts)] = True
                order = sorted(texts)
                changed = {at: pc.replace_with_mask(batch.column(at), pa.array(mask), pa.array([texts[i] for i in order], batch.column(at).type))}
                size = batch.schema.get_field_index(length_column) if length_column else -1
                if size >= 0:
                    changed[size] = pc.replace_with_mask(batch.column(size), pa.array(mask), pa.array([len(texts[i]) for i in order], batch.column(size).type))
                batch = pa.RecordBatch.from_arrays([changed.get(k, c) for k, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch

    return docs.mapInArrow(apply, docs.schema)
