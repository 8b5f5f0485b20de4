"""Secret scan: an Aho-Corasick pass finds keywords, patterns are tried only there, checksums decide.

1. A text's bytes are folded (case goes, hexadecimal digits become ``0``), so
   that one automaton finds the keywords of all kinds in either case, and runs
   of hexadecimal digits as runs of ``0``. A hit is a place to look at, no more.
2. The pattern of the keyword's kind is matched at the hit, on the text itself.
   Matches of a kind do not overlap, the leftmost counts, and it must have its
   least length.
3. Kinds with a checksum inside must agree with it, which leaves next to no
   chance hits: access tokens that end in the CRC-32 of their middle in base 62,
   and bech32 keys with their BCH code of six characters.

Texts are scanned where they lie; nothing is shuffled. A text is passed once and
each hit costs the length of its match at most.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

# The alphabets of the two encodings, the generator of the BCH code.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc62(token: str) -> bool:
    """``<prefix>_``, 30 characters, and their CRC-32 as six digits of base 62."""
    body, digits = token[-36:-6], token[-6:]
    value = 0
    for c in digits:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def bech32(key: str) -> bool:
    """Prefix, ``1`` and characters of five bits; the last six make the code's remainder 1. One case throughout."""
    if key.lower() != key and key.upper() != key:
        return False
    prefix, _, data = key.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    rest = 1
    for v in values:
        top, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATOR):
            rest ^= g if top >> i & 1 else 0
    return rest == 1


@dataclass(frozen=True)
class Kind:
    """keywords: every match begins with one of them. part: the group that ``least`` is about."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    least: int = 0
    part: int = 0
    check: Callable[[str], bool] | None = None


#: In the order of their spans at one place.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Kind("access", ("AKIA",), "AKIA[A-Z0-9]+", 20),
    Kind("hex", ("0" * 24,), "[0-9a-f]+", 24),
    Kind("host_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gh[pousr]_[A-Za-z0-9]+", 40, 0, lambda t: len(t) == 40 and crc62(t)),
    Kind("registry_token", ("npm_",), "npm_[A-Za-z0-9]+", 40, 0, lambda t: len(t) == 40 and crc62(t)),
    Kind("age_key", ("AGE-SECRET-KEY-1",), f"AGE-SECRET-KEY-1[{BECH32.upper()}]+", 74, 0, lambda t: len(t) == 74 and bech32(t)),
    Kind("nostr_key", ("nsec1",), f"nsec1[{BECH32}]+", 63, 0, lambda t: len(t) == 63 and bech32(t)),
)

#: Lower case, and hexadecimal digits in either case as ``0``.
FOLD = bytes(ord("0") if chr(b).lower() in "0123456789abcdef" else ord(chr(b).lower()) if b < 128 else b for b in range(256))


class Scanner:
    """Finds the spans of some kinds in one text after another."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.patterns = [re.compile(k.pattern.encode(), re.ASCII) for k in kinds]
        asked: dict[str, set[int]] = {}
        for i, k in enumerate(kinds):
            for word in k.keywords:
                asked.setdefault(word.encode().translate(FOLD).decode("latin-1"), set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for word, of in asked.items():
            self.automaton.add_word(word, (len(word) - 1, tuple(sorted(of))))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in code points, in order."""
        raw = text.encode("utf-8", "surrogatepass")
        upto, found = [0] * len(self.kinds), []
        hits: list[list[int]] = [[] for _ in self.kinds]
        for last, (back, of) in self.automaton.iter(raw.translate(FOLD).decode("latin-1")):
            for i in of:
                hits[i].append(last - back)
        for i, (kind, pattern) in enumerate(zip(self.kinds, self.patterns, strict=True)):
            for start in hits[i] if len(kind.keywords) < 2 else sorted(hits[i]):
                if start >= upto[i] and (m := pattern.match(raw, start)):
                    upto[i] = m.end()
                    if m.end(kind.part) - m.start(kind.part) >= kind.least and (kind.check is None or kind.check(m[0].decode())):
                        found.append((start, i, m.end()))
        found.sort()
        if len(raw) == len(text) or not found:
            return found
        at, points, out = 0, 0, []
        for start, i, end in found:  # matches are ASCII, so only what is before them has to be counted
            if start >= at:
                points += len(raw[at:start].decode("utf-8", "surrogatepass"))
                first = points
            else:
                first = points - len(raw[start:at].decode("utf-8", "surrogatepass"))
            at, points = (start, first) if start >= at else (at, points)
            out.append((first, i, first + end - start))
        return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, spans (kind, start, end in code points; by start, then in the order of ``kinds``); a row for each row.

    A null text is empty. Matches of one kind don't overlap, those of different
    kinds may. Where two keywords of a kind begin at one place, or a keyword lies
    inside an earlier match, the leftmost match counts. Repeated rows and null
    ids get their own rows; an empty table gives none; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [k.name for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kinds)
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in sliced(batches, 200):
            found = [[{"kind": names[i], "start": s, "end": e} for s, i, e in scanner.spans(t or "")] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every code point of a span as ``*``; spans that overlap or nest are as their union."""
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        first, last = F.greatest(done["upto"], s["start"]), F.greatest(done["upto"], s["end"])
        plain = F.substring(text, (done["upto"] + 1).cast("int"), (first - done["upto"]).cast("int"))
        return F.struct(last.alias("upto"), F.concat(done["out"], plain, F.repeat(F.lit("*"), (last - first).cast("int"))).alias("out"))

    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, (done["upto"] + 1).cast("int"), F.length(text))))
