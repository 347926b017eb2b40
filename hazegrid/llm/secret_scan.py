"""Secrets in whole texts: keywords by Aho-Corasick, anchored patterns at their hits, checksums inside the finds."""

from __future__ import annotations

import base64
import binascii
import re
from functools import lru_cache
from zlib import crc32

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import map_texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "pem")

# Keywords (lower case) of each kind, and its pattern, which must match where the keyword begins.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "pem": ("-----begin ",),
}
PATTERNS = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "pem": re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----"),
}
HEX = re.compile(rb"[0-9a-f]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _checksum_62(body: bytes) -> bool:
    """The last six characters are the crc32 of those before, in base 62."""
    n, digits = crc32(body[:-6]), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0").encode() == body[-6:]


def _whole_der(body: bytes) -> bool:
    """The key's bytes are one DER sequence whose stated length is the length it has."""
    try:
        der = base64.b64decode(b"".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(der) < 4 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    k = der[1] & 0x7F
    return len(der) == 2 + k + int.from_bytes(der[2:2 + k], "big")


ACCEPT = {
    "assign": lambda m: len(m[1]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "github": lambda m: _checksum_62(m[1]),
    "npm": lambda m: _checksum_62(m[1]),
    "pem": lambda m: _whole_der(m[2]),
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for k in keywords:
            found.add_word(k, (kind, len(k)))
    found.make_automaton()
    return found


_is_hex = np.zeros(256, np.bool_)
_is_hex[list(b"0123456789abcdef")] = True


def _hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Runs of 32 and more hexadecimal digits. Such a run covers eight bytes in a row of every fourth byte, so
    only places where eight of those are digits are looked at."""
    probe = _is_hex[np.frombuffer(data, np.uint8)[::4]]
    if len(probe) < 8:
        return []
    two = probe[:-1] & probe[1:]
    four = two[:-2] & two[2:]
    out, last = [], -1
    for p in (np.flatnonzero(four[:-4] & four[4:]) * 4).tolist():
        if p < last:
            continue
        begin = p
        while begin > 0 and _is_hex[data[begin - 1]]:
            begin -= 1
        last = HEX.match(data, p).end()
        if last - begin >= 32:
            out.append((begin, last))
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the order of KINDS. Per kind: leftmost, not overlapping; a match
    that fails its check still uses up its characters."""
    data = text.encode("utf-8", "surrogatepass")
    spans, upto = [], {}
    for end, (kind, n) in automaton().iter(data.lower().decode("latin-1")):
        start = end - n + 1
        if start < upto.get(kind, 0):
            continue
        m = PATTERNS[kind].match(data, start)
        if m:
            upto[kind] = m.end()
            if ACCEPT[kind](m):
                spans.append((start, KINDS.index(kind), m.end()))
    spans.extend((a, KINDS.index("hex"), b) for a, b in _hex_runs(data))
    spans.sort()
    if spans and len(data) != len(text):
        begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        point = lambda b: int(begins[b - 1]) if b else 0
        return [(KINDS[k], point(a), point(b)) for a, k, b in spans]
    return [(KINDS[k], a, b) for a, k, b in spans]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, found): code points, end exclusive, and the matched text.

    Each text is scanned once for keywords; patterns run only where a keyword begins, and tokens that carry a
    checksum must prove it. No shuffle.

    Null and empty texts have no spans. Repeated rows give repeated rows; an empty table gives an empty result;
    other columns are ignored."""
    def make():
        return lambda texts: [[[{"kind": k, "start": a, "end": b, "found": t[a:b]} for k, a, b in scan(t)] for t in texts]]

    return map_texts(df, {id_col: "doc_id"}, text_col, "spans array<struct<kind:string,start:int,end:int,found:string>>", make)


def digest(df: DataFrame) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return find_secrets(df).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
