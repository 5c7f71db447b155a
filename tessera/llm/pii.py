"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Base kinds (``email ip card phone``) follow fixed patterns and stay whenever they
match; each pattern is matched in linear time, however long the text. On top of
them the method proposes spans of further kinds and scores each: a prior for
the pattern, more if a checksum or another test of its structure holds (mod-97 for bank account numbers, the
mod-10 variants for cards of other lengths and routing numbers, entropy by alphabet for keys, a header that decodes for
signed tokens, a body that decodes for private keys), more for a telling word shortly before or
after the span and for a value that is assigned, less for a word before it that speaks against it.
Spans at ``threshold`` or above count, unless they overlap a span already taken;
the best score goes first.

The pass is row-local: one scan, no shuffle.

Defined results: a null or empty text has no spans; texts are read whole;
repeated rows are judged one by one; an empty table gives an empty result; other
columns pass through untouched. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import re
from bisect import bisect_left
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, map_texts, schema_of, texts

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "card_other", "ssn", "routing", "phone_local", "mac", "ipv6", "secret", "private_key", "jwt", "password")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match can't start later in a run of digits if it can't at its start, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ROUTING = re.compile(r"(?<![0-9-])[0-9]{9}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])|(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{4,39}(?![0-9A-Za-z:.]))(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:.])")
#: Published prefixes of access keys, with what follows them.
_PUBLISHED = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,200}|sk_live_[A-Za-z0-9]{16,64}|AIza[A-Za-z0-9_-]{35}")
_SECRET = re.compile(rf"(?<![A-Za-z0-9_+/-])(?:{_PUBLISHED.pattern}|[A-Za-z0-9_+/-]{{20,128}}={{0,2}})(?![A-Za-z0-9_+/=-])")
_HEX, _BASE32, _ONE_CASE = re.compile("[0-9a-f]+|[0-9A-F]+"), re.compile("[A-Z2-7]+"), re.compile("[0-9a-z]+|[0-9A-Z]+")
_PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----(?:\s*+[A-Za-z-]+: [^\n]*+)*+[A-Za-z0-9+/=\s]*+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++(?![A-Za-z0-9_.-])")
#: The value of an assignment to a name of this sort; the name is before the span.
_PASSWORD = re.compile(r"""(?i)(?<![^\W_])(?:password|passwd|passwort|passphrase|pwd|contrase\u00f1a|mot de passe)["']?\s{0,3}[:=]\s{0,3}["']?(?P<span>[^\s"'<>,;]{6,64})""")
_PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your|none|null|true|false|x{4,}|\*{3,}|\.{3,}|\$\{|required|optional")
_ASSIGNED = re.compile(r"""[=:]\s{0,3}["'`]?$""")
#: kind: (pattern, prior, gain of a valid checksum, words that speak for it, words that speak against it).
EXTRA = {
    "iban": (_IBAN, 0.3, 0.5, ("iban", "account", "konto", "cuenta", "compte", "bank"), ("isbn", "serial", "sku")),
    "card_other": (_CARD, 0.1, 0.3, ("card", "visa", "karte", "tarjeta", "carte", "credit"), ("order", "tracking", "isbn", "serial")),
    "ssn": (_SSN, 0.4, 0.1, ("ssn", "social", "security"), ("part", "model", "version", "isbn")),
    "routing": (_ROUTING, 0.0, 0.3, ("routing", "aba", "transit"), ("zip", "order", "serial", "population")),
    "phone_local": (_LOCAL_PHONE, 0.3, 0.0, ("phone", "call", "tel", "fax", "mobile", "telefon", "telefono", "cell"), ("order", "version", "isbn")),
    "mac": (_MAC, 0.6, 0.0, ("mac", "device", "hardware"), ("sha", "hash")),
    "ipv6": (_IPV6, 0.6, 0.0, ("address", "host", "server"), ("time", "version")),
    "secret": (_SECRET, 0.0, 0.6, ("key", "token", "secret", "password", "passwort", "api", "bearer", "credential"), ("sha", "md5", "digest", "checksum", "commit", "hash", "uuid")),
    "private_key": (_PRIVATE_KEY, 0.4, 0.6, (), ()),
    "jwt": (_JWT, 0.2, 0.8, (), ()),
    "password": (_PASSWORD, 0.4, 0.3, (), ()),
}
THRESHOLD = 0.6
CONTEXT_CHARS = 40
CONTEXT_WEIGHT = 0.4
#: For a key or password that is assigned, as in ``name = "value"``.
ASSIGNED_WEIGHT = 0.2
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The remainder test of international bank account numbers."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _aba(d: str) -> bool:
    n = [ord(c) - 48 for c in d]
    return any(n) and (3 * (n[0] + n[3] + n[6]) + 7 * (n[1] + n[4] + n[7]) + n[2] + n[5] + n[8]) % 10 == 0


def _entropy(x: str) -> float:
    """Bits a character, by the characters' own frequencies."""
    return -sum(x.count(c) / len(x) * log2(x.count(c) / len(x)) for c in set(x))


def _random(x: str) -> bool:
    """Does a run look drawn from an alphabet: hexadecimal, base 32, letters of one case and digits, or base 64?"""
    core = x.rstrip("=")
    digits, letters = sum(map(str.isdigit, core)), sum(map(str.isalpha, core))
    if not digits or not letters:
        return False
    if _HEX.fullmatch(core):
        return _entropy(core) >= 0.7 * min(4, log2(len(core)))
    if _BASE32.fullmatch(core):
        return _entropy(core) >= 0.7 * min(5, log2(len(core)))
    if _ONE_CASE.fullmatch(core):
        return 100 * digits >= 12 * len(core) and _entropy(core) >= 0.68 * min(5.2, log2(len(core)))
    mixed = bool(re.search("[a-z]", core) and re.search("[A-Z]", core))
    if mixed and core.isalnum() and len(core) >= 32:  # digits and letters of both cases without a break: no name or path is made so
        return len(set(core)) >= 6
    return mixed and _entropy(core) >= 0.75 * min(6, log2(len(core)))


def _decoded(x: str) -> bytes | None:
    """Base 64 of either alphabet, as bytes."""
    x = "".join(x.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return binascii.a2b_base64(x + "=" * (-len(x) % 4), strict_mode=True)
    except binascii.Error:
        return None


def _signed(token: str) -> bool:
    """Is the first part of a token a header that names its algorithm?"""
    try:
        header = json.loads(_decoded(token.split(".")[0]) or b"")
    except ValueError:
        return False
    return isinstance(header, dict) and "alg" in header


def _valid(kind: str, found: str) -> float:
    """How much of a kind's gain the span's own structure earns."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "iban":
        return mod97(found.replace(" ", ""))
    if kind == "card_other":
        return luhn(digits)
    if kind == "routing":
        return _aba(digits)
    if kind == "secret":  # a published prefix; without one, the look of a drawn run says half of it
        return 1.0 if _PUBLISHED.fullmatch(found) else 0.5 * _random(found)
    if kind == "private_key":
        body = re.sub(r"\s*[A-Za-z-]+: [^\n]*", "", found.split("-----")[2])
        return bool(body.strip()) and _decoded(body) is not None
    if kind == "jwt":
        return _signed(found)
    if kind == "password":
        return not _PLACEHOLDER.search(found) and bool(re.search(r"[^A-Za-z]", found))
    return kind == "ssn" and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    The class before the at sign doesn't contain it, so a match begins where the
    run that ends at the sign begins, but not before the end of the last match.
    """
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds, by start, then kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def extra_spans(text: str, taken: list[tuple[int, int, str]], threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """Spans that the method adds to ``taken``, with their scores; none overlaps another."""
    proposed = []
    for kind, (pattern, prior, gain, good, bad) in EXTRA.items():
        for m in pattern.finditer(text):
            if kind == "card_other" and not 12 <= sum(map(str.isdigit, m[0])) <= 13:
                continue
            start, end = m.span("span" if "span" in pattern.groupindex else 0)
            before, after = ({w.lower() for w in _WORD.findall(side)} for side in (text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]))
            valid = _valid(kind, text[start:end])
            score = prior + gain * valid + ASSIGNED_WEIGHT * (valid > 0 and kind in ("secret", "password") and bool(_ASSIGNED.search(text[max(0, start - 6) : start]))) + CONTEXT_WEIGHT * (not (before | after).isdisjoint(good)) - CONTEXT_WEIGHT * (not before.isdisjoint(bad))
            if score >= threshold - 1e-9:
                proposed.append((start, end, kind, round(score, 2)))
    starts, ends = [a for a, _, _ in taken], [b for _, b, _ in taken]  # ascending, up to overlaps of base kinds
    ends = [*accumulate(ends, max)]
    out: list = []
    begin, finish = [], []  # of what is taken from the proposals, both ascending as none overlaps another
    for p in sorted(proposed, key=lambda s: (-s[3], s[0], EXTRA_KINDS.index(s[2]))):
        k, j = bisect_left(starts, p[1]), bisect_left(begin, p[1])
        if (k and ends[k - 1] > p[0]) or (j and finish[j - 1] > p[0]):
            continue
        begin.insert(j, p[0])
        finish.insert(j, p[1])
        out.append(p)
    return sorted(out)


def find(text: str) -> tuple[list, list]:
    base = base_spans(text)
    return base, extra_spans(text, base)


def written(spans: list) -> str:
    order = (*KINDS, *EXTRA_KINDS)
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in sorted(spans, key=lambda s: (s[0], order.index(s[2]))))


def mask(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are merged under the first."""
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[0] >= at:
            parts += [text[at : s[0]], f"<{s[2]}>"]
        at = max(at, s[1])
    return "".join([*parts, text[at:]])


def _report(batches):
    for batch in batches:
        found = [find(x) for x in texts(batch.column("text"))]
        counts = [pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found]), pa.array([written([*b, *e]) for b, e in found]), pa.array([len(e) for _, e in found], pa.int64())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_extra"],
        )


def _masked(batches):
    for batch in batches:
        out = [None if x is None else mask(x, [*b, *e]) if b or e else x for x, (b, e) in ((x, find(x or "")) for x in batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)


def pii_report(docs: DataFrame) -> DataFrame:
    """Spans of every row: counts by base kind, the digest of the base spans, and all spans."""
    docs = docs.select("doc_id", "text")
    long, string = T.LongType(), T.StringType()
    return map_texts(docs, _report, T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", long) for k in KINDS), T.StructField("base_sha256", string), T.StructField("spans", string), T.StructField("n_extra", long)]))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; null stays null; other columns unchanged."""
    return map_texts(docs, _masked, schema_of(docs))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(documents(spark, sf_dir))
