"""Personal data by anchor expansion: Aho-Corasick finds cues, local parsers expand and validate each.

Base kinds (email, ip, card, phone) equal the leftmost non-overlapping matches of their patterns over the
whole text. An address is expanded from its at-sign once to the left and once to the right, a phone number from its
plus sign; runs of digits are anchors of their own. Every parser reads a character a fixed number of times at most, so
a text of any length or make takes time in proportion. Beyond the base kinds the method adds, by their own cues:

  url      a URL with user information (scheme://user:secret@host)
  iban     two letters, two digits and 11 to 30 letters or digits that pass the mod-97 check
  account  6 to 20 digits or letters and digits after an identifier cue (account, passport, ssn, ...)
  secret   a value of 16 or more characters after a credential cue (token, password, api_key, secret)

Spans are code points, end exclusive. Null text is the empty text: no spans. Of an IBAN's possible ends the last valid
one counts. Equal rows give equal rows, whatever their identifiers; a column named like an output is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import python_stage, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "secret")
# The parts of the base patterns, possessive where nothing could be given back.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT_CUES = ("account", "acct", "passport", "ssn", "tax id", "customer id", "iban", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "password", "passwd", "api_key", "apikey", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://")
ACCOUNT = re.compile(r"(?:\s*(?:no|number|nr|num)\b\.?)?\s{0,3}[:#=]?\s{0,3}((?=[A-Z0-9-]{0,21}[0-9]{3})[A-Z0-9][A-Z0-9-]{4,22}[A-Z0-9])(?![A-Za-z0-9])")
SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_=-]{16,})")
#: One letter wide, so that one that fails hides none that begins inside it; a letter or digit before it is looked for in the parser.
IBAN = re.compile(r"[A-Z](?=([A-Z][0-9]{2}(?:[ ]?[A-Z0-9]){11,30}))")
URL_USER = re.compile(r"[^\s/@:\"'<>]++:[^\s/@\"'<>]++@[A-Za-z0-9.-]++(?::[0-9]+)?")


@lru_cache(maxsize=1)
def cues():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kinds in {
        "@": ("email",), "+": ("phone",),
        **{c: ("account",) for c in ACCOUNT_CUES}, **{c: ("secret",) for c in SECRET_CUES}, **{s: ("url",) for s in SCHEMES},
    }.items():
        found.add_word(word, (kinds[0], len(word)))
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """Lower case, code point by code point, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_end(found: str, after: str) -> int:
    """The last place in found, which begins like an IBAN, at which a valid one of 15 characters or more ends, 0 if there is none; after is the character behind found."""
    head = int("".join(str(int(c, 36)) for c in found[:4]))
    end, n, value = 0, 4, 0
    for i in range(4, len(found)):
        c = found[i]
        if c == " ":
            continue
        n += 1
        digit = int(c, 36)
        value = (value * (10 if digit < 10 else 100) + digit) % 97
        if n >= 15 and (value * 1_000_000 + head) % 97 == 1 and not (found[i + 1] if i + 1 < len(found) else after).isalnum():
            end = i + 1
    return end


def emails(text: str, signs: list[int]) -> list[tuple[int, int]]:
    """Addresses around the at-signs at those places; each character is read once to the left and once to the right of a sign."""
    out, low = [], 0
    for at in signs:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        low = max(low, at + 1)
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
    return out


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by kind as listed in BASE and ADDED, then start."""
    text = text or ""
    anchors: dict[str, list[int]] = {}
    for end, (kind, n) in cues().iter(folded(text)):
        anchors.setdefault(kind, []).append(end - n + 1 if kind in ("email", "phone") else end + 1)
    out: list[tuple[str, int, int]] = [("email", s, e) for s, e in emails(text, anchors.get("email", ()))]
    for m in DOTTED.finditer(text):
        at = m.start()
        if m.end() - at < 7:
            continue
        parts = m[0].split(".")
        for i in range(0, len(parts) - 3, 4):  # four numbers at a time, as the pattern takes them
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in four) and all(int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    done = 0
    for at in anchors.get("phone", ()):
        if at >= done and (m := PHONE.match(text, at)):
            done = m.end()
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    for at in anchors.get("url", ()):
        if m := URL_USER.match(text, at):
            out.append(("url", m.start(), m.end()))
    last = 0
    for m in IBAN.finditer(text):
        at, end = m.start(), m.end(1)
        if at >= last and not (at and text[at - 1].isascii() and text[at - 1].isalnum()) and (n := iban_end(text[at:end], text[end : end + 1])):
            last = at + n
            out.append(("iban", at, last))
    for kind, pattern in (("account", ACCOUNT), ("secret", SECRET)):
        last = 0
        for at in anchors.get(kind, ()):
            if at >= last and (m := pattern.match(text, at)):
                out.append((kind, m.start(1), m.end(1)))
                last = m.end(1)
    rank = {k: i for i, k in enumerate((*BASE, *ADDED))}
    return sorted(set(out), key=lambda s: (rank[s[0]], s[1], s[2]))


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """text with each span replaced by [KIND]; of overlapping spans the first, then the longest, names the whole."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """docs with pii, an array of (kind, start, end), and on request redacted, the text without personal data."""

    def one(text: str | None) -> tuple:
        spans = spans_of(text)
        rows = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        return (rows, redacted(text, spans)) if redact else (rows,)

    return python_stage(docs, [text_col], "pii array<struct<kind:string,start:bigint,end:bigint>>" + ", redacted string" * redact, one)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count base spans; spans lists those of all kinds."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s.kind.isin(*BASE))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return found.select(
        "doc_id",
        *[F.expr(f"size(filter(pii, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("pii")).alias("spans"),
    )
