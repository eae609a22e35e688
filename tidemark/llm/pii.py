"""PII with offset-preserving deobfuscation.

A transducer rewrites a text and remembers for each output character the source span it came from. It folds homoglyphs
(full-width and mathematical forms, look-alike Cyrillic and Greek letters, other digits) to ASCII, spelled digits to digits,
and disguises of ``@`` and ``.`` such as ``(at)``, ``[dot]`` or ``name at host dot com``. Identifiers are searched in the output, and
what is found there is mapped back to characters of the source. Spans of the plain text stay as they are; a span of the
rewritten text is added unless nothing in it was rewritten or it lies inside a plain one.

Every search takes time in proportion to the text: an address is found from its ``@`` or disguise, grown left over the user and
right over the host, and a run of figures is entered at its beginning alone.

Defined cases: a null or empty text has no spans; repeated rows are searched apart and alike, ties (rows of one id) too; texts are
read whole, however long; ids may be null and of any type; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_python, small_batches

KINDS = ("email", "ip", "card", "phone")
USER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

#: Look-alikes that no Unicode decomposition folds.
LOOKALIKE = dict(zip("аеорсухіјѕԁԛԝһӏАВЕКМНОРСТХІЈЅαονρικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdqwhlABEKMHOPCTXIJSaovpiktuxABEZHIKMNOPTYX", strict=True))
LOOKALIKE |= dict.fromkeys("‐‑‒–—−﹣", "-") | dict.fromkeys("․﹒", ".") | {"﹫": "@", "﹢": "+"}
#: Spelled digits in the languages of the texts.
SPELLED = {
    **{w: d for d, w in zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True)},
    **{w: d for d, w in zip("0123456789", "null eins zwei drei vier fünf sechs sieben acht neun".split(), strict=True)},
    **{w: d for d, w in zip("0123456789", "zéro un deux trois quatre cinq six sept huit neuf".split(), strict=True)},
    **{w: d for d, w in zip("0123456789", "cero uno dos tres cuatro cinco seis siete ocho nueve".split(), strict=True)},
    "oh": "0",
}
_WORD = "(?:" + "|".join(sorted(map(re.escape, SPELLED), key=len, reverse=True)) + ")"
#: Two spelled digits or more with spaces, hyphens or dots between; a sign or digits may stand among them.
_RUN = re.compile(rf"(?<![^\W_])(?:plus[ -]+)?(?:{_WORD}|[0-9]+)(?:(?:[ ,.-]+|[ ]+(?:dot|point)[ ]+)(?:{_WORD}|[0-9]+))+(?![^\W_])", re.I)
_PART = re.compile(rf"(?P<plus>plus)|(?P<word>{_WORD}(?![^\W\d_]))|(?P<point>dot|point)", re.I)
#: Words that a spelled run is made of, by whether they count; runs with three that count are looked for before anything slower.
_SPOKEN = {**dict.fromkeys(("plus", "dot", "point"), 1), **dict.fromkeys(SPELLED, 2)}
_BETWEEN = re.compile(r"[\W_]+")
_THREE = re.compile(rb"\x02\x01*\x02\x01*\x02")
_DOT = r"(?:[ ]*+[\[({<][ ]*+(?:dot|punkt|point|punto|\.)[ ]*+[\])}>][ ]*+)"
_LABEL = r"[A-Za-z0-9-]++"
#: What may stand for ``@``; blanks on either side belong to it, but for a bare ``@``.
_SIGN = re.compile(r"[\[({<][ ]*+(?:at|arroba|@)[ ]*+[\])}>]|(?<=[ ])at(?=[ ])|@", re.I)
_BLANKS, _JOINS = re.compile(r"[ ]*+"), re.compile(r"[ -]*+")
_HOST = re.compile(rf"{_LABEL}(?:(?:\.|{_DOT}|[ ]++dot[ ]++){_LABEL})+", re.I)
#: The user before the sign, on the text turned round.
_TOD = r"(?:[ ]*+[\])}>][ ]*+(?:tod|tknup|tniop|otnup|\.)[ ]*+[\[({<][ ]*+)"
_RESU = re.compile(rf"[A-Za-z0-9_%+-]++(?:(?:\.|{_TOD})[A-Za-z0-9_%+-]++)*", re.I)
#: Ends of host names that bare words may spell; brackets say enough by themselves.
_ENDS = set("com org net edu gov info biz io co uk de fr es it nl eu us ca ch at be pl ru jp cn in br au mx ar".split())
_BARE = re.compile(r"[ ](?:at|dot)[ ]", re.I)
_ANY_DOT = re.compile(rf"{_DOT}|[ ]+dot[ ]+", re.I)
_BRACKETED = re.compile(r"[\[({<][ ]*(?:at|arroba|@|dot|punkt|point|punto|\.)[ ]*[\])}>]", re.I)
_DOTTED_IP = re.compile(rf"(?<![0-9])[0-9]++(?:(?:\.|{_DOT}|[ ]++dot[ ]++)[0-9]++){{3}}", re.I)

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping: from each ``@``, as far left as users go but not into the match before, and right over the host."""
    out, after, free = [], 0, 0
    while (sign := text.find("@", after)) >= 0:
        start = len(text[free:sign].rstrip(USER)) + free
        after = free = sign + 1
        if start < sign and (host := HOST.match(text, after)):
            out.append((start, host.end()))
            after = free = host.end()
    return out


def _in_range(ip: str) -> bool:
    return all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in ip.split("."))


def find(text: str) -> dict[str, list[Span]]:
    """The plain identifiers: leftmost, non-overlapping in a kind; a match that fails its rule is dropped whole."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    out["email"] = emails(text)
    if DIGITS.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if _in_range(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m[0])) <= 15]
    return out


def fold(c: str) -> str:
    """One ASCII character for a look-alike, or the character itself."""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    k = unicodedata.normalize("NFKC", c)
    return k if len(k) == 1 and k.isascii() and not k.isspace() else c


_FOLDED = {ord(c): f for c in map(chr, range(128, 0x1F000)) if not 0xD800 <= ord(c) < 0xE000 and not 0x4E00 <= ord(c) < 0xD7A4 and (f := fold(c)) != c}
_FOLDED |= {c: f for c in range(0x1D400, 0x1D800) if (f := fold(chr(c))) != chr(c)}
_FOLDS = re.compile("[" + re.escape("".join(map(chr, sorted(_FOLDED)))) + "]")
_FOLD_SET = frozenset(map(chr, _FOLDED))


def spelled_run(low: str) -> bool:
    """Does a lower-case text have three spoken digits among which only figures, signs and points stand?"""
    tokens = _BETWEEN.split(_plain_i(low))
    return _THREE.search(bytes([_SPOKEN.get(x) or x.isdigit() for x in tokens])) is not None


def _plain_i(low: str) -> str:
    """Lower-case text with the forms of i that a search without case takes for it."""
    return low if low.isascii() else low.replace("i̇", "i").replace("ı", "i")


def disguised_at(text: str, low: str) -> bool:
    return " dot " in low or any(c in text for c in "[({<") and _BRACKETED.search(text) is not None


class Rewritten:
    """Text with, for runs of it, where they came from: a run is copied one to one, or stands whole for its source span."""

    def __init__(self, text: str):
        self.text, self.at, self.src, self.end = text, [0], [0], [None]

    def source(self, start: int, stop: int) -> Span:
        def of(i: int, last: bool) -> int:
            k = bisect_right(self.at, i) - 1
            if self.end[k] is None:
                return self.src[k] + i - self.at[k] + last
            return self.end[k] if last else self.src[k]

        return of(start, False), of(stop - 1, True)

    def replace(self, changes: list[tuple[int, int, str]]) -> Rewritten:
        """changes: start, stop, new text, in order, of this text; spans refer to the first source."""
        out, parts, size, last = Rewritten(""), [], 0, 0
        out.at, out.src, out.end = [], [], []

        def copy(a: int, z: int) -> None:
            nonlocal size
            while a < z:
                k = bisect_right(self.at, a) - 1
                stop = min(z, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                out.at.append(size)
                out.src.append(self.src[k] + (a - self.at[k] if self.end[k] is None else 0))
                out.end.append(self.end[k])
                parts.append(self.text[a:stop])
                size, a = size + stop - a, stop

        for start, stop, new in changes:
            copy(last, start)
            if new:
                src, end = self.source(start, stop)
                out.at.append(size)
                out.src.append(src)
                out.end.append(end)
                parts.append(new)
                size += len(new)
            last = stop
        copy(last, len(self.text))
        out.text = "".join(parts)
        if not out.at:
            out.at, out.src, out.end = [0], [0], [None]
        return out


def _digits(run: str, at: int) -> list[tuple[int, int, str]]:
    """Changes that spell a run of digit words in figures, put together; none if it has fewer than three words."""
    parts = list(_PART.finditer(run))
    if sum(1 for m in parts if m["word"]) < 3:
        return []
    changes, last, end = [], None, 0
    for m in parts:
        a, z = at + m.start(), at + m.end()
        if m["word"]:
            if last is not None and not run[last : m.start()].strip(" ,-"):
                changes.append((at + last, a, ""))
            changes.append((a, z, SPELLED[_plain_i(m[0].lower())]))
            last = m.end()
        elif m["plus"]:
            changes.append((a, at + _JOINS.match(run, m.end()).end(), "+"))
        else:
            left = m.start() - len(run[end : m.start()]) + len(run[end : m.start()].rstrip(" "))
            changes.append((at + left, at + _BLANKS.match(run, m.end()).end(), "."))
        end = m.end()
    return changes


def addresses(text: str) -> list[tuple[Span, Span, Span]]:
    """user, sign with its blanks and host of what may be a disguised address, in order and apart. A user doesn't go beyond the
    sign before; a match that a rule drops later still takes its text."""
    out, turned, free = [], text[::-1], 0
    for sign in _SIGN.finditer(text):
        left, right = sign.span()
        if left < free:
            continue
        if sign[0] != "@":
            left = free + len(text[free:left].rstrip(" "))
            right = _BLANKS.match(text, right).end()
        user = _RESU.match(turned, len(text) - left, len(text) - free)
        free = max(free, left) if sign[0] == "@" else sign.end()
        if user and (host := _HOST.match(text, right)):
            out.append(((len(text) - user.end(), left), (left, right), host.span()))
            free = host.end()
    return out


def _spelled_out(host: str) -> bool:
    """Do bare words spell a host with a known ending?"""
    return _BARE.search(host) is not None and host.lower().rsplit(None, 1)[-1].rsplit(".", 1)[-1] in _ENDS


def rewrite(text: str) -> Rewritten | None:
    """The deobfuscated text, or None if nothing in it is disguised."""
    now, changed = Rewritten(text), False
    if not text.isascii() and not _FOLD_SET.isdisjoint(text):
        now, changed = now.replace([(m.start(), m.end(), _FOLDED[ord(m[0])]) for m in _FOLDS.finditer(text)]), True
    low = now.text.lower()
    if spelled_run(low):
        changes = [c for m in _RUN.finditer(now.text) for c in _digits(m[0], m.start())]
        if changes:
            now, changed = now.replace(changes), True
    if disguised_at(now.text, low):
        changes, taken = [], []
        for user, at, host in addresses(now.text):
            if _BARE.search(now.text[at[0] : host[1]]) and not _spelled_out(now.text[slice(*host)]):
                continue
            taken.append((user[0], host[1]))
            for a, z in (user, host):
                changes += [(a + d.start(), a + d.end(), ".") for d in _ANY_DOT.finditer(now.text[a:z])]
            changes.append((*at, "@"))
        begins = [a for a, _ in taken]
        for m in _DOTTED_IP.finditer(now.text):
            k = bisect_left(begins, m.end())
            if not k or taken[k - 1][1] <= m.start():
                changes += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _ANY_DOT.finditer(m[0])]
        if changes:
            now, changed = now.replace(sorted(changes)), True
    return now if changed else None


def search(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans and added spans by kind."""
    text = text or ""
    base = find(text)
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    plain = sorted(s for k in KINDS for s in base[k])
    begins, reach = [a for a, _ in plain], list(accumulate((z for _, z in plain), max))
    now = rewrite(text)
    if now is not None:
        for kind, spans in find(now.text).items():
            for a, z in spans:
                source = now.source(a, z)
                if now.text[a:z] == text[source[0] : source[1]]:
                    continue  # nothing in it was rewritten
                k = bisect_right(begins, source[0])
                if not k or reach[k - 1] < source[1]:
                    added[kind].append(source)
    return base, added


def joined(*found: dict[str, list[Span]]) -> str:
    rows = sorted((a, i, z) for f in found for i, k in enumerate(KINDS) for a, z in f[k])
    return ",".join(f"{KINDS[i]}:{a}:{z}" for a, i, z in rows)


FIELDS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base_sha256 string, spans string"


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and, of its whole text, the counts of plain spans by kind, the number added, a digest and all spans."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *[x.split()[0] for x in FIELDS.split(", ")]]

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, added = search(text)
                rows.append((*(len(base[k]) for k in KINDS), sum(map(len, added.values())), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base, added)))
            if rows:
                made = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], names)

    return in_python(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def op10_digest(docs: DataFrame) -> DataFrame:
    return personal_data(docs)
