"""Personal data in one text: exact base spans, and candidates that generators propose for a model to judge."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from random import Random

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Characters of context on each side that features may look at.
CONTEXT = 48

#: Invented data in the place of each base span of the sample.
INVENTED = 4

#: Words that announce a kind, in the order of KINDS.
CUES = (
    ("email", "e-mail", "mail", "mailto", "contact", "write"),
    ("ip", "host", "server", "address", "addr", "login", "client"),
    ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "whatsapp"),
)

# Base patterns. A number can only begin where no digit stands before, which spares quadratic retries in long runs.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Everything a number of any kind consists of; no match crosses the border of such a run.
_REGION = re.compile(r"[0-9+][0-9+() .-]*")
_DIGITS = re.compile(r"[0-9]+")
_PIECE = re.compile(r"[^ ]+")

_OPEN, _CLOSE = r"\s?[\[({]\s?", r"\s?[\])}]\s?"
_AT_MARKS = ("@", "[at]", "(at)", "{at}", "[AT]", "(AT)", "[@]", "(@)", " at ", " AT ")
_HOST = re.compile(rf"\s?[A-Za-z0-9-]+(?:(?:\.|{_OPEN}(?:dot|DOT|\.){_CLOSE}|\s(?:dot|DOT)\s)[A-Za-z0-9-]+)*")
_DOTTED = re.compile(r"\.|\b(?:dot|DOT)\b")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\s?$")
_DOT_MARKS = ("[.]", "(.)", "[dot]", "(dot)", " dot ", "[DOT]", "(DOT)")
_DOT = rf"(?:\.|{_OPEN}(?:dot|DOT|\.){_CLOSE}|\s(?:dot|DOT)\s)"
_MARKED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}{_DOT}[0-9]{{1,3}}{_DOT}[0-9]{{1,3}}{_DOT}[0-9]{{1,3}}(?![0-9])")
_DATE = re.compile(r"(?:[12][0-9]{3}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]|[0-3]?[0-9][-./ ][0-3]?[0-9][-./ ][12][0-9]{3})$")

_ENDINGS = ("com", "org", "net", "de", "fr", "es", "io", "edu", "info", "co.uk", "com.br", "gov")
_LAST_LABELS = {e.split(".")[-1] for e in _ENDINGS} | {"eu", "it", "nl", "ch", "at", "pl", "us", "ca", "biz", "dev", "app"}

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and not _LOCAL_END.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield EMAIL, start, done
        at = text.find("@", done)


def _small(number: str) -> bool:
    """Whether digits say at most 255, however many zeros lead."""
    bare = number.lstrip("0")
    return len(bare) < 4 and int(bare or "0") <= 255


def _regions(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _REGION.finditer(text) if m.end() - m.start() >= 7]


def _numbers(text: str, regions: list[tuple[int, int]]) -> Iterator[Span]:
    for low, high in regions:
        for m in _IP.finditer(text, low, high):
            if all(map(_small, m.group().split("."))):
                yield IP, m.start(), m.end()
        for m in _CARD.finditer(text, low, high):
            digits = only_digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield CARD, m.start(), m.end()
        if text.find("+", low, high) >= 0:
            for m in _PHONE.finditer(text, low, high):
                if 8 <= len(only_digits(m.group())) <= 15:
                    yield PHONE, m.start(), m.end()


def _proposed_emails(text: str) -> Iterator[Span]:
    for mark in _AT_MARKS:
        at = text.find(mark)
        while at >= 0:
            low = max(0, at - CONTEXT)
            local, host = _LOCAL.search(text[low:at]), _HOST.match(text, at + len(mark))
            if local and host and (mark[0] != " " or _DOTTED.search(host.group())):
                yield EMAIL, low + local.start(), host.end()
            at = text.find(mark, at + len(mark))


def _proposed_ips(text: str) -> Iterator[Span]:
    for mark in _DOT_MARKS:
        at = text.find(mark)
        while at >= 0:
            # Three numbers and two marks may stand before this one.
            found = _MARKED_IP.search(text, max(0, at - 28), at + 28)
            if found and found.start() < at < found.end():
                yield IP, found.start(), found.end()
                at = found.end() - len(mark)
            at = text.find(mark, at + len(mark))


def _proposed_numbers(text: str, regions: list[tuple[int, int]]) -> Iterator[Span]:
    """Up to six neighbouring pieces of digits, each window for every kind its digits allow."""
    for low, high in regions:
        low -= low > 0 and text[low - 1] == "("
        pieces = []
        for m in _PIECE.finditer(text, low, high):
            n = sum(map(len, _DIGITS.findall(m.group())))
            if n:
                pieces.append((m.start(), m.end(), n))
        for i, (start, _, _) in enumerate(pieces):
            total = 0
            for _, end, n in pieces[i : i + 6]:
                total += n
                if total > 19:
                    break
                while text[end - 1] not in "0123456789":
                    end -= 1
                begin = start
                while text[begin] not in "0123456789+(":
                    begin += 1
                if 7 <= total <= 15:
                    yield PHONE, begin, end
                if 13 <= total <= 19:
                    yield CARD, begin, end
                if text.count(".", begin, end) == 3 and _IP.fullmatch(text, begin, end):
                    yield IP, begin, end


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans by kind and start, and all other candidates that overlap none of them, each once."""
    regions = _regions(text)
    base = sorted([*_emails(text), *_numbers(text, regions)])
    proposed = {*_proposed_emails(text), *_proposed_ips(text), *_proposed_numbers(text, regions)}
    if not proposed:
        return base, []
    starts = sorted((s, e) for _, s, e in base)
    free, i, reach = [], 0, -1
    for kind, start, end in sorted(proposed, key=lambda c: c[2]):
        # Base spans that begin before this candidate ends; ``reach`` is where the furthest of them ends.
        while i < len(starts) and starts[i][0] < end:
            reach = max(reach, starts[i][1])
            i += 1
        if reach <= start:
            free.append((kind, start, end))
    return base, sorted(free)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _side(char: str) -> float:
    return 0.0 if not char or char.isspace() else 1.0 if char.isalpha() else 2.0 if char.isdigit() else 3.0


FEATURES = 34


def features(kind: int, before: str, span: str, after: str) -> list[float]:
    """Format and context of a candidate."""
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    lower = span.lower()
    last = re.split(r"[^a-z0-9]+", lower)[-1]
    words = set(re.findall(r"[a-z-]+", before.lower()[-CONTEXT:]))
    cues = [float(any(c in words for c in CUES[k])) for k in range(4)]
    bracketed = float(bool(re.search(r"[\[({]\s?(?:at|@|dot|\.)\s?[\])}]", lower)))
    return [
        *[float(kind == k) for k in range(4)],
        float(len(span)), float(len(digits)), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[-1]),
        float(span.startswith("+")), float(span.count(" ")), float(span.count(".")), float(span.count("-")), float(span.count("(")),
        bracketed, float(luhn(digits) and len(digits) >= 13), float(max((int(g[:6]) for g in groups), default=0)), float(all(map(_small, groups))),
        float(digits[:1] or 0), float(len(set(digits))), float("@" in span), float(" at " in lower), float(" dot " in lower),
        float(len(last)) if last.isalpha() else 0.0, float(last in _LAST_LABELS), float(bool(_DATE.fullmatch(span))),
        _side(before[-1:]), _side(after[:1]), float(any(c in "\"'=#$/" for c in before[-3:])),
        *cues,
    ]


def _with_check(digits: str) -> str:
    """Digits with a last one that makes them valid."""
    return digits + next(c for c in "0123456789" if luhn(digits + c))


def _another(kind: int, r: Random, words: list[str]) -> str:
    """An invented datum of a kind in its base form, from the words around and random digits."""

    def digits(n: int) -> str:
        return "".join(r.choices("0123456789", k=n))

    def word() -> str:
        return r.choice(words) if words else "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9)))

    if kind == EMAIL:
        local = r.choice([word(), f"{word()}.{word()}", f"{word()[0]}.{word()}", f"{word()}_{word()}", f"{word()}{digits(r.randint(1, 4))}"])
        return f"{local}@{r.choice([word(), f'{word()}-{word()}', f'{word()}.{word()}'])}.{r.choice(_ENDINGS)}"
    if kind == IP:
        return ".".join(str(r.randint(0, 255) if r.random() < 0.8 else r.randint(0, 9)) for _ in range(4))
    if kind == CARD:
        return _with_check(r.choice("3456") + digits(14))
    return f"+{r.randint(1, 99)} {digits(3)} {digits(7)}"


def _spellings(kind: int, r: Random, span: str) -> Iterator[tuple[int, bool, str]]:
    """``(label, cued, spelling)``: other spellings of a datum, and things of like form that are none. Some are only
    told by a word that announces them."""
    digits = only_digits(span)
    if kind == EMAIL:
        local, _, host = span.partition("@")
        parts = host.split(".")
        for at in (" [at] ", " (at) ", "[at]", "(at)", " at ", "@"):
            for dot in (" [dot] ", " (dot) ", "[dot]", "(dot)", " dot "):
                yield 1, False, local + at + dot.join(parts)
        for at in ("[at]", "(at)", " (at) "):
            yield 1, False, local + at + host
        yield 1, True, f"{local} at {host}"
        yield 0, False, f"{local} at {host}"
        yield 0, False, f"look at {host}"
        yield 0, False, f"{r.choice(('meet', 'sit', 'look', local))} at {parts[0]} dot {r.choice(('the', 'then', 'and', 'now', 'line', parts[0]))}"
        yield 0, False, f"{local}@{parts[0]}"
    elif kind == IP:
        parts = span.split(".")
        large = [*parts]
        large[r.randrange(4)] = str(r.randint(256, 999))
        for dot in ("[.]", "(.)", " dot ", "[dot]", "(dot)", " [dot] "):
            yield 1, False, dot.join(parts)
            yield 0, False, dot.join(large)
        yield 1, False, f"{'.'.join(parts[:3])}[.]{parts[3]}"
        yield 0, False, ".".join(large)
    elif kind == CARD:
        broken = digits[:-1] + str((int(digits[-1]) + r.randint(1, 9)) % 10)
        amex = _with_check(r.choice(("34", "37")) + digits[2:14])
        other = amex[:-1] + str((int(amex[-1]) + r.randint(1, 9)) % 10)
        for separator in (".", "  ", " . "):
            yield 1, False, separator.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        for separator in ("", " ", "-", "."):
            yield 0, False, separator.join(broken[i : i + 4] for i in range(0, len(broken), 4))
        for separator in (" ", "-"):
            yield 1, False, f"{amex[:4]}{separator}{amex[4:10]}{separator}{amex[10:]}"
            yield 0, False, f"{other[:4]}{separator}{other[4:10]}{separator}{other[10:]}"
        yield 1, True, amex
        yield 0, False, other
        yield 0, False, digits[:14]
        yield 0, False, digits[:13]
    else:
        tail = digits[-10:].rjust(10, "5")
        a, b, c = tail[:3], tail[3:6], tail[6:]
        for spelling in (f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10] or 1} {a} {b} {c}", f"1-{a}-{b}-{c}"):
            yield 1, False, spelling
        for spelling in (tail, f"{a} {b} {c}", f"{b}-{c}", f"0{a} {b}{c}", f"{b} {c}"):
            yield 1, True, spelling
        day, month, year = f"{r.randint(1, 28):02d}", f"{r.randint(1, 12):02d}", r.randint(1900, 2060)
        for spelling in (f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{month}-{day}-{year}", f"{year}{month}{day}", f"{year} {year + 1}", f"{year}-{year + 9}"):
            yield 0, False, spelling
        for spelling in (tail, digits[:7], digits[:8], f"{a} {b} {c}", f"{b} {c}", f"{a}{b} {c} {a}", f"{b}{c} {a}", f"{a} {b[0]} {c}", f"{b[0]}.{c[0]}.{a}{b}"):
            yield 0, False, spelling
        yield 0, False, f"{b}000 {a}0000"


def views(kind: int, before: str, span: str, after: str) -> Iterator[tuple[int, str, str, str, int]]:
    """A base span and invented ones in other spellings (label 1), and things of like form in its place (label 0)."""
    r = Random(zlib.crc32(f"{before}|{span}|{after}".encode("utf-8", "surrogatepass")))
    words = re.findall(r"[a-z]{3,10}", f"{before} {after}")
    invented = [_another(kind, r, words) for _ in range(INVENTED)]
    for datum in invented:
        yield kind, before, datum, after, 1
    for datum in (span, *invented):
        for label, cued, spelling in _spellings(kind, r, datum):
            announced = f"{before} {r.choice(CUES[kind])}{r.choice((': ', ' '))}"
            if not cued:
                yield kind, before, spelling, after, label
            if cued or label and r.random() < 0.5:
                yield kind, announced, spelling, after, label
            # Numbers that the generators take for a phone number as well.
            if kind in (IP, CARD) and label == (kind == CARD) and 7 <= len(only_digits(spelling)) <= 15:
                yield PHONE, announced if cued else before, spelling, after, 0
