"""Finders of protected content in one text: (start, end) of every kind, code points, ends exclusive.

A text is looked at through a few indexes made once (runs of digits, chunks between white space, ends of
lines), and each finder reads only around what can begin a match.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import cached_property

Spans = Iterator[tuple[int, int]]

# Names and signs that carry a meaning of their own.
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "CNY", "RMB")
CURRENCY_SIGNS = "$€£¥"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_DIGITS, _CHUNK, _TICKS = re.compile(r"[0-9]+"), re.compile(r"\S+"), re.compile(r"`+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL_CHARS = _NAME_CHARS | frozenset(".!#$%&'*+/=?^_`{|}~-")
_PATH_CHARS = _NAME_CHARS | frozenset("._~+@%-")
_HEX = frozenset("0123456789abcdefABCDEF:.")
_MONTH_OF = {name[:n]: k for k, name in enumerate(MONTHS, 1) for n in (3, len(name))} | {"sept": 9}
_CLOSERS = {")": "(", "]": "[", "}": "{"}


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Text:
    """A text and its indexes."""

    def __init__(self, text: str):
        self.t = text
        self.n = len(text)

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < self.n else ""

    def word_at(self, i: int) -> bool:
        return 0 <= i < self.n and _word(self.t[i])

    @cached_property
    def digits(self) -> list[tuple[int, int]]:
        return [m.span() for m in _DIGITS.finditer(self.t)]

    @cached_property
    def chunks(self) -> list[tuple[int, int]]:
        return [m.span() for m in _CHUNK.finditer(self.t)]

    @cached_property
    def line_ends(self) -> list[int]:
        return [i for i, c in enumerate(self.t) if c == "\n"] + [self.n]

    def line_end(self, i: int) -> int:
        return self.line_ends[bisect.bisect_left(self.line_ends, i)]

    def blanks(self, i: int, step: int = 1) -> int:
        """The first place from i on, in steps, that has no blank within a line."""
        while 0 <= i < self.n and self.t[i].isspace() and self.t[i] not in "\r\n":
            i += step
        return i

    def escaped(self, i: int) -> bool:
        k = i
        while k and self.t[k - 1] == "\\":
            k -= 1
        return (i - k) % 2 == 1

    def places(self, what: str, start: int = 0, end: int | None = None) -> Iterator[int]:
        end = self.n if end is None else end
        while (start := self.t.find(what, start, end)) >= 0:
            yield start
            start += 1

    def closing(self, what: str, start: int, end: int) -> int:
        """The first unescaped place of a mark before ``end``, or -1."""
        return next((i for i in self.places(what, start, end) if not self.escaped(i)), -1)

    def trimmed(self, start: int, end: int) -> int:
        """The end without closing punctuation, and without brackets that close nothing inside."""
        inside = self.t[start:end].rstrip(".,;:!?")
        while inside and inside[-1] in _CLOSERS and inside.count(inside[-1]) > inside.count(_CLOSERS[inside[-1]]):
            inside = inside[:-1]
        return start + len(inside)


def _apart(spans: Spans) -> Spans:
    """Those that begin at or behind the end of the one before."""
    last = 0
    for s, e in spans:
        if e > s >= last:
            last = e
            yield s, e


# --- addresses ---------------------------------------------------------------------------------------


def _labels(host: str) -> int:
    """How many labels of a dotted name are sound, from the first on."""
    count = 0
    for label in host.split("."):
        if not label or len(label) > 63 or label[0] == "-" or label[-1] == "-":
            break
        count += 1
    return count


def _run(x: Text, i: int, chars: frozenset, end: int) -> int:
    while i < end and x.t[i] in chars:
        i += 1
    return i


def links(x: Text) -> Spans:
    """Addresses that begin with a scheme or www."""
    for a, b in x.chunks:
        low = x.t[a:b].lower()
        found = sorted({low.find(head, k) for head in ("http://", "https://", "www.") for k in range(len(low)) if low.startswith(head, k)}) if "http" in low or "www." in low else []
        last = a
        for k in found:
            s = a + k
            if s < last or x.word_at(s - 1):
                continue
            body = s + (4 if low.startswith("www.", k) else low.index("//", k) - k + 2)
            e = body
            while e < b and x.t[e] not in "<>\"'":
                e += 1
            if e > body:
                last = e
                yield s, x.trimmed(s, e)


def domains(x: Text) -> Spans:
    """Bare host names of two labels and more, with what follows of port and path."""
    host = _NAME_CHARS | {"-", "."}
    for a, b in x.chunks:
        if x.t.find(".", a + 1, b - 1) < 0:
            continue
        i = a
        while i < b:
            if x.t[i] not in _NAME_CHARS or i and (x.word_at(i - 1) or x.t[i - 1] in "@\\/.-"):
                i += 1
                continue
            e = _run(x, i, host, b)
            names = x.t[i:e].split(".")
            names = names[: _labels(x.t[i:e])]
            while len(names) > 1 and not (names[-1].lower().startswith("xn--") and 6 <= len(names[-1]) <= 63 or names[-1].isalpha() and 2 <= len(names[-1])):
                names.pop()
            s, e = i, i + len(".".join(names))
            if len(names) < 2 or e < b and (x.t[e] in _NAME_CHARS or x.t[e] == "-"):
                i = max(e, i + 1)
                continue
            if x.at(e) == ":" and x.at(e + 1).isdigit():
                e = _run(x, e + 1, frozenset("0123456789"), min(b, e + 6))
            if x.at(e) and x.t[e] in "/?#":
                while e < b and x.t[e] not in "<>\"'":
                    e += 1
            yield s, x.trimmed(s, e)
            i = e


def mails(x: Text) -> Spans:
    last = 0
    for i in x.places("@"):
        s = i
        while s > last and x.t[s - 1] in _LOCAL_CHARS:
            s -= 1
        while s < i and s and (x.word_at(s - 1) or x.t[s - 1] in ".+-"):
            s += 1
        e = _run(x, i + 1, _NAME_CHARS | {"-", "."}, x.n)
        names = x.t[i + 1 : e].split(".")[: _labels(x.t[i + 1 : e])]
        e = i + 1 + len(".".join(names))
        if s < i and len(names) > 1 and not x.word_at(e) and x.at(e) != "-":
            last = e
            yield s, e


def v4(x: Text) -> Spans:
    for a, b in x.chunks:
        for m in re.finditer(r"[0-9.]+", x.t[a:b]):
            if m[0].count(".") == 3 and _is_address(m[0], 4):
                yield a + m.start(), a + m.end()


def _is_address(value: str, version: int) -> bool:
    try:
        return ipaddress.ip_address(value).version == version
    except ValueError:
        return False


def v6(x: Text) -> Spans:
    for a, b in x.chunks:
        if x.t.count(":", a, b) < 2:
            continue
        i = a
        while i < b:
            e = _run(x, i, _HEX, b)
            if e == i:
                i += 1
                continue
            zone = e
            if x.at(e) == "%":
                zone = _run(x, e + 1, _NAME_CHARS | frozenset("._~-"), b)
                zone = e if zone == e + 1 else zone
            after = x.at(zone)
            whole = x.t[i:zone].rstrip(".")
            if whole.count(":") >= 2 and not (after and (after in "_.:~-" or after in _NAME_CHARS)) and _is_address(whole, 6):
                yield i, i + len(whole)
            i = max(zone, i + 1)


# --- numbers -----------------------------------------------------------------------------------------


def _ends(x: Text, i: int) -> list[int]:
    """Where a number that begins at i (sign, digits, point) may end, the longest first."""
    if x.at(i) and x.t[i] in "+-":
        i += 1
    whole = _run(x, i, frozenset("0123456789"), x.n)
    stems = []
    if whole > i:
        e = whole
        if whole - i <= 3:
            grouped = []
            while x.at(e) == "," and x.t[e + 1 : e + 4].isdigit() and len(x.t[e + 1 : e + 4]) == 3:
                e += 4
                grouped.append(e)
            stems += reversed(grouped)
        stems.append(whole)
    elif x.at(i) != ".":
        return []
    out = []
    for stem in stems or [i]:
        cuts = []
        if x.at(stem) == ".":
            point = _run(x, stem + 1, frozenset("0123456789"), x.n)
            cuts += range(point, stem + 1, -1)
        if whole > i:
            cuts.append(stem)
        for cut in cuts:
            if x.at(cut) and x.t[cut] in "eE":
                power = cut + 1 + (x.at(cut + 1) in ("+", "-"))
                end = _run(x, power, frozenset("0123456789"), x.n)
                out += range(end, power, -1)
            out.append(cut)
    return out


def _number_starts(x: Text) -> Iterator[int]:
    """Places where a number may begin: at a sign, a point or a digit, not within a word or behind a point."""
    for s, _ in x.digits:
        first = s - (x.at(s - 1) == ".")
        first -= x.at(first - 1) in ("+", "-")
        for i in range(first, s + 1):
            if not i or not (x.word_at(i - 1) or x.t[i - 1] == "."):
                yield i


def numbers(x: Text) -> Spans:
    return _apart((i, e) for i in _number_starts(x) if (e := next((e for e in _ends(x, i) if not x.word_at(e)), 0)))


def percents(x: Text) -> Spans:
    """Numbers with a percent sign behind."""

    def end(i: int) -> int:
        return next((k + 1 for e in _ends(x, i) if x.at(k := x.blanks(e)) == "%" and not x.word_at(k + 1)), 0)

    return _apart((i, e) for i in _number_starts(x) if (e := end(i)))


def _code_at(x: Text, i: int) -> int:
    return i + 3 if x.t[i : i + 3].upper() in CURRENCY_CODES else 0


def amounts(x: Text) -> Spans:
    """Numbers with a currency's sign or code before, or its code behind."""

    def found() -> Spans:
        for s, _ in x.digits:
            first = s - (x.at(s - 1) == ".")
            first -= x.at(first - 1) in ("+", "-")
            k = x.blanks(first - 1, -1)
            head = k if k >= 0 and x.t[k] in CURRENCY_SIGNS else k - 2 if k >= 2 and _code_at(x, k - 2) else -1
            if head >= 0:
                sign = x.blanks(head - 1, -1)
                if sign >= 0 and x.t[sign] in "+-" and not x.word_at(sign - 1):
                    head = sign
                if not x.word_at(head - 1) and (e := next((e for e in _ends(x, first) if not x.word_at(e)), 0)):
                    yield head, e
                    continue
            for i in range(first, s + 1):
                if not x.word_at(i - 1):
                    e = next((c for e in _ends(x, i) if (c := _code_at(x, x.blanks(e))) and not x.word_at(c)), 0)
                    if e:
                        yield i, e
                        break

    return _apart(sorted(found()))


def _is_day(year: int, month: int, day: int) -> bool:
    try:
        date(year, month, day)
    except ValueError:
        return False
    return True


def dates(x: Text) -> Spans:
    """Days of the calendar: year-month-day, with slashes in either order, and with English month names."""
    return _apart(sorted(_dates(x)))


def _dates(x: Text) -> Spans:
    runs = x.digits
    for k, (s, e) in enumerate(runs):
        if k + 2 < len(runs):
            (s2, e2), (s3, e3) = runs[k + 1], runs[k + 2]
            sizes, gaps = (e - s, e2 - s2, e3 - s3), (x.t[e:s2], x.t[e2:s3])
            parts = [int(x.t[a:b]) for a, b in ((s, e), (s2, e2), (s3, e3))] if max(sizes) <= 4 else []
            if gaps == ("-", "-") and sizes == (4, 2, 2) and _is_day(*parts):
                yield s, e3
            if gaps == ("/", "/") and parts and sizes[1] <= 2:
                if sizes[0] == 4 and sizes[2] <= 2 and _is_day(*parts):
                    yield s, e3
                elif sizes[0] <= 2 and sizes[2] >= 2:
                    year = parts[2] if sizes[2] == 4 else 2000 + parts[2]
                    if _is_day(year, parts[0], parts[1]) or _is_day(year, parts[1], parts[0]):
                        yield s, e3
        if e - s > 2:
            continue
        # A month before or behind, with blanks between, and a year of four digits last.
        a = x.blanks(s - 1, -1)
        name = a + 1
        while name and x.t[name - 1].isascii() and x.t[name - 1].isalpha():
            name -= 1
        month = _MONTH_OF.get(x.t[name : a + 1].lower())
        y = x.blanks(e + (x.at(e) == ","))
        if month and a < s - 1 and not x.word_at(name - 1) and y > e + (x.at(e) == ",") and _year(x, y) and _is_day(int(x.t[y : y + 4]), month, int(x.t[s:e])):
            yield name, y + 4
        a = x.blanks(e)
        b = a
        while b < x.n and x.t[b].isascii() and x.t[b].isalpha():
            b += 1
        month, y = _MONTH_OF.get(x.t[a:b].lower()), x.blanks(b)
        if month and a > e and y > b and _year(x, y) and _is_day(int(x.t[y : y + 4]), month, int(x.t[s:e])):
            yield s, y + 4


def _year(x: Text, i: int) -> bool:
    return _run(x, i, frozenset("0123456789"), x.n) == i + 4


# --- marks -------------------------------------------------------------------------------------------


def flags(x: Text) -> Spans:
    """Command-line options, with a value behind an equals sign."""
    last = 0
    for i in x.places("-"):
        if i < last or i and (x.word_at(i - 1) or x.t[i - 1] == "-"):
            continue
        k = i + 1 + (x.at(i + 1) == "-")
        if not (x.at(k).isascii() and x.at(k).isalpha()):
            continue
        e = _run(x, k, _NAME_CHARS | {"-"}, x.n)
        if x.at(e) == "=" and x.at(e + 1).strip():
            e += 1
            while e < x.n and not x.t[e].isspace():
                e += 1
        last = e
        yield i, e


def citations(x: Text) -> Spans:
    """Numbers in square brackets; one or two authors and a year in round ones."""
    for i in x.places("["):
        e = x.t.find("]", i, i + 10_000)
        parts = re.split(r"[-,]", x.t[i + 1 : e]) if e > i else []
        # Blanks may stand around separators, not at the brackets.
        if parts and all(p.strip().isdigit() for p in parts) and parts[0] == parts[0].lstrip() and parts[-1] == parts[-1].rstrip():
            yield i, e + 1
    for i in x.places("("):
        e = x.t.find(")", i, i + 10_000)
        if e > i and _author_year(x.t[i + 1 : e]):
            yield i, e + 1


def _author_year(inside: str) -> bool:
    names, _, year = inside.rpartition(",")
    year = year.lstrip()
    if not (year[:4].isdigit() and len(year) in (4, 5) and (len(year) == 4 or "a" <= year[4] <= "z")):
        return False
    is_name = lambda w: len(w) > 1 and "A" <= w[0] <= "Z" and all(c.isascii() and c.isalpha() or c in "'’-" for c in w)
    words = names.split()
    if names != names.strip() or not words or not is_name(words[0]):
        return False
    return not words[1:] or is_name(words[-1]) and words[1:-1] in (["and"], ["&"], ["et", "al."])


def fences(x: Text) -> Spans:
    """Blocks between fences of three marks and more; one that isn't closed goes to the end."""
    start, opened = 0, None
    for end in x.line_ends:
        line = x.t[start:end]
        body = line.lstrip(" \t")
        mark = body[:1]
        size = len(body) - len(body.lstrip(mark)) if mark and mark in "`~" and len(line) - len(body) <= 3 else 0
        after = min(end + 1, x.n)
        if opened is None and size >= 3:
            opened = start, mark, size
        elif opened and mark == opened[1] and size >= opened[2] and not body[size:].strip(" \t"):
            yield opened[0], after
            opened = None
        start = end + 1
    if opened:
        yield opened[0], x.n


def ticks(x: Text) -> Spans:
    """Code between runs of as many backticks in one paragraph; one that isn't closed goes to the end of its line."""
    runs = [m.span() for m in _TICKS.finditer(x.t) if not x.escaped(m.start())]
    of_size: dict[int, list[int]] = {}
    for s, e in runs:
        of_size.setdefault(e - s, []).append(s)
    breaks = [m.start() for m in re.finditer(r"\r?\n[ \t]*\r?\n", x.t)] + [x.n]
    last = -1
    for s, e in runs:
        if s < last:
            continue
        same = of_size[e - s]
        k = bisect.bisect_right(same, s)
        if k < len(same) and same[k] < breaks[bisect.bisect_left(breaks, e)]:
            last = same[k] + e - s
        else:
            last = x.line_end(e)
        yield s, last
        last = max(last, e)


def destinations(x: Text) -> Spans:
    """Targets of links, behind a label whose brackets match within its line."""
    last = 0
    for i in x.places("]("):
        if i < last or x.escaped(i) or not _closes(x, i):
            continue
        depth, e = 1, i + 2
        while e < x.n and x.t[e] != "\n":
            if x.t[e] == "\\":
                e += 1
            elif x.t[e] == "(":
                depth += 1
            elif x.t[e] == ")":
                depth -= 1
                if not depth:
                    break
            e += 1
        e = min(e, x.n)
        last = e + 1
        yield i + 2, e


def _closes(x: Text, i: int) -> bool:
    """Whether the bracket at i closes one that its line opened."""
    depth = 0
    for k in range(i - 1, x.t.rfind("\n", 0, i), -1):
        if x.t[k] == "[" and not x.escaped(k):
            if not depth:
                return True
            depth -= 1
        elif x.t[k] == "]" and not x.escaped(k):
            depth += 1
    return False


def quotations(x: Text) -> Spans:
    """Double quotes to their ends or those of the line; single ones around two characters and more."""
    last = 0
    for i in sorted([*x.places('"'), *x.places("“")]):
        if i < last or x.t[i] == '"' and x.escaped(i):
            continue
        end = x.line_end(i + 1)
        e = x.closing('"', i + 1, end) if x.t[i] == '"' else x.t.find("”", i + 1, end)
        last = end if e < 0 else e + 1
        yield i, last
        last = max(last, i + 1)
    for opening, closing in (("‘", "’"), ("'", "'")):
        last = 0
        for i in x.places(opening):
            e = x.t.find(closing, i + 1, x.line_end(i))
            bound = opening == "'" and (x.word_at(i - 1) or x.word_at(e + 1))
            if i >= last and e > i + 2 and not bound:
                last = e + 1
                yield i, last


def posix(x: Text) -> Spans:
    """Paths from the root, the home folder or a dot, also with blanks before a later slash."""
    last = 0
    for i in x.places("/"):
        s = i
        while s and x.t[s - 1] in ".~":
            s -= 1
        s = next((k for k in range(s, i + 1) if x.t[k:i] in ("", "~", ".", "..") and not (x.word_at(k - 1) or x.at(k - 1) == ":")), -1)
        if s < last:
            continue
        e, name = i + 1, 0
        while e < x.n and (x.t[e] in _PATH_CHARS or x.t[e] == "/" and name):
            name = 0 if x.t[e] == "/" else name + 1
            e += 1
        if e > i + 1:
            yield s, x.trimmed(s, e)
        last = max(e, i + 1)
        if (far := _with_blanks(x, s, i + 1, "/", '<>"|')) > last:
            yield s, far


def windows(x: Text) -> Spans:
    """Paths from a drive or a share, also with blanks before a later backslash."""
    last = 0
    for i in x.places("\\"):
        if x.at(i - 1) == ":" and x.at(i - 2).isascii() and x.at(i - 2).isalpha():
            s, first = i - 2, i + 1
        elif x.at(i + 1) == "\\":
            share = _run(x, i + 2, _NAME_CHARS | frozenset("._$-"), x.n)
            s, first = i, share + 1
            if share == i + 2 or x.at(share) != "\\":
                continue
        else:
            continue
        if s < last or s and (x.t[s - 1] in _NAME_CHARS or x.t[s - 1] == "_"):
            continue
        e, name = first, 0
        while e < x.n and not x.t[e].isspace() and x.t[e] not in '/:*?"<>|' and (x.t[e] != "\\" or name):
            name = 0 if x.t[e] == "\\" else name + 1
            e += 1
        if e > first:
            yield s, x.trimmed(s, e)
        last = max(e, first)
        if (far := _with_blanks(x, s, first, "\\", '<>"|?*')) > last:
            yield s, far


def _with_blanks(x: Text, start: int, first: int, separator: str, forbidden: str) -> int:
    """The end of a path whose names hold blanks: a separator must follow a blank; it ends at the line's end, at
    what can't stand in a path, where something else begins, or behind a name's extension.  0 if there is none."""
    end = x.line_end(first)
    stop = re.compile(rf"[;{re.escape(forbidden)}]|[ \t]+(?=https?://|www\.|[~.]{{0,2}}/|[A-Za-z]:\\|\\\\|--?[A-Za-z])", re.IGNORECASE)
    if m := stop.search(x.t, first, end):
        end = m.start()
    blanks = [k for k in range(start, end) if x.t[k] in " \t"]
    last = x.t.rfind(separator, first, end)
    if not blanks or last < blanks[0]:
        return 0
    for k in blanks:
        stem, dot, extension = x.t[start:k].rstrip().rpartition(".")
        if k > last and dot and 1 <= len(extension) <= 12 and extension.isalnum() and extension.isascii():
            end = k
            break
    return x.trimmed(start, end)


def formulas(x: Text) -> Spans:
    """What stands between dollar signs, single or double, or between backslashed brackets."""
    i = 0
    while (i := x.t.find("$", i)) >= 0:
        if x.escaped(i):
            i += 1
            continue
        run = _run(x, i, frozenset("$"), x.n) - i
        if run >= 2:
            e = next((k for k in x.places("$$", i + 2) if not x.escaped(k) and x.at(k - 1) != "$" and x.at(k + 2) != "$"), -1)
            e = x.n if e < 0 else e + 2
        elif x.at(i - 1) == "$":
            i += 1
            continue
        else:
            end = x.line_end(i + 1)
            e = next((k for k in x.places("$", i + 1, end) if not x.escaped(k) and x.at(k - 1) != "$" and x.at(k + 1) != "$"), -1)
            if _price(x, i) and (e < 0 or _price(x, e)):
                i += 1
                continue
            e = end if e < 0 else e + 1
        yield i, e
        i = max(e, i + 1)
    for opening, closing in ((r"\(", r"\)"), (r"\[", r"\]")):
        last = 0
        for i in x.places(opening):
            if i < last or x.escaped(i):
                continue
            end = x.line_end(i + 2)
            e = x.closing(closing, i + 2, end)
            e = end if e < 0 else e + 2
            yield i, e
            last = max(e, i + 2)


def _price(x: Text, i: int) -> bool:
    k = x.blanks(i + 1)
    k += x.at(k) in ("+", "-")
    k += x.at(k) == "."
    return x.at(k).isdigit()


def identifiers(x: Text, names: tuple[str, ...]) -> Spans:
    """Places of given names, not within longer words."""
    for name in names:
        last = 0
        for i in x.places(name):
            inside = _word(name[0]) and x.word_at(i - 1) or _word(name[-1]) and x.word_at(i + len(name))
            if i >= last and not inside:
                last = i + len(name)
                yield i, last


#: Finders by kind, and characters of which a text must hold one to be worth a look.
FINDERS: dict[str, tuple[Callable[[Text], Spans], str]] = {
    "CLI_FLAG": (flags, "-"),
    "CITATION": (citations, "[("),
    "CODE": (lambda x: [*fences(x), *ticks(x)], "`~"),
    "CURRENCY": (amounts, "0123456789"),
    "DATE": (dates, "0123456789"),
    "EMAIL": (mails, "@"),
    "IPV4": (v4, "0123456789"),
    "IPV6": (v6, ":"),
    "MARKDOWN_DESTINATION": (destinations, "]"),
    "MATH": (formulas, "$\\"),
    "NUMBER": (numbers, "0123456789"),
    "PERCENTAGE": (percents, "%"),
    "POSIX_PATH": (posix, "/"),
    "QUOTATION": (quotations, "\"'“‘"),
    "URL": (lambda x: [*links(x), *domains(x)], "."),
    "WINDOWS_PATH": (windows, "\\"),
}
HINT = re.compile("[" + re.escape("".join(sorted(set("".join(h for _, h in FINDERS.values()))))) + "]")


def find(text: str, names: tuple[str, ...] = (), kinds: tuple[str, ...] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every match, sorted; kinds may overlap."""
    x = Text(text)
    out = [(s, e, "IDENTIFIER") for s, e in identifiers(x, names)]
    for kind, (finder, hint) in FINDERS.items():
        if (kinds is None or kind in kinds) and any(c in text for c in hint):
            out += [(s, e, kind) for s, e in finder(x) if e > s]
    return sorted(out)
