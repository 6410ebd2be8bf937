"""Names of people and firms as typed by hand: folding, parts, and how two spellings compare."""

from __future__ import annotations

import re
import unicodedata

#: Letters that don't decompose into a base letter and a mark.
_PLAIN = {ord(a): b for a, b in zip("łŁøØđĐðÐßæÆœŒþÞıħŦŧ", ("l", "l", "o", "o", "d", "d", "d", "d", "ss", "ae", "ae", "oe", "oe", "th", "th", "i", "h", "t", "t"), strict=True)}
#: Titles and other words around a name.
_AROUND = frozenset("mr mrs ms miss dr prof sir mba phd md msc bsc ma ba jr sr ii iii iv esq ext external contractor".split())
#: Legal forms, written without dots and spaces.
_LEGAL = sorted(
    ("llc", "limitedliabilityco", "limitedliabilitycompany", "gmbh", "gesellschaftmbh", "ltd", "limited", "inc", "incorporated", "corp", "corporation", "bv", "sa", "ab", "aktiebolag", "publab", "abpubl", "plc", "ag", "kg", "cokg", "andcokg", "ucokg", "undcokg", "spzoo", "oy", "as", "nv", "srl", "spa", "sarl", "pty", "ptyltd", "co", "company"),
    key=len,
    reverse=True,
)
#: What a company field holds where there is no company.
NO_COMPANY = frozenset(("", "na", "none", "null", "nil", "unknown", "selfemployed", "freelance", "freelancer", "independent", "private", "nocompany", "tbd", "tbc", "notset"))

def fold(text: str | None) -> str:
    """Lower case, marks off; other letters than a-z stand for one of them, so that all names share one small alphabet."""
    if not text:
        return ""
    plain = unicodedata.normalize("NFKD", text.translate(_PLAIN)).lower().translate(_PLAIN)
    out = []
    for c in plain:
        if "a" <= c <= "z" or "0" <= c <= "9":
            out.append(c)
        elif unicodedata.combining(c) or c in "'’`´":
            continue
        elif c.isalpha():
            out.append(chr(97 + ord(c) % 26))
        else:
            out.append(c)
    return "".join(out)


_ASIDE = re.compile(r"[\"“”«»(\[]\s*([^\"“”«»)\]]*?)\s*[\"“”«»)\]]")


def name_parts(name: str | None) -> tuple[list[str], list[str]]:
    """The words of a name, family name last where a comma shows it, without titles and middle initials; and names given aside."""
    text = fold(name)
    aside = [w for a in _ASIDE.findall(text) for w in re.findall(r"[a-z]+", a) if w not in _AROUND]
    text = _ASIDE.sub(" ", text)
    halves = [re.findall(r"[a-z0-9]+", h) for h in text.split(",")]
    halves = [[w for w in h if w not in _AROUND] for h in halves]
    halves = [h for h in halves if h]
    words = halves[1] + halves[0] if len(halves) > 1 else halves[0] if halves else []
    long = [w for w in words if len(w) > 1]
    if len(long) >= 2:
        words = long
    elif len(long) == 1 and len(words) > 2:
        words = [next(w for w in words if len(w) == 1), *long]
    return words, aside


def distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last, two = None, list(range(len(b) + 1)), None
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most and (two is None or min(last) > most):
            return most + 1
        before, last, two = last, row, last
    return last[-1]


def typo_room(word: str) -> int:
    """Slips of the hand that a word of this length may have."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def alike(a: str, b: str) -> bool:
    room = min(typo_room(a), typo_room(b))
    return a == b or (room > 0 and distance(a, b, room) <= room)


class FirstNames:
    """Which words are first names in their own right, which are forms of one name, and which tell relatives apart; all learned from the data."""

    def __init__(self, common: set[str], pairs: set[tuple[str, str]], apart: set[tuple[str, str]] = frozenset()) -> None:
        self.common = common
        self.short: set[tuple[str, str]] = set(pairs) | {(b, a) for a, b in pairs}
        self.apart: set[tuple[str, str]] = set(apart) | {(b, a) for a, b in apart}
        self.forms: dict[str, set[str]] = {}
        for a, b in self.short:
            self.forms.setdefault(a, set()).add(b)

    def same(self, a: str, b: str) -> float:
        """How well two first names agree: 1 equal, 0 not at all."""
        if a == b:
            return 1.0
        if (a, b) in self.short:
            return 0.9
        if len(a) == 1 or len(b) == 1:
            return 0.6 if a[:1] == b[:1] else 0.0
        if (a in self.common and b in self.common) or (a, b) in self.apart:
            return 0.0  # Daniel isn't Daniela
        room = max(min(typo_room(a), typo_room(b)), 1 if min(len(a), len(b)) >= 3 else 0)
        d = distance(a, b, room)
        if d <= room:
            return 0.9 if d == 1 else 0.75
        return 0.7 if any(alike(a, x) for x in self.forms.get(b, ())) or any(alike(b, x) for x in self.forms.get(a, ())) else 0.0


def same_person(a: tuple[list[str], list[str]], b: tuple[list[str], list[str]], first_names: FirstNames) -> float:
    """How well two names agree as one person's, 0 to 1; 0 unless family and first name both do, in either order."""
    (wa, xa), (wb, xb) = a, b
    if not wa or not wb:
        return 0.0
    if len(wa) == 1 or len(wb) == 1:
        return 1.0 if wa == wb and len(wa[0]) > 3 else 0.0
    best = 0.0
    for la, fa in ((wa[-1], wa[0]), (wa[0], wa[-1])):
        for lb, fb in ((wb[-1], wb[0]), (wb[0], wb[-1])):
            if len(la) < 3 or len(lb) < 3 or (la, lb) in first_names.apart or (la != lb and (la in first_names.common or lb in first_names.common)):
                continue
            d = distance(la, lb, 2)
            if d > min(typo_room(la), typo_room(lb)):
                continue
            first = max(first_names.same(p, q) for p in (fa, *xa) for q in (fb, *xb))
            if first:
                best = max(best, first * (1.0, 0.95, 0.85)[d])
    return best


_TAGS = re.compile(r"\([^)]*\)|\[[^\]]*\]|\s[-–—/|]\s.*$")


def firm_parts(company: str | None) -> tuple[list[str], str]:
    """The words of a firm's name without its legal form, remarks and article; and its legal form."""
    text = fold(company)
    text = _TAGS.sub(" ", text)
    text = text.replace("&", " and ")
    text = re.sub(r"\b(?:[a-z]\.\s*){1,}[a-z]?\b\.?", lambda m: re.sub(r"[.\s]", "", m.group()) + " ", text)
    words = re.findall(r"[a-z0-9]+", text)
    if words[:1] == ["the"]:
        words = words[1:]
    for legal in _LEGAL:
        for k in range(1, min(4, len(words)) + 1):
            if "".join(words[-k:]) == legal and len(words) > k:
                return [w for w in words[:-k] if w != "and"], legal
    return [w for w in words if w != "and"], ""


def shortened(short: str, full: str) -> bool:
    """True where ``short`` is ``full`` with letters left out, as in trdg for trading."""
    if not 3 <= len(short) < len(full) or short[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def _word_cost(a: str, b: str) -> float:
    if a == b:
        return 0.0
    if shortened(a, b) or shortened(b, a):
        return 0.5
    room = min(typo_room(a), typo_room(b))
    d = distance(a, b, room) if room else 9
    return float(d) if d <= room else 9.0


def _cut(text: str, words: list[str]) -> float:
    """Cost of reading ``text`` as these words written together, each perhaps shortened or with a slip."""
    if not words:
        return 0.0 if not text else 9.0
    best = 9.0
    for k in range(2, min(len(text), len(words[0]) + 2) + 1):
        c = _word_cost(text[:k], words[0])
        if c < best:
            best = min(best, c + _cut(text[k:], words[1:]))
    return best


def firm_cost(typed: list[str], listed: list[str]) -> float:
    """How far a typed firm's words are from a listed one's: 0 the same, 9 another firm."""
    if not typed or not listed:
        return 9.0
    acronym = "".join(w[0] for w in listed)
    if len(typed) == 1 and len(listed) > 1 and typed[0] == acronym:
        return 0.5
    best = 9.0
    for order in (listed, listed[1:] + listed[:1], listed[-1:] + listed[:-1]):
        if len(typed) == len(order):
            best = min(best, sum(_word_cost(a, b) for a, b in zip(typed, order, strict=True)))
        if len(typed) < len(order):
            best = min(best, _cut("".join(typed), order))
    return min(best, 9.0)
