"""What a question over a table asks for, whatever its wording: its slots, filled from the labels of the table it is asked of.

A question is read as tokens. The labels of its table (columns and rows) are found in it; a number with a comparison
before or after it is a condition on the label beside it; the other labels are what is asked for, in the direction that a
superlative or comparative names. Nothing else of the wording counts: neither its order nor its verbs, its nouns for rows,
remarks, notes on totals, or slips of the pen. No sentence form is known to this module.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

#: English words of size. Superlatives give a direction, comparatives a direction or a comparison.
UP = "more greater higher larger bigger over above exceed exceeds exceeding exceeded beyond surpass surpasses surpassing upwards".split()
DOWN = "less lower smaller fewer under below beneath".split()
TOP = "highest greatest largest biggest maximum max maximal most top peak best maximise maximises maximising maximize maximizes maximizing".split()
BOTTOM = "lowest smallest least minimum min minimal fewest bottom worst minimise minimises minimising minimize minimizes minimizing".split()
NOT = "no not never nor without cannot doesn't don't isn't aren't".split()
EQUAL = "exactly equal equals equalling".split()
#: Words that no measure consists of, should a question name a measure that its table doesn't have.
PLAIN = (
    "a an the of in on at to by for with from as is are was were be been has have had having do does did and or but if when where which what who whose that this these those it its their there "
    "than well both each every all any only one ones among amongst between against other others another same such so while provided keep keeping keeps take takes show shows shown showing report reports reported "
    "name list find give tell state identify determine see please answer question reach reaches attain attains get gets come comes beat beaten better undominated dominated dominates optimal pareto weigh weighing compare compared "
    "line lines item items row rows entry entries position positions record records period periods year years quarter quarters month months date dates column columns table tables "
    "value values amount amounts figure figures count counted counting total totals subtotal subtotals leave leaves out exclude excluding excluded ignore ignoring ignored omit omitting skip disregard"
).split()
_SYMBOL = {"<": "lt", "<=": "lte", "=<": "lte", "≤": "lte", ">": "gt", ">=": "gte", "=>": "gte", "≥": "gte", "=": "eq"}

_LEXICON = {*UP, *DOWN, *TOP, *BOTTOM, *NOT, *EQUAL, *PLAIN}
_UP, _DOWN, _TOP, _BOTTOM, _NOT, _EQUAL, _PLAIN = map(frozenset, (UP, DOWN, TOP, BOTTOM, NOT, EQUAL, PLAIN))
_TOKEN = re.compile(r"(?<!\w)[-(−]\s?[$€£¥]?\s?[-(]?\d[\d,]*(?:\.\d+)?|\d[\d,.]*\d|\.?\d|[^\W\d_]+(?:['’][^\W\d_]+)?|[<>=]=?|[≤≥]")
_HIDDEN = re.compile("[​‌‍﻿­]")
#: A bracketed number beside a word is a footnote mark.
_REMARK = re.compile(r"(?<=[\w.]) ?[(\[]\d{1,2}[)\]](?=\W|$)")
_TOTALS = re.compile(
    r"(?:exclud\w*|ignor\w*|omit\w*|disregard\w*|skip\w*|without|leav\w* out|not count\w*)[^.?!;]{0,40}?\b(?:sub)?totals?\b(?: (?:rows?|lines?|items?))?"
)


def slips(word: str) -> set[str]:
    """The forms that ``word`` takes by one letter left out, doubled or swapped with the next."""
    n = len(word)
    return {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + word[i] + word[i:] for i in range(n)} | {
        word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(n - 1)
    }


_MENDED: dict[str, str] = {}
for _w in sorted(_LEXICON, key=lambda w: (len(w), w)):
    for _s in slips(_w) if len(_w) > 3 else ():
        if len(_s) > 2 and _s not in _LEXICON:
            _MENDED.setdefault(_s, _w)


def plain(text: str | None) -> str:
    """A text in lower case without invisible characters and footnote marks, with single blanks."""
    return _REMARK.sub("", re.sub(r"\s+", " ", _HIDDEN.sub("", text or "")).lower())


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(plain(text))


@lru_cache(maxsize=200_000)
def label_tokens(label: str | None) -> tuple[str, ...]:
    """A label as tokens, without what stands in brackets where something stands beside them."""
    t = plain(label)
    return tuple(_TOKEN.findall(re.sub(r"[(\[][^()\[\]]*[)\]]", " ", t))) or tuple(_TOKEN.findall(t))


@lru_cache(maxsize=200_000)
def quantity(token: str) -> float | None:
    """The number that a token writes, in one style; None if it writes none."""
    t = token.replace("−", "-")
    try:
        v = float(re.sub(r"[^\d.]", "", t))
    except ValueError:
        return None
    return round(-v if "-" in t or "(" in t else v, 4) + 0.0


def _alike(a: str, b: str) -> bool:
    return a == b or (abs(len(a) - len(b)) < 2 and len(b) > 2 and not b[0].isdigit() and (a in slips(b) or b in slips(a)))


def find_labels(words: list[str], labels: Iterable[tuple[str, ...]]) -> list[tuple[int, int, str]]:
    """``begin``, ``end`` and text of the labels in ``words``, the longest first, none within another.

    Words that are neither part of a label nor of the lexicon may be a label with a slip of the pen in it.
    """
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for label in {*labels}:
        if label:
            by_first.setdefault(label[0], []).append(label)
    found, i, n = [], 0, len(words)
    while i < n:
        fit = max((t for t in by_first.get(words[i], ()) if tuple(words[i : i + len(t)]) == t), key=len, default=None)
        if fit:
            found.append((i, i + len(fit), " ".join(fit)))
        i += len(fit) if fit else 1
    used = [False] * n
    for b, e, _ in found:
        used[b:e] = [True] * (e - b)
    odd = [
        i for i in range(n) if not used[i] and words[i][0].isalpha() and len(words[i]) > 2 and words[i] not in _LEXICON and words[i] not in _MENDED
    ]
    if odd:
        known = [t for ts in by_first.values() for t in ts]
        for i in odd:
            for t in sorted(known, key=lambda t: (-len(t), t)):
                b = next(
                    (
                        b for b in range(
                            max(0, i - len(t) + 1),
                            min(i, n - len(t)) + 1
                        ) if not any(used[b : b + len(t)]) and all(map(_alike, words[b : b + len(t)], t))
                    ),
                    None
                )
                if b is not None:
                    found.append((b, b + len(t), " ".join(t)))
                    used[b : b + len(t)] = [True] * len(t)
                    break
        found.sort()
    return found


def _comparison(before: list[str], after: list[str]) -> str | None:
    """The comparison that the words before and after a number name."""
    for w in reversed(before):
        if w in _SYMBOL:
            return _SYMBOL[w]
    words, negative = {*before}, not _NOT.isdisjoint(before)
    if after[:1] == ["or"] and len(after) > 1:
        if after[1] in _UP:
            return "gte"
        if after[1] in _DOWN:
            return "lte"
    if ("at" in words and "least" in words) or "minimum" in words:
        return "gte"
    if ("at" in words and "most" in words) or "maximum" in words or (before[-2:] == ["up", "to"]):
        return "lte"
    size = next((w for w in reversed(before) if w in _UP or w in _DOWN), None)
    if size is None:
        return "eq" if not _EQUAL.isdisjoint(words) else None
    if "equal" in words and "or" in words:
        return "gte" if size in _UP else "lte"
    return ("lte" if negative else "gt") if size in _UP else ("gte" if negative else "lt")


def signature(question: str | None, labels: Callable[[], Iterable[str | None]] = tuple) -> str:
    """What a question asks for, in one form for all wordings: its conditions, and its measures with their directions.

    A question in which no measure, condition or direction is found is its own words.
    """
    q = _TOTALS.sub(" ", plain(question))
    words = _TOKEN.findall(q)
    if not words:
        return "words|"
    spans = find_labels(words, map(label_tokens, labels()))
    at = {}
    for b, e, name in spans:
        at.update(dict.fromkeys(range(b, e), (b, e, name)))
    mended = [w if i in at else _MENDED.get(w, w) for i, w in enumerate(words)]
    if "total" in mended and any(name in ("total", "totals", "subtotal") for _, _, name in spans):  # a note whose words had slips
        q = _TOTALS.sub(" ", " ".join(mended))
        if q != " ".join(mended):
            return signature(q, labels)
    conditions, bound, taken = set(), set(), set()
    for i, w in enumerate(mended):
        if i in at or not any(c.isdigit() for c in w) or (value := quantity(w)) is None:
            continue
        k = i
        while k > 0 and k - 1 not in at and i - k < 8 and not mended[k - 1][-1].isdigit():
            k -= 1
        op = _comparison(mended[k:i], mended[i + 1 : i + 3])
        if op is None:
            continue
        ahead = at.get(i + 2) if i + 1 < len(mended) and mended[i + 1] in ("in", "of", "for", "on") else None
        own = ahead or next((at[j] for j in range(i - 1, -1, -1) if j in at), None) or next(
            (at[j] for j in range(i + 1, len(mended)) if j in at),
            None
        )
        first = own[1] if own and own[1] <= i else k
        sizes = [j for j in range(max(k, first), i) if mended[j] in _UP or mended[j] in _DOWN or mended[j] in _TOP or mended[j] in _BOTTOM]
        taken.update(sizes[-1:] if len(sizes) > 1 and mended[sizes[0]] in _TOP | _BOTTOM and mended[sizes[-1]] in _UP | _DOWN else sizes)
        if mended[i + 1 : i + 2] == ["or"]:
            taken.add(i + 2)
        if own is None:  # its table has no such label: the words before the comparison
            j = i - 1
            while j >= 0 and (mended[j] in _LEXICON or mended[j] in _SYMBOL):
                j -= 1
            e = j + 1
            while j >= 0 and mended[j] not in _LEXICON:
                j -= 1
            own = (j + 1, e, " ".join(mended[j + 1 : e]))
        bound.add(own[:2])
        conditions.add(f"{own[2]} {op} {value!r}")
    targets = list(dict.fromkeys(name for b, e, name in spans if (b, e) not in bound))
    sizes = [(i, w) for i, w in enumerate(mended) if i not in at and i not in taken]
    way = ["higher" if w in _TOP else "lower" for _, w in sizes if w in _TOP or w in _BOTTOM]
    way = way or ["higher" if w in _UP else "lower" for _, w in sizes if w in _UP or w in _DOWN]
    if not targets and way:  # a measure that its table doesn't have: the words that are none of the language's
        free = [
            w for i, w in enumerate(mended) if w not in _LEXICON and w not in _SYMBOL and not any(b <= i < e for b, e in bound) and not (w[-1].isdigit() and conditions)
        ]
        targets = [" ".join(free)] if free else []
    if not targets and not conditions:
        return "words|" + " ".join(mended)
    if len(targets) == len(way):
        asked = sorted(f"{t} {d}" for t, d in zip(targets, way))
    else:
        asked = sorted(f"{t} {way[0] if way else ''}" for t in targets)
    return "|".join(["if", *sorted(conditions), "ask", *asked])
