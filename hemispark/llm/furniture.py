"""Print and recognition damage of scanned pages. Plain Python and numpy, no Spark.

Lines, and stretches inside lines that may be page furniture or end in a cut word, are labelled by a linear conditional
chain: a weighted sum of layout features gives each of the labels body, break (the piece ends in a cut word) and header
its score, a matrix the transitions, and the Viterbi path the labels. The weights are fitted to the pages themselves, by
rounds of labelling and refitting that start from a prior (:func:`fit_chain`). Text is put together by the labels: headers
go, a piece labelled break is joined with the next one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from typing import NamedTuple

import numpy as np

BODY, BREAK, HEADER = 0, 1, 2
_MONTH = r"(?i:january|february|march|april|may|june|july|august|september|october|november|december|janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[ée]cembre)"
_DATE = rf"\d{{1,2}} +{_MONTH} +\d{{4}}"
#: Stretches that may be furniture, on a line of their own or inside one: a page number next to a rule, a title or a date.
_CANDIDATE = re.compile(
    r"\[ *(?i:page) +\d{1,4} *\]"
    r"|[-–—] *\d{1,4} *[-–—](?: +[A-Z][\w.]*(?: [A-Z][\w.]*){0,4}(?: *\([^()\n]{2,40}\))?)?"
    r"|\d{1,4} *\| *[A-Z][\w.]*(?: +(?:[A-Z][\w.]*|of|no|n°|\d{1,4})){1,7}"
    r"|[pP](?:age|\.) *\d{1,4} */ *[A-Z]\w+(?: [A-Z]\w+)?"
    rf"|\d{{1,4}} +[A-Z]\w+(?: +[A-Z]\w+){{1,4}} +{_DATE}"
    rf"|[A-Z]\w+ +(?:(?:[A-Z]\w+|to|of|and|the) +){{0,5}}(?:[-–—] +)?{_DATE}(?: +[-–—]| +Col\.?)? +\d{{1,4}}"
    r"|[A-Z][a-z]+ +\d{1,4} +\d{1,2}\.\d{1,2}\.\d{2,4} +(?:UN)?REVISED"
    r"|(?:[A-Z]{4,} +){2,5}\d{1,4}(?![\d%.,]\d)"
    r"|(?<![Pp]aragraph )(?<![Pp]aragraphe )\(\d{1,4}\)"
)
_PAGE_NUMBER = re.compile(r"\(?[-–— ]*\d{1,4}[-–— ]*\)?")
#: Places at which a line is cut further, as a cut word may end there although the line break became a space.
_CUT_INSIDE = re.compile(r"(?<=[^\W\d_]-)[ \t]+(?=[^\W\d_])")
_CUT = re.compile(r"[^\W\d_]+-$")
_DIGIT = re.compile(r"\d")
_WORDS = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?:;,…][”\"'»)\]]*$")
#: Titles that run along page heads.
_TITLE_WORDS = frozenset("page debate debates motion motions bills bill public oral written answers questions question official report assembly national parliament house committee hansard revised unrevised col column session sitting order paper".split())
_SMALL_TITLE_WORDS = _TITLE_WORDS | frozenset("of to and the p page no col".split())
#: Words after a hyphen that was meant: a shared second part follows.
_SUSPENDED = frozenset("and or et ou ek ousa to und y e nor as but".split())
FEATURES = (
    "bias", "furniture pattern", "line of its own", "number alone", "capitals beside a number", "title beside a number", "words in lower case that titles lack",
    "cut word that goes on", "hyphen that was meant", "ends a sentence", "title without a number", "line that other pages of the debate have", "outermost of several",
)
#: Prior of the weights: rows are FEATURES, columns body, break, header.
PRIOR = np.array(
    [
        [1.2, 0.4, -1.0], [-2.0, -2.0, 2.6], [-0.6, -0.6, 1.4], [-1.0, -1.0, 1.2], [-0.4, -0.6, 0.8], [-0.5, -0.5, 1.5], [1.2, 0.6, -1.8],
        [-1.5, 4.0, -3.0], [1.0, -2.0, -1.0], [1.0, 0.5, -1.5], [-0.9, -0.9, 1.2], [-1.0, -1.0, 1.2], [0.0, 0.0, 0.0],
    ]
)
PRIOR_STEPS = np.array([[0.3, 0.0, 0.0], [0.3, 0.0, 0.0], [0.3, 0.0, -0.7]])


class Chain(NamedTuple):
    """Weights of the features, and of one label after another."""

    weights: np.ndarray
    steps: np.ndarray


DEFAULT = Chain(PRIOR, PRIOR_STEPS)
#: Rounds of labelling and refitting, steps of a refit, and what holds the weights to their prior.
ROUNDS, STEPS, HOLD = 3, 60, 0.02


def _matches(piece: str) -> bool:
    return bool(_CANDIDATE.fullmatch(piece))


def line_shape(line: str) -> str:
    """A line without its numbers, by which running headers are known again."""
    return " ".join(_DIGIT.sub("0", re.sub(r"\d+", "0", line)).split())


def _split(text: str) -> list[tuple[int, int, bool, bool]]:
    """(start, end, alone on its line, matches a furniture pattern) of lines, cut further at possible furniture and cut words."""
    out, at = [], 0
    for line in text.split("\n"):
        cuts = []
        if _DIGIT.search(line):  # all patterns have a number
            for m in _CANDIDATE.finditer(line):
                a, b = m.span()
                if _matches(m.group()) and (a == 0 or not line[a - 1].isalnum()) and (b == len(line) or not line[b].isalnum()):
                    cuts.append((a, b, True))
        if "- " in line or "-\t" in line:
            cuts += [(m.end(), m.end(), False) for m in _CUT_INSIDE.finditer(line) if not any(a < m.end() < b for a, b, _ in cuts)]
            cuts.sort()
        last = 0
        for a, b, furniture in cuts:
            if line[last:a].strip():
                out.append((at + last, at + a, False, False))
            if furniture:
                out.append((at + a, at + b, not line[:a].strip() and not line[b:].strip(), True))
            last = b
        if line[last:].strip():
            out.append((at + last, at + len(line), last == 0, False))
        at += len(line) + 1
    return out


def pieces(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, alone on its line) of what the chain labels."""
    return [x[:3] for x in _split(text)]


def _goes_on(left: str, right: str) -> bool:
    """Whether a word cut after ``left`` may go on with ``right``."""
    return bool(right) and (right[0].islower() or left.isupper() and right.isupper())


def features(text: str, split: list[tuple[int, int, bool, bool]], repeated: Collection[str] = ()) -> list[list[float]]:
    """A row of FEATURES for each piece. ``repeated``: shapes of lines that other pages have too."""
    rows = []
    for i, (a, b, own, matches) in enumerate(split):
        piece = text[a:b].strip()
        words = _WORDS.findall(piece)
        small = any(w.islower() and w not in _SMALL_TITLE_WORDS for w in words)
        digits = bool(_DIGIT.search(piece))
        ends = bool(words) and bool(_END.search(piece))
        titled = len(words) <= 8 and not small and not _TITLE_WORDS.isdisjoint(map(str.lower, words))
        goes_on = meant = 0.0
        if piece[-1:] == "-" and (m := _CUT.search(piece)):
            after = next((text[c:d] for c, d, _, furniture in split[i + 1 :] if not furniture), "")
            right = w[1] if (w := re.match(r"\s*([^\W\d_]+)", after)) else ""
            if right.lower() in _SUSPENDED:
                meant = 1.0
            elif _goes_on(m.group()[:-1], right):
                goes_on = 1.0
        title = titled and not digits and not ends and words[0][0].isupper() and (piece.isupper() or sum(w[0].isupper() and w.lower() in _TITLE_WORDS for w in words) > 1)
        again = bool(repeated) and own and not small and line_shape(piece) in repeated
        rows.append(
            [
                1.0, float(matches), float(own), float(digits and bool(_PAGE_NUMBER.fullmatch(piece))), sum(w[0].isupper() for w in words) / len(words) if words and digits else 0.0,
                float(digits and titled), float(small), goes_on, meant, float(ends), float(own and title), float(again), float(len(split) > 1 and i in (0, len(split) - 1)),
            ]
        )
    return rows


def best_path(scores: np.ndarray, steps: np.ndarray) -> list[int]:
    """Labels of the best path; ties to the smaller label."""
    best, back = scores[0], np.zeros(scores.shape, dtype=int)
    for i in range(1, len(scores)):
        paths = best[:, None] + steps
        back[i] = paths.argmax(0)
        best = paths.max(0) + scores[i]
    label, labels = int(best.argmax()), []
    for i in range(len(scores) - 1, -1, -1):
        labels.append(label)
        label = int(back[i][label])
    return labels[::-1]


def label_pieces(text: str, chain: Chain = DEFAULT, repeated: Collection[str] = ()) -> list[tuple[int, int, int]]:
    """(start, end, label) of each piece by the best path through the chain."""
    split = _split(text)
    if not split:
        return []
    scores = np.array(features(text, split, repeated)) @ chain.weights
    labels = best_path(scores, chain.steps) if len(split) > 1 else [int(scores[0].argmax())]
    return [(a, b, k) for (a, b, _, _), k in zip(split, labels)]


def fit_chain(texts: Iterable[tuple[str, Collection[str]]], rounds: int = ROUNDS) -> Chain:
    """The chain fitted to texts and their repeated lines, without labels: the best paths under the present weights are the labels to
    which the weights are refitted (conditional likelihood, held to the prior), round by round. No texts: the prior."""
    grids = [np.array(features(t, s, r)) for t, r in texts if (s := _split(t))]
    if not grids:
        return DEFAULT
    x, weights, steps = np.concatenate(grids), PRIOR, PRIOR_STEPS
    for _ in range(rounds):
        paths = [best_path(g @ weights, steps) for g in grids]
        y = np.eye(3)[[k for p in paths for k in p]]
        weights = PRIOR.copy()
        for _ in range(STEPS):
            scores = x @ weights
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weights -= 0.5 * (x.T @ (p - y) / len(x) + HOLD * (weights - PRIOR))
        moves = np.zeros((3, 3))
        for p in paths:
            np.add.at(moves, (p[:-1], p[1:]), 1)
        # how much more often one label follows another than by chance, held to the prior by counts of its own
        share = y.mean(0) + 1e-3
        held = 50 * share[:, None] * share * np.exp(PRIOR_STEPS)
        steps = np.log((moves + held) / ((moves + held).sum(1, keepdims=True) * share))
        steps = np.clip(steps, -1.0, 1.0)
    return Chain(weights, steps)


def is_furniture(flat: str) -> bool:
    """Whether the whole text is page furniture."""
    labels = label_pieces(flat)
    return bool(labels) and all(k == HEADER for _, _, k in labels)


def join_lines(text: str, chain: Chain = DEFAULT, repeated: Collection[str] = ()) -> tuple[str, bool, bool]:
    """Continuous text put together by the labels of the pieces; whether furniture and whether cut words were found."""
    labels = label_pieces(text, chain, repeated)
    if len(labels) < 2 and not any(k == HEADER for _, _, k in labels):
        return text.strip(), False, False
    out, header, hyphen, last, cut = "", False, False, 0, False
    for a, b, k in labels:
        if k == HEADER:
            header = True
            continue
        piece, gap = text[a:b].strip(), text[last:a]
        if not out:
            out = piece
        elif cut and (m := re.match(r"[^\W\d_]", piece)):
            out, hyphen = out[:-1] + piece, True
        else:
            out += ("\n\n" if re.search(r"\n\s*\n", gap) else " ") + piece
        last, cut = b, k == BREAK and piece.endswith("-")
    return out, header, hyphen


#: What recognition makes of letters: seen form, and the letters it may stand for.
CONFUSIONS = {
    "0": "o", "1": "li", "5": "s", "9": "g", "6": "b", "8": "b", "3": "e", "4": "a", "7": "t", "@": "a", "!": "il", "(": "c", "$": "s", "|": "li", "]": "l", "[": "l", "€": "e",
    "c": "e", "b": "h", "f": "t",
}
PAIRS = {"rn": "m", "cl": "d", "ii": "u", "vv": "w", "ri": "n", "li": "h"}
_SIGNS = frozenset("0156983477@!($|][€")
_SIGNED = re.compile(r"[\d_@!($|\[\]€]")
_TOKEN = re.compile(r"[\w@!($|\[\]€’'-]*[^\W\d_][\w@!($|\[\]€’'-]*")
#: A word is at least so many times as frequent as a damaged form of it that has letters only: in the given tables one form
#: makes up to 13 % of a word (`eleveri`), while other words that confusions join lie closer together. A form with signs or
#: digits is no word, so its word need only be as frequent. Ratios of exact counts hold at every size.
RATIO, SIGNED_RATIO = 6, 1
#: Longer tokens are no words.
LONGEST = 40
_CODE = re.compile(r"\d+(?:st|nd|rd|th|e|er|ème|h|m|km|am|pm|s)|[a-z]{1,2}\d+|\d+[a-z]")


def reversals(token: str, depth: int) -> Iterator[set[str]]:
    """What ``token`` (lower case) may have been before recognition: the forms by one reversed confusion more each time."""
    marks = sum(c in _SIGNS for c in token)
    frontier, seen = {token}, {token}
    for _ in range(depth):
        reached = set()
        for word in frontier:
            for i, c in enumerate(word):
                for to in CONFUSIONS.get(c, ""):
                    reached.add(word[:i] + to + word[i + 1 :])
                if (to := PAIRS.get(word[i : i + 2])) is not None:
                    reached.add(word[:i] + to + word[i + 2 :])
        reached -= seen
        yield reached
        frontier = {w for w in reached if not marks or sum(c in _SIGNS for c in w) < marks}
        seen |= reached


def search_depth(low: str) -> int:
    """How many confusions are undone in a token: most in one with signs or digits, none in numbers, codes and short words."""
    letters = sum(c.isalpha() for c in low)
    if any(c in _SIGNS for c in low):
        if letters < 2 and len(low) > 2 or letters < 1 or len(low) > LONGEST or _CODE.fullmatch(low):
            return 0
        return 4
    return 2 if 4 <= len(low) <= LONGEST else 0


def damage_search(token: str, lexicon: dict[str, int], depth: int = 4) -> str | None:
    """A frequent word that recognition may have turned into ``token`` (lower case), else None.

    Fewer confusions are better, unless the word they give is so rare that it is itself a damaged form of a further one;
    then more frequent words, then the later in the alphabet. A token that was never counted counts as seen once.
    """
    need, found = (RATIO if token.isalpha() else SIGNED_RATIO) * max(1, lexicon.get(token, 0)), None
    for reached in reversals(token, depth):
        hits = [w for w in reached if len(w) > 1 and w.isalpha() and lexicon.get(w, 0) >= need]
        if hits:
            found = max(hits, key=lambda w: (lexicon[w], w))
            need = RATIO * lexicon[found]
    return found


class GlyphReader:
    """Finds and repairs words with misrecognised characters; ``lexicon`` holds words of the corpus and their counts."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self._known: dict[str, str | None] = {}

    def _repair(self, token: str) -> str | None:
        low = token.lower()
        if low in self._known:
            return self._known[low]
        if len(self._known) > 200_000:
            self._known.clear()
        self._known[low] = found = self._look(low)
        return found

    def _look(self, low: str) -> str | None:
        depth = search_depth(low)
        return damage_search(low, self.lexicon, depth) if depth else None

    def _untouched(self, words: list[str]) -> bool:
        """Whether none of the words (lower case, letters only) is damaged."""
        return all(self._repair(w) is None for w in words)

    def scan(self, text: str) -> tuple[str, bool]:
        """Repaired text and whether a damaged word was found."""
        hit = False
        # where only letters are looked up, none of which is damaged, nothing is to mend
        if not _SIGNED.search(text) and self._untouched(_WORDS.findall(text.lower())):
            return text, False

        def mend(m: re.Match) -> str:
            nonlocal hit
            token = m.group()
            if token.isalpha():
                if (word := self._repair(token)) is None:
                    return token
                hit = True
                return _case_like(token, word)
            core = token.strip("'’-[]|")
            while core.endswith(("!", ")")):
                core = core[:-1]
            if core.startswith("(") and (")" in text[m.end() : m.end() + 60].split("\n")[0] or ")" in token):
                core = core[1:]
            if not core:
                return token
            parts = re.split(r"([’'-])", core)
            out = [self._repair(p) or p if p not in "’'-" and p else p for p in parts]
            if out == parts:
                if len(parts) > 1 and not core.isalpha() and (whole := self._repair(core)):
                    out = [whole]
                else:
                    return token
            hit = True
            fixed = "".join(o if o == p else _case_like(p, o) for p, o in zip(parts, out)) if len(out) == len(parts) else out[0]
            return token.replace(core, fixed, 1)

        return _TOKEN.sub(mend, text), hit


class CountReader(GlyphReader):
    """Counts every token that would be looked up."""

    def __init__(self):
        super().__init__({})
        self.counts: Counter[str] = Counter()

    def _repair(self, token: str) -> str | None:
        self.counts[token.lower()] += 1
        return None

    def _untouched(self, words: list[str]) -> bool:
        self.counts.update(words)
        return True


class MappedReader(GlyphReader):
    """Repairs by a table of corrections."""

    def __init__(self, corrections: dict[str, str]):
        super().__init__({})
        self.corrections = corrections

    def _repair(self, token: str) -> str | None:
        return self.corrections.get(token.lower())

    def _untouched(self, words: list[str]) -> bool:
        return self.corrections.keys().isdisjoint(words)


def _case_like(seen: str, word: str) -> str:
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word.capitalize() if seen[:1].isupper() else word
