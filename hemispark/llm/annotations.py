"""Reading of one transcript row: marks, sounds, hesitations, labels and further turns. Plain Python, no Spark."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from hemispark.llm.characters import normalize_text

_CLOCK = r"\d{1,2}(?:[:h]|\.(?=\d\d))\d{2}(?:[:.,]\d{1,3}){0,2}"
_STAMP = re.compile(
    rf"\d{{1,2}}:\d{{2}}:\d{{2}}[.,]\d{{1,3}}\s*--?>\s*\d{{1,2}}:\d{{2}}:\d{{2}}[.,]\d{{1,3}}"  # subtitle range
    rf"|[\[(<{{@]\s*{_CLOCK}(?:\s*[ap]\.?\s?m\.?)?\s*[\])>}}]"  # clock in brackets
    rf"|[\[(<{{]\s*t\s*=\s*\d+(?:\.\d+)?\s*(?:ms|s)?\s*[\])>}}]"  # offset
    rf"|@{_CLOCK}|(?<![\d:])\d{{1,2}}:\d{{2}}:\d{{2}}(?![\d:])"  # clock with seconds, nobody speaks it
)
_VOICED = r"u+h+m*|u+m+|e+rm+|er|h+m+|h+u+m+|mm+-?h+m+|m+h+m+|a+hem|e+u+h+|h+e+u+|e+eh+|e+h|hein"
_FILLER = re.compile(rf"(?P<lead>[(–—-]\s*)?(?<![\w'’/-])(?:{_VOICED})(?![\w'’/]|-\w)(?P<tail>\s*(?:\)|–|—|\.\.\.|…|,))?", re.IGNORECASE)
#: Words that name a noise, a reaction or inaudible speech.
SOUND_WORDS = frozenset(
    "applause laughter laughs laugh laughing inaudible indistinct unclear coughs cough coughing noise crosstalk microphone mic phone ringing rings bell bells"
    " clears throat banging desks rires rire bruit applaudissements toux murmurs murmur cheers cheering music sighs sigh whispers silence pause interruptions"
    " interruption inaudibles brouhaha exclamations overlapping static beep thumping shouting boos booing sneezes gavel knocking door telephone slams slam closes chair scraping chairs footsteps gasps groans hubbub uproar background siren feedback riye taptap tapaz".split()
)
_BRACKET = re.compile(r"\(([^()\[\]]{1,60})\)|\[([^\[\]]{1,60})\]|\*([^*\n]{2,40})\*|<([^<>]{2,40})>|\{([^{}]{2,40})\}|♪\s*([^♪]{0,60}?)\s*♪|♪|(?<![\w/])/([^/\n]{3,40})/(?![\w/])")
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Mme|Mlle|Miss|Madam|M|Hon|Sir|Prof)"
_LABEL = (
    rf"(?:{_TITLE}\.?(?:\s+(?:the\s+)?(?:Hon\.?\s+)?)?[A-ZÀ-Þ][^:.!?\n“”\"]{{0,40}}(?:\.\s?[^:.!?\n“”\"]{{1,40}})?"
    r"|The\s+(?:[A-Z][\w'’-]*|of|the|and|for|Ag\.)(?:,?\s+(?:[A-Z][\w'’-]*\.?|of|the|and|for))*(?:\s*\([^()\n]{2,60}\))?"
    r"|[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+){1,2})"
)
_TURN = re.compile(rf"(?:(?<=[.!?…)\]}}>»”\"*♪])\s*|(?:^|\s)[/–—|-]\s+|\n\s*)(?:[-–—/|]\s+)?(?P<label>{_LABEL})\s*:(?!\d)\s+")
_QUOTED = re.compile(r"(?:quote|cite|citer|sit|words of|says?|said|dit|writes?|wrote|read|letter from)\s+[^.!?]{0,60}$", re.IGNORECASE)

#: Sentences of the record itself, not of a speaker.
_STAGE = re.compile(
    r"\((?:[^()]{2,90})\)"
    r"|the (?:national )?anthem was (?:played|sung)\.?"
    r"|(?:at|on resuming at) \d{1,2}[.:h]\d{2}(?: ?[ap]\.?m\.?)?,? .{0,80}(?:suspended|adjourned|resumed|in the chair)\.?"
    r"|the (?:assembly|house|committee|council) (?:met|resumed|sat) .{0,60}at \d{1,2}[.:h]\d{2}(?: ?[ap]\.?m\.?)?\.?"
    r"|(?:the )?(?:sitting|assembly|house|debate) (?:was )?(?:suspended|resumed|adjourned).{0,60}",
    re.IGNORECASE | re.DOTALL,
)
_DECOR = re.compile(
    r"^\s*(?:>>+|[-–—*•]+|#\s*\d+|CH(?:ANNEL)?\.?\s*\d+\s*:|SPEAKER\s*\d+\s*[-–:]|[\[(]?\d{1,2}[:.h]\d{2}(?:[:.]\d{2})?[\])]?)\s*"
    r"|\s*(?:[\[(]\d{1,2}[:.h]\d{2}(?:[:.]\d{2})?[\])]|\(\s*cont[^()]*\)|\(\s*(?:mic|microphone|via|by|on|remote|online|off)\b[^()]*\)|\[[^\[\]]*\]|//+|:+|\.\.\.|…)\s*$",
    re.IGNORECASE,
)
_BARE_MARK = re.compile(r"[0-9<>#\[\]{}/:|*@_=~…]|\.\.\.|^\s*[-–—]")


class Row(NamedTuple):
    text: str  # clean text of the first turn
    noises: list[str]
    labels: list[str]  # labels of further turns
    texts: list[str]  # their clean texts
    stage: bool  # reads as a mere stage direction


def strip_label(raw: str | None) -> tuple[str | None, bool]:
    """Label without anything but title, name and office, and whether there was anything else."""
    if raw is None:
        return None, False
    label, noisy = re.sub(r"\s+", " ", normalize_text(raw)).strip(), False
    while label:
        shorter = _DECOR.sub("", label).strip()
        if shorter == label:
            break
        label, noisy = shorter, True
    bare = re.sub(r"\([^()]*[A-Za-zÀ-ÿ]{2}[^()]*\)\s*$", "", label)  # the name that holds an office
    if _BARE_MARK.search(bare):
        noisy, label = True, _BARE_MARK.sub("", label).strip() or label
    return label or None, noisy


def is_stage(text: str) -> bool:
    """Whether the whole (normalised) text is a stage direction. Page headers and marks of time are none."""
    flat = re.sub(r"\s+", " ", text).strip()
    if not _STAGE.fullmatch(flat) or _STAMP.fullmatch(flat) or re.fullmatch(r"\(\d+\)", flat):
        return False
    inner = flat[1:-1] if flat.startswith("(") else ""
    return not (inner and _FILLER.fullmatch(inner))


def _is_sound(m: re.Match) -> bool:
    inner = next((g for g in m.groups() if g is not None), "")
    words = set(re.findall(r"[a-zà-ÿ]+", inner.lower()))
    if m.group().startswith(("♪", "<", "{", "*")):
        return bool(words) or m.group().startswith("♪")
    return bool(words & SOUND_WORDS) and len(words) <= 7


def _spoken_filler(m: re.Match) -> bool:
    word = re.sub(r"[^\w]", "", m.group())
    return not (len(word) > 1 and word.isupper())  # abbreviations


def scrub(text: str) -> tuple[str, list[str]]:
    """Text without marks of time, sounds and hesitations, and which of them it had."""
    noises = []
    plain = _STAMP.sub(" ", text)
    if plain != text:
        noises.append("timestamp")
    hit = False

    def sound(m: re.Match) -> str:
        nonlocal hit
        if not _is_sound(m):
            return m.group()
        hit = True
        return " "

    plain = _BRACKET.sub(sound, plain)
    if hit:
        noises.append("sound")
    hit = False

    def filler(m: re.Match) -> str:
        nonlocal hit
        if not _spoken_filler(m):
            return m.group()
        lead, tail = m.group("lead") or "", (m.group("tail") or "").strip()
        if tail == ")" and "(" not in lead:
            return m.group()
        hit = True
        return " "

    plain = _FILLER.sub(filler, plain)
    if hit:
        noises.append("filler")
    return plain, noises


def tidy(text: str) -> str:
    """White space and stranded punctuation after scrubbing; line breaks stay."""
    text = re.sub(r"\(\s*[,;]?\s*\)", " ", text)
    text = re.sub(r"[ \t]{2,}", " ", text)
    text = re.sub(r" ?([,;])(?:\s*[,;])+", r"\1", text)
    text = re.sub(r"[ \t]+(?=[,.;!?](?:\s|$))", "", text)
    return re.sub(r" *\n *", "\n", text).strip(" \t,;–—")


@lru_cache(4096)
def _flat_label(label: str) -> str:
    return re.sub(r"\s+", " ", label).strip()


def read_row(speaker: str | None, text: str | None, flag: bool | None) -> Row:
    """Everything about one row. NULL text reads as ''."""
    plain = normalize_text(text or "")
    stage = is_stage(plain)
    if bool(flag) != stage and (stage or _is_speech(plain)):
        return Row(tidy(plain), ["stage_flag"], [], [], stage)
    if flag:
        return Row(plain.strip(), [], [], [], True)
    noises = ["label"] if strip_label(speaker)[1] else []
    marked = _STAMP.sub(" ", plain)
    starts = [m for m in _TURN.finditer(marked) if marked[: m.start()].strip(" /–—-|\n") and not _QUOTED.search(marked[: m.start("label")].replace("\n", " "))]
    if starts:
        noises.append("inline")
        source = plain if marked == plain else marked
        if marked != plain:
            noises.append("timestamp")
        bounds = [*(m.start() for m in starts), len(source)]
        first, more = scrub(source[: bounds[0]])
        texts = []
        for m, end in zip(starts, bounds[1:]):
            clean, extra = scrub(source[m.end() : end])
            texts.append(tidy(clean))
            more += extra
        return Row(tidy(first), list(dict.fromkeys(noises + more)), [_flat_label(m.group("label")) for m in starts], texts, False)
    clean, more = scrub(plain)
    return Row(tidy(clean), noises + more, [], [], False)


def _is_speech(text: str) -> bool:
    """Running words of a speaker: not a header, page number or bracketed note."""
    from hemispark.llm.furniture import is_furniture

    flat = re.sub(r"\s+", " ", text).strip()
    return bool(re.search(r"[^\W\d_]{2}", flat)) and not is_furniture(flat) and not re.fullmatch(r"[(\[<{*♪].*[)\]>}*♪]", flat)
