"""Spans of a batch of texts that may be personal information, and the features that tell.

The generators aim at recall: whatever has the shape of a mention, or stands where one would, is proposed, spans overlap, and
none is left out for being unlike known names or numbers. Names of scripts with capitals are proposed by shape and context,
names of kanji and kana by theirs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import regex

from stratalog.llm.pii_text import DIGIT, EAST, FAR, KINDS_OF_CUES, LETTER, SEPARATOR, Batch, Lexicon

KINDS = ("email", "phone", "id_number", "address", "name")
#: What is scored by trees of its own; names in kanji and kana are judged apart from the others.
MODELS = (*KINDS, "east")

_L = r"A-Za-zªµºÀ-ʯ̀-ͯͰ-ԯḀ-ỿ"
_AT = r"(?:@| @ |\s?\((?i:at)\)\s?|\s?\[(?i:at)\]\s?|\s?\{(?i:at)\}\s?)"
_DOT = r"(?:\.| \. |\s?\((?i:dot)\)\s?|\s?\[(?i:dot)\]\s?|\s?\{(?i:dot)\}\s?)"
#: Letters of an e-mail address; kana and kanji stand beside it.
_M = r"A-Za-z0-9À-ɏͰ-ԯ"
_LABEL = rf"[{_M}](?:[{_M}-]*[{_M}])?"
_LOCAL = rf"[{_M}_%+][{_M}̀-ͯ_%+'-]*+"
_EMAILS = [
    regex.compile(rf"{_LOCAL}(?:{_DOT}{_LOCAL})*+{_AT}{_LABEL}(?:{_DOT}{_LABEL})+"),
    regex.compile(rf"(?i){_LOCAL}(?:(?:\.| dot ){_LOCAL})*+ at {_LABEL}(?: dot {_LABEL})+"),
]
_SPELLED = regex.compile(r" at \S+ dot ")
#: Characters before and after the sign within which an address is looked for; standards allow no longer ones.
_REACH = 330

#: No letter or digit of a script that sets words apart.
_W = r"[A-Za-z0-9_À-ɏ]"
_GROUP = r"(?:\(\d{1,5}\)|\d++)"
_DIGITS = regex.compile(rf"(?<![A-Za-z0-9_À-ɏ#.,/-])\+?{_GROUP}(?:(?:[ ./-]|(?<=\))|(?=\()|\) | ?[/-] ?){_GROUP})*+(?:,? ?(?i:ext\.?|x|extension|poste|dw\.?) ?\d{{1,6}})?")
#: Shapes of numbers that mix letters and digits, as authorities of several countries issue them.
_MIXED = [
    regex.compile(rf"(?i)(?<!{_W}|[#-])[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-Z](?!{_W})"),
    regex.compile(rf"(?i)(?<!{_W}|[#-])[A-Z]{{1,3}}[ -]?\d{{5,12}}(?:[ -]?[A-Z])?(?!{_W})"),
    regex.compile(rf"(?i)(?<!{_W}|[#-])(?:\d{{1,3}}[. ]?\d{{3}}[. ]?\d{{3}}|[XYZ][- ]?\d{{7}}|\d{{5,12}})[- ]?[A-Z](?!{_W})"),
    regex.compile(rf"(?i)(?<!{_W}|[#-])(?=[A-Z0-9]*[A-Z])(?=(?:[A-Z]*\d){{3}})[A-Z0-9]{{5,20}}(?: (?=[A-Z]*\d)[A-Z0-9]{{1,6}}){{0,2}}(?!{_W})"),
    regex.compile(rf"(?i)(?<!{_W}|[#-])(?=[A-Z]{{0,3}}\d|\d+ )(?:\d+|[A-Z0-9]{{1,4}})(?:[ -](?=[A-Z]{{0,2}}\d|[A-Z]{{1,2}}(?!{_W}))[A-Z0-9]{{1,7}}){{1,4}}(?!{_W})"),
    regex.compile(rf"(?i)(?<!{_W}|[#-])[A-Z]{{6}}\d\d[A-Z]\d\d[A-Z]\d{{3}}[A-Z](?!{_W})"),
]
_HAS_LETTER = regex.compile(r"(?i)(?<![A-Z])[A-Z]{1,3}[ -]?\d|\d[ -]?[A-Z](?![A-Z])|(?<![A-Z])[A-Z]{6}\d")
_KANJI_DIGITS = regex.compile(r"[〇零一二三四五六七八九]{5,}")
#: Least digits of a number; there is no greatest.
_LEAST = 5

_NW = rf"[{_L}][{_L}'’-]*"
_HOUSE = rf"\d{{1,6}}(?:[-/]\d{{1,6}})?(?: ?[a-zA-Z](?!{_W}))?"
_FLAT = r"(?:(?:flat|apt\.?|apartment|unit|suite|room) \w{1,6},? )?"
_AFTER_WORDS = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|row|avenue|ave\.?|drive|dr\.?|close|court|ct\.?|way|terrace|square|sq\.?|place|pl\.?|boulevard|blvd\.?|crescent|mews|hill|gardens|parade|grove|walk|path|park|circle|quay|green|highway|hwy\.?|alley|trail|view|rise|loop|wharf|embankment)"
_BEFORE_WORDS = r"(?:rue|avenue|av\.|ave\.|boulevard|bd\.?|chemin|place|quai|impasse|allée|cours|route|square|passage|sentier|faubourg|esplanade)"
_SOUTH_WORDS = r"(?:calle|c/|avda\.?|avenida|av\.|plaza|pza\.?|paseo|pº|camino|ronda|travesía|carretera|pasaje|glorieta|carrer|rua|praça|via|viale|piazza|corso|largo|vicolo)"
_GERMAN_ENDS = r"(?:straße|strasse|str\.|str|weg|gasse|platz|allee|ring|damm|ufer|chaussee|steig|stieg|graben|markt|straat|laan|plein|gatan|vägen)"
_ADDRESSES = [
    regex.compile(rf"(?i)(?<!{_W}|[.,/€$£-]){_FLAT}{_HOUSE},? (?:{_NW} ){{1,4}}?{_AFTER_WORDS}(?!{_W}|')"),
    regex.compile(rf"(?i)(?<!{_W}|[.,/-])\d{{1,6}}(?: ?(?:bis|ter|quater|[a-f])(?!{_W}))?,? {_BEFORE_WORDS}(?: (?:de la|de l['’]|des|du|de|aux?|à la))? ?{_NW}(?:[ -](?:de |du |des |la )?\p{{Lu}}{_NW})*"),
    regex.compile(rf"(?i)(?<!{_W}|/){_SOUTH_WORDS}(?: (?:de la|de los|de las|del|de|della|delle|dei|da|do))? ?(?:{_NW})(?: {_NW}){{0,4}}?,? ?(?:n\.?º ?|núm\. ?|nº ?)?{_HOUSE}(?!{_W})"),
    regex.compile(rf"(?i)(?<!{_W})(?:(?:am|an der|im|zum|zur|auf dem|auf der|unter den) )?(?:(?:alte|neue|große|kleine|obere|untere|lange|kurze|hohe|breite)[nr]? )?(?:[{_L}'-]+{_GERMAN_ENDS}|(?:{_NW} ){{1,2}}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer))\.?,? {_HOUSE}(?!{_W})"),
    regex.compile(r"(?:東京都|北海道|大阪府|京都府|[一-龥]{2,3}県)?(?:[一-龥ヶ]{1,6}[市区町村郡])+[一-龥ァ-ヶーのノ]{0,10}[0-9一二三四五六七八九十]+(?:丁目|番地?|号|の|[0-9-])*"),
]
_PREPOSED = regex.compile(rf"(?i)(?:am|im|zum|zur|(?:an|auf) der|unter den) {_NW} {_HOUSE}(?!{_W})")
_ENGLISH_HEAD = regex.compile(r"(?:(?:flat|apt\.?|apartment|unit|suite|room) \w+,? |(?<!\w)(?:am|an der|im|zum|zur|auf dem|unter den) |\d[ -])$")
_UNITS = regex.compile(r"\s?(?:cm|mm|km|m\b|kg|g\b|ml|l\b|eur\b|euros?\b|€|\$|£|%|x ?\d|°|v\b|w\b|days?|weeks?|months?|years?|hours?|minutes?|times?|stars?|tage|wochen|monate|jahre|stunden|minuten|mal|sterne|jours?|semaines?|mois|ans|heures?|fois|étoiles|días?|semanas?|meses|años|horas?|veces|estrellas|日|回|円|個|年|月)")
_MONEY = regex.compile(r"[€$£¥]\s?$|\b(?:eur|usd|gbp)\s?$")
_DATE = regex.compile(r"(?:\d{4}[-./ ]\d{1,2}[-./ ]\d{1,2}|\d{1,2}[-./ ]\d{1,2}[-./ ](?:\d{4}|\d{2}))$")
_GROUPS, _LETTERS = regex.compile(r"\d+"), regex.compile(r"[A-Za-z]+")

#: Frequent Japanese family names, a feature of names in kanji, not a condition.
FAMILY_KANJI = frozenset("佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 斎藤 清水 山崎 森 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 斉藤 福田 太田 西村 藤井 金子 岡本 藤原 三浦 中野 原田 松田 竹内 上田 中川 小野 和田 石田 森田 原".split())
_KANJI = "一-龥々ヶ"
_EAST_NAMES = [
    regex.compile(rf"(?<![{_KANJI}])[{_KANJI}]{{1,4}}[ ・](?:[{_KANJI}]{{1,3}}(?![{_KANJI}])|[ぁ-ん]{{2,4}}(?=さん|様|氏|$|[\n。、,{SEPARATOR}])|[ァ-ヶー]{{2,6}})"),
    regex.compile(rf"[{_KANJI}]{{2,}}[ぁ-んァ-ヶー]{{0,4}}(?=さん|様|さま|氏|くん|君|ちゃん|先生|殿|と申|という|です|と名乗|[（(<])"),
    regex.compile(rf"(?<=(?:担当|担当者|店員|配達員|技術者|友人|隣人|妻|夫|私|名前|氏名|宛名|宛先|受取人|差出人)[はの、:：]\s?)[{_KANJI}]{{2,}}[ぁ-ん]{{0,5}}"),
    regex.compile(r"[ァ-ヶー]{2,}[・＝=][ァ-ヶー]{2,}"),
    regex.compile(rf"(?<=^|[\n。、,「『（({SEPARATOR}])[{_KANJI}]{{3,6}}(?=$|[\n。、,」』）){SEPARATOR}])"),
]
_HONORIFIC = regex.compile(r"さん|様|さま|氏|くん|君|ちゃん|先生|殿")


class Found(NamedTuple):
    """Candidates of a kind: spans of the joined text and their features."""

    start: np.ndarray
    end: np.ndarray
    features: np.ndarray


def _spans(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    a = np.array(spans, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def candidates(batch: Batch) -> dict[str, Found]:
    """All candidates of a batch by model."""
    out = {"email": _emails(batch)}
    numbers = _numbers(batch, out["email"])
    out["phone"] = out["id_number"] = numbers
    out["address"] = _addresses(batch)
    out["name"] = _names(batch, [out["email"], numbers], out["address"])
    out["east"] = _east_names(batch)
    return out


def _emails(batch: Batch) -> Found:
    """Around the signs that an address must have, so a text is not searched word by word."""
    text, found, p = batch.text, {}, batch.points
    low = p | 0x20
    bracket = np.flatnonzero(np.isin(p, [0x28, 0x5B, 0x7B]) & (np.roll(low, -1) == 0x61) & (np.roll(low, -2) == 0x74) & np.isin(np.roll(p, -3), [0x29, 0x5D, 0x7D]))
    signs = [np.sort(np.concatenate([np.flatnonzero(p == 0x40), bracket])).tolist(), []]
    at = batch.lower.find(" dot ")
    while at >= 0:
        a = max(0, at - _REACH)
        signs[1] += [m.start() for m in _SPELLED.finditer(batch.lower, a, at + 5) if m.end() == at + 5]
        at = batch.lower.find(" dot ", at + 1)
    for i, pattern in enumerate(_EMAILS):
        for sign in signs[i]:
            for m in pattern.finditer(text, max(0, sign - _REACH), sign + _REACH):
                if m.start() < sign < m.end():
                    s = m[0]
                    found[m.span()] = (float(i), float("@" in s), float(s.count(".")), float(len(s)), float(s[-2:].isalpha()), float(s.count(" ")))
                    break
                if m.start() > sign:
                    break
    spans = sorted(found)
    start, end = _spans(spans)
    own = np.array([found[s] for s in spans], np.float32).reshape(-1, 6)
    return Found(start, end, np.hstack([own, batch.context(start, end)]))


def _inside(start: np.ndarray, end: np.ndarray, of: Found) -> np.ndarray:
    """Whether spans meet one of those, which do not overlap."""
    if not len(of.start):
        return np.zeros(len(start), bool)
    reach = np.maximum.accumulate(of.end)
    i = np.searchsorted(of.start, end) - 1
    return (i >= 0) & (reach[np.maximum(i, 0)] > start)


def _windows(batch: Batch) -> list[tuple[int, int]]:
    """Stretches with so many digits, near one another, that a number may lie there."""
    at = np.flatnonzero(batch.flags & DIGIT != 0)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 9) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    keep = last - first + 1 >= _LEAST - 1
    return list(zip((np.maximum(at[first[keep]] - 8, 0)).tolist(), (at[last[keep]] + 9).tolist(), strict=True))


def _numbers(batch: Batch, emails: Found) -> Found:
    """Runs of digit groups, all their parts of several groups, mixtures of letters and digits, and digits as words."""
    text, found = batch.text, {}
    for a, b in _windows(batch):
        for m in _DIGITS.finditer(text, a, b):
            groups = [g.span() for g in _GROUPS.finditer(text, m.start(), m.end())]
            sizes = [y - x for x, y in groups]
            after = text[m.end() : m.end() + 1]
            if sum(sizes) >= _LEAST and not (after and (after.isascii() and after.isalnum() or after == "_")):
                found[m.span()] = 0
            if len(groups) > 1:
                for i in range(len(groups)):
                    n = 0
                    for j in range(i, len(groups)):
                        n += sizes[j]
                        if n > 20:
                            break
                        if n >= 7:
                            x, y = groups[i][0], groups[j][1]
                            x -= text[x - 1] == "(" and text.find(")", x, y) > 0
                            x -= text[x - 1] == "+"
                            found.setdefault((x, y), 1)
        for k, pattern in enumerate(_MIXED) if _HAS_LETTER.search(text, a, b) else ():
            for m in pattern.finditer(text, a, b):
                if _LEAST - 1 <= sum(c.isdigit() for c in m[0]) < len(m[0].replace(" ", "").replace("-", "")):
                    found.setdefault(m.span(), 2 + k)
    for m in batch.in_east(_KANJI_DIGITS):
        found.setdefault(m.span(), 8)
    word = np.flatnonzero(batch.info[:, Lexicon.NUMBER] > 0)
    if len(word):
        near = (np.diff(word) == 1) & (batch.starts[word[1:]] - batch.ends[word[:-1]] <= 2) & np.isin(batch.points[batch.ends[word[:-1]]], [32, 44, 45])
        cut = np.flatnonzero(~near) + 1
        for x, y in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(word)]]), strict=True):
            if y - x >= _LEAST:
                found.setdefault((int(batch.starts[word[x]]), int(batch.ends[word[y - 1]])), 9)
    spans = sorted(found)
    start, end = _spans(spans)
    free = ~_inside(start, end, emails)
    spans, start, end = [s for s, f in zip(spans, free, strict=True) if f], start[free], end[free]
    own = np.array([_number_features(batch, a, b, found[a, b]) for a, b in spans], np.float32).reshape(len(spans), _NUMBER_WIDTH)
    mails = batch.distances((emails.start, emails.end), start, end, *batch.sentence(start, end))
    return Found(start, end, np.hstack([own, np.column_stack(mails).astype(np.float32), batch.context(start, end)]))


_NUMBER_WIDTH = 27


def _number_features(batch: Batch, start: int, end: int, form: int) -> tuple:
    text = batch.text
    s, before, after = text[start:end], text[max(0, start - 6) : start].rpartition(SEPARATOR)[2], text[end : end + 12]
    groups, letters = _GROUPS.findall(s), _LETTERS.findall(s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    count = sum(map(len, letters)) if form != 9 else 0
    prefix = len(letters[0]) if letters and form != 9 and not s[0].isdigit() else 0
    return (
        form, len(digits), len(groups), sizes[0], sizes[1] if len(sizes) > 1 else 0, sizes[-1], max(sizes), count, prefix, bool(letters) and s[-1].isalpha(), s[0] == "+", s[0] == "(",
        digits[:1] == "0", digits[:2] == "00", int(digits[:1] or 0), "." in s, "-" in s, "/" in s, " " in s, "#" in before[-2:], bool(_DATE.match(s)), bool(_MONEY.search(before.lower())), bool(_UNITS.match(after.lower())),
        len(before) > 1 and before[-2].isdigit() or before[-1:].isdigit(), after[:1] in (" ", "-", "/", ".") and after[1:2].isdigit(), s.islower(), len(end_of) if (end_of := s[s.rfind(" ") + 1 :]) else 0,
    )


def _addresses(batch: Batch) -> Found:
    """Around words for streets that have a digit near."""
    text, found = batch.text, {}
    street = batch.info[:, Lexicon.STREET].astype(np.int64)
    hit = np.flatnonzero(street)
    a, b = np.maximum(batch.starts[hit] - 60, 0), np.minimum(batch.ends[hit] + 60, len(text) - 1)
    hit, a, b = (x[batch.digits[b] > batch.digits[a]] for x in (hit, a, b))
    for i, x, y in zip(hit.tolist(), a.tolist(), b.tolist(), strict=True):
        kind = street[i]
        for form in ((0,) if kind & 1 else ()) + ((1, 2) if kind & 2 else ()) + ((3,) if kind & 5 else ()):
            for m in _ADDRESSES[form].finditer(text, x, y, overlapped=True):
                if m.start() <= batch.starts[i] < m.end() or m.end() == batch.ends[i]:
                    found[m.span()] = form
    lower = batch.lower
    # a German preposition, a capitalised word and a number
    n = len(batch.starts)
    head = np.arange(max(0, n - 1))
    small = batch.info[head, Lexicon.PREPOSITION] > 0
    behind = batch.ends[head + 1]
    number = batch.flags[np.minimum(behind + 1, len(text) - 1)] & DIGIT != 0
    for i in head[small & (batch.case[head + 1] == 1) & (batch.points[np.minimum(behind, len(text) - 1)] == 32) & number].tolist():
        begin = int(batch.starts[i - 1] if i and batch.words[i] in ("der", "den") and batch.words[i - 1] in ("an", "in", "auf", "unter") else batch.starts[i])
        m = _PREPOSED.match(text, begin)
        if m:
            found.setdefault(m.span(), 5)
    for m in batch.in_east(_ADDRESSES[4], True):
        found.setdefault(m.span(), 4)
    spans = sorted(found)
    own = []
    for x, y in spans:
        s = text[x:y]
        words, numbers = regex.findall(_NW, s), _GROUPS.findall(s)
        own.append((
            found[x, y], sum(w[0].isupper() for w in words), len(words), sum(w.islower() for w in words), len(numbers[0]) if numbers else 0, int(numbers[0][:6]) if numbers else 0, "," in s, len(s),
            bool(_ENGLISH_HEAD.search(lower[max(0, x - 20) : x])), bool(_UNITS.match(lower, y)), s[0].isdigit(), s.isupper(), min((batch.lexicon.usual(w.lower()) for w in words), default=17.0), np.mean([batch.lexicon.usual(w.lower()) for w in words] or [17.0]),
            bool(_MONEY.search(lower[max(0, x - 6) : x])), bool(regex.match(r",? ?(?:[A-Z0-9]|\d{4,5})", text[y : y + 4])), sum(s.lower().startswith(w) for w in ("am ", "im ", "zum ", "zur ", "an ", "auf ", "unter ", "flat ", "apt", "unit ")),
        ))
    start, end = _spans(spans)
    return Found(start, end, np.hstack([np.array(own, np.float32).reshape(len(spans), 17), batch.context(start, end)]))


def _names(batch: Batch, contacts: list[Found], addresses: Found) -> Found:
    """Pairs of words: given and family name, with initials and particles between, in either order, or an initial for the given
    name. A pair is proposed when it is capitalised, or when one of its words is like a given name, or when it stands beside
    a word that tells of a person, a form of address, a way to reach one, or Japanese text."""
    n = len(batch.starts)
    if n < 2:
        return Found(*_spans([]), np.zeros((0, _NAME_WIDTH + len(_no_context(batch))), np.float32))
    p, starts, ends, case, info = batch.points, batch.starts, batch.ends, batch.case, batch.info
    nxt = np.minimum(np.arange(n) + 1, n - 1)
    gap = starts[nxt] - ends
    last = np.arange(n) == n - 1
    first_after, second_after = p[ends], p[np.minimum(ends + 1, len(p) - 1)]
    letters = ends - starts
    space = ~last & (gap == 1) & (first_after == 32)
    initial = (letters == 1) & (first_after == 0x2E) & (batch.flags[starts] & LETTER != 0)
    dotted = ~last & initial & ((gap == 1) | ((gap == 2) & (second_after == 32)))
    comma = ~last & (first_after == 0x2C) & ((gap == 1) | ((gap == 2) & (second_after == 32)))
    particle = info[:, Lexicon.PARTICLE] > 0
    # beyond initials and particles that follow place i
    over = np.arange(n)
    for _ in range(2):
        over = np.where(dotted[over] & ~last[over], nxt[over], over)
    after_initials = over
    for _ in range(3):
        over = np.where(particle[over] & space[over], nxt[over], over)
    glued, capital = batch.glued, (case == 1) | (case == 2) | (case == 4)
    given_ok = ~glued & ~initial & (letters > 1)
    family_ok = ~batch.glued & (letters > 1) & ~initial
    forms = []

    def add(form, head, tail, begin, end_word, good):
        at = np.flatnonzero(good)
        if len(at):
            forms.append((np.full(len(at), form), head[at], tail[at], begin[at], end_word[at]))

    here = np.arange(n)
    follow = np.where(space, nxt, -1)
    f = np.where(follow >= 0, over[np.maximum(follow, 0)], -1)
    good = given_ok & space & (f >= 0) & family_ok[np.maximum(f, 0)]
    add(0, here, f, starts, np.where(f >= 0, f, 0), good)
    # a second family name, or a middle name
    f2 = np.where((f >= 0) & space[np.maximum(f, 0)], nxt[np.maximum(f, 0)], -1)
    add(1, here, f2, starts, np.where(f2 >= 0, f2, 0), good & (f2 >= 0) & family_ok[np.maximum(f2, 0)] & (case[np.maximum(f2, 0)] == case[np.maximum(f, 0)]) & capital)
    # initials for the given name
    g = np.where(dotted, over[nxt], -1)
    before = np.maximum(here - 1, 0)
    add(2, here, g, starts, np.where(g >= 0, g, 0), dotted & ~glued & (g >= 0) & family_ok[np.maximum(g, 0)] & ~(dotted[before] & (here > 0)))
    # family, given [initial]; particles before the family
    begin = starts.copy()
    behind = here.copy()
    for _ in range(3):
        prev = np.maximum(behind - 1, 0)
        step = (behind > 0) & particle[prev] & space[prev] & ~glued[prev]
        behind = np.where(step, prev, behind)
    begin = starts[behind]
    add(3, nxt, here, begin, nxt, comma & family_ok & given_ok[nxt])
    add(4, nxt, here, begin, nxt, comma & family_ok & initial[nxt])
    if not forms:
        return Found(*_spans([]), np.zeros((0, _NAME_WIDTH + len(_no_context(batch))), np.float32))
    form, g, f, start, end_word = (np.concatenate(x) for x in zip(*forms, strict=True))
    end = ends[end_word] + (form == 4)
    # what makes a pair worth a look
    usual = info[:, Lexicon.SMALL]
    shaped = capital[f] & (capital[g] | (form == 2) | (form == 4))
    east = (batch.flags[np.minimum(end, len(p) - 1)] & EAST != 0) | (batch.flags[start - 1] & EAST != 0)
    like = (info[g, Lexicon.LIKE] > 0) | (info[f, Lexicon.LIKE] > 0) | (info[g, Lexicon.COMMON_GIVEN] > 0)
    keep = shaped | like | east
    # of the others, those of which a word is in no vocabulary or of a script without case, beside something that tells of a person
    ask = np.flatnonzero(~keep & ((np.maximum(usual[g], usual[f]) >= 17) | (case[g] == 3)))
    places, near = (start[ask], end[ask], *batch.sentence(start[ask], end[ask])), np.zeros(len(ask), bool)
    for kind in ("closing", "title", "relation", "speech", "service", "self"):
        a, b = batch.distances(batch.cues[KINDS_OF_CUES.index(kind)], *places)
        near |= (a <= 12) | (b <= 3)
    for c in (*contacts, addresses):
        a, b = batch.distances((c.start, c.end), *places)
        near |= (a <= 3) | (b <= 4)
    keep[ask[near]] = True
    keep &= ~(_inside(start, end, contacts[0]))
    form, g, f, start, end, end_word = (x[keep] for x in (form, g, f, start, end, end_word))
    order = np.lexsort((end, start))
    form, g, f, start, end, end_word = (x[order] for x in (form, g, f, start, end, end_word))
    borders = batch.sentence(start, end)
    reach = [batch.distances((c.start, c.end), start, end, *borders) for c in (*contacts, addresses)]
    # the words around, and how far a stretch of capitalised words goes on
    head = np.minimum(np.searchsorted(starts, start), n - 1)
    prev, follow = np.maximum(head - 1, 0), np.minimum(end_word + 1, n - 1)
    text_of = batch.texts_of(starts)
    has_prev = (head > 0) & (start - ends[prev] <= 3) & (text_of[prev] == text_of[head])
    has_next = (end_word < n - 1) & (starts[follow] - end <= 3) & (text_of[follow] == text_of[head])
    beside_prev = (start - ends[prev] == 1) & (p[ends[prev]] == 32)
    beside_next = (starts[follow] - end == 1) & (p[np.minimum(end, len(p) - 1)] == 32)
    run = np.zeros(len(form))
    honorific = np.zeros(len(form), np.float32)
    east = batch.flags[np.minimum(end, len(p) - 1)] & EAST != 0
    for i in np.flatnonzero(east):
        honorific[i] = bool(_HONORIFIC.match(batch.text, int(end[i])))
    run = (beside_prev & capital[prev]).astype(float) + (beside_next & capital[follow])
    own = [form, case[g], case[f], case[g] == case[f], letters[g], letters[f], end_word - head, start != starts[head], p[start] == 0, particle[np.maximum(f - 1, 0)] & (f > g), (form == 0) & (after_initials[np.minimum(g + 1, n - 1)] > np.minimum(g + 1, n - 1)), honorific, run]
    for w in (g, f):
        i = info[w]
        cue = i[:, Lexicon.CUE].astype(np.int64)
        own += [i[:, Lexicon.LISTED], i[:, Lexicon.LIKE], i[:, Lexicon.COMMON_GIVEN], i[:, Lexicon.COMMON_FAMILY], i[:, Lexicon.SMALL], i[:, Lexicon.CAPITAL], i[:, Lexicon.CAPITAL] - i[:, Lexicon.SMALL], i[:, Lexicon.BRAND], i[:, Lexicon.SPECIAL], i[:, Lexicon.STREET] > 0, i[:, Lexicon.PARTICLE], cue != 0, cue >> KINDS_OF_CUES.index("day") & 1, (cue & 0b1110111) != 0]
    for w, there in ((prev, has_prev), (follow, has_next)):
        i = info[w]
        own += [np.where(there, case[w], -1), np.where(there, i[:, Lexicon.SMALL], -1), np.where(there, i[:, Lexicon.CAPITAL], -1), np.where(there, i[:, Lexicon.STREET], -1), there & (i[:, Lexicon.BRAND] > 0), np.where(there, letters[w], -1), there & (i[:, Lexicon.LIKE] > 0)]
    for a, b in reach:
        own += [a, b]
    own.append(_inside(start, end, addresses))
    return Found(start, end, np.hstack([np.column_stack(own).astype(np.float32), batch.context(start, end)]))


_NAME_WIDTH = 13 + 28 + 14 + 6 + 1


def _no_context(batch: Batch) -> np.ndarray:
    none = np.zeros(1, np.int64) + 1
    return batch.context(none, none)[0]


def _east_names(batch: Batch) -> Found:
    """Names in kanji and kana: set apart by a space or a dot, before a form of address, after a word for a person, or standing
    alone. Of a run of kanji before a form of address, each end that may be the name is proposed."""
    text, found = batch.text, {}
    if batch.east:
        for form, pattern in enumerate(_EAST_NAMES):
            for m in batch.in_east(pattern):
                a, b = m.span()
                found.setdefault((a, b), form)
                if form in (1, 2):
                    for size in range(2, 8):
                        if form == 1 and b - size > a:
                            found.setdefault((b - size, b), 1)
                        if form == 2 and a + size < b:
                            found.setdefault((a, a + size), 2)
    spans = sorted(found)
    own = []
    for a, b in spans:
        s, before, after = text[a:b], text[a - 1], text[b : b + 1]
        kanji = sum(0x4E00 <= ord(c) <= 0x9FFF or c == "々" for c in s)
        own.append((
            found[a, b], b - a, kanji, s[:2] in FAMILY_KANJI or s[:3] in FAMILY_KANJI, s[:1] in FAMILY_KANJI, any(c in " ・=" for c in s), bool(_HONORIFIC.match(text, b)), text.startswith("様", b), 0x4E00 <= ord(before) <= 0x9FFF, 0x4E00 <= ord(after or " ") <= 0x9FFF,
            0x3040 <= ord(before) <= 0x30FF, 0x3040 <= ord(after or " ") <= 0x30FF, _usual_kanji(s, batch.lexicon), s[-1] in "子郎太美一介樹香奈恵雄夫男也人平彦代江花菜翔斗真大輝", text.startswith(("と申", "という", "と名"), b), kanji == b - a,
        ))
    start, end = _spans(spans)
    return Found(start, end, np.hstack([np.array(own, np.float32).reshape(len(spans), 16), batch.context(start, end)]))


def _usual_kanji(s: str, lexicon: Lexicon) -> float:
    """How usual the first two characters are as a word."""
    return min((float(np.log2(2 + r[s[:2].encode()])) for r in lexicon.ranks if s[:2].encode() in r), default=17.0)


__all__ = ["FAR", "KINDS", "MODELS", "Found", "candidates"]
