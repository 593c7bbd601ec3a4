"""Sentence units of subtitle texts: repair, cue structure and a pushdown automaton over one text.

The automaton works on a *masked* copy of the text that has the text's length, so offsets need no
translation: structure (cue numbers, time lines) becomes GAP, invisible things (markup, note signs)
HIDE, and a change of speaker TURN. Only texts whose encoding was damaged carry a table of offsets.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from dataclasses import dataclass

GAP, HIDE, TURN, END = "\x01", "\x02", "\x03", "\x00"

# Words before a full stop that never ends a sentence (lower-cased).
NEVER = frozenset(
    "dr mr mrs ms prof sgt capt cpt lt col gen maj rev hon fr st mt ft vs approx i.e e.g cf fig messrs mme mlle mm dra sra srta sr "
    "srs sras profa ej ex p.ej p.ex c.-à-d c.-a-d av z b d h u o bzw hr str z.b d.h u.a ul ул т е н т.е им см проф пр акад "
    "ดร นพ ศ डॉ श्री د أ م p a adm brig sen gov pres rep supt insp det cmdr cpl pvt atty esq bd abb bzgl vgl ggf tab bspw sog tel "
    "dott ing avv arch geb gest mgr inż".split()
)
# Words whose full stop goes on only before a number.
BEFORE_NUMBER = frozenset("no nr núm num nº n fl p pp pg pág vol sec ch art ca c д стр кв гл п op cap núms nos nrs".split())
# Words whose full stop ends a sentence if the next word begins one.
EITHER = frozenset("etc a.m p.m am pm b.c a.d co inc ltd corp jr al usw m v.chr n.chr д п э г ч др".split())


def _misread(word: str) -> str:
    """A word in which letters that scanners take for each other are one."""
    return word.translate(_ALIKE).replace("rn", "m").replace("vv", "w")


_ALIKE = str.maketrans("f015|", "tolsl")
def _trie(words: dict[str, str]) -> dict:
    """Words with their kinds as a trie from their last letter on, since a stop is met from behind."""
    root: dict = {}
    for word, kind in words.items():
        node = root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node[""] = kind
    return root


def _walk(node: dict, word: str) -> str:
    for c in reversed(word):
        node = node.get(c)
        if node is None:
            return ""
    return node.get("", "")


# What adverts in subtitle files say in their first line, with characters that are often misread.
ADVERT = (
    r"adverti[s5]e y[o0]ur|[s5]ubtit[l1|]es? (?:by|d[o0](?:w|vv)[nr]|fr[o0](?:m|rn))|captions?(?: by|:)|capti[o0]ns?:|[s5]ynced (?:&|and)|c[o0](?:rr|n)ected by|^=+ .* =+$"
    r"|(?:w|vv)atch .{0,30} fir[s5]t [o0]n |find (?:m|rn)[o0]re at |j[o0]in u[s5]:|d[o0] y[o0]u [l1|]ike .*\?$|^(?:[s5]upp[o0]rt|f[o0][l1][l1][o0](?:w|vv)) u[s5]\b"
    r"|d[o0]wn[l1][o0]aded fr[o0]m|enc[o0]ded by|tran[s5][l1]ated by|\bn[o0] ad[s5]\b"
)
# Parts of words, one of which every advert has, with misread characters folded.
ADVERT_PARTS = ("advertise", "subtitles", "caption", "synced", "corrected", "conected",  "== ", "watch ", "vvatch ", "find more", "find rnore", "join us", "you like", "support us", "follow us", "downloaded", "encoded", "translated", " ads")
# What Japanese sentences end with; told at a cue's end where no stop is written.
JA_FINAL = ("です", "ます", "ました", "ません", "でした", "った", "んだ", "いた", "した", "ある", "いる", "ない", "さい", "でしょう", "ろう", "よう", "か", "ね", "よ")
# Thai words that need something behind them, after which a space never ends a sentence; words that begin a clause which "before" closes.
THAI_OPEN = ("เชื่อ", "ว่า", "และ", "กับ", "ของ", "คุณ", "นาย", "นาง", "ชื่อ", "หรือ", "แต่", "ให้", "เมื่อ", "ราคา", "ตอน", "ๆ", "ดร.", "พบ", "เห็น", "เพราะ")
THAI_LEAD, THAI_BEFORE = ("เมื่อ", "หลังจาก", "ใน"), "ก่อน"


@dataclass(frozen=True)
class Lexicon:
    """The words that the automaton knows, each replaceable; without any it goes by stops, marks, case and cues alone."""

    never: frozenset[str] = NEVER
    before_number: frozenset[str] = BEFORE_NUMBER
    either: frozenset[str] = EITHER
    advert: str = ADVERT
    advert_parts: tuple[str, ...] = ADVERT_PARTS
    japanese_final: tuple[str, ...] = JA_FINAL
    thai_open: tuple[str, ...] = THAI_OPEN
    thai_lead: tuple[str, ...] = THAI_LEAD


#: No words at all.
BARE = Lexicon(frozenset(), frozenset(), frozenset(), "", (), (), (), ())


class _Words:
    """A lexicon's tries and patterns."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.all = {w: kind for kind, words in (("either", lexicon.either), ("number", lexicon.before_number), ("never", lexicon.never)) for w in words}
        self.trie = _trie(self.all)
        self.misread = _trie({_misread(w): kind for w, kind in self.all.items() if len(w) > 1})
        self.longest = max(map(len, self.all), default=0) + 1  # "m" may be misread as "rn"
        self.advert = re.compile(lexicon.advert, re.I) if lexicon.advert else None
        self.advert_parts = lexicon.advert_parts
        self.japanese_final = lexicon.japanese_final
        self.japanese_longest = max(map(len, lexicon.japanese_final), default=0)
        self.thai_open = lexicon.thai_open
        self.thai_lead = re.compile(rf"[\s\x01\x02]*(?:{'|'.join(map(re.escape, lexicon.thai_lead))})") if lexicon.thai_lead else None

    def abbreviation(self, word: str) -> str:
        """"never", "number" or "either" of an abbreviation, be it damaged; else ""."""
        if len(word) > self.longest:
            return ""
        kind = _walk(self.trie, word)
        if not kind and len(word) > 1:
            kind = _walk(self.misread, _misread(word))
            if not kind and "\ufffd" in word:
                shape = re.compile(re.escape(word).replace("\ufffd", "."))
                kind = next((k for w, k in self.all.items() if shape.fullmatch(w)), "")
        return kind


@functools.lru_cache(maxsize=8)
def _words(lexicon: Lexicon) -> _Words:
    return _Words(lexicon)


# What Windows-1252 makes of the bytes 80 to 9F, and where that leaves nothing, Latin-1.
_CP1252 = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_CP1251 = {b: ord(bytes([b]).decode("cp1251")) for b in range(0x80, 0x100) if b != 0x98}
_LEADS = re.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")
_UTF8 = re.compile(r"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: So many accented letters in a row are no Latin script's.
_FOREIGN = re.compile(r"[À-ÿ¸¨]{3,}")


def _decoded(text: str, places: list[int] | None) -> tuple[str, list[int]] | None:
    """UTF-8 that was read byte by byte, put right; with each character's end in the original text."""
    as_bytes = text.translate(_CP1252)
    out, ends, at = [], [], 0
    for m in _UTF8.finditer(as_bytes):
        try:
            char = m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            continue
        out.append(text[at : m.start()])
        ends.extend(range(at + 1, m.start() + 1))
        out.append(char)
        ends.append(m.end())
        at = m.end()
    if not at:
        return None
    out.append(text[at:])
    ends.extend(range(at + 1, len(text) + 1))
    return "".join(out), ends if places is None else [places[e - 1] for e in ends]


def repaired(text: str) -> tuple[str, list[int] | None]:
    """The text with damaged encodings put right, and the original end of each character (None: as they are)."""
    places: list[int] | None = None
    if text.isascii():
        return text, None
    for _ in range(2):
        if not _LEADS.search(text) or (better := _decoded(text, places)) is None:
            break
        text, places = better
    if _FOREIGN.search(text) and len(_FOREIGN.findall(text)) > 2:  # Cyrillic bytes read as Latin letters, one for one
        text = text.translate(_CP1251)
    return text, places


_NUMBER = re.compile(r"[\ufeff \t]*[0-9OolIZSB]{1,7}\s*\Z")
_FRAMES = re.compile(r"(?:^|(?<=[\n\r]))[﻿ \t]*\{\d+\}\{\d*\}")
_HIDDEN = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}|[♪♫♬♩﻿​‎‏‪-‮⁠]")
_TURN = re.compile(r"[\s\x02]*(>>+|-(?!-)|–(?=[ \x02]*\S))")
_DESCRIPTION = re.compile(r"[\s\x02]*(?:(?:\[[^\]]*\]|\([^()]*\)|（[^（）]*）|［[^［］]*］|【[^【】]*】|\*[^*]+\*)[\s\x02]*)+\Z")
_HIDDEN_CHARS = re.compile(r"[♪♫♬♩﻿​‎‏‪-‮⁠?�]")
_STARTS = frozenset("-–>[(（［【*?=")


def _advert_places(text: str, parts: tuple[str, ...]) -> list[int]:
    """Where words of adverts stand, in order."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    low = low.replace("0", "o").replace("1", "l").replace("|", "l").replace("5", "s")
    places = []
    for part in parts:
        j = low.find(part)
        while j >= 0:
            places.append(j)
            j = low.find(part, j + 1)
    places.sort()
    return places


def _clocks(text: str):
    """Begin and end of each time line with the cue number before it."""
    at, j = 0, text.find("-->")
    while j >= 0:
        begin, end = text.rfind("\n", at, j) + 1 or at, text.find("\n", j) + 1 or len(text)
        if begin > at:
            before = text.rfind("\n", at, begin - 1) + 1 or at
            if _NUMBER.match(text, before, begin):
                begin = before
        yield begin, end
        at, j = end, text.find("-->", end)


def masked(text: str, words: _Words) -> tuple[str, list[int]]:
    """The masked text, and ends of units that stand outside the sentences: adverts' lines, descriptions alone in a cue."""
    parts: list[str] = []
    apart: list[int] = []
    at = 0
    if "\r" in text and "\n" not in text:
        text = text.replace("\r", "\n")
    if "-->" in text:
        heads = _clocks(text)
    elif "}{" in text:
        heads = (m.span() for m in _FRAMES.finditer(text))
        text = text.replace("|", "\n")
    else:
        heads = ()
    adverts = _advert_places(text, words.advert_parts)
    for begin, end in heads:
        if begin > at:
            if not parts and text[:begin].lstrip("﻿ \n\r\t")[:6] in ("WEBVTT", ""):
                parts.append(GAP * (begin - at))  # the file's heading
            else:
                _speech(text[at:begin], at, parts, apart, adverts, words)
        parts.append(GAP * (end - begin))
        at = end
    if at < len(text):
        _speech(text[at:], at, parts, apart, adverts, words)
    return "".join(parts), apart


def _speech(text: str, at: int, parts: list[str], apart: list[int], adverts: list[int], words: _Words) -> None:
    """Appends what lies between two time lines, masked if it is not plain speech."""
    if (
        text[0] in _STARTS or text[0].isspace() or "<" in text or "{" in text or "\n-" in text or "\n–" in text or "\n>" in text or "\n " in text
        or not text.isascii() and _HIDDEN_CHARS.search(text) or "\n?" in text or adverts and bisect_left(adverts, at) < bisect_left(adverts, at + len(text))
    ):
        cue, begin = [], at
        for line in text.splitlines(keepends=True):
            cue.append((begin, line))
            begin += len(line)
        _cue(cue, parts, apart, words)
    else:
        parts.append(text)


def _hide(m: re.Match) -> str:
    return HIDE * len(m[0])


def _cue(cue: list[tuple[int, str]], parts: list[str], apart: list[int], words: _Words) -> None:
    shown = []
    for at, line in cue:
        if "<" in line or "{" in line or not line.isascii():
            line = _HIDDEN.sub(_hide, line)
        shown.append((at, line))
    text = "".join(s for _, s in shown)
    bare = text.replace(HIDE, "").strip()
    if not bare:
        parts.append(GAP * len(text))
        return
    first = bare[0]
    if first in "[(（［【*" and _DESCRIPTION.match(text):
        whole = "".join(s for _, s in cue)
        inner = whole.rstrip()
        # note signs within the brackets are the description's own; the closing bracket ends the unit
        apart.append(cue[0][0] + len(inner.rstrip("♪♫♬♩ ")) if inner[-1:] in "♪♫♬♩" else cue[0][0] + _last(text))
        parts.append(TURN + GAP * (len(text) - 1))
        return
    if words.advert is not None and words.advert.search(bare.split("\n", 1)[0].rstrip()):
        for at, line in shown:
            if end := _last(line):
                apart.append(at + end)
        parts.append(TURN + GAP * (len(text) - 1))
        return
    turn = False
    for i, (_, line) in enumerate(shown):
        head = line.lstrip("\x02 \t")[:2]
        if head[:1] in ("-", "–", ">") and head and (m := _TURN.match(line)) and (turn or i == 0 or head[0] != "–"):
            turn = True
            line = line[: m.start(1)].replace(" ", HIDE) + TURN * len(m[1]) + line[m.end() :]
        song = cue[i][1].rstrip()
        if song and song[-1] in "♪♫♬♩":
            k = len(song)
            line = line[: k - 1] + TURN + line[k:]
        elif song.startswith(("? ", "� ")) and song[-2:] in (" ?", " �"):  # note signs lost in a narrow encoding
            k = len(song)
            line = HIDE + line[1 : k - 1] + TURN + line[k:]
        parts.append(line)


def _last(s: str) -> int:
    """Where the last visible character of a masked text ends."""
    return len(s.rstrip(_BLANKS))


_BLANKS = GAP + HIDE + TURN + END + " \t\n\r\x0b\x0c\xa0　  \x85"
# What ends sentences in any script, after the Unicode property Sentence_Terminal, with the ellipsis and the Tibetan marks, without the Burmese comma.
TERMINATORS = ".!?…։؝؞؟۔܀܁܂߹࠷࠹࠽࠾।॥།༎။።፧፨᙮᜵᜶។៕᠃᠉᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿‼‽⁇⁈⁉⸮⸼。꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫﹒﹖﹗！．？｡"
_STOPS = frozenset(TERMINATORS)
_MARKS = "\"“”„«»「」『』〝〞‹›[]()（）［］【】"
_PLAIN = re.compile(f"[{re.escape(TERMINATORS)}" + r"\"()\[\]«»“”„\x03]")
_ANY = re.compile(
    "[" + re.escape(TERMINATORS) + re.escape(_MARKS) + "\x03　]"
    + r"|(?<=[฀-๿\"”])[ \n\x01\x02\r]+(?=[^ \n\x01\x02\r\x03])|(?<=[るただすいんかねよう])[ \r\x02]*[\n\x01]"
)
_SKIP = re.compile(r"[\s\x01\x02]*")
_EDGES = frozenset(_BLANKS + "\"“”„«»‹›「」『』()[]（）¿¡,;:|")
_OPENS = {"«": "»", "„": "“", "「": "」", "『": "』", "〝": "〞", "‹": "›", "[": "]", "(": ")", "（": "）", "［": "］", "【": "】"}
_BRACKETS = frozenset("])）］】")
_BEFORE_OPENING = frozenset(" \n\r\t\x01\x02\x03([（—–-:：¿¡　\xa0")
_AFTER_CLOSING = frozenset(" \n\r\t\x00\x01\x02\x03　\xa0")
_CLOSERS = frozenset("\"“”»«」』〞›‹’'")
#: Scripts without capitals, Georgian's everyday letters among them.
_CASELESS = re.compile("[\u0590-\u109f\u10d0-\u139f\u1401-\u1c7f\u3040-\u30ff\u3400-\u9fff\ua000-\ua4ff\ua840-\uabff\uac00-\ud7af]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_THAI = re.compile(r"[฀-๿]")
_LEADING = re.compile(r"(?:[\s\x01\x02]|\[[^\]]*\]|\([^()]*\)|（[^（）]*）|［[^［］]*］|【[^【】]*】|\*[^*\n]{1,60}\*)*")
_MONTH = re.compile(
    r"(?:jan|feb|m[aä\ufffd]r|apr|ma[iy]|jun|jul|aug|sep|o[ck]t|nov|de[cz])[a-zä\ufffd]*\b(?!\.)", re.I
)
def unit_ends(text: str | None, lexicon: Lexicon = Lexicon()) -> list[int]:
    """Ends (in code points, after the last character) of the sentence units of a subtitle text; none of null or blank."""
    if not text:
        return []
    words = _words(lexicon)
    fixed, places = repaired(text)
    s, ends = masked(fixed, words)
    ends += _sentences(s + END, words)
    ends.sort()
    return ends if places is None else [places[e - 1] for e in ends]


#: An item's mark at a line's start: its opening bracket, number or letter, and closing sign.
_ITEM = re.compile(r"[\n\x01][ \t\x02]*(\(?)(\d{1,3}(?:\.\d{1,3}){0,4}|[A-Za-z]|[ivxIVX]{2,5})([.)])(?=[ \t\x02])")
_FIRST_ITEM = re.compile(r"\n[ \t\x02]*\(?(?:(?:\d{1,3}\.){0,4}1|[AaIi])[.)][ \t\x02]")
_ROMAN = {"i": 1, "v": 5, "x": 10}


def _values(mark: str) -> list[tuple[str, int | tuple[int, ...]]]:
    """What an item's mark may count: (kind, number or numbers parted by points), in the order in which they are tried."""
    if mark[0].isdigit():
        return [("1", tuple(map(int, mark.split("."))))]
    low, out = mark.lower(), []
    case = "A" if mark.isupper() else "a"
    if len(mark) == 1:
        out.append((case, ord(low) - 96))
    if set(low) <= _ROMAN.keys():
        digits = [_ROMAN[c] for c in low]
        out.append((f"{case} roman", sum(-d if d < max(digits[i:]) else d for i, d in enumerate(digits))))
    return out


def _follows(now: int | tuple[int, ...], last: int | tuple[int, ...]) -> bool:
    """Whether a number counts on from another: 4 from 3; 2.1, 3 and 2.0.1 from 2.0, the way points nest."""
    if isinstance(now, int) or isinstance(last, int):
        return isinstance(now, int) and isinstance(last, int) and now == last + 1
    k = len(now) - 1
    return now == (*last, 1) or k < len(last) and now == (*last[:k], last[k] + 1)


def list_items(s: str) -> list[tuple[int, int]]:
    """(start, end of the mark) of every item of a list; levels are a stack.

    An item counts on from the last of its kind on the stack, which ends the levels above it, or opens a level with the
    first number or letter. A level is a list's if it has two items at least.
    """
    if not _FIRST_ITEM.search(s.replace(GAP, "")):  # quick, and no list begins otherwise
        return []
    levels: list[list] = []  # kind, number reached, (start, end) of its first item until a second comes
    found: list[tuple[int, int]] = []
    for m in _ITEM.finditer(s):
        at, options = (m.start(1), m.end(3)), [((m[1], kind, m[3]), n) for kind, n in _values(m[2])]
        for depth in range(len(levels) - 1, -1, -1):
            kind, reached, first = levels[depth]
            if n := next((n for k, n in options if k == kind and _follows(n, reached)), 0):
                del levels[depth + 1 :]
                if first is not None:
                    found.append(first)
                found.append(at)
                levels[depth] = [kind, n, None]
                break
        else:
            levels += [[k, n, at] for k, n in options[::-1] if n == 1 or isinstance(n, tuple) and set(n) == {1}][:1]
    return sorted(found)


#: Marks that open, each with what closes it; "“" and "»" also close.
_PAIRS = {"«": "»", "»": "«", "„": "“", "“": "”", "「": "」", "『": "』", "〝": "〞", "‹": "›", "[": "]", "(": ")", "（": "）", "［": "］", "【": "】"}
_OPENED_BY = {"»": "«", "«": "»", "“": "„", "”": "“", "」": "「", "』": "『", "〞": "〝", "›": "‹", "]": "[", ")": "(", "）": "（", "］": "［", "】": "【"}
_MARK_OR_TURN = re.compile("[" + re.escape("\"“”„«»「」『』〝〞‹›[]()（）［］【】") + "\x03]")
_MARK_TURN_OR_BLANK_LINE = re.compile(_MARK_OR_TURN.pattern + r"|\n[ \t]*\n")


def paired_marks(s: str) -> set[int]:
    """Where quotations and brackets open that also close, however far away; the others are stray marks.

    Marks are matched by a stack for each kind. A change of speaker, and in a text without cues a blank line, begins anew.
    A straight mark that looks like an opening one opens only if the next does not look like one too.
    """
    out: set[int] = set()
    open_at: dict[str, list[int]] = {}
    straight = -1
    for m in (_MARK_OR_TURN if GAP in s else _MARK_TURN_OR_BLANK_LINE).finditer(s):
        c, i = m[0], m.start()
        if c == '"':
            opening = (i == 0 or s[i - 1] in _BEFORE_OPENING) and s[i + 1] not in _AFTER_CLOSING
            if straight >= 0 and not opening:
                out.add(straight)
                straight = -1
            else:
                straight = i
        elif c == TURN or len(c) > 1:
            open_at.clear()
            straight = -1
        elif (opener := _OPENED_BY.get(c)) and open_at.get(opener):
            out.add(open_at[opener].pop())
        elif c in _PAIRS:
            open_at.setdefault(c, []).append(i)
    return out


def _begins(s: str, n: int) -> str:
    """What stands at ``n``: "U" begins a sentence, "l" goes on, "D" digit, "c" caseless letter, "q" opening mark, "-" dash, "," other."""
    c = s[n]
    if c.isalpha():
        if c.isupper():
            return "U"
        if c.islower() and not "\u10d0" <= c <= "\u10ff":  # Georgian begins sentences with these
            # a capital I misread as l
            return "U" if c == "l" and s[n + 1 : n + 2] and s[n + 1] in "tnsfm'’" else "l"
        return "c"
    if c.isdigit():
        return "U" if s[n + 1 : n + 2].isalpha() and s[n + 1 : n + 2].isascii() else "D"
    if c in "¿¡":
        return "U"
    if c in "\"“„«「『〝‹([（［【‘'»*#":
        return "q"
    if c in "-—–\x96\x97":
        m = _SKIP.match(s, n + 1).end()
        return _begins(s, m) if m == n + 1 and m < len(s) and s[m] not in "-—–" else "-"
    if c == "�":
        return "U"
    if c == "|":
        return "U"
    if c in ",;:%)]）］】…。、，；：":
        return ","
    return "U" if c in ".…" else "q"


def _sentences(s: str, words: _Words) -> list[int]:
    """Ends of the sentences of a masked text with END behind it."""
    ends: list[int] = []
    stack: list[str] = []
    skip = _SKIP.match
    start = skip(s, 0).end()
    opened = -1  # where the outermost open quotation began
    upto, n_all = 0, len(s) - 1
    plain = s.isascii() or not _CASELESS.search(s)
    paired = paired_marks(s) if _MARK_OR_TURN.search(s) else frozenset()
    items = [(a - 1, b - 1) for a, b in list_items("\n" + s)][::-1]
    lead, lead_end = -1, 0  # where the descriptions before the sentence end
    for m in (_PLAIN if plain else _ANY).finditer(s):
        i = m.start()
        while items and items[-1][0] <= i:  # an item begins a unit, and its mark's stop ends none
            at, mark_end = items.pop()
            if not stack and at >= start:
                if end := _last(s[start:at]):
                    ends.append(start + end)
                start, upto = at, max(upto, mark_end)
        if i < upto:
            continue
        if start != lead:
            lead, lead_end = start, start if s[start].isalnum() else _LEADING.match(s, start).end()
        c = m[0]
        if c in _STOPS:
            k = i + 1
            after = s[k]
            if c == "." and after.isalnum():
                continue  # within a number, name or address
            while after in _STOPS:
                k += 1
                after = s[k]
            upto = k
            if stack and stack[-1] in _BRACKETS:
                continue
            inside = bool(stack)
            quoted_from = opened
            while True:  # closing marks belong to the unit
                if after in _CLOSERS:
                    if stack and after == stack[-1]:
                        stack.pop()
                    elif not (after in "’'" or (not stack and after in "”»" and not inside)):
                        break
                    k += 1
                    after = s[k]
                elif inside and stack and stack[-1] in "»›«" and after in " \xa0 \n\x01\x02\r":
                    j = skip(s, k).end()
                    if s[j] != stack[-1]:
                        break
                    stack.pop()
                    k = j + 1
                    after = s[k]
                else:
                    break
            upto = k
            if stack:
                continue
            n = k + 1 if after == " " and s[k + 1] not in _BLANK_SET else skip(s, k).end()
            if n >= n_all or s[n] == TURN:
                continue  # the turn, or the end of the text, ends it
            if _ends(s, start, lead_end, i, s[i : i + 1] if k == i + 1 else _run(s, i), k, n, inside, quoted_from, words):
                ends.append(k)
                start = n
        elif c == TURN:
            stack.clear()
            if i > start and (end := _last(s[start:i])):
                ends.append(start + end)
            start = skip(s, i + 1).end()
        elif c in _MARK_SET:
            if c == '"':
                before, after = s[i - 1 : i], s[i + 1]
                if '"' in stack:
                    closing = not (before.isspace() and not after.isspace() and after != END and stack[-1] != '"')
                else:
                    closing = bool(before) and before not in " \n\r\t\x01\x02\x03([（—–-:：¿¡" and after in " \n\r\x00\x01\x02\x03.,;:!?"
                if closing:
                    if '"' in stack:
                        del stack[stack.index('"') :]
                elif i in paired:
                    if not stack:
                        opened = i
                    stack.append('"')
            elif stack and c == stack[-1]:
                stack.pop()
            elif c in _OPENS and not (c == "«" and "«" in stack):
                if i in paired:  # else a stray mark
                    if not stack:
                        opened = i
                    stack.append(_OPENS[c])
            elif c == "“":
                if i in paired:
                    if not stack:
                        opened = i
                    stack.append("”")
            elif c == "»" and not stack:
                if i in paired:
                    opened = i
                    stack.append("«")
            elif c in stack:
                del stack[stack.index(c) :]
        elif stack:
            continue
        elif c == "　":
            if lead_end < i and _CJK.search(s, start, i) and s[i - 1] not in "、，：":
                ends.append(start + _last(s[start:i]))
                start = skip(s, i).end()
        elif s[i - 1] in "\"”" or "฀" <= s[i - 1] <= "๿":
            if lead_end < i and _thai_break(s, start, i, m.end(), words):
                ends.append(start + _last(s[start:i]))
                start = m.end()
        else:
            n = skip(s, i).end()
            if n < n_all and s[n] not in "かねよとの、。？！…\x03" and _shown_before(s, start, i, words.japanese_longest).endswith(words.japanese_final):
                ends.append(start + _last(s[start:i]))
                start = n
    for at, _ in reversed(items):  # items behind the last mark
        if not stack and at >= start:
            if end := _last(s[start:at]):
                ends.append(start + end)
            start = at
    end = _last(s[start:])
    if end:
        ends.append(start + end)
    return ends


def _shown_before(s: str, start: int, i: int, n: int) -> str:
    """The last ``n`` characters of speech before ``i``."""
    out = ""
    while i > start and len(out) < n:
        i -= 1
        if s[i] not in _UNBROKEN:
            out = s[i] + out
    return out


def _run(s: str, i: int) -> str:
    k = i
    while s[k] in _STOPS:
        k += 1
    return s[i:k]


_BLANK_SET = frozenset(_BLANKS + END)
_MARK_SET = frozenset(_MARKS)
_UNBROKEN = frozenset("\n\r" + HIDE + GAP)


def _ends(s: str, start: int, lead_end: int, i: int, run: str, k: int, n: int, inside: bool, opened: int, words: _Words) -> bool:
    """Whether the stops ``run`` at ``i``, with closing marks up to ``k``, end the sentence begun at ``start``."""
    if not s[start].isalnum() and lead_end >= i:
        return False  # nothing but a pause or description so far
    nxt = _begins(s, n)
    last = s[i - 1]
    caseless = last >= "\u0590" and bool(_CASELESS.match(last)) or (run[0] not in ".!?…")
    if inside and k > i + len(run):  # stops within a quotation that closes here
        if nxt in ("l", ",") or (nxt == "-" and s[n] != "-"):
            return False
        if s[n] == "と" and n == k:
            return False  # what was said, with its particle
        if nxt == "c" or _CASELESS.search(s, opened + 1, i):
            if lead_end >= opened:
                return nxt == "q" and n > k  # the speech comes first, then who says it
            return not ("؀" <= s[n] <= "ۿ")
        return True
    if run in ("…", "……") or run.startswith("..") or run.endswith("…"):
        if caseless:
            return False
        return nxt in ("U", "q")
    if run != ".":
        if run[0] in "!?" and not caseless and n > k and nxt in ("l", ",") and not _CASELESS.match(s[n]):
            return nxt == "l"
        return not (nxt == "," and n == k)
    if n == k:
        return False  # within a number, name or address
    if nxt == ",":
        return False
    k0, least = i, max(start, i - words.longest - 2)  # longer words are no abbreviations
    while k0 > least and s[k0 - 1] not in _EDGES:
        k0 -= 1
    word = s[k0:i]
    if k0 == start and len(word) < 3 and word.isdigit() and s[start - 1 : start] in ("", "\n", "\r", GAP, TURN, HIDE):
        return False  # the number of a list's item
    low = word.lower()
    if nxt == "l":
        return False
    if nxt == "U" and word.isdigit() and _MONTH.match(s, n):
        return False
    kind = words.abbreviation(low)
    if kind == "number":
        return nxt != "D"
    if len(word) == 1 and word.isupper() and nxt == "U" and not _CASELESS.match(word):
        return False
    if low == "m":  # Monsieur, or the second half of p. m.
        j = i - 2
        while j > start and s[j] in _BLANK_SET:
            j -= 1
        return word != "M" and s[max(start, j - 1) : j + 1] in ("p.", "a.")
    return kind != "never"


def _thai_break(s: str, start: int, i: int, n: int, words: _Words) -> bool:
    """Whether the space from ``i`` to ``n`` ends a Thai sentence."""
    if not _THAI.search(s, start, i):
        return False
    nxt = s[n]
    if s[i - 1] in "\"”":
        return nxt not in ",;:"
    if nxt.isdigit() or nxt in "\"“(,;:.":
        return False
    e = i
    while e > start and s[e - 1] in _BLANK_SET:
        e -= 1
    if words.thai_open and s.endswith(words.thai_open, start, e):
        return False
    return not (s.endswith(THAI_BEFORE, start, e) and i - start <= 64 and words.thai_lead is not None and words.thai_lead.match(s, start, i))
