"""Sentence units: texts with the units they must give, and edges."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.sentence_text import BARE, Lexicon, unit_ends
from millrace.llm.sentences import sentence_ends


def srt(*cues: str) -> str:
    return "\n".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i + 1:02d},000\n{c}\n" for i, c in enumerate(cues, 1))


def units(text: str) -> list[str]:
    """The last twelve characters of every unit."""
    return [text[max(0, e - 12) : e].replace("\n", " ")[-12:] for e in unit_ends(text)]


def ends_with(text: str, *tails: str) -> None:
    ends = unit_ends(text)
    assert [text[e - len(t) : e] for e, t in zip(ends, tails, strict=False)] == list(tails), [text[:e][-25:] for e in ends]
    assert len(ends) == len(tails), [text[:e][-25:] for e in ends]


CASES = [
    (srt("The file is called vault_v70.72.dat\nand Koro has it."), ["has it."]),
    (srt("It's a trap! Fine, give or take 294.45", "meters."), ["trap!", "meters."]),
    (srt("Mr. Dekev, you never leave at", "the map... Keep the gate (and", "the map) away from St. Loto."), ["map...", "Loto."]),
    (srt("Wait... you turn back without Napalo?", "...and that is how we lost it."), ["Napalo?", "lost it."]),
    (srt('"Run!" she said, and Kala did. "Stay here," said Bo, "and\nhide." Fine.'), ["did.", 'hide."', "Fine."]),
    (srt('"Is it Fenma?" he asked. "Or the vault?"'), ["asked.", 'vault?"']),
    (srt("- Fine, right?\n- No. 7 is locked", "[door creaks]", "(sighs) We open at 9 a.m. Mr. Bo left at 9", "a.m. sharp, etc."), ["right?", "locked", "creaks]", "9 a.m.", "etc."]),
    (srt("Si vuelve, está en la caja n\ufffdm. 5, creo. 5gt. Bo and Sgf. Ko left."), ["creo.", "left."]),
    (srt("「もう遅い」と言いまし", "た", "「逃げろ！」とBoが叫んだ"), ["た", "んだ"]),
    (srt("J. T. Kaqui of the U.N.K. sector won approx. 5 rounds. It was 2 B.C. when they came."), ["rounds.", "came."]),
    (srt("Subtitles by the Hilzala crew!\nFind more at x.example", "Check www.x.example before you go."), ["crew!", "x.example", "go."]),
    (srt("♪ Sgt. Wa moves at dawn. ♪\n♪ No stop here ♪", "<i>Fine.</i>"), ["dawn.", "here", "Fine."]),
    (srt("NARRATOR: They sold 9,000 copies.", ">> Go!\n>> You what?!"), ["copies.", "Go!", "what?!"]),
    (srt("—Ven —dijo Zeltora—, o perdemos la señal. ¿Y ahora qué? «¡Corre!», gritó Ho a las 6:15 p. m. con el mapa."), ["señal.", "qué?", "mapa."]),
    (srt("« Cours ! » a crié Bo, je crois. M. Bo coûte 2,5 pièces, c.-à-d. trop. Attention, Bo !"), ["crois.", "trop.", "Bo !"]),
    (srt("Dr. Bo kommt am 4. Mai zurück. Das kostet 2 Münzen, z. B. am Hafen. Die Nr. 6 ist da usw. usf."), ["zurück.", "Hafen.", "usf."]),
    (srt("«Беги!» — крикнул Bo. Он живёт на ул. Мельничной, д.", "7. В 2 г. до н. э. тут стоял маяк и т. п. Где он?"), ["Bo.", "7.", "т. п.", "он?"]),
    (srt("「もう遅い。帰ろう」と彼女は言っ\nた。待って…まだ鍵がある。灯台は？"), ["た。", "ある。", "は？"]),
    (srt("船はどこですか　待って…まだ鍵がある", "これは第4話です"), ["ですか", "ある", "です"]),
    (srt("他说：“今晚不行。”好吧。“快跑！”Bo喊道。等等……还没有船。"), ["。”", "好吧。", "喊道。", "船。"]),
    (srt("สะพานอยู่ที่ไหน\nราคา 9.5 เหรียญ ดร. Bo พูดว่า", '"หนีเร็ว"'), ["ไหน", "เหรียญ", 'หนีเร็ว"']),
    (srt('"भागो!" Bo ने कहा। डॉ. Bo आए। रुको... Bo बाहर है।'), ["कहा।", "आए।", "है।"]),
    (srt("قال Bo: «اهرب!» ثم اختفى. وصل د. Bo غدا، أليس كذلك؟"), ["اختفى.", "كذلك؟"]),
    ("{1}{20}Fine. Who told|Bo?\n{21}{40}[door]\n", ["Fine.", "Bo?", "[door]"]),
    ("WEBVTT\n\n00:01.000 --> 00:02.000 line:10%\n{\\an8}Fine. \n", ["Fine."]),
    ("No cues here. Only text", ["here.", "text"]),
]


@pytest.mark.parametrize("text,tails", CASES)
def test_units(text, tails):
    ends_with(text, *tails)
    if "\r" not in text:
        crlf = text.replace("\n", "\r\n")
        assert len(unit_ends(crlf)) == len(tails)


@pytest.mark.parametrize("text,tails", [c for c in CASES if any(ord(x) > 0x3FF for x in c[0])])
def test_damaged_encoding_moves_no_boundary(text, tails):
    broken = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode("utf-8"))
    assert len(unit_ends(broken)) == len(tails)
    mended = lambda s: "".join({chr(b): chr(b) for b in ()}.get(c, c) for c in s)
    for e, t in zip(unit_ends(broken), tails, strict=True):
        raw = bytes(next(b for b in range(256) if (bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b)) == c) for c in mended(broken[:e]))
        assert raw.decode("utf-8").endswith(t)


def test_cyrillic_read_as_latin():
    text = srt("Хорошо. Это стоит 192,9 монет, т. е. слишком дорого. Где карта и т. д.?")
    ends = unit_ends(text)
    assert unit_ends("".join(bytes([b]).decode("latin-1") for b in text.encode("cp1251"))) == ends and len(ends) == 3


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?…\n\"'()[]«»“”-–♪*{}<>0123456789:,→>。「」　é�|\r", max_size=200))
def test_ends_are_ordered_and_within(text):
    ends = unit_ends(text)
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) and not text[e - 1].isspace() for e in ends)


def test_long_text_is_linear():
    assert len(unit_ends("He left (and " * 30_000 + "went.")) == 1
    assert len(unit_ends("Fine. " * 50_000)) == 50_000


def test_over_a_table(spark):
    df = spark.createDataFrame([(1, "A. B.", 5), (2, "", 5), (3, None, 5), (1, "A. B.", 5), (4, " \n", 5)], "doc_id bigint, text string, end_pos int")
    assert sorted(tuple(r) for r in sentence_ends(df).collect()) == [(1, 5)] * 2 or sorted(tuple(r) for r in sentence_ends(df).collect()) == [(1, 2), (1, 2), (1, 5), (1, 5)]
    assert sentence_ends(df.limit(0)).count() == 0


def test_markup_of_any_length_is_hidden():
    style = "; ".join(f"x{i}: Bo. Ko" for i in range(40))
    text = srt(f'<font style="{style}">The gate is shut. We wait.</font>', f"{{{style}}}Nobody came. Fine.")
    ends_with(text, "is shut.", "We wait.", "Nobody came.", "Fine.")


def units(text, **more):
    ends = unit_ends(text, **more)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends, strict=False)]


def test_quotations_of_any_length():
    for n in (5, 40, 4000):
        assert len(units('"' + "It goes on and on here. " * n + 'End of it," he said. Then more.')) == 2
        assert len(units("He (" + "it goes on. " * n + "so) left. Then more.")) == 2
        assert len(units("«" + "It goes on here. " * n + "End» he said. Then more.")) == 2
    assert units('A stray " mark. Then more. And "this. Is quoted" speech.') == ['A stray " mark.', "Then more.", 'And "this. Is quoted" speech.']
    assert len(units("A stray ( bracket. Then more. And more.")) == 3


@pytest.mark.parametrize(
    "text, want",
    [
        ("Adm. Jones left. Sen. Lee met Brig. Gen. Ray.", ["Adm. Jones left.", "Sen. Lee met Brig. Gen. Ray."]),
        ("Vgl. Abb. 3 dazu. Gut.", ["Vgl. Abb. 3 dazu.", "Gut."]),
        ("ሰላም ነው። እንዴት ነህ፧ ደህና።", ["ሰላም ነው።", "እንዴት ነህ፧", "ደህና።"]),
        ("မင်္ဂလာပါ။ နေကောင်းလား။", ["မင်္ဂလာပါ။", "နေကောင်းလား။"]),
        ("សួស្តី។ សុខសប្បាយទេ។", ["សួស្តី។", "សុខសប្បាយទេ។"]),
        ("Բարև։ Լավ։", ["Բարև։", "Լավ։"]),
        ("یہ ہے۔ وہ نہیں ہے۔", ["یہ ہے۔", "وہ نہیں ہے۔"]),
        ("ეს არის. ის არ არის.", ["ეს არის.", "ის არ არის."]),
        ("བཀྲ་ཤིས། བདེ་ལེགས།", ["བཀྲ་ཤིས།", "བདེ་ལེགས།"]),
    ],
)
def test_scripts_and_titles(text, want):
    assert units(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("The list:\n1. First item. It is long.\n  a) Sub one. And more\n  b) Sub two\n2. Second item", ["The list:", "1. First item.", "It is long.", "a) Sub one.", "And more", "b) Sub two", "2. Second item"]),
        ("(a) one thing\n(b) another\n(i) sub\n(ii) sub two\n(c) third", ["(a) one thing", "(b) another", "(i) sub", "(ii) sub two", "(c) third"]),
        ("1.1. Alpha\n1.2. Beta. Gamma\n2. Out\n2.1. In", ["1.1. Alpha", "1.2. Beta.", "Gamma", "2. Out", "2.1. In"]),
        ("It was no. 1\nI saw it.\n1. place was his. Good.", ["It was no. 1\nI saw it.", "1. place was his.", "Good."]),  # one item is no list
    ],
)
def test_list_levels(text, want):
    assert units(text) == want


def test_words_are_a_parameter():
    assert units("Dr. Who left. He ran.") == ["Dr. Who left.", "He ran."]
    assert units("Dr. Who left. He ran.", lexicon=BARE) == ["Dr.", "Who left.", "He ran."]
    assert units("Xyz. Who left.", lexicon=Lexicon(never=frozenset({"xyz"}))) == ["Xyz. Who left."]
    assert unit_ends("ยินดี ต้อนรับ", BARE) and unit_ends("これは本です\nはい", BARE)


def test_time_is_linear():
    import time

    for part in ("เขาไปตลาดเพราะ ", '("', "“(", "Hello there. ", "1) ", "　", "かね\n", "[x "):
        took = []
        for n in (40_000, 320_000):
            began = time.perf_counter()
            unit_ends(part * (n // len(part)))
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * 4 * max(took[0], 0.01), part
