"""Language detection and greetings as column expressions.

A script with two characters or more decides, Kana beside Han means Japanese, Arabic script is told apart by letters
and words, Latin script by an ordered cascade of letters and words; the default is English. Of scripts that tie, the
first of the list below wins. Null counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Script classes: fixed values.
SCRIPTS = (
    ("Chinese", r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"),
    ("Japanese", r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF65}-\x{FF9F}"),
    ("Korean", r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}"),
    ("Arabic", r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"),
    ("Hebrew", r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}"),
    ("Thai", r"\x{0E00}-\x{0E7F}"),
    ("Hindi", r"\x{0900}-\x{097F}"),
    ("Bengali", r"\x{0980}-\x{09FF}"),
    ("Tamil", r"\x{0B80}-\x{0BFF}"),
    ("Telugu", r"\x{0C00}-\x{0C7F}"),
    ("Kannada", r"\x{0C80}-\x{0CFF}"),
    ("Malayalam", r"\x{0D00}-\x{0D7F}"),
    ("Gujarati", r"\x{0A80}-\x{0AFF}"),
    ("Punjabi", r"\x{0A00}-\x{0A7F}"),
    ("Burmese", r"\x{1000}-\x{109F}"),
    ("Khmer", r"\x{1780}-\x{17FF}"),
    ("Lao", r"\x{0E80}-\x{0EFF}"),
    ("Georgian", r"\x{10A0}-\x{10FF}\x{2D00}-\x{2D2F}"),
    ("Armenian", r"\x{0530}-\x{058F}"),
    ("Amharic", r"\x{1200}-\x{137F}"),
    ("Tibetan", r"\x{0F00}-\x{0FFF}"),
    ("Sinhala", r"\x{0D80}-\x{0DFF}"),
    ("Russian", r"\x{0400}-\x{052F}"),
    ("Greek", r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}"),
)
#: Latin cascade: language, then tests that must all hold; each test is letters, words, or either. Fixed values.
LATIN = (
    ("Vietnamese", (("ảạắằẳẵặấầẩẫậđẻẽẹếềểễệỉĩịỏọốồổỗộơớờởỡợủũụưứừửữựỷỹỵ", ""),)),
    ("Turkish", (("ğış", ""), ("", "bir ve için ile bu da de değil ama"))),
    ("Polish", (("ąćęłńóśźż", ""),)),
    ("Czech", (("ěšžřďťňů", ""),)),
    ("Romanian", (("ăâîșț", ""), ("", "și este sau care pentru"))),
    ("Hungarian", (("őű", ""),)),
    ("German", (("äöüß", "und der die das ist nicht ein eine"), ("", "und der die das ist"))),
    ("French", (("àâçéèêëïîôùûüÿœæ", "le la les de des est et un une du au"), ("", "le la les est une des"))),
    ("Portuguese", (("ãõç", ""), ("", "o a os as de do da é em um uma não que"))),
    ("Spanish", (("áéíóúñ¿¡", "el la los las de del es en por que un una"), ("ñ¿¡", "el los las del por"))),
    ("Italian", (("", "il lo la gli le di del della è e un una che non per"), ("", "il della gli che è"))),
    ("Dutch", (("", "het de een van en in is dat op te met"), ("", "het een van dat"))),
    ("Swedish", (("åäö", ""), ("", "och att det en ett är för med"))),
    ("Norwegian", (("åæø", ""), ("", "og er det en et for med på"))),
    ("Danish", (("åæø", ""), ("", "og er det en et til med af"))),
    ("Finnish", (("äö", ""), ("", "ja on ei se että tai kun niin"))),
    ("Indonesian", (("", "dan yang di dari untuk dengan ini itu adalah tidak ada"), ("", "yang dari untuk dengan adalah"))),
    ("Swahili", (("", "na ya wa ni kwa katika hii hiyo"),)),
)
PERSIAN_WORDS = "این است که برای های را در به از می یک"
ARABIC_WORDS = "ال في من على هذا هذه إلى التي الذي كان"


def _ascii_words(words: str) -> list[str]:
    return [w for w in words.split() if w.isascii()]


def _other_words(words: str) -> str:
    """A pattern for the words that are not all ASCII. Word ends are those of ASCII letters, digits and underscores, so a
    word that begins with another letter needs a word character before it."""
    ends = lambda c, yes, no: no if c.isascii() else yes
    rest = [w for w in words.split() if not w.isascii()]
    return "|".join(ends(w[0], "(?<=[A-Za-z0-9_])", "(?<![A-Za-z0-9_])") + w + ends(w[-1], "(?=[A-Za-z0-9_])", "(?![A-Za-z0-9_])") for w in rest)


_WORDS = sorted({w for _, tests in LATIN for _, words in tests for w in _ascii_words(words)})


def _test(s: Column, letters: str, words: str) -> Column:
    """One test of the cascade on what a text holds: ``s`` has its ``words``, ``letters`` and ``lower`` text."""
    of = lambda xs: F.array(*map(F.lit, xs))
    parts = [F.arrays_overlap(s["letters"], of(letters))] * bool(letters)
    if plain := _ascii_words(words):
        parts.append(F.arrays_overlap(s["words"], of(plain)))
    if other := _other_words(words):
        parts.append(s["lower"].rlike(other))
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _latin(s: Column) -> Column:
    out = F.lit("English")
    for name, tests in reversed(LATIN):
        hit = F.lit(True)
        for t in tests:
            hit = hit & _test(s, *t)
        out = F.when(hit, name).otherwise(out)
    return out


def script_counts(text: Column) -> Column:
    """A map from script to its characters in the text."""
    return F.create_map(*(x for name, cls in SCRIPTS for x in (F.lit(name), F.regexp_count(text, F.lit(f"[{cls}]")))))


def _words_held(text: Column, words: str) -> Column:
    return sum(F.contains(text, F.lit(f" {w} ")).cast("int") for w in words.split())


def _arabic_script(text: Column) -> Column:
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    persian = 3 * F.regexp_count(text, F.lit("[پچژگ]")) + F.regexp_count(text, F.lit("[کی]")) + 2 * _words_held(spaced, PERSIAN_WORDS)
    arabic = F.regexp_count(text, F.lit("[كيةىإأؤئ]")) + 2 * _words_held(spaced, ARABIC_WORDS)
    return F.when((persian >= 3) & (persian > arabic), "Persian").otherwise("Arabic")


def _other_script(s: Column) -> Column:
    counts = F.array(*(F.struct(F.regexp_count(s["other"], F.lit(f"[{cls}]")).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("s")) for i, (name, cls) in enumerate(SCRIPTS)))
    top = F.array_max(counts)
    mixed = s["other"].rlike(f"[{SCRIPTS[0][1]}]") & s["other"].rlike(f"[{SCRIPTS[1][1]}]")
    return F.when(mixed, "Japanese").when(top["n"] < 2, _latin(s)).when(top["s"] == "Arabic", _arabic_script(s["text"])).otherwise(top["s"])


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def detect_language(text: Column) -> Column:
    """What a text holds (its characters beyond ASCII, and the words that the cascade asks for) is sought once; the tests
    then look at these few."""

    def held(t: Column) -> Column:
        parts = F.struct(t.alias("text"), F.lower(t).alias("lower"), F.regexp_replace(t, r"[\x00-\x7F]+", "").alias("other"))
        words = lambda p: F.array_intersect(F.split(p["lower"], "[^A-Za-z0-9_]+"), F.array(*map(F.lit, _WORDS)))
        return _once(parts, lambda p: F.struct(p["text"].alias("text"), p["lower"].alias("lower"), p["other"].alias("other"), words(p).alias("words"), F.array_distinct(F.split(F.lower(p["other"]), "")).alias("letters")))

    scripts = "[" + "".join(c for _, c in SCRIPTS) + "]"
    return _once(_once(F.coalesce(text, F.lit("")), held), lambda s: F.when(s["other"].rlike(scripts), _other_script(s)).otherwise(_latin(s)))


#: Openers that count as greetings: fixed values.
GREETINGS = (
    r"(hi|hello|hey|yo|sup|howdy|hiya|heya|hullo)( there| y'all| you| folks| everyone)?",
    r"good (morning|afternoon|evening|day|night)",
    r"(what'?s up|wassup|whaddup)",
    r"greetings",
    r"(你好|您好|大家好|嗨|哈喽|哈啰|哈囉|哈罗|喂)[啊呀吖呢么呗哦哈]?",
    r"(早|早啊|早安|早上好|中午好|下午好|晚上好|晚安)[啊呀吖呢么呗哦哈]?",
    r"(在吗|在嗎|在不在|有人吗|有人嗎|有人在吗|有人在嗎)",
    r"(こんにちは|こんばんは|おはよう|おはようございます|やあ|どうも|はじめまして)",
    r"(안녕|안녕하세요|안녕하십니까)",
    r"(hola|bonjour|salut|coucou|hallo|servus|hej|hejsan|ciao|saluton|ola|olá|privet|привет)",
)


def is_greeting(text: Column) -> Column:
    t = F.lower(F.trim(F.regexp_replace(F.trim(text), r"[\s!！。.?？~，,、;；:：]+$", "")))
    return F.coalesce((F.length(t) > 0) & (F.length(t) <= 20) & t.rlike("^(?:" + "|".join(GREETINGS) + ")$"), F.lit(False))


#: Languages with names, tags, directions or script families of their own: fixed values.
METADATA = (
    ("English", "English", "en", "ltr", "latin"),
    ("Arabic", "Arabic / العربية", "ar", "rtl", "arabic"),
    ("Persian", "Persian (Farsi / فارسی)", "fa", "rtl", "arabic"),
    ("Hebrew", "Hebrew / עברית", "he", "rtl", "other"),
    ("Chinese", "Chinese", "zh-Hans", "ltr", "cjk"),
    ("Traditional Chinese", "Traditional Chinese", "zh-Hant", "ltr", "cjk"),
    ("Japanese", "Japanese", "ja", "ltr", "cjk"),
    ("Korean", "Korean", "ko", "ltr", "cjk"),
)
#: Languages that a page in another script is told from by their script alone: fixed values.
OWN_SCRIPT = ("Arabic", "Persian", "Hindi", "Thai", "Hebrew")


def _of_language(language: Column, at: int, other: Column) -> Column:
    for row in METADATA:
        other = F.when(language == row[0], F.lit(row[at])).otherwise(other)
    return other


def language_metadata(language: Column) -> Column:
    """``prompt_name, html_lang, direction, script_family``; a language without an entry is written from left to right in
    Latin script and goes by its own name, an empty one by English."""
    own = F.coalesce(F.nullif(language, F.lit("")), F.lit("English"))
    return F.struct(
        _of_language(language, 1, own).alias("prompt_name"), _of_language(language, 2, F.lit(None).cast("string")).alias("html_lang"),
        _of_language(language, 3, F.lit("ltr")).alias("direction"), _of_language(language, 4, F.lit("latin")).alias("script_family"),
    )


def script_family(language: Column) -> Column:
    return _of_language(language, 4, F.lit("latin"))


def text_direction(language: Column) -> Column:
    return _of_language(language, 3, F.lit("ltr"))


def language_matches(content: Column, target: Column) -> Column:
    """Whether a page may be written for a target language, by the first 1500 characters without front matter, code and
    formulas; fewer than 20 pass. Targets in Chinese, Japanese or Korean take each other, those with a script of their
    own only themselves, and all others what is in neither (languages of one script family aside)."""
    ends = "\n---\n"
    body = _once(content, lambda c: _once(F.locate(ends, c, 4), lambda at: F.when(at > 0, F.substr(c, at + len(ends))).otherwise(c)))
    for mark, gone in (("```", r"```[\s\S]*?```"), ("$$", r"\$\$[\s\S]*?\$\$"), ("$", r"\$[^$\n]*\$")):
        body = _once(body, lambda b: F.when(F.contains(b, F.lit(mark)), F.regexp_replace(b, gone, "")).otherwise(b))  # noqa: B023
    fits = lambda d: F.when(script_family(target) == "cjk", script_family(d) == "cjk").when(target.isin(*OWN_SCRIPT), d == target).when(d.isin(*OWN_SCRIPT), script_family(d) == script_family(target)).otherwise(script_family(d) != "cjk")
    return _once(F.substring(body, 1, 1500), lambda sample: (F.length(F.trim(sample)) < 20) | _once(detect_language(sample), fits))
