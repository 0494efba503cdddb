"""Words, stems, terms, coverage, slugs and clipping as Spark expressions.

Java's ``\\s`` leaves out the no-break space, so patterns here are (?U) where white space matters.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WORD = r"[\p{L}\p{N}]+"
#: Ends of sentences and clauses.
BREAKS = r"[.!?;:,\n\r|•·()\[\]{}«»\"“”„…—–]+"

#: Suffixes in the order in which they are tried, and spellings of one meaning.
ARTICLE_SUFFIXES = ["овете", "ите", "ата", "ята", "ето", "ото", "ият", "ът", "ят"]
INFLECTION_SUFFIXES = ["ове", "ия", "ии", "ие", "и", "а", "я", "е", "о"]
SYNONYMS = {"веб": "уеб", "web": "уеб", "online": "онлайн", "интернет": "онлайн", "site": "сайт", "website": "сайт", "design": "дизайн"}
MIN_STEM = 3
FIRST_CYRILLIC = "\u0400"  # first character of the block, in byte order as Spark compares strings
#: Bulgarian and English words without a topic.
BULGARIAN_STOPWORDS = """
а аз ако ала бе без беше би бил била били било били благодаря близо бъдат бъде бяха в вас ваш ваша ваше ваши вече
ви вие винаги все всеки всички всичко всяка във въпреки върху г ги го година години да дали два двама две двете ден
днес дни до добре докато дори досега доста друг друга други е едва един една едно ето за зад заедно заради засега
затова защо защото и из или им има имат иска й каза как каква какво както какъв като кога когато което които кой
който колко която къде където към ли м май ме между мен ми много мога могат може моля момента му н на над назад
най напред например нас не него нещо нея ни ние никой нито нищо но някои някой няколко няма обаче около освен
особено от отново още пак по повече повечето под поне поради после почти прави пред преди през при пък първо с са
сам само се сега си след следва сме според сред срещу сте съм със също т така такива такъв там твой те тези ти
то това тогава този той толкова точно трябва тук тъй тя тях у утре ч часа че често чрез ще щом я
нашата нашият нашите нашето наш наши ваша вашата вашият вашите вашето ни нас вас
""".split()
ENGLISH_STOPWORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having "
    "he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()
STOPWORDS = list(dict.fromkeys([*BULGARIAN_STOPWORDS, *ENGLISH_STOPWORDS]))
#: Words that open a question.
QUESTION_WORDS = "как какво какъв каква какви кой коя кое кои кога къде колко защо докога how what why when where which who can should is are do does".split()
#: A deliberately loose Latin form, and the official streamlined one.
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъьюя"
LOOSE = ["a", "b", "v", "g", "d", "e", "z", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "c", "s", "s", "a", "", "u", "a"]
STREAMLINED = ["a", "b", "v", "g", "d", "e", "zh", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "ts", "ch", "sh", "sht", "a", "y", "yu", "ya"]
_FOLDS = [("sht", "s"), ("zh", "z"), ("ch", "c"), ("sh", "s"), ("ts", "c"), ("kh", "h"), ("ya", "a"), ("yu", "u"), ("[yj]", "i"), ("w", "v"), (r"(.)\1+", "$1")]
_INVISIBLE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{AD}\\x{61C}\\x{200B}-\\x{200F}\\x{2028}-\\x{202F}\\x{2060}-\\x{206F}\\x{FEFF}\\x{E0000}-\\x{E007F}]"


_WORD, _BREAK, _DASH, _NUMBER, _CYRILLIC_WORD = regex.compile(WORD), regex.compile(BREAKS), regex.compile(r"\p{Pd}"), regex.compile(r"\p{N}+"), regex.compile(r"\p{Cyrillic}+")
_SITE = regex.compile(r"(?<!\p{L})(?:уеб|веб|web)[ \t\n\x0B\f\r-]*(?:сайт|site)s?")


def strip_invisible(s: Column) -> Column:
    return F.regexp_replace(s, _INVISIBLE, "")


def squash(s: Column) -> Column:
    return F.trim(F.regexp_replace(strip_invisible(s), r"(?U)\s+", " "))


def for_compare(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))


@functools.cache
def _unlike_nfkc() -> tuple[str, str]:
    """Pattern of the characters by which a text may differ from its NFKC: those that change, and those that may join the one before;
    and before it a shorter one of what is outside the long runs of others, which most texts do not have."""
    joins = {int(d.split()[1], 16) for d in map(unicodedata.decomposition, map(chr, range(0x110000))) if d and d[0] != "<" and " " in d}
    odd = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (c in joins or 0x1161 <= c < 0x11C3 or unicodedata.combining(chr(c)) or unicodedata.normalize("NFKC", chr(c)) != chr(c))]
    starts = [c for c, before in zip(odd, [-1, *odd]) if c != before + 1]
    ends = [c for c, after in zip(odd, [*odd[1:], -1]) if c + 1 != after]
    listed = lambda pairs: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in pairs)
    plain = [(a, b) for a, b in zip([0, *(e + 1 for e in ends)], [s - 1 for s in starts]) if b < 0x2030 and b - a > 12 or a <= 0x2013 <= b]
    return f"[^{listed(plain)}]", f"[{listed(zip(starts, ends, strict=True))}]"


@F.arrow_udf(StringType())
def _nfkc(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in s.to_pylist()], pa.string())


@F.arrow_udf(ArrayType(StringType()))
def _nfkc_each(s: pa.Array) -> pa.Array:
    return pa.array([None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs] for xs in s.to_pylist()], pa.list_(pa.string()))


def _may_change(s: Column) -> Column:
    rough, exact = _unlike_nfkc()
    return F.when(s.rlike(rough), s.rlike(exact)).otherwise(False)


def nfkc(s: Column) -> Column:
    """Compatibility normalisation, which Spark has no expression for; only texts that it may change leave the JVM."""
    return F.coalesce(_nfkc(F.when(_may_change(s), s)), s)


def nfkc_each(texts: Column) -> Column:
    """nfkc of an array's texts, for those that a lambda looks at."""
    return F.coalesce(_nfkc_each(F.when(F.exists(texts, _may_change), texts)), texts)


def beside(texts: Column, value: Column) -> Column:
    """Each text as field 0 with the value as field 1: a lambda can not take in what a UDF made, but can be given it."""
    return F.arrays_zip(texts, F.array_repeat(value, F.size(texts)))


def fold_spellings(s: Column) -> Column:
    """Lower case, one dash, one word for a web site; without compatibility normalisation."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"\p{Pd}", "-"), r"(?<![\p{L}])(?:уеб|веб|web)[\s-]*(?:сайт|site)s?", "сайт")


def normalize(s: Column) -> Column:
    """fold_spellings after NFKC."""
    return fold_spellings(nfkc(s))


def words(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(f"({WORD})"), F.lit(1))


def tokens(s: Column, plain: bool = False) -> Column:
    """The words of a text that is normalised first; ``plain``: of one whose NFKC has been taken, as within a lambda, where no UDF can stand."""
    whole = s if plain else nfkc(s)
    low = F.lower(whole)
    # a dash ends a word either way; folding changes words of texts that name a site
    folded = F.when(low.contains("site") | low.contains("сайт"), fold_spellings(low)).otherwise(low)
    return F.regexp_extract_all(folded, F.lit(f"({WORD})"), F.lit(1))


def _cut_one(w: Column, suffixes: list[str]) -> Column:
    """The longest suffix that leaves a stem goes: the shortest head is tried first."""
    return F.regexp_replace(w, f"^(.{{{MIN_STEM},}}?)(?:{'|'.join(suffixes)})$", "$1")


def stem(w: Column) -> Column:
    """Of a lower-case word: Cyrillic article and inflection, English plural, then synonyms.

    Chains of single replacements, so that the expression grows with the rules and no further;
    what can not change, most words, is told by a comparison before any pattern is tried.
    """
    cut = F.regexp_replace(_cut_one(_cut_one(w, ARTICLE_SUFFIXES), INFLECTION_SUFFIXES), "^(.{4,})ен$", "$1н")
    latin = F.regexp_replace(w, "^(.{2,})ies$", "$1y")
    latin = F.regexp_replace(latin, "^(?=.{5,}$)(.*(?:ss|sh|ch|x|z))es$", "$1")
    latin = F.regexp_replace(latin, "^(.{2,}[^sui])s$", "$1")
    plain = F.when(w.endswith("s") & w.rlike("^[a-z]+$"), latin).when((w >= FIRST_CYRILLIC) & w.rlike(r"^\p{IsCyrillic}{4,}$"), cut).otherwise(w)
    same = F.when(plain.isin(list(SYNONYMS)), F.try_element_at(F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv]), plain))
    return F.coalesce(same, plain)


def stem_word(w: str) -> str:
    """``stem`` of one lower-case word."""
    out = w
    if len(w) >= 4 and not w.isascii() and _CYRILLIC_WORD.fullmatch(w):
        for suffixes in (ARTICLE_SUFFIXES, INFLECTION_SUFFIXES):
            # as in the expression, the longest that leaves a stem
            fit = max((x for x in suffixes if out.endswith(x) and len(out) - len(x) >= MIN_STEM), key=len, default="")
            out = out[: len(out) - len(fit)]
        if len(out) >= 6 and out.endswith("ен"):
            out = out[:-2] + "н"
    elif w.endswith("s") and w.isascii() and w.isalpha():
        if len(w) > 4 and w.endswith("ies"):
            out = w[:-3] + "y"
        elif len(w) > 4 and w.endswith(("sses", "shes", "ches", "xes", "zes")):
            out = w[:-2]
        elif len(w) > 3 and not w.endswith(("ss", "us", "is")):
            out = w[:-1]
    return SYNONYMS.get(out, out)


class Analyzer:
    """Words of a text's segments as (surface, key, stop, plain), for passes that go over texts in Python: what ``tokens``, ``stem``,
    ``is_stop`` and ``is_number`` say; each word is looked at once as long as it is remembered."""

    def __init__(self, stopwords: list[str] | None = None, keep: int = 200_000):
        self.stop, self.keep, self.known = frozenset(STOPWORDS if stopwords is None else stopwords), keep, {}

    def _of(self, w: str) -> tuple[str, str, bool, bool]:
        if len(self.known) >= self.keep:
            self.known.clear()
        stop = w in self.stop
        out = self.known[w] = (w, w if stop else stem_word(w), stop, len(w) >= 2 and ("a" <= w[0] <= "z" or not _NUMBER.fullmatch(w)))
        return out

    def __call__(self, text: str) -> Iterator[list[tuple[str, str, bool, bool]]]:
        known = self.known
        for segment in _BREAK.split(text):
            folded = segment if segment.isascii() else unicodedata.normalize("NFKC", segment)
            folded = folded.lower()
            if not folded.isascii():
                folded = _DASH.sub("-", folded)
            if "сайт" in folded or "site" in folded:
                folded = _SITE.sub("сайт", folded)
            found = _WORD.findall(folded)
            if found:
                yield [known.get(w) or self._of(w) for w in found]


#: What stands for the end of a segment: no other character becomes it by compatibility normalisation.
_END = "«"
_PARTS, _BREAKS = regex.compile(f"{WORD}|{_END}"), re.compile(BREAKS)
#: The same pattern for texts without characters beyond these, of which both engines say the same.
_FEW_PARTS, _BEYOND = re.compile(rf"[^\W_]+|{_END}"), re.compile("[^\x00-\u052f«»“”„…—–‘’•·]")


def _ascii_table(segments: bool) -> bytes:
    """Letters in lower case and digits as they are, a blank for the rest; what ends a segment as a full stop."""
    end = "." if segments else " "
    return bytes(ord(c.lower() if c.isalnum() else end if _BREAKS.match(c) else " ") for c in map(chr, range(128))) + bytes(128)


_ASCII = {segments: _ascii_table(segments) for segments in (True, False)}


def parts(text: str, segments: bool = True) -> list[str]:
    """The words of a text, as ``tokens`` has them; with ``segments`` « or a full stop wherever one ends."""
    if text.isascii() and "site" not in (low := text.lower()):
        return low.encode().translate(_ASCII[segments]).replace(b".", b" . ").decode().split()
    # a segment ends before normalisation, which may make more of these characters
    whole = unicodedata.normalize("NFKC", _BREAKS.sub(_END, text) if segments else text).lower()
    if not segments:
        whole = whole.replace(_END, " ")
    if "сайт" in whole or "site" in whole:
        whole = _SITE.sub("сайт", _DASH.sub("-", whole))
    return (_PARTS if _BEYOND.search(whole) else _FEW_PARTS).findall(whole)


class Vocabulary(dict):
    """Numbers of the words met, from 1, and what ``Analyzer`` says of each: for passes over texts as arrays. Ends of segments are 0."""

    def __init__(self, stopwords: list[str] | None = None):
        self.analyzer, self.key_of = Analyzer(stopwords), {}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.key_of.clear()
        self.update({_END: 0, ".": 0})
        self.surfaces, self.keys, self.key, self.hashes, self.kind = [""], [""], [0], [0], [0]

    def __missing__(self, w: str) -> int:
        _, key, stop, plain = self.analyzer._of(w)
        number = self[w] = len(self.surfaces)
        at = self.key_of.get(key)
        if at is None:
            at = self.key_of[key] = len(self.keys)
            self.keys.append(key)
        self.surfaces.append(w)
        self.key.append(at)
        self.hashes.append(xxhash.xxh3_64_intdigest(key.encode()))
        self.kind.append(stop + 2 * plain + 4 * (len(w) >= 3))
        return number

    def numbers(self, text: str, segments: bool = True) -> np.ndarray:
        found = parts(text, segments)
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


def is_stop(w: Column, stopwords: list[str] | None = None) -> Column:
    """By the fixed Bulgarian and English lists, or by a list given."""
    return w.isin(STOPWORDS if stopwords is None else stopwords)


def is_number(w: Column) -> Column:
    """Digits only; a letter of the Latin alphabet in front rules it out without a pattern."""
    return ~w.between("a", "{") & w.rlike(r"^\p{N}+$")


def terms(s: Column, stopwords: list[str] | None = None, plain: bool = False) -> Column:
    """Stems of words that are no stop words nor numbers, of two letters or more, in order; ``plain`` as for tokens."""
    kept = F.filter(tokens(s, plain), lambda w: (F.length(w) >= 2) & ~is_stop(w, stopwords) & ~is_number(w))
    return F.transform(kept, stem)


def keyword_terms(s: Column, stopwords: list[str] | None = None) -> Column:
    """Distinct stems of the words with a topic, of all words if none has one."""
    all_words = tokens(s)
    kept = F.filter(all_words, lambda w: ~is_stop(w, stopwords))
    return F.array_distinct(F.transform(F.when(F.size(kept) > 0, kept).otherwise(all_words), stem))


def keyword_key(s: Column, stopwords: list[str] | None = None) -> Column:
    return F.array_join(F.array_sort(keyword_terms(s, stopwords)), " ")


def coverage(kw_terms: Column, text_terms: Column) -> Column:
    """Share of a keyword's terms that a text has; 0 for none."""
    return F.coalesce(F.size(F.array_intersect(kw_terms, text_terms)) / F.nullif(F.size(kw_terms).cast("double"), F.lit(0.0)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0)), F.lit(0.0))


def starts_with_keyword(text_terms: Column, kw_terms: Column) -> Column:
    return (F.size(kw_terms) > 0) & (F.slice(text_terms, F.lit(1), F.greatest(F.size(kw_terms), F.lit(1))) == kw_terms)


def looks_like_question(s: Column) -> Column:
    return F.endswith(F.trim(s), F.lit("?")) | F.coalesce(F.get(words(s), F.lit(0)).isin(QUESTION_WORDS), F.lit(False))


def _spelled(s: Column, table: list[str]) -> Column:
    out = F.lower(s)
    for c, to in zip(CYRILLIC, table, strict=True):
        out = F.replace(out, F.lit(c), F.lit(to))
    return out


def loose_latin(s: Column) -> Column:
    out = _spelled(s, LOOSE)
    for pattern, to in _FOLDS:
        out = F.regexp_replace(out, pattern, to)
    return out


def file_slug(s: Column, most: int = 40) -> Column:
    out = F.regexp_replace(F.regexp_replace(_spelled(s, STREAMLINED), "[^a-z0-9]+", "-"), "^-+", "")
    return F.regexp_replace(F.left(out, F.lit(most)), "-+$", "")


def clip(s: Column, most: int) -> Column:
    """At most so many characters, cut at a blank if one is in the last two fifths, with an ellipsis."""
    clean = squash(s)
    head = F.left(clean, F.lit(most - 1))
    at = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.instr(head, " ") > 0) & (at > most * 0.6), F.left(head, at)).otherwise(head)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def length_bucket(words_: Column) -> Column:
    return F.when(words_ < 150, "very_short").when(words_ < 400, "short").when(words_ < 900, "medium").when(words_ < 1800, "long").otherwise("very_long")


def segments(s: Column) -> Column:
    """Parts between punctuation that no phrase may cross."""
    return F.filter(F.transform(F.split(s, BREAKS), lambda x: F.trim(x)), lambda x: x != "")


def title_core(title: Column) -> Column:
    """The part before the first separator."""
    return F.trim(F.split(title, r"\s[|–—-]\s|\s?[|»]\s?").getItem(0))


def slug_matches(url: Column, keyword: Column) -> Column:
    """Whether at least half of the keyword's terms that have a spelling of four letters or more, as
    stem or as written, in loose Latin, are in the address's host and path."""
    place = F.try_url_decode(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^?#]*)", 1))
    slug = loose_latin(F.regexp_replace(place, r"[^\p{L}\p{N}]+", ""))
    kept = F.transform(F.filter(tokens(keyword), lambda w: ~is_stop(w)), lambda w: F.struct(stem(w).alias("stem"), w.alias("raw")))
    spelled = F.transform(kept, lambda t: F.struct(t["stem"].alias("stem"), loose_latin(t["stem"]).alias("a"), loose_latin(t["raw"]).alias("b")))
    found = F.transform(
        F.filter(spelled, lambda t: (F.length(t["a"]) >= 4) | (F.length(t["b"]) >= 4)),
        lambda t: F.struct(t["stem"].alias("stem"), ((F.length(t["a"]) >= 4) & F.contains(slug, t["a"]) | (F.length(t["b"]) >= 4) & F.contains(slug, t["b"])).alias("hit")),
    )
    testable = F.size(F.array_distinct(F.transform(found, lambda t: t["stem"])))
    hits = F.size(F.array_distinct(F.transform(F.filter(found, lambda t: t["hit"]), lambda t: t["stem"])))
    return F.coalesce((testable > 0) & (hits * 2 >= testable), F.lit(False))


def keyword_flags(keyword: Column, title: Column, h1: Column, meta: Column, body: Column, url: Column) -> dict[str, Column]:
    """What of a page has the keyword; ``h1`` is an array."""
    kw = keyword_terms(keyword)
    whole = lambda s: coverage(kw, terms(s)) >= 0.999
    none = F.lit("")
    return {
        "in_title": whole(F.coalesce(title, none)), "in_h1": F.coalesce(F.exists(beside(nfkc_each(h1), kw), lambda x: coverage(x["1"], terms(x["0"], plain=True)) >= 0.999), F.lit(False)), "in_url": slug_matches(url, keyword), "in_meta": whole(F.coalesce(meta, none)),
        "title_coverage": coverage(kw, terms(F.coalesce(title, none))), "body_coverage": coverage(kw, terms(F.coalesce(body, none))), "starts_title": starts_with_keyword(terms(F.coalesce(title, none)), kw),
    }


def phrase_of(h1: Column, title: Column) -> Column:
    """What a page is about: its first H1, else its title without the site's name, in lower case; of 4
    to 90 characters and twelve words at most, or nothing."""
    head = F.trim(F.regexp_replace(F.coalesce(h1, F.lit("")), r"(?U)\s+", " "))
    core = F.trim(F.get(F.split(F.coalesce(title, F.lit("")), r"(?U)\s+[|–—·•-]\s+|\s*[|–—·•]\s*"), F.lit(0)))
    fits = lambda s: F.length(s).between(4, 90) & (F.size(F.split(s, r"(?U)\s+")) <= 12)
    return F.lower(F.when(fits(head), head).when(fits(core), core))


def intro_prose(intro: Column, headings: Column, blocks: int = 2) -> Column:
    """The first paragraphs of 40 characters or more that are no headings, joined by a blank."""
    known = F.transform(F.array_compact(headings), for_compare)
    kept = F.filter(F.transform(F.split(intro, r"\n+"), lambda b: F.trim(F.regexp_replace(b, r"(?U)\s+", " "))), lambda b: (F.length(b) >= 40) & ~F.array_contains(known, for_compare(b)))
    return F.array_join(F.slice(kept, 1, blocks), " ")


def faq_questions(subheads: Column, most: int = 12) -> Column:
    """Subheadings that ask something, each once, in order."""
    return F.slice(F.array_distinct(F.filter(subheads, looks_like_question)), 1, most)


def as_question(s: Column) -> Column:
    """Cleaned of list marks, with a question mark and a capital letter."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"^[\s\-–•\d.)]+", ""))
    asked = F.when(clean.endswith("?"), clean).otherwise(F.concat(clean, F.lit("?")))
    return F.concat(F.upper(F.left(asked, F.lit(1))), F.substr(asked, F.lit(2)))


def percent(x: Column) -> Column:
    """0.29 as "29%"."""
    return F.concat(F.floor(x * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def interval(rate: Column, low: Column, high: Column) -> Column:
    """"29% (19–41%)", of equal ends one figure."""
    a, b = percent(low), percent(high)
    return F.concat(percent(rate), F.lit(" ("), F.when(a == b, a).otherwise(F.concat(F.rtrim(a, F.lit("%")), F.lit("–"), b)), F.lit(")"))


def money(usd: Column) -> Column:
    """Two decimals, four below a cent; of unknown prices nothing."""
    return F.when(usd <= 0, "$0").when(usd < 0.01, F.format_string("$%.4f", usd)).otherwise(F.format_string("$%.2f", F.floor(usd * 100 + 0.5) / 100))


def latency(ms: Column) -> Column:
    """"840 ms" or "2.3 s"; a dash where nothing was measured."""
    return F.when(ms.isNull() | (ms <= 0), "—").when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.1f", F.floor(ms / 100 + 0.5) / 10), F.lit(" s")))
