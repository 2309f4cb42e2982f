"""Text that looks the same but is made of other characters (problem 2).

Method: the corpus gives a vocabulary of clean spellings. Every suspect token is walked, as it stands,
over tries of them by a weighted edit automaton: edges between look-alikes cost nothing, ignorable
characters are read for nothing, any other edit costs one. A short token must be met at no cost, a
longer one may hold one edit, which is left as it is: the spelling then tells what the look-alikes
around it stand for. The cheapest spelling, among these the most frequent, makes the token's form,
and with it decides whether the value is a case; only tokens that no spelling matches are put right
by table. A spelling is dealt to the slices of its whole class and of both halves of it, one of which
is whole in any token an edit away.

One pass over the values does both jobs: Arrow's regular expressions (linear time, over whole
batches) pick out the values with a character of interest, which are dissected, and the words of all
others are counted, combined before the shuffle.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import partitions_of, stored
from ..sources.tables import table

# Look-alike letters; each row is one shape in Latin, Cyrillic and Greek.
SHAPES = """
a а α|c с|e е|h һ|i і ι|j ј|k к κ|o о ο|p р ρ|s ѕ|v ѵ ν|x х χ|y у γ|d ԁ|q ԛ|w ԝ|u υ|n ո
A А Α|B В Β|C С|E Е Ε|H Н Η|I І Ι|J Ј|K К Κ|M М Μ|N Ν|O О Ο|P Р Ρ|S Ѕ|T Т Τ|X Х Χ|Y У Υ|Z Ζ
"""
# Letters and digits of the Arabic script that look like those on the right.
TO_PERSIAN = dict(zip("يىكہەھ٠١٢٣٤٥٦٧٨٩", "ییکههه۰۱۲۳۴۵۶۷۸۹", strict=True))
TO_ARABIC = dict(zip("یکہەھ", "يكههه", strict=True))
# Characters that show nothing, and blanks other than the ordinary one.
IGNORABLE = "\u00ad\u061c\u0640\u180e\u200b\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
BLANKS = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
JOINER, EMOJI_JOINER, EMOJI_STYLE = "\u200c", "\u200d", "\ufe0f"
# Frequent words that tell Persian from Arabic (written with Persian letters).
PERSIAN_WORDS = frozenset("از به که را این است با برای تا شما هر هم یا ما می های های آن دارد دارند باشد شود کند هستید بسیار یک و\u200c چون ولی هزار درصد".split())
ARABIC_WORDS = frozenset("فی من علی الی هذه هذا عن مع التی الذی ان او کل قبل بعد عند ذلک کنت نحن هل لم لا".split())

_LATIN_OF, _CYRILLIC_OF = {}, {}
for _row in SHAPES.replace("\n", "|").split("|"):
    if _row:
        _latin, *_others = _row.split()
        for _c in _others:
            _LATIN_OF[_c] = _latin
            if "Ѐ" <= _c <= "ӿ" and _c not in "іѕјһԁԛԝѵІЅЈ":
                _CYRILLIC_OF[_latin] = _c
#: Letters of Russian; other Cyrillic ones occur in no language of the values.
_RUSSIAN = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")

_ARABIC_LETTER = "\\u0620-\\u064A\\u066E-\\u06D3\\u06FA-\\u06FF"
_AL = "\\x{0620}-\\x{064A}\\x{066E}-\\x{06D3}\\x{06FA}-\\x{06FF}"


def _changed() -> str:
    """The characters that tables or compatibility forms change wherever they stand, as ranges (RE2).

    All ignorable ones but the emoji joiner, whose neighbours decide; blanks; letters, marks and numbers
    that have another form or are composed with what stands before them; marks of other width.
    """
    points = {ord(c) for c in (*_LATIN_OF, *TO_PERSIAN, *IGNORABLE, *BLANKS)} - {ord(EMOJI_JOINER)}
    for point in range(0x80, 0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] in "LMN" or "！" <= c <= "･" or "︐" <= c <= "﹫":
            if unicodedata.normalize("NFC", unicodedata.normalize("NFKC", c)) != c:
                points.add(point)
            parts = unicodedata.decomposition(c).split()
            if len(parts) == 2 and parts[0][0] != "<":
                points.add(int(parts[1], 16))
    points.update(range(0x1161, 0x1176), range(0x11A8, 0x11C3))  # Hangul is composed by rule
    ranges: list[list[int]] = []
    for point in sorted(points):
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges)


#: A superset of the values that may hold a case (RE2).
SUSPECT = (
    f"[{_changed()}"
    "\\x{00AD}\\x{061C}\\x{0640}\\x{180E}\\x{200B}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FEFF}"
    "\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}"
    "\\x{0300}-\\x{0338}\\x{0653}-\\x{0655}\\x{0370}-\\x{052F}\\x{FB00}-\\x{FB06}\\x{FB1D}-\\x{FDFD}\\x{FE10}-\\x{FE19}\\x{FE30}-\\x{FE6B}\\x{FE70}-\\x{FEFC}\\x{FF01}-\\x{FFEE}"
    "\\x{0629}\\x{0623}\\x{0625}\\x{0649}\\x{064A}\\x{0643}\\x{0660}-\\x{0669}\\x{06BE}\\x{06C1}\\x{06D5}\\x{2100}-\\x{214F}\\x{2160}-\\x{217F}\\x{2460}-\\x{24FF}"
    "\\x{1D400}-\\x{1D7FF}\\x{1F100}-\\x{1F189}]"
    f"|^\\x{{200C}}|\\x{{200C}}$|[^{_AL}\\x{{064B}}-\\x{{0652}}]\\x{{200C}}|\\x{{200C}}[^{_AL}]"
    "|^\\x{200D}|\\x{200D}$|[^\\pS\\x{FE0F}]\\x{200D}|\\x{200D}[^\\pS]|[\\pL ]\\x{FE0F}"
)

_TOKEN = regex.compile(f"[\\p{{L}}\\p{{M}}\\p{{N}}{IGNORABLE}{JOINER}_]+")
_CYRILLIC = regex.compile("[\\u0400-\\u052f]")
_ARABIC = regex.compile(f"[{_ARABIC_LETTER}]")
_DROP = str.maketrans("", "", IGNORABLE)
_NO_JOINER = regex.compile(f"(?<![{_ARABIC_LETTER}\\u064B-\\u0652]){JOINER}|{JOINER}(?![{_ARABIC_LETTER}])")
_SPACE = str.maketrans(dict.fromkeys(BLANKS, " "))


@lru_cache(200_000)
def _plain(token: str) -> str:
    """Compatibility forms resolved and letters composed; nothing invisible is left."""
    plain = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", token.translate(_DROP)))
    while JOINER * 2 in plain:
        plain = plain.replace(JOINER * 2, JOINER)
    # Joiners count only between two letters of the Arabic script.
    return _NO_JOINER.sub("", plain) if JOINER in plain else plain


def shape(token: str) -> str:
    """The look-alike class of a token: equal for tokens that look the same."""
    return "".join(TO_PERSIAN.get(c) or _LATIN_OF.get(c, c) for c in _plain(token))


def language_of(value: str) -> str:
    """'fa', 'ar', 'ru' or 'la', by script and, within the Arabic script, by words and letters."""
    plain = _plain(value) if len(value) < 200 else unicodedata.normalize("NFKC", value)
    arabic, cyrillic = len(_ARABIC.findall(plain)), len(_CYRILLIC.findall(plain))
    latin = sum(1 for c in plain if c < "ɐ" and c.isalpha())
    if arabic and arabic * 3 >= max(latin, cyrillic):
        score = 0
        for word in regex.findall("[\\p{L}\\p{M}]+", plain):
            folded = "".join(TO_PERSIAN.get(c, c) for c in word)
            score += (folded in PERSIAN_WORDS) + sum(c in "پچژگ" for c in word)
            score -= (folded in ARABIC_WORDS) + (word.startswith("ال") and len(word) > 4) + sum(c in "ةإ" for c in word)
        return "fa" if score >= 0 else "ar"
    return "ru" if cyrillic > latin else "la"


def _script_of(token: str, language: str) -> str:
    """Latin or Cyrillic, by the letters that have no twin; failing those, by the value."""
    for c in token:
        if c in _RUSSIAN and c not in _LATIN_OF:
            return "ru"
        if c.isascii() and c.isalpha() and c not in _CYRILLIC_OF or (c.isalpha() and "À" <= c < "ɐ"):
            return "la"
    return "ru" if language == "ru" else "la"


def by_table(token: str, language: str) -> tuple[str, str, bool]:
    """(form by table, language of the token, whether the token is surely a disguise)."""
    bare = token.translate(_DROP)
    plain = _plain(token)
    sure = plain != bare or bare != token
    if _ARABIC.search(plain) or regex.search("[٠-٩]", plain):
        own = "ar" if language == "ar" else "fa"
        fixed = "".join((TO_ARABIC if own == "ar" else TO_PERSIAN).get(c, c) for c in plain)
        return fixed, own, sure or fixed != plain
    letters = [c for c in plain if c.isalpha()]
    foreign = [c for c in letters if c in _LATIN_OF]
    cyrillic = any("Ѐ" <= c <= "ԯ" for c in letters)
    if not foreign and not (cyrillic or language == "ru"):
        return plain, "la", sure
    own = _script_of(plain, language)
    if own == "ru":
        fixed = "".join(_CYRILLIC_OF.get(c, c) if c.isascii() else _CYRILLIC_OF.get(_LATIN_OF.get(c, ""), c) if c not in _RUSSIAN and c in _LATIN_OF else c for c in plain)
        mixed = any(c in _RUSSIAN and c not in _LATIN_OF for c in letters)
    else:
        if cyrillic and any(c in _RUSSIAN and c not in _LATIN_OF for c in letters):
            return plain, "ru", sure
        fixed = "".join(_LATIN_OF.get(c, c) for c in plain)
        mixed = any(c.isascii() or c < "ɐ" for c in letters) or any(c in "іѕјһԁԛԝѵІЅЈ" for c in letters)
    return fixed, own, sure or (fixed != plain and mixed)


def dissect(value: str, persian: bool = False) -> tuple[str, list[str], list[tuple[int, str, str, str, bool]]]:
    """Language, parts, and of the suspect parts (place, token, form by table, language, sure).

    ``persian``: the Arabic script is known to be Persian here.
    """
    language = language_of(value)
    if persian and language == "ar":
        language = "fa"
    parts: list[str] = []
    asks: list[tuple[int, str, str, str, bool]] = []
    at = 0
    for m in _TOKEN.finditer(value):
        token = m.group()
        if token.isascii() and not (language == "ru" and all(c in _CYRILLIC_OF for c in token)):
            continue
        before = value[m.start() - 1] if m.start() else ""
        if not any(c.isalnum() for c in token):
            # Marks and joiners alone: fit in an emoji, else nothing is needed there.
            usual = before and not before.isspace() and unicodedata.category(before)[0] == "S"
            after = value[m.end() : m.end() + 1]
            if usual and (set(token) <= {EMOJI_STYLE} or (set(token) <= {EMOJI_STYLE, EMOJI_JOINER} and after and unicodedata.category(after)[0] == "S")):
                continue
            kept = "".join(c for c in token if c not in IGNORABLE and c not in (JOINER, EMOJI_STYLE))
            if kept == token:
                continue
            parts += [_gap(value[at : m.start()]), kept]
            at = m.end()
            continue
        fixed, own, sure = by_table(token, language)
        if fixed == token:
            continue
        parts.append(_gap(value[at : m.start()]))
        asks.append((len(parts), token, fixed, own, sure))
        parts.append(token)
        at = m.end()
    parts.append(_gap(value[at:]))
    return language, parts, asks


def _gap(text: str) -> str:
    """What lies between suspect tokens, with ordinary blanks and marks of ordinary width."""
    if text.isascii():
        return text
    return "".join(
        unicodedata.normalize("NFKC", c) if "！" <= c <= "･" or "︐" <= c <= "﹫" and c != EMOJI_STYLE else c
        for c in text.translate(_SPACE))


#: Letters from which a token may differ from a spelling by one edit.
EDIT_LETTERS = 6
#: Letters that look like each other, by class.
_TWINS: dict[str, tuple[str, ...]] = {}
for _c, _v in (*_LATIN_OF.items(), *TO_PERSIAN.items()):
    _TWINS[_v] = (*_TWINS.get(_v, (_v,)), _c)
_OWN = {"fa": TO_PERSIAN, "ar": TO_ARABIC, "la": _LATIN_OF, "ru": {}}


def budget_of(word: str) -> int:
    return 1 if len(word) >= EDIT_LETTERS else 0


def slices_of(word: str) -> list[str]:
    """The slices that hold every spelling within the budget of a token of this class.

    If the edit lies in the later half of a spelling of ``n`` letters, its first ``n // 2`` letters begin the
    token, else its last ``n // 2`` letters end it; ``n`` is that of the token, one more or one less.
    """
    found = ["=" + word]
    if budget_of(word):
        n = len(word)
        for half in sorted({(n - 1) // 2, n // 2, (n + 1) // 2}):
            found += ["<" + word[:half], ">" + word[n - half :]]
    return found


def spelling_slices(folded: Column) -> Column:
    """The slices of a clean spelling, by its class."""
    half = F.floor(F.length(folded) / 2).cast("int")
    halves = F.array(F.concat(F.lit("<"), F.substring(folded, F.lit(1), half)), F.concat(F.lit(">"), F.substring(folded, F.length(folded) - half + 1, half)))
    return F.concat(F.array(F.concat(F.lit("="), folded)), F.when(F.length(folded) >= EDIT_LETTERS - 1, halves).otherwise(F.array().cast("array<string>")))


class LookalikeTrie:
    """Clean spellings as they are written, searched by a weighted edit automaton."""

    def __init__(self, language: str = "la") -> None:
        self.root: dict = {}
        self.own = _OWN[language]

    def add(self, spelling: str, weight: int) -> None:
        node = self.root
        for c in spelling:
            node = node.setdefault(c, {})
        node[""] = weight

    def search(self, token: str, budget: int | None = None) -> tuple[int, int, str] | None:
        """(cost, weight, form) of the cheapest spelling: look-alikes and ignorables cost 0, other edits 1.

        The form is the spelling, but for the edited letter, which stays the token's own.
        """
        word = _plain(token)
        budget = budget_of(word) if budget is None else budget
        frontier = {(0, id(self.root)): (0, "", self.root)}
        best: tuple[int, int, str] | None = None
        while frontier:
            following: dict = {}

            def reach(i: int, node: dict, cost: int, form: str) -> None:
                key = (i, id(node))
                if cost <= budget and (key not in following or following[key][0] > cost):  # noqa: B023
                    following[key] = (cost, form, node)  # noqa: B023

            for (i, _), (cost, form, node) in frontier.items():
                if i == len(word) and "" in node:
                    found = (cost, node[""], form)
                    if best is None or (-cost, found[1], form) > (-best[0], best[1], best[2]):
                        best = found
                if i < len(word):
                    c = word[i]
                    kind = TO_PERSIAN.get(c) or _LATIN_OF.get(c, c)
                    twins = [x for x in _TWINS.get(kind, (c,)) if x in node]
                    for x in twins:
                        reach(i + 1, node[x], cost, form + x)
                    if cost < budget:
                        kept = form + self.own.get(c, c)
                        reach(i + 1, node, cost + 1, kept)
                        for x, child in node.items():
                            if x and x not in twins:
                                reach(i + 1, child, cost + 1, kept)
                if cost < budget:
                    for x, child in node.items():
                        if x:
                            reach(i, child, cost + 1, form)
            frontier = following
        return best


_ASKS = "array<struct<at:int,token:string,fixed:string,lang:string,sure:boolean,slices:array<string>>>"
_ASK_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("token", pa.string()), ("fixed", pa.string()), ("lang", pa.string()), ("sure", pa.bool_()), ("slices", pa.list_(pa.string()))]))
#: Words that a task counts before it passes the counts on.
COUNTED_WORDS = 100_000
_WORD = regex.compile(f"[\\p{{L}}\\p{{M}}\\p{{N}}{JOINER}]+")


def _dissect_batches(keys: int):
    """Rows of two kinds: a suspect value with its parts, or a clean word with its count."""

    def run(batches):
        seen: Counter = Counter()
        names: list[str] = []
        kinds: list[pa.DataType] = []
        for batch in batches:
            names, kinds = batch.schema.names[:keys], [batch.schema.field(i).type for i in range(keys)]
            doubtful = pc.match_substring_regex(batch.column(keys), SUSPECT)
            for value in batch.column(keys).filter(pc.invert(doubtful)).to_pylist():
                seen.update(_WORD.findall(value))
            rows = batch.filter(doubtful)
            parts, asks = [], []
            for value, persian in zip(rows.column(keys).to_pylist(), rows.column(keys + 1).to_pylist(), strict=True):
                _, p, a = dissect(value, bool(persian))
                parts.append(p)
                places = {at for at, *_ in a}
                seen.update(_WORD.findall(" ".join(x for i, x in enumerate(p) if i not in places)))
                asks.append([{"at": at, "token": t, "fixed": f, "lang": g, "sure": s, "slices": slices_of(shape(t))} for at, t, f, g, s in a])
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(i) for i in range(keys + 1)], pa.array(parts, pa.list_(pa.string())), pa.array(asks, _ASK_TYPE), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())],
                names=[*names, "value", "parts", "asks", "word", "n"])
            if len(seen) >= COUNTED_WORDS:
                yield _counted(seen, names, kinds)
                seen = Counter()
        if seen:
            yield _counted(seen, names, kinds)

    return run


def _counted(seen: Counter, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    n = len(seen)
    return pa.RecordBatch.from_arrays(
        [*[pa.nulls(n, k) for k in kinds], pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, _ASK_TYPE), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
        names=[*names, "value", "parts", "asks", "word", "n"])


def _resolve(_key, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Slices of the classes: a trie for each slice and language, over which its tokens are walked."""
    tries: dict[tuple[str, str], LookalikeTrie] = {}
    for part, lang, word, n in zip(known["slice"], known["lang"], known["word"], known["n"], strict=True):
        if (part, lang) not in tries:
            tries[part, lang] = LookalikeTrie(lang)
        tries[part, lang].add(word, n)
    answers = []
    for part, token, lang in zip(asked["slice"], asked["token"], asked["lang"], strict=True):
        found = tries[part, lang].search(token) if (part, lang) in tries else None
        if found is not None:
            answers.append((token, lang, *found))
    return pd.DataFrame(answers, columns=["token", "lang", "cost", "n", "form"])


# The letters of the clean vocabulary, by language.
_CLEAN = {
    "fa": "^(?!.*\\u200c\\u200c)[آابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیئءأؤً\u200c۰-۹]+$",
    "ar": "^[اآأإبتثجحخدذرزسشصضطظعغفقكلمنوهيىئءؤة\u0640ً-ْ٠-٩]+$",
    "la": "^[A-Za-zÀ-ſ0-9]+$",
    "ru": "^[А-Яа-яЁё]+$",
}


def canonical_values(values: DataFrame, keys: list[str], value: str = "value", persian: Column | None = None) -> DataFrame:
    """``keys, value, canonical`` of the values whose canonical form differs from them.

    A value that is null, empty or already in its one consistent form gives no row, so that equal
    looking values are equal once these rows replace theirs. ``persian`` is true where the Arabic
    script cannot be Arabic. Texts are read whole, whatever their length; the key columns must tell
    the values apart; an empty input gives an empty result. Ties between spellings go to the more
    frequent, then the later one in code point order.
    """
    spark = values.sparkSession
    values = values.select(*keys, F.col(value).alias("value"), (F.lit(False) if persian is None else persian).alias("persian")).where(
        F.col("value").isNotNull() & (F.col("value") != ""))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields[:-1]) + f", parts array<string>, asks {_ASKS}, word string, n long"
    passed = stored(values.mapInArrow(_dissect_batches(len(keys)), schema), "dissected")
    doubtful = passed.where("word is null").drop("word", "n")
    words = passed.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))

    asks = doubtful.select(*keys, F.explode("asks").alias("a")).select(*keys, "a.*")
    distinct = asks.groupBy("token", "lang", "sure", "slices", "fixed").count().drop("count")
    tagged = words.select("word", "n", F.explode(F.array_compact(F.array(*[F.when(F.col("word").rlike(p), F.lit(g)) for g, p in _CLEAN.items()]))).alias("lang"))
    folded = F.translate("word", "".join(_LATIN_OF) + "".join(TO_PERSIAN), "".join(_LATIN_OF.values()) + "".join(TO_PERSIAN.values()))
    asked = distinct.select("token", "lang", F.explode("slices").alias("slice")).distinct()
    # Only spellings of a slice that is asked for travel on.
    known = tagged.select("word", "n", "lang", F.explode(spelling_slices(folded)).alias("slice")).join(asked.select("slice").distinct(), "slice", "left_semi")
    n = partitions_of(spark)
    bucket = F.pmod(F.xxhash64("slice"), F.lit(n)).alias("b")
    walked = (
        asked.select(bucket, "slice", "token", "lang").groupBy("b")
        .cogroup(known.select(bucket, "slice", "word", "n", "lang").groupBy("b"))
        .applyInPandas(_resolve, "token string, lang string, cost int, n long, form string"))
    spelt = walked.groupBy("token", "lang").agg(F.max_by("form", F.struct(-F.col("cost"), "n", "form")).alias("form"))
    resolved = distinct.select("token", "lang", "sure", "fixed").distinct().join(spelt, ["token", "lang"], "left").select(
        "token", "lang", "sure", F.coalesce("form", F.when(F.col("sure"), F.col("fixed")).otherwise(F.col("token"))).alias("canonical"))
    fixes = asks.join(resolved, ["token", "lang", "sure"]).where(F.col("canonical") != F.col("token")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("at", "canonical"))).alias("fixes"))
    rebuilt = F.array_join(F.transform("parts", lambda p, i: F.coalesce(F.try_element_at("fixes", i), p)), "")
    return (
        doubtful.join(fixes, keys, "left").select(*keys, "value", F.when(F.col("fixes").isNull(), F.array_join("parts", "")).otherwise(rebuilt).alias("canonical"))
        .where(F.col("canonical") != F.col("value")))


def _fields(spark: SparkSession, root: str) -> DataFrame:
    lead = table(spark, root, "lead").select(
        F.lit("lead").alias("table_name"), F.col("lead_id").alias("row_id"),
        F.explode(F.create_map(F.lit("bio"), "bio", F.lit("business_name"), "business_name", F.lit("city"), "city")).alias("field", "value"))
    result = table(spark, root, "search_result").select(
        F.lit("search_result").alias("table_name"), F.col("result_idx").alias("row_id"), F.lit("snippet").alias("field"), F.col("snippet").alias("value"))
    return lead.unionByName(result)


def p2_canonical(spark: SparkSession, root: str) -> DataFrame:
    """Every value that is not in canonical form, with that form."""
    # Names and cities are Persian, English or Turkish.
    return canonical_values(_fields(spark, root), ["table_name", "row_id", "field"], persian=F.col("field").isin("business_name", "city"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_canonical(spark, root).select("table_name", "row_id", "field")


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical}
