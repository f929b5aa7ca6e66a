"""Names and addresses as Spark expressions; only Unicode folding and transliteration are a vectorised UDF."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import tables as T

#: Unicode-aware, as names are in many scripts.
PUNCTUATION = r"(?U)[^\w\s]|_"
INDIC = r"[ऀ-ൿ]"

_PLAIN = {ord(a): b for a, b in {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}.items()}
for _c in range(0xC0, 0x250):
    _base = unicodedata.normalize("NFKD", chr(_c))[0]
    if _base.isascii() and _base.isalpha():
        _PLAIN.setdefault(_c, _base)
_TO_DEVANAGARI = {first + i: 0x0900 + i for first in T.INDIC_BLOCKS for i in range(0x80)}
_INDIC = re.compile(INDIC)
_LEGAL = [(re.compile(p), word) for p, word in T.TRANSLITERATED_LEGAL]
_SYLLABLE = re.compile(f"([{''.join(T.CONSONANTS)}])([{''.join(T.VOWEL_SIGNS)}{T.HALANT}])?(?=(.?))", re.S)
_SINGLE = str.maketrans(T.VOWELS | T.VOWEL_SIGNS | {c: "n" for c in T.NASALS} | {T.VISARGA: "", T.HALANT: "", T.NUKTA: ""} | {chr(0x966 + i): str(i) for i in range(10)})


def _romanise(word: str) -> str:
    """One Devanagari word: a consonant takes its vowel sign, none after a halant, and "a" before another consonant or a nasal."""
    if word in T.DEVANAGARI_WORDS:
        return T.DEVANAGARI_WORDS[word]

    def syllable(m: re.Match) -> str:
        letter, sign, after = m.groups()
        if sign:
            return T.CONSONANTS[letter] + T.VOWEL_SIGNS.get(sign, "")
        return T.CONSONANTS[letter] + ("a" if after and (after in T.CONSONANTS or after in T.NASALS) else "")

    return _SYLLABLE.sub(syllable, unicodedata.normalize("NFD", word).replace(T.NUKTA, "")).translate(_SINGLE)


def transliterate(text: str) -> str:
    """Indic scripts to Latin, word by word; other texts stay as they are."""
    if not _INDIC.search(text):
        return text
    words = [_romanise(w) for w in text.translate(_TO_DEVANAGARI).split()]
    words = [next((legal for p, legal in _LEGAL if p.fullmatch(w)), w) for w in words]
    return re.sub(r"\blimit t\b", "limited", " ".join(words))


def fold_text(text: str) -> str:
    """NFKC, Latin letters without accents, lower case; other scripts stay."""
    return unicodedata.normalize("NFKC", text).translate(_PLAIN).lower()


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    return s.fillna("").map(lambda x: x.lower() if x.isascii() else fold_text(x))


@F.pandas_udf(StringType())
def fold_name(s: pd.Series) -> pd.Series:
    return s.fillna("").map(lambda x: x.lower() if x.isascii() else fold_text(transliterate(x)))


def _words(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)\s+"), lambda t: t != "")


def undigit(token: Column) -> Column:
    """Digits that stand for letters in a word with at least two letters."""
    letters = F.length(F.regexp_replace(token, r"[^\p{L}]", ""))
    return F.when(token.rlike("[a-z]") & token.rlike("[0-9]") & (letters >= 2), F.translate(token, *T.DIGIT_LETTERS)).otherwise(token)


def join_initials(s: Column) -> Column:
    """Runs of single letters become one word."""
    return F.regexp_replace(s, r"(?<=(^| )\p{L}) (?=\p{L}( |$))", "")


def strip_legal(clean: Column) -> Column:
    """struct(core, legal) of a clean name: legal phrases, then legal words and filler words, go; what was found, sorted."""
    phrases = F.array(*[F.struct(F.lit(f" {p} ").alias("p"), F.lit(c).alias("c")) for p, c in T.LEGAL_PHRASES])
    start = F.struct(F.concat(F.lit(" "), clean, F.lit(" ")).alias("s"), F.array().cast("array<string>").alias("l"))
    step = lambda acc, x: F.struct(F.replace(acc["s"], x["p"], F.lit(" ")).alias("s"), F.when(F.contains(acc["s"], x["p"]), F.array_append(acc["l"], x["c"])).otherwise(acc["l"]).alias("l"))
    classes = F.create_map(*[F.lit(x) for kv in T.LEGAL_WORDS.items() for x in kv])
    filler = lambda t: t.isin(T.HONORIFICS)

    def finish(acc):
        rest = F.filter(F.split(acc["s"], " "), lambda t: t != "")
        core = F.filter(rest, lambda t: ~t.isin(list(T.LEGAL_WORDS)) & ~filler(t))
        all_words = F.filter(F.split(clean, " "), lambda t: t != "")
        kept = F.filter(all_words, lambda t: ~filler(t))
        core = F.when(F.size(core) > 0, core).when(F.size(kept) > 0, kept).otherwise(all_words)
        found = F.filter(F.transform(rest, lambda t: F.try_element_at(classes, t)), lambda c: c.isNotNull())
        legal = F.array_sort(F.array_distinct(F.concat(acc["l"], found)))
        legal = F.when(F.array_contains(legal, "pvt_ltd"), F.array_remove(legal, "ltd")).otherwise(legal)
        return F.struct(F.array_join(core, " ").alias("core"), F.array_join(legal, "|").alias("legal"))

    return F.aggregate(phrases, start, step, finish)


def skeleton(s: Column) -> Column:
    """Consonants with runs collapsed."""
    return F.regexp_replace(F.regexp_replace(s, "[aeiouyh]", ""), r"(.)\1+", "$1")


def phonetic(s: Column) -> Column:
    """A sound key that survives transliteration."""
    for pattern, to in T.PHONETIC:
        s = F.regexp_replace(s, pattern, to)
    return s


def with_names(df: DataFrame, raw: str = "business_name") -> DataFrame:
    """Adds name_clean, name_core, legal, is_domain, is_translit, alias_core, name_concat, name_skel, name_phon."""
    c = F.col
    df = df.withColumns({"is_translit": F.coalesce(c(raw).rlike(INDIC), F.lit(False)), "__s": fold_name(F.col(raw))})
    df = df.withColumn("__s", F.trim(F.regexp_replace(F.replace(c("__s"), F.lit("null"), F.lit(" ")), r"(?U)^\s+|\s+$", "")))
    df = df.withColumns({"__handle": F.regexp_replace("__s", r"^[ \-<>#*]+", "").startswith("@"), "__s": F.regexp_replace("__s", r"(?U)^[\W_]+|[\W_]+$", "")})
    df = df.withColumn("__domain", F.regexp_extract("__s", T.DOMAIN, 1))
    has_domain = c("__domain") != ""
    df = df.withColumns({"is_domain": c("__handle") | has_domain, "__s": F.when(has_domain, F.translate("__domain", "-", " ")).otherwise(c("__s"))})
    df = df.withColumn("__parts", F.split("__s", T.ALIAS_MARKS, -1))
    ampersand = lambda s: F.replace(s, F.lit("&"), F.lit(" and "))
    tidy = lambda s: F.array_join(F.transform(_words(F.regexp_replace(s, PUNCTUATION, " ")), undigit), " ")
    main = F.replace(F.replace(ampersand(F.get("__parts", F.lit(0))), F.lit("m/s"), F.lit(" ")), F.lit("'"), F.lit(""))
    df = df.withColumns({"name_clean": join_initials(tidy(main)), "__alias": tidy(ampersand(F.array_join(F.slice("__parts", 2, 1 << 20), " ")))})
    df = df.withColumns({"__l": strip_legal(c("name_clean")), "alias_core": F.when(c("__alias") != "", strip_legal(c("__alias"))["core"]).otherwise("")})
    df = df.withColumns({"name_core": c("__l.core"), "legal": c("__l.legal"), "name_concat": F.replace(c("__l.core"), F.lit(" "), F.lit(""))})
    df = df.withColumns({"name_skel": skeleton(c("name_concat")), "name_phon": phonetic(c("name_concat"))})
    return df.drop("__s", "__handle", "__domain", "__parts", "__alias", "__l")


def with_addresses(df: DataFrame, raw: str = "business_address", country: str = "country") -> DataFrame:
    """Adds addr_clean, house_no, addr_nums, street, postcode."""
    c = F.col
    df = df.withColumn("__f", fold(F.col(raw)))
    s = F.regexp_replace(F.regexp_replace("__f", r"(?<![a-z])n/a(?![a-z])", " "), r"[ऀ-෿฀-࿿]", " ")
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    common, french = as_map(T.ABBREVIATIONS), as_map(T.ABBREVIATIONS | T.FRENCH_ABBREVIATIONS)
    is_french = F.lower(F.coalesce(c(country), F.lit(""))) == "france"

    def word(t):
        t = F.coalesce(F.when(is_french, F.try_element_at(french, t)).otherwise(F.try_element_at(common, t)), t)
        return F.regexp_replace(t, r"^0+(?=[0-9]+$)", "")

    parts = F.transform(F.split(s, ","), lambda p: F.array_join(F.transform(F.filter(_words(F.regexp_replace(F.translate(p, "#'", "  "), PUNCTUATION, " ")), lambda t: ~t.isin(T.ADDRESS_JUNK)), word), " "))
    df = df.withColumn("__c", F.filter(parts, lambda p: p != ""))
    numbered = F.get(F.filter("__c", lambda p: p.rlike(r"^\d+\s+[a-z].*$")), F.lit(0))
    letters = lambda p: F.length(F.regexp_replace(p, r"[^\p{L}]", ""))
    longest = F.aggregate("__c", F.lit(""), lambda best, p: F.when((letters(p) > letters(best)) | ((best == "") & (p != "")), p).otherwise(best))
    df = df.withColumns({"addr_clean": F.array_join("__c", ", "), "__n": numbered, "postcode": F.regexp_replace(F.regexp_extract("__f", T.POSTCODE, 1), r"\s", "")})
    df = df.withColumn("__nums", F.regexp_extract_all("addr_clean", F.lit(r"\d+"), F.lit(0)))
    df = df.withColumns(
        {
            "house_no": F.coalesce(F.regexp_extract("__n", r"^(\d+)", 1), F.get("__nums", F.lit(0)), F.lit("")),
            "street": F.coalesce(F.regexp_extract("__n", r"^\d+\s+([a-z].*)$", 1), longest),
            "addr_nums": F.array_join(F.array_sort(F.array_distinct(F.filter("__nums", lambda n: n != c("postcode")))), " "),
        }
    )
    return df.drop("__f", "__c", "__n", "__nums")


NORMAL_COLUMNS = (
    "entity_id src country name_clean name_core name_concat name_skel name_phon legal is_domain is_translit alias_core addr_clean house_no addr_nums street postcode"
).split()


def normalize_records(records: DataFrame) -> DataFrame:
    """Records (entity_id, business_name, business_address, country) to the normalised table. Nulls count as empty."""
    df = records.withColumn("src", F.substring("entity_id", 1, 2)).na.fill("", ["business_name", "business_address", "country"])
    return with_addresses(with_names(df)).select(*NORMAL_COLUMNS)
