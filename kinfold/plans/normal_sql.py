"""DuckDB twins of name and address normalisation, for records in Latin letters.

The SQL has no lookaround and no transliteration; the fixtures' texts hold neither Indic letters nor letters that
the accents' removal leaves, and tests of the functions hold those cases.
"""

from __future__ import annotations

from kinfold.functions import tables as T

from . import fixtures as X0


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    return f"[{', '.join(map(quoted, xs))}]"


def mapped(d: dict[str, str]) -> str:
    return f"map {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in d.items())}}}"


def folded(x: str) -> str:
    return f"lower(strip_accents(replace(coalesce({x}, ''), 'ß', 'ss')))"


def words(x: str) -> str:
    return rf"[t for t in string_split_regex({x}, '\s+') if t <> '']"


def spaced(x: str) -> str:
    """Punctuation as spaces."""
    return rf"regexp_replace({x}, '[^\w\s]|_', ' ', 'g')"


def tidied(x: str) -> str:
    """The words, digits that stand for letters put back."""
    letters = "length(regexp_replace(t, '[^a-z]', '', 'g')) >= 2"
    change = f"case when {letters} and regexp_matches(t, '[0-9]') then translate(t, {', '.join(map(quoted, T.DIGIT_LETTERS))}) else t end"
    return f"[{change} for t in {words(spaced(x))}]"


def text_of(xs: str, between: str = " ") -> str:
    return f"coalesce(array_to_string({xs}, {quoted(between)}), '')"


def _names() -> str:
    single = lambda t: f"regexp_matches({t}, '^[a-z]$')"
    initials = f"{text_of(f'''[case when i = 1 or ({single('t')} and {single('ws[i - 1]')}) then t else ' ' || t end for t, i in ws]''', '')}"
    both = lambda x: f"replace({x}, '&', ' and ')"
    found = "phrases0 as (select distinct x, ' ' || x || ' ' as s, []::varchar[] as l from (select name_clean as x from cleaned union select alias from cleaned))"
    for i, (phrase, form) in enumerate(T.LEGAL_PHRASES, 1):
        p = quoted(f" {phrase} ")
        found += f",\nphrases{i} as (select x, replace(s, {p}, ' ') as s, case when contains(s, {p}) then list_append(l, {quoted(form)}) else l end as l from phrases{i - 1})"
    filler, legal = listed(T.HONORIFICS), mapped(T.LEGAL_WORDS)
    return rf"""
n1 as (select entity_id, regexp_matches(coalesce(business_name, ''), '[ऀ-ൿ]') as is_translit, trim(regexp_replace(replace({folded("business_name")}, 'null', ' '), '^\s+|\s+$', '', 'g')) as s from records),
n2 as (select entity_id, is_translit, starts_with(regexp_replace(s, '^[ \-<>#*]+', ''), '@') as handle, regexp_replace(s, '^[\W_]+|[\W_]+$', '', 'g') as s from n1),
n3 as (select *, regexp_extract(s, {quoted(T.DOMAIN)}, 1) as domain from n2),
n4 as (select entity_id, is_translit, handle or domain <> '' as is_domain, string_split_regex(case when domain <> '' then replace(domain, '-', ' ') else s end, {quoted(T.ALIAS_MARKS)}) as parts from n3),
n5 as (select *, {tidied("replace(replace(" + both("parts[1]") + ", 'm/s', ' '), '''', '')")} as ws, {text_of(tidied(both(text_of("parts[2:]"))))} as alias from n4),
cleaned as (select *, {initials} as name_clean from n5),
{found},
l1 as (select x, l, [t for t in string_split(s, ' ') if t <> ''] as rest, [t for t in string_split(x, ' ') if t <> ''] as every from phrases{len(T.LEGAL_PHRASES)}),
l2 as (select x, every, [t for t in rest if not list_contains(map_keys({legal}), t) and not list_contains({filler}, t)] as core, [t for t in every if not list_contains({filler}, t)] as meant,
  list_sort(list_distinct(list_concat(l, [{legal}[t] for t in rest if list_contains(map_keys({legal}), t)]))) as legal from l1),
stripped as (select x, {text_of("case when len(core) > 0 then core when len(meant) > 0 then meant else every end")} as core, {text_of("[f for f in legal if f <> 'ltd' or not list_contains(legal, 'pvt_ltd')]", "|")} as legal from l2),
n6 as (select entity_id, name_clean, a.core as name_core, replace(a.core, ' ', '') as name_concat, a.legal as legal, is_domain, is_translit, case when alias <> '' then b.core else '' end as alias_core
  from cleaned join stripped a on a.x = name_clean join stripped b on b.x = alias)"""


def names(records: str) -> str:
    return f"""with {records}, {_names()}
select *, {X0._runs_sql("regexp_replace(name_concat, '[aeiouyh]', '', 'g')")} as name_skel, {X0._phonetic_sql("name_concat")} as name_phon from n6"""


def _addresses() -> str:
    common, french = mapped(T.ABBREVIATIONS), mapped(T.ABBREVIATIONS | T.FRENCH_ABBREVIATIONS)
    full = rf"regexp_replace(coalesce(case when french then {french}[t] else {common}[t] end, t), '^0+([0-9]+)$', '\1')"
    part = f"[{full} for t in {words(spaced(quoted_translate('p')))} if not list_contains({listed(T.ADDRESS_JUNK)}, t)]"
    return rf"""
a1 as (select entity_id, lower(country) = 'france' as french, {folded("business_address")} as f from records),
a2 as (select *, regexp_replace(regexp_replace(f, '(^|[^a-z])n/a($|[^a-z])', '\1 \2', 'g'), '[ऀ-෿฀-࿿]', ' ', 'g') as s from a1),
a3 as (select *, [q for q in [{text_of(part)} for p in string_split(s, ',')] if q <> ''] as c,
  regexp_replace(regexp_extract(f, '(?:^|[^0-9])(\d{{6}}|\d{{5}}|\d{{3}}\s\d{{3}})(?:$|[^0-9])', 1), '\s', '', 'g') as postcode from a2),
a4 as (select *, {text_of("c", ", ")} as addr_clean, [p for p in c if regexp_matches(p, '^\d+\s+[a-z].*$')][1] as numbered,
  coalesce(list_sort([{{'k': -length(regexp_replace(p, '[^a-z]', '', 'g')), 'i': i, 'p': p}} for p, i in c])[1].p, '') as longest from a3),
a5 as (select *, regexp_extract_all(addr_clean, '\d+') as nums from a4)"""


def quoted_translate(x: str) -> str:
    return f"translate({x}, '#''', '  ')"


def addresses(records: str) -> str:
    return rf"""with {records}, {_addresses()}
select entity_id, addr_clean, coalesce(regexp_extract(numbered, '^(\d+)', 1), nums[1], '') as house_no, {text_of("list_sort(list_distinct([n for n in nums if n <> postcode]))")} as addr_nums,
  coalesce(regexp_extract(numbered, '^\d+\s+([a-z].*)$', 1), longest) as street, postcode from a5"""


#: Names in Indic scripts: whole words of the table, syllables, spellings of legal forms, digits, dotted letters.
INDIC_NAMES = [
    "राम ट्रेडर्स प्राइवेट लिमिटेड", "श्री कृष्णा फूड्स", "अमृत दुग्ध केंद्र", "गौरव संस्कृति भवन", "ज़रीना बाज़ार", "मदन २०२४", "દિલીપ પ્રાયવેટ લિમિટેડ", "রবীন্দ্র ভবন", "ராஜா மளிகை",
    "తెలుగు సంఘం", "ಮೈಸೂರು ಸಿಲ್ಕ್", "ਪੰਜਾਬ ਢਾਬਾ", "കേരള ആയുർവേദ", "ABC राम Pvt", "दुःख हरण", "plain name", "", "प्रा. लि. न्यू भारत",
]


def transliterated() -> str:
    """Word by word: a known word, else letter by letter (a consonant before another or a nasal has an "a"), then the legal forms."""
    import unicodedata

    bases = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0x900, 0x980) if len(unicodedata.normalize("NFD", chr(c))) > 1}
    plain = f"replace(translate(w, {quoted(''.join(bases))}, {quoted(''.join(bases.values()))}), {quoted(T.NUKTA)}, '')"
    consonants, closes = listed(T.CONSONANTS), listed([*T.CONSONANTS, *T.NASALS])
    rest = T.VOWELS | T.VOWEL_SIGNS | dict.fromkeys(T.NASALS, "n") | dict.fromkeys((T.VISARGA, T.HALANT, T.NUKTA), "") | {chr(0x966 + i): str(i) for i in range(10)}
    letter = f"case when list_contains({consonants}, c) then {mapped(T.CONSONANTS)}[c] || case when i < len(cs) and list_contains({closes}, cs[i + 1]) then 'a' else '' end else coalesce({mapped(rest)}[c], c) end"
    legal = " ".join(f"when regexp_full_match(r, {quoted(p)}) then {quoted(word)}" for p, word in T.TRANSLITERATED_LEGAL)
    names = ", ".join(f"({i}, {quoted(x)})" for i, x in enumerate(INDIC_NAMES))
    return rf"""with names as (select * from (values {names}) as t(name_id, name)),
moved as (select name_id, name, {text_of("[case when ord(c) between 2432 and 3455 then chr(2304 + ord(c) % 128) else c end for c in string_split(name, '')]", "")} as s from names where regexp_matches(name, '[ऀ-ൿ]')),
cut as (select name_id, unnest(x) as w, unnest(range(1, len(x) + 1)) as k from (select name_id, {words("s")} as x from moved)),
split as (select *, string_split({plain}, '') as cs from cut),
roman as (select name_id, k, coalesce({mapped(T.DEVANAGARI_WORDS)}[w], {text_of(f"[{letter} for c, i in cs]", "")}) as r from split),
done as (select name_id, regexp_replace(string_agg(case {legal} else r end, ' ' order by k), '\blimit t\b', 'limited', 'g') as latin from roman group by 1)
select name_id::int as name_id, lower(coalesce(latin, name)) as latin from names left join done using (name_id)"""
