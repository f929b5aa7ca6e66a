"""DuckDB twins of the string similarities, as steps of a query.

A longest common subsequence is counted with a bit for each character of x in a HUGEINT, so x may have 125
characters at most; the fixtures' names and addresses are far shorter, and a longer one fails aloud.
"""

from __future__ import annotations

WORDS = "list_sort(list_distinct([t for t in string_split({}, ' ') if t <> '']))"
#: Jaro-Winkler compares bytes there, so letters beyond ASCII become capitals, one for one; names hold none.
BEYOND, CAPITALS = "äöüßéèêàçùâîôûñáíóú", "ABCDEFGHIJKLMNOPQRS"


def joined(words: str) -> str:
    return f"coalesce(array_to_string({words}, ' '), '')"


def sorted_words(x: str) -> str:
    return joined(f"list_sort([t for t in string_split({x}, ' ') if t <> ''])")


def winkler(x: str, y: str) -> str:
    one, two = (f"translate({c}, '{BEYOND}', '{CAPITALS}')" for c in (x, y))
    return f"case when {x} = {y} then 1.0 when {x} = '' or {y} = '' then 0.0 else jaro_winkler_similarity({one}, {two}) end"


def steps(ratios: str, sets: str) -> str:
    """Steps ``rated`` (x, y, r) and ``token_sets`` (x, y, v), for the pairs (x, y) that the two queries give."""
    return f"""
words as (select x, y, {WORDS.format("x")} as wx, {WORDS.format("y")} as wy from (select distinct x, y from ({sets}))),
halves as (select *, {joined("[t for t in wx if list_contains(wy, t)]")} as shared, [t for t in wx if not list_contains(wy, t)] as l, [t for t in wy if not list_contains(wx, t)] as r from words),
sides as (select *, trim(shared || ' ' || {joined("l")}) as u, trim(shared || ' ' || {joined("r")}) as v from halves),
asked as (select x, y from ({ratios}) union select u, v from sides union select shared, u from sides union select shared, v from sides),
letters as (select x, c, bit_or(1::hugeint << (i - 1)::int) as bits from (select x, unnest(string_split(x, '')) as c, unnest(range(1, length(x) + 1)) as i from (select distinct x from asked where x <> '')) group by x, c),
places as (select x, map(list(c), list(bits)) as mask, (1::hugeint << length(x)::int) - 1 as full_row from letters group by x),
hits as (select x, y, [coalesce(mask[c], 0::hugeint) for c in string_split(y, '')] as h, full_row from asked join places using (x) where x <> y and y <> ''),
common as (select x, y, length(x) - bit_count(list_reduce(h, lambda v, k: ((v + (v & k)) | (v - (v & k))) & full_row, full_row)) as n from hits),
rated as (select x, y, case when x = y then 1.0::double else 2.0::double * coalesce(n, 0) / (length(x) + length(y)) end as r from asked left join common using (x, y)),
token_sets as (
  select s.x, s.y, case when len(wx) = 0 or len(wy) = 0 then 0.0 when shared <> '' and (len(l) = 0 or len(s.r) = 0) then 1.0 when shared = '' then a.r else greatest(a.r, b.r, c.r) end as v
  from sides s join rated a on a.x = u and a.y = s.v join rated b on b.x = shared and b.y = u join rated c on c.x = shared and c.y = s.v
)"""


def partial(pairs: str) -> tuple[str, str, str]:
    """Steps up to ``windows`` (x, y, of_x, of_y), the pairs they ask for, and the step ``slid`` (x, y, v) that follows ``rated``."""
    windows = f"""
short as (select x, y, case when length(x) > length(y) then y else x end as a, case when length(x) > length(y) then x else y end as b from (select distinct x, y from ({pairs}))),
windows as (select of_x, of_y, a as x, substr(b, greatest(k, 0) + 1, k + length(a) - greatest(k, 0)) as y from (select x as of_x, y as of_y, a, b, unnest(range(1 - length(a), length(b))) as k from short where a <> ''))"""
    slid = """
slid as (select s.x, s.y, case when a = '' then (b = '')::int::double else best end as v from short s left join (select of_x, of_y, max(r) as best from windows join rated using (x, y) group by 1, 2) on of_x = s.x and of_y = s.y)"""
    return windows, "select x, y from windows", slid
