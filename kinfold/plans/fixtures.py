"""Inputs for the registered queries, derived from the driver's tables, with their DuckDB twins.

Records come from ``documents`` (name and address from words of the text), scored candidates from
``lineitem`` with ``orders`` as the entities. Buckets that SQL must repeat are taken from md5.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import storage
from kinfold.functions import text
from kinfold.operators import blocking as B
from kinfold.operators import decode as D
from kinfold.operators import evaluate as E


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, str] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that several queries start from, written once in an application by the first that needs it.

    Without this each use of a derived table (and a plan uses keys or candidates many times) would read and
    normalise all texts anew.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = storage.shared_dir(spark)
    path = f"{_FOLDERS[app]}/{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}/{name}"
    if not storage.exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


LETTERS = "a-zäöüßéèêàçùâîôûñáíóú0-9"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, src, country, business_name, business_address, truth."""
    return kept(spark, sf_dir, "records", lambda: _records(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), f"[^{LETTERS}]+", " ")).alias("c"))
    docs = docs.withColumn("w", F.split("c", " "))
    src = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    return docs.select(
        F.concat(src, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        src.alias("src"),
        F.col("lang").alias("country"),
        F.array_join(F.slice("w", 1, 4), " ").alias("business_name"),
        F.concat_ws(" ", (F.length("c") % 97).cast("string"), F.array_join(F.slice("w", 5, 5), " ")).alias("business_address"),
        F.md5(F.substring("c", 1, 120)).alias("truth"),
    )


RECORDS_SQL = f"""
docs0 as (select doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^{LETTERS}]+', ' ', 'g')) as c from documents),
records as (
  select 'S' || (doc_id % 3 + 1) || '-' || doc_id as entity_id, 'S' || (doc_id % 3 + 1) as src, lang as country,
    array_to_string(string_split(c, ' ')[1:4], ' ') as business_name,
    (length(c) % 97) || ' ' || array_to_string(string_split(c, ' ')[5:9], ' ') as business_address, md5(substr(c, 1, 120)) as truth
  from docs0
)"""


#: Names and addresses with what texts of documents lack: legal forms, initials, domains, handles, other names, digits for letters, abbreviations, junk, postcodes.
ODD_RECORDS = [
    ("Acme Widgets Private Limited", "12 Main St., N/A, Springfield, 560001", "India"),
    ("The A B C Trading Co. & Sons", "Flat 7, 0012 Park Ave, null, New York 10001", "US"),
    ("www.blue-sky-foods.com", "3 r de la Paix, 75 002 Paris", "France"),
    ("@golden_gate", "", "US"),
    ("Smith's Bakery d/b/a Jones & Co LLC", "#45 Oak Blvd, apt 6, 94107-1234", "US"),
    ("M/S Shree Ram Traders Pvt. Ltd.", "Plot No 9, Sec 21, Opp Market, 110 001 Delhi", "India"),
    ("Gr33n L3af Foods", "unknown", "US"),
    ("Société Générale S.A.R.L. et Cie", "ZI Nord, 5 bd Voltaire, 69003 Lyon", "France"),
    ("ltd", "000, 007 Bond", "UK"),
    ("null", "null, n/a", ""),
    ("  <Café> Zoë formerly Chez Zoë  ", "No. 10, Rue Émile, 1234567", "France"),
    ("L L C Holdings inc opc private limited", "12 12 12, 34 Elm Ct, 12", "US"),
    ("the of and", "Near Post Office, Vill Rampur, Dist Patna 800020", "India"),
    ("http://shop.example.co.in/path", "1 a, 2 b, bb", "India"),
    ("x 1 y 2 z", "Bldg 5; Fl 3 / Ste 200", "US"),
    ("", "", None),
    (None, None, None),
]


def odd_records(spark: SparkSession) -> DataFrame:
    rows = [(f"S{i % 3 + 1}-{i}", *r) for i, r in enumerate(ODD_RECORDS)]
    return spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")


def _literal(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


ODD_SQL = f"""records as (select * from (values {", ".join(f"('S{i % 3 + 1}-{i}', {', '.join(map(_literal, r))})" for i, r in enumerate(ODD_RECORDS))}) as t(entity_id, business_name, business_address, country))"""


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised table of the records by the full normaliser."""
    return kept(spark, sf_dir, "normalized", lambda: text.normalize_records(records(spark, sf_dir)))


def plain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "plain_keys", lambda: B.build_keys(plain(spark, sf_dir)))


def plain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "plain_candidates", lambda: B.build_candidates(plain_keys(spark, sf_dir)))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A normalised table by rules that SQL can repeat: words as they are, sound and skeleton keys by regular expressions."""
    return kept(spark, sf_dir, "plain", lambda: _plain(spark, sf_dir))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    concat = F.replace(F.col("business_name"), F.lit(" "), F.lit(""))
    house = F.split("business_address", " ")
    return r.select(
        "entity_id", "src", "country", F.col("business_name").alias("name_core"), F.col("business_name").alias("name_clean"), concat.alias("name_concat"), text.skeleton(concat).alias("name_skel"), text.phonetic(concat).alias("name_phon"),
        F.lit("").alias("legal"), F.lit(False).alias("is_domain"), F.lit(False).alias("is_translit"), F.lit("").alias("alias_core"), F.col("business_address").alias("addr_clean"), F.get(house, F.lit(0)).alias("house_no"),
        F.get(house, F.lit(0)).alias("addr_nums"), F.array_join(F.slice(house, 2, 100), " ").alias("street"), F.lit("").alias("postcode"),
    )


def _phonetic_sql(x: str) -> str:
    from kinfold.functions import tables as T

    for pattern, to in T.PHONETIC[:-1]:
        x = f"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return _runs_sql(x)


def _runs_sql(x: str) -> str:
    """Collapse runs; RE2 has no back references, so letter by letter."""
    return f"array_to_string([y for y, i in string_split({x}, '') if i = 1 or y <> string_split({x}, '')[i - 1]], '')"


PLAIN_SQL = f"""{RECORDS_SQL},
plain0 as (
  select entity_id, src, country, business_name as name_core, replace(business_name, ' ', '') as name_concat, business_address as addr_clean,
    string_split(business_address, ' ')[1] as house_no, array_to_string(string_split(business_address, ' ')[2:], ' ') as street, truth from records
), plain as (
  select *, {_runs_sql("regexp_replace(name_concat, '[aeiouyh]', '', 'g')")} as name_skel, {_phonetic_sql("name_concat")} as name_phon from plain0
)"""


def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("entity_id", "src", "country", "truth")
    left = r.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), "country", "truth")
    return left.join(r.where("src <> 'S1'").select(F.col("entity_id").alias("cand_id"), "country", "truth"), ["country", "truth"]).select("s1_id", "cand_id")


TRUTH_SQL = "truth as (select a.entity_id as s1_id, b.entity_id as cand_id from records a join records b using (country, truth) where a.src = 'S1' and b.src <> 'S1')"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, cand_id, prob, label, source, keys: one row a pair."""
    return kept(spark, sf_dir, "scored", lambda: _scored(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("cand_id")).agg(
        F.max(F.round(F.col("l_quantity").cast("double") / 51.0, 6)).alias("prob"),
        F.max(F.col("l_returnflag") == "R").alias("label"),
        F.min(F.when(F.col("l_suppkey") % 2 == 0, "s2").otherwise("s3")).alias("source"),
        F.array_sort(F.collect_set(F.concat(F.lit("k"), F.col("l_linenumber").cast("string")))).alias("keys"),
    )


def scored_with_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates of a blocking that misses every tenth pair, true ones among them."""
    return scored(spark, sf_dir).where((F.col("s1_id") * 7 + F.col("cand_id")) % 10 != 0)


SCORED_SQL = """
c as (
  select l_orderkey as s1_id, l_partkey as cand_id, max(round(l_quantity::double / 51.0, 6)) as prob, bool_or(l_returnflag = 'R') as label,
    min(case when l_suppkey % 2 = 0 then 's2' else 's3' end) as source, list_sort(list(distinct 'k' || l_linenumber)) as keys
  from lineitem group by 1, 2
), e as (
  select o_orderkey as s1_id, o_orderpriority as grp, coalesce(n_true, 0)::bigint as n_true from orders
  left join (select s1_id, count(*) filter (where label) as n_true from c group by 1) t on t.s1_id = o_orderkey
), a as (
  select * replace (case when prob >= max(prob) over (partition by cand_id) then prob else 0.0 end as prob) from c
)"""


#: The same with candidates that miss every tenth pair; the truth is that of all pairs.
MISSES_SQL = SCORED_SQL.replace("\nc as (", "\nc0 as (", 1).replace("), e as (", "), c as (select * from c0 where (s1_id * 7 + cand_id) % 10 <> 0\n), e as (", 1).replace("filter (where label) as n_true from c group", "filter (where label) as n_true from c0 group", 1)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, grp, n_true of every entity, by the truth."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id"), F.col("o_orderpriority").alias("grp"))
    return E.with_n_true(orders, scored(spark, sf_dir).where("label"))


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.assign_owner(scored(spark, sf_dir))
