"""Features of candidate pairs: similarities, frequencies, and the pair's place among its neighbours.

-1 stands for "cannot be compared" throughout. Cheap features are native; similarities that Spark lacks
run as vectorised UDFs once the pairs are final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import similarity as S
from kinfold.functions import tables as T

ATTRIBUTES = (
    "name_core name_concat name_skel name_phon name_clean alias_core legal is_domain is_translit addr_clean street house_no addr_nums postcode country"
).split()
BASE = (
    "n_tset n_tsort n_concat_ratio n_concat_partial n_jw n_skel n_clean_ratio n_alias n_idf_overlap n_shared_max_idf n_unshared_max_idf n_len_diff n_tok_a n_tok_b "
    "legal_same legal_conflict legal_missing dom_any translit_any a_tset a_ratio a_street house_eq nums_jacc post_eq addr_empty n_phon nf_s1_a nf_s1_b nf_s1_lg_b nf_t_b "
    "addr_empty_s1 addr_empty_t house_near is_s3 n_keys"
).split()
CONTEXT = ["s1_ncands", "t_ncands", "rank_in_s1", "gap_to_best_s1"]
FEATURES = [*BASE, *[f"k_{k}" for k in T.KEY_KINDS], *CONTEXT]


def idf_table(norm: DataFrame) -> DataFrame:
    """country, tok, idf: ln of all records over the token's occurrences in its country."""
    tokens = norm.select("country", F.explode(F.split("name_core", " ")).alias("tok")).where("tok <> ''")
    n = norm.agg(F.count("*").alias("n"))
    return tokens.groupBy("country", "tok").count().crossJoin(F.broadcast(n)).select("country", "tok", F.ln(F.col("n") / F.col("count")).alias("idf"))  # one row is broadcast


def name_frequency(norm: DataFrame) -> DataFrame:
    """country, name_concat, n_s1, n_t."""
    return norm.groupBy("country", "name_concat").agg(F.count_if(F.col("src") == "S1").alias("n_s1"), F.count_if(F.col("src") != "S1").alias("n_t"))


def legal_frequency(norm: DataFrame) -> DataFrame:
    """country, name_concat, legal, n: reference records with the name and the legal form."""
    return norm.where("src = 'S1'").groupBy("country", "name_concat", "legal").agg(F.count("*").alias("n"))


def target_counts(cands: DataFrame) -> DataFrame:
    """cand_id, t_ncands over all candidates."""
    return cands.groupBy("cand_id").agg(F.count("*").alias("t_ncands"))


def with_attributes(cands: DataFrame, norm: DataFrame, columns=ATTRIBUTES) -> DataFrame:
    """Candidates with the columns of both records, suffixed _a (reference) and _b (target)."""
    side = lambda id_col, suffix: norm.select(F.col("entity_id").alias(id_col), *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    return cands.join(side("s1_id", "_a"), "s1_id").join(side("cand_id", "_b"), "cand_id")


def idf_weights(norm: DataFrame) -> DataFrame:
    """entity_id, w: a map from each distinct name token to its idf. Made once a record, not once a pair."""
    tokens = norm.select("entity_id", "country", F.explode(F.array_distinct(F.filter(F.split("name_core", " "), lambda t: t != ""))).alias("tok"))
    weighed = tokens.join(idf_table(norm), ["country", "tok"])
    return weighed.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tok", "idf")))).alias("w"))


def idf_features(a: Column, b: Column) -> dict[str, Column]:
    """Shared share of the weight of all tokens, heaviest shared and heaviest unshared token (0 where a side is empty)."""
    shared = F.map_filter(a, lambda t, _: F.map_contains_key(b, t))
    rest = F.concat(F.map_values(F.map_filter(a, lambda t, _: ~F.map_contains_key(b, t))), F.map_values(F.map_filter(b, lambda t, _: ~F.map_contains_key(a, t))))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    both = a.isNotNull() & b.isNotNull()
    values = F.map_values(shared)
    share = F.try_divide(total(values), total(values) + total(rest))
    pick = lambda x: F.when(both, F.coalesce(x, F.lit(0.0))).otherwise(F.lit(0.0))
    return {"n_idf_overlap": pick(share), "n_shared_max_idf": pick(F.array_max(values)), "n_unshared_max_idf": pick(F.array_max(rest))}


def _tokens(c: str) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def exact_features() -> dict[str, Column]:
    """The features that need no similarity UDF, from columns suffixed _a and _b and from ``keys``."""
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    either_empty = lambda c: (a(c) == "") | (b(c) == "")
    flag = lambda c: c.cast("int")
    la, lb = F.length("name_core_a"), F.length("name_core_b")
    shared_legal = F.arrays_overlap(F.split("legal_a", "\\|"), F.split("legal_b", "\\|"))
    legal = ~either_empty("legal")
    houses = F.levenshtein(a("house_no"), b("house_no"))
    near = (houses <= 1) | a("house_no").startswith(b("house_no")) | b("house_no").startswith(a("house_no")) | a("house_no").endswith(b("house_no")) | b("house_no").endswith(a("house_no"))
    count = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))) + 1
    out = {
        "n_len_diff": F.abs(la - lb) / F.greatest(la, lb, F.lit(1)),
        "n_tok_a": count("name_core_a"),
        "n_tok_b": count("name_core_b"),
        "legal_same": flag(legal & shared_legal),
        "legal_conflict": flag(legal & ~shared_legal),
        "legal_missing": flag(~legal),
        "dom_any": flag(a("is_domain") | b("is_domain")),
        "translit_any": flag(a("is_translit") | b("is_translit")),
        "house_eq": F.when(either_empty("house_no"), -1).otherwise(flag(a("house_no") == b("house_no"))),
        "nums_jacc": F.when(either_empty("addr_nums"), -1.0).otherwise(S.jaccard(_tokens("addr_nums_a"), _tokens("addr_nums_b"))),
        "post_eq": F.when(either_empty("postcode"), -1).otherwise(flag(a("postcode") == b("postcode"))),
        "addr_empty": flag(either_empty("addr_clean")),
        "addr_empty_s1": flag(a("addr_clean") == ""),
        "addr_empty_t": flag(b("addr_clean") == ""),
        "house_near": F.when(either_empty("house_no"), -1).when(a("house_no") == b("house_no"), 2).otherwise(flag(near)),
        "is_s3": flag(F.substring("cand_id", 1, 2) == "S3"),
        "n_keys": F.size("keys"),
    }
    return out | {f"k_{k}": flag(F.array_contains("keys", k)) for k in T.KEY_KINDS}


def similarity_features() -> dict[str, Column]:
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    no_address = (a("addr_clean") == "") | (b("addr_clean") == "")
    alias = F.greatest(F.when(a("alias_core") != "", S.token_set(a("alias_core"), b("name_core"))).otherwise(0.0), F.when(b("alias_core") != "", S.token_set(a("name_core"), b("alias_core"))).otherwise(0.0))
    return {
        "n_tset": S.token_set(a("name_core"), b("name_core")),
        "n_tsort": S.token_sort(a("name_core"), b("name_core")),
        "n_concat_ratio": S.ratio(a("name_concat"), b("name_concat")),
        "n_concat_partial": S.partial_ratio(a("name_concat"), b("name_concat")),
        "n_jw": S.jaro_winkler(a("name_concat"), b("name_concat")),
        "n_skel": S.ratio(a("name_skel"), b("name_skel")),
        "n_clean_ratio": S.ratio(a("name_clean"), b("name_clean")),
        "n_alias": F.when((a("alias_core") == "") & (b("alias_core") == ""), -1.0).otherwise(alias),
        "n_phon": S.ratio(a("name_phon"), b("name_phon")),
        "a_tset": F.when(no_address, -1.0).otherwise(S.token_set(a("addr_clean"), b("addr_clean"))),
        "a_ratio": F.when(no_address, -1.0).otherwise(S.ratio(a("addr_clean"), b("addr_clean"))),
        "a_street": F.when(no_address, -1.0).otherwise(S.ratio(a("street"), b("street"))),
    }


def with_frequencies(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """Adds nf_s1_a, nf_s1_b, nf_t_b and nf_s1_lg_b: how many records share the exact names."""
    freq, legal = name_frequency(norm), legal_frequency(norm)
    one = freq.select(F.col("country").alias("country_a"), F.col("name_concat").alias("name_concat_a"), F.col("n_s1").alias("nf_s1_a"))
    two = freq.select(F.col("country").alias("country_b"), F.col("name_concat").alias("name_concat_b"), F.col("n_s1").alias("nf_s1_b"), F.col("n_t").alias("nf_t_b"))
    three = legal.select(F.col("country").alias("country_b"), F.col("name_concat").alias("name_concat_b"), F.col("legal").alias("legal_b"), F.col("n").alias("nf_s1_lg_b"))
    pairs = pairs.join(one, ["country_a", "name_concat_a"], "left").join(two, ["country_b", "name_concat_b"], "left").join(three, ["country_b", "name_concat_b", "legal_b"], "left")
    return pairs.na.fill(0, ["nf_s1_a", "nf_s1_b", "nf_t_b", "nf_s1_lg_b"])


def with_s1_context(df: DataFrame) -> DataFrame:
    """Adds s1_ncands, rank_in_s1 and gap_to_best_s1 by a cheap combined similarity, to nine places, so that equal pairs are equal in whatever order weights were summed."""
    w = Window.partitionBy("s1_id")
    cheap = F.col("n_tset") + F.col("n_concat_ratio") + F.col("n_idf_overlap") + F.greatest("a_tset", F.lit(0.0))
    df = df.withColumn("__s", F.round(cheap, 9))
    return df.withColumns({"s1_ncands": F.count("*").over(w), "rank_in_s1": F.rank().over(w.orderBy(F.desc("__s"))), "gap_to_best_s1": F.max("__s").over(w) - F.col("__s")}).drop("__s")


def pair_features(cands: DataFrame, norm: DataFrame, drop_only: tuple[str, ...] = ("tok",)) -> DataFrame:
    """s1_id, cand_id and FEATURES. Pairs whose only key is in ``drop_only`` go, after targets have been counted."""
    weights = idf_weights(norm)
    kept = cands.join(target_counts(cands), "cand_id").where(~((F.size("keys") == 1) & F.get("keys", F.lit(0)).isin(list(drop_only))))
    df = with_frequencies(with_attributes(kept, norm), norm)
    df = df.join(weights.toDF("s1_id", "w_a"), "s1_id", "left").join(weights.toDF("cand_id", "w_b"), "cand_id", "left")
    df = df.withColumns(exact_features() | idf_features(F.col("w_a"), F.col("w_b"))).withColumns(similarity_features())
    return with_s1_context(df.select("s1_id", "cand_id", "t_ncands", *BASE, *[f"k_{k}" for k in T.KEY_KINDS])).select("s1_id", "cand_id", *FEATURES)


SCORE_CONTEXT = (
    "p1 p1_logit p1_rank_s1 p1_gap_best_s1 p1_gap_next_s1 s1_n_strong s1_sum_p s1_max_p t_max_p t_gap_best_other t_rank t_n_strong is_best_for_t "
    "sib_name_max sib_addr_max sib_n x_name_addr x_exact_name_noaddr x_name_min_addr"
).split()
STRONG, SIBLINGS, LIVE = 0.5, 4, 0.02


def score_context(df: DataFrame, strong: float = STRONG) -> DataFrame:
    """Adds what a first score ``p1`` says about the pair among the entity's and the target's other pairs."""
    p = F.col("p1")
    s, t = Window.partitionBy("s1_id"), Window.partitionBy("cand_id")
    clip = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    df = df.withColumns(
        {
            "p1_logit": F.ln(clip / (1 - clip)),
            "p1_rank_s1": F.rank().over(s.orderBy(F.desc("p1"))),
            "s1_max_p": F.max("p1").over(s),
            "p1_gap_best_s1": F.max("p1").over(s) - p,
            "p1_gap_next_s1": p - F.lead("p1", 1, 0.0).over(s.orderBy(F.desc("p1"), "cand_id")),
            "s1_n_strong": F.count_if(p >= strong).over(s),
            "s1_sum_p": F.sum("p1").over(s),
        }
    )
    # the two best rows of a target tell the best of the others; so no third pass over its rows
    df = df.withColumns({"t_max_p": F.max("p1").over(t), "__next": F.coalesce(F.lead("p1", 1).over(t.orderBy(F.desc("p1"))), F.lit(0.0)), "t_rank": F.rank().over(t.orderBy(F.desc("p1"))), "t_n_strong": F.count_if(p >= strong).over(t)})
    other = F.when((p == F.col("t_max_p")) & (F.count_if(p == F.col("t_max_p")).over(t) == 1), F.col("__next")).otherwise(F.col("t_max_p"))
    return df.withColumns({"t_gap_best_other": p - other, "is_best_for_t": (p >= F.col("t_max_p")).cast("int")}).drop("__next")


def interactions(df: DataFrame) -> DataFrame:
    n, a = F.col("n_tset"), F.col("a_tset")
    return df.withColumns(
        {
            "x_name_addr": n * F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)),
            "x_exact_name_noaddr": ((F.col("n_concat_ratio") >= 0.999) & (F.col("addr_empty") == 1)).cast("int"),
            "x_name_min_addr": F.least(n, F.when(a < 0, n).otherwise(a)),
        }
    )


def sibling_features(df: DataFrame, norm: DataFrame, strong: float = STRONG, most: int = SIBLINGS, live: float = LIVE) -> DataFrame:
    """Adds sib_name_max, sib_addr_max, sib_n: likeness to the entity's strongest other candidates (-1, -1, 0 without any)."""
    attributes = norm.select(F.col("entity_id").alias("id"), F.col("name_core").alias("name"), F.col("addr_clean").alias("addr"))
    top = df.where(F.col("p1") >= strong).withColumn("r", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("p1"), "cand_id"))).where(F.col("r") <= most).select("s1_id", F.col("cand_id").alias("sib"))
    pairs = df.where(F.col("p1") >= live).select("s1_id", "cand_id").join(top, "s1_id").where("cand_id <> sib")
    one, two = attributes.toDF("cand_id", "n1", "a1"), attributes.toDF("sib", "n2", "a2")
    pairs = pairs.join(one, "cand_id", "left").join(two, "sib", "left").na.fill("", ["n1", "n2", "a1", "a2"])
    sims = pairs.select("s1_id", "cand_id", S.token_set(F.col("n1"), F.col("n2")).alias("n"), F.when((F.col("a1") == "") | (F.col("a2") == ""), -1.0).otherwise(S.token_set(F.col("a1"), F.col("a2"))).alias("a"))
    best = sims.groupBy("s1_id", "cand_id").agg(F.max("n").alias("sib_name_max"), F.max("a").alias("sib_addr_max"), F.count("*").cast("int").alias("sib_n"))
    return df.join(best, ["s1_id", "cand_id"], "left").na.fill(-1.0, ["sib_name_max", "sib_addr_max"]).na.fill(0, ["sib_n"])
