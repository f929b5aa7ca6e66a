"""Blocking: keys, capped candidate generation, one-hop expansion and recall.

A record gives at most one key of most kinds and two of some; all come from one projection over the
normalised table joined with its rare tokens, exploded from an array, so the table is scanned once.
Caps bound every block, so the join on (kind, key) has no block larger than cap times cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import tables as T


def street_key(street: Column) -> Column:
    """The first word of a street that tells something: three letters or more, no digit, no filler."""
    good = F.filter(F.split(street, " "), lambda w: (F.length(w) >= 3) & ~w.rlike("[0-9]") & ~w.isin(T.STREET_STOP))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def name_tokens(norm: DataFrame) -> DataFrame:
    """entity_id, country, tok of two characters or more; repeats within a name stay."""
    return norm.select("entity_id", "country", F.explode(F.split("name_core", " ")).alias("tok")).where(F.length("tok") >= 2)


def address_tokens(norm: DataFrame) -> DataFrame:
    """entity_id, country, tok: distinct words of four letters or more."""
    words = F.array_distinct(F.split(F.regexp_replace("addr_clean", "[^a-z ]", " "), " "))
    return norm.select("entity_id", "country", F.explode(words).alias("tok")).where(F.length("tok") >= 4)


def token_frequency(tokens: DataFrame) -> DataFrame:
    """country, tok, df."""
    return tokens.groupBy("country", "tok").agg(F.count("*").alias("df"))


def rare_tokens(tokens: DataFrame, keep: int = 2, df_max: int | None = None) -> DataFrame:
    """entity_id, toks: the ``keep`` rarest tokens of a record in order (rarest first, then by token).

    The frequency side has one row a token, so a very common token is a skewed probe side that Spark splits;
    ranks are pruned to ``keep`` rows before they are exchanged.
    """
    joined = tokens.distinct().join(token_frequency(tokens), ["country", "tok"])
    order = Window.partitionBy("entity_id").orderBy("df", "tok")
    top = joined.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)
    if df_max is not None:
        top = top.where(F.col("df") <= df_max)
    lists = top.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("r", "tok"))).alias("l"))
    return lists.select("entity_id", F.transform("l", lambda x: x["tok"]).alias("toks"))


def build_keys(norm: DataFrame, df_max: int = T.TOKEN_DF_MAX) -> DataFrame:
    """entity_id, src, kind, key for all kinds but ``hop``; every key begins with the country."""
    names = rare_tokens(name_tokens(norm), 2, df_max).withColumnRenamed("toks", "rare")
    words = rare_tokens(address_tokens(norm), 2).withColumnRenamed("toks", "words")
    columns = ["entity_id", "src", "country", "name_concat", "name_skel", "name_phon", "house_no", street_key(F.col("street")).alias("skey")]
    df = norm.select(*columns).join(names, "entity_id", "left").join(words, "entity_id", "left")
    none = F.array().cast("array<string>")
    df = df.withColumns({"rare": F.coalesce("rare", none), "words": F.coalesce("words", none)})
    c, bar = F.col, F.lit("|")
    house, skey = c("house_no") != "", c("skey") != ""
    join = lambda *parts: F.concat(c("country"), *[x for p in parts for x in (bar, p)])
    pre, word = F.substring("name_concat", 1, 8), F.get("words", F.lit(0))
    rare, long_name, sound = F.get("rare", F.lit(0)), F.length("name_concat") >= 5, F.length("name_phon") >= 3

    def one(kind: str, guard: Column, *parts: Column) -> Column:
        return F.when(guard, F.array(F.struct(F.lit(kind).alias("kind"), join(*parts).alias("key")))).otherwise(F.array())

    def many(kind: str, tokens: str, guard: Column, make) -> Column:
        return F.when(guard, F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), make(t).alias("key")))).otherwise(F.array())

    keys = F.concat(
        one("addr", house & skey, c("house_no"), c("skey")),
        many("tok", "rare", F.lit(True), lambda t: join(t)),
        one("pre", long_name, pre),
        one("skel", F.length("name_skel") >= 4, F.substring("name_skel", 1, 6)),
        one("num", house & rare.isNotNull(), c("house_no"), rare),
        one("full", F.length("name_concat") >= 4, c("name_concat")),
        many("tokat", "rare", word.isNotNull(), lambda t: join(t, word)),
        one("prehs", long_name & house, pre, c("house_no")),
        one("prest", long_name & skey, pre, c("skey")),
        one("addr2", F.size("words") == 2, F.array_min("words"), F.array_max("words")),
        one("phonhs", sound & house, F.substring("name_phon", 1, 6), c("house_no")),
        one("phonat", sound & word.isNotNull(), F.substring("name_phon", 1, 4), word),
        many("hsat", "words", house, lambda t: join(c("house_no"), t)),
    )
    return df.select("entity_id", "src", F.explode(keys).alias("k")).select("entity_id", "src", "k.kind", "k.key")


def block_sizes(keys: DataFrame) -> DataFrame:
    """kind, key, n_t, n_s: targets and reference records of each block that has both."""
    sizes = keys.groupBy("kind", "key").agg(F.count_if(F.col("src") != "S1").alias("n_t"), F.count_if(F.col("src") == "S1").alias("n_s"))
    return sizes.where((F.col("n_t") > 0) & (F.col("n_s") > 0))


def usable_blocks(sizes: DataFrame, cap_targets: dict = T.CAP_TARGETS, cap_s1: dict = T.CAP_S1) -> DataFrame:
    """Blocks within the caps of their kind (a kind without caps is left out)."""
    fits = F.lit(False)
    for kind, most in cap_targets.items():
        fits = fits | ((F.col("kind") == kind) & (F.col("n_t") <= most) & (F.col("n_s") <= cap_s1[kind]))
    return sizes.where(fits)


def block_statistics(keys: DataFrame, cap_targets: dict = T.CAP_TARGETS, cap_s1: dict = T.CAP_S1) -> DataFrame:
    """kind, blocks, usable, pairs_uncapped, pairs_capped."""
    sizes = block_sizes(keys)
    fits = usable_blocks(sizes, cap_targets, cap_s1).withColumn("u", F.lit(1))
    both = sizes.join(fits.select("kind", "key", "u"), ["kind", "key"], "left").withColumn("p", F.col("n_t") * F.col("n_s"))
    return both.groupBy("kind").agg(F.count("*").alias("blocks"), F.count("u").alias("usable"), F.sum("p").alias("pairs_uncapped"), F.coalesce(F.sum(F.when(F.col("u") == 1, F.col("p"))), F.lit(0)).alias("pairs_capped"))


def build_candidates(keys: DataFrame, cap_targets: dict = T.CAP_TARGETS, cap_s1: dict = T.CAP_S1) -> DataFrame:
    """s1_id, cand_id, keys (sorted array of kinds): one join on (kind, key) within usable blocks."""
    ok = usable_blocks(block_sizes(keys), cap_targets, cap_s1).select("kind", "key")
    live = keys.join(ok, ["kind", "key"], "left_semi")
    left = live.where("src = 'S1'").select("kind", "key", F.col("entity_id").alias("s1_id"))
    right = live.where("src <> 'S1'").select("kind", "key", F.col("entity_id").alias("cand_id"))
    return left.join(right, ["kind", "key"]).groupBy("s1_id", "cand_id").agg(F.array_sort(F.collect_set("kind")).alias("keys"))


def link_keys(norm: DataFrame, group_max: int = T.HOP_GROUP_MAX) -> DataFrame:
    """entity_id, k, kk of targets that are in a link group of 2 to ``group_max`` (sound, whole address, house and sound)."""
    c, bar = F.col, F.lit("|")
    item = lambda k, guard, *parts: F.when(guard, F.struct(F.lit(k).alias("k"), F.concat(c("country"), *[x for p in parts for x in (bar, p)]).alias("kk")))
    sound = F.length("name_phon") >= 3
    keys = F.array(
        item("p", sound, c("name_phon")),
        item("a", F.length("addr_clean") >= 8, c("addr_clean")),
        item("h", sound & (c("house_no") != ""), c("house_no"), F.substring("name_phon", 1, 3)),
    )
    rows = norm.where("src <> 'S1'").select("entity_id", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("x")).select("entity_id", "x.k", "x.kk")
    groups = rows.groupBy("k", "kk").count().where(F.col("count").between(2, group_max))
    return rows.join(groups, ["k", "kk"], "left_semi")


def add_hops(cands: DataFrame, norm: DataFrame, seed_keys: int = T.HOP_SEED_KEYS, group_max: int = T.HOP_GROUP_MAX) -> DataFrame:
    """Candidates and, with the key ``hop``, pairs that link through one strong candidate (``seed_keys`` keys or more). One hop only."""
    links = link_keys(norm, group_max)
    seeds = cands.where(F.size("keys") >= seed_keys).select("s1_id", F.col("cand_id").alias("via"))
    near = links.select(F.col("entity_id").alias("via"), "k", "kk").join(links, ["k", "kk"]).where("via <> entity_id").select("via", F.col("entity_id").alias("cand_id")).distinct()
    hops = seeds.join(near, "via").select("s1_id", "cand_id").distinct().join(cands, ["s1_id", "cand_id"], "left_anti")
    return cands.unionByName(hops.withColumn("keys", F.array(F.lit("hop"))))


def recall_report(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairs, s1_covered, true_pairs, found, recall. ``truth``: pairs (s1_id, cand_id)."""
    totals = cands.agg(F.count("*").alias("pairs"), F.count_distinct("s1_id").alias("s1_covered"))
    hit = truth.join(cands.select("s1_id", "cand_id", F.lit(1).alias("hit")), ["s1_id", "cand_id"], "left")
    found = hit.agg(F.count("*").alias("true_pairs"), F.count("hit").alias("found"))
    return totals.crossJoin(F.broadcast(found)).withColumn("recall", F.try_divide("found", "true_pairs"))  # both sides are one row


def label(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """``cands`` with label: is the pair true?"""
    marks = truth.select("s1_id", "cand_id").distinct().withColumn("__t", F.lit(True))
    return cands.join(marks, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("__t", F.lit(False))).drop("__t")


def missed_pairs(cands: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", "cand_id").distinct().join(cands, ["s1_id", "cand_id"], "left_anti")
