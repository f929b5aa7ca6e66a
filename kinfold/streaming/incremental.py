"""Records as a stream: normalisation and blocking keys that need no state.

An addition: batches of new records get their normalised form, and the keys that come from the record
alone, as they arrive. Keys of rare tokens need counts of the whole corpus and stay with the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text


def normalized_stream(records: DataFrame) -> DataFrame:
    """Works on a streaming or a batch table alike: only projections."""
    return text.normalize_records(records)


def name_keys(norm: DataFrame) -> DataFrame:
    """entity_id, kind, key of the whole-name and the name-beginning keys."""
    c, bar = F.col, F.lit("|")
    keys = F.array(
        F.when(F.length("name_concat") >= 4, F.struct(F.lit("full").alias("kind"), F.concat(c("country"), bar, c("name_concat")).alias("key"))),
        F.when(F.length("name_concat") >= 5, F.struct(F.lit("pre").alias("kind"), F.concat(c("country"), bar, F.substring("name_concat", 1, 8)).alias("key"))),
    )
    return norm.select("entity_id", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("k")).select("entity_id", "k.kind", "k.key")
