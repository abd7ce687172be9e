"""Mixed notations and time zones -> one instant in UTC, through a dictionary of distinct values.

Every distinct (text, zone, order) is parsed once, in Python, and kept in a dictionary in the
shared folder that later batches extend; the instants are then joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.instants import parse_instant
from grainmill.operators.skew import join_dictionary
from grainmill.runtime import broadcast_if_few, shared_dir, stage, stage_path

KEYS = ["gm_raw", "gm_zone", "gm_order"]
ENTRY = "gm_raw string, gm_zone string, gm_order string, utc_us bigint"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [parse_instant(r, z, o) for r, z, o in zip(b.gm_raw, b.gm_zone, b.gm_order)]
        yield b.assign(utc_us=pd.array(got, dtype="Int64"))


#: Changes whenever the parser gives another instant for a text, so that old entries are left behind.
VERSION = 1


class InstantDictionary:
    """Distinct written dates with their instants, kept as parquet batches under a path."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or stage_path(spark, "instants")

    @classmethod
    def shared(cls, spark: SparkSession) -> InstantDictionary:
        """The dictionary of the shared folder, which every run extends."""
        return cls(spark, f"{shared_dir(spark)}/grainmill-instants-{VERSION}")

    def entries(self) -> DataFrame:
        """All entries so far, each key once; utc_us is null for texts that denote no day or instant."""
        # two runs at once may both have parsed a key, and then alike
        return self.spark.read.schema(ENTRY).parquet(self.path).groupBy(*KEYS).agg(F.min("utc_us").alias("utc_us"))

    def extend(self, distinct: DataFrame) -> int:
        """Parse the keys that are new and append them; gives their number.

        A batch that fails leaves nothing behind, since parquet is committed as a whole;
        running it again parses the same keys.
        """
        new = distinct.select(*KEYS)
        if self._exists():
            new = stage(new.join(self.entries().select(*KEYS), KEYS, "left_anti"), "new-instants")
        found = new.count()
        if found or not self._exists():
            new.mapInPandas(_parse, ENTRY).write.mode("append").parquet(self.path)
        return found

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(self.path, "_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)


def located(rows: DataFrame, raw: str, source: str, registry: DataFrame) -> DataFrame:
    """Rows with gm_raw, gm_zone, gm_order: the text and how its source writes dates.

    A source that the registry lacks counts as UTC and MDY; of repeated registry rows the
    one of the best trust counts. Rows without text drop out: they denote nothing.
    """
    known = registry.groupBy(F.col("source_name").alias("gm_source")).agg(
        F.min_by("time_zone", F.struct("trust_rank", "time_zone")).alias("gm_z"), F.min_by("date_order", F.struct("trust_rank", "date_order")).alias("gm_o")
    )
    rows = rows.where(F.col(raw).isNotNull()).withColumn("gm_source", F.col(source))
    return (
        rows.join(broadcast_if_few(known), "gm_source", "left")
        .withColumns({"gm_raw": F.col(raw), "gm_zone": F.coalesce("gm_z", F.lit("UTC")), "gm_order": F.coalesce("gm_o", F.lit("MDY"))})
        .drop("gm_source", "gm_z", "gm_o")
    )


def normalise_instants(rows: DataFrame, dictionary: InstantDictionary | None = None) -> DataFrame:
    """Add utc_us to rows that carry gm_raw, gm_zone and gm_order (see located).

    Rows whose text denotes no day or instant (months, quarters, seasons, open ends, blank
    texts, impossible dates) drop out. Null texts never come in; an empty table gives an
    empty result; repeated rows each keep their place. Other columns pass through.
    """
    spark = rows.sparkSession
    dictionary = dictionary or InstantDictionary(spark)
    counted = stage(rows.groupBy(*KEYS).agg(F.count("*").alias("gm_n")), "instant-keys")
    dictionary.extend(counted)
    useful = counted.join(dictionary.entries().where(F.col("utc_us").isNotNull()), KEYS)
    return join_dictionary(rows, useful, KEYS, "gm_n").drop(*KEYS)


#: table, key, text column, source column or literal source of the four dated tables.
DATED = (
    ("grants", "grant_id", "deadline", "source_name", None),
    ("sam_opportunities", "sam_row", "response_dead_line", None, "fed-notices-api"),
    ("grants_gov_hits", "hit_row", "close_date", None, "opp-search-api"),
    ("raw_grants", "raw_id", "deadline", "source_name", None),
)


def dated_records(tables: dict[str, DataFrame], registry: DataFrame) -> DataFrame:
    """All dated texts of the given tables as record_table, record_id and located text."""
    parts = []
    for name, key, raw, source, literal in DATED:
        if name not in tables:
            continue
        src = F.col(source) if source else F.lit(literal)
        parts.append(tables[name].select(F.lit(name).alias("record_table"), F.col(key).cast("string").alias("record_id"), F.col(raw).alias("gm_text"), src.alias("gm_src")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return located(rows, "gm_text", "gm_src", registry).drop("gm_text", "gm_src")
