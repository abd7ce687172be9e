"""Queries of the problems that prepare training texts; each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm.boilerplate import find_furniture
from grainmill.llm.canonical import LISTS, canonical_entries
from grainmill.llm.chunking import split_documents
from grainmill.llm.encode import encode_documents
from grainmill.llm.mixture import mix, share_report, sized
from grainmill.llm.pages import page_texts
from grainmill.llm.residue import find_residue, validation
from grainmill.llm.survivors import best_records, grouped
from grainmill.llm.truncation import cut_rates, cut_reasons, find_cut
from grainmill.runtime import table

#: How strongly the weights of the curriculum change over the run.
TILT = 0.5


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions and pages with template residue or void text in place of content."""
    return find_residue(table(spark, folder, "grants")).select("grant_id", "field")


def p1_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and precision of the classifier of p1_found on hosts that it wasn't fitted to."""
    return validation(page_texts(table(spark, folder, "grants")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions that were cut."""
    found = find_cut(table(spark, folder, "grants"), table(spark, folder, "raw_grants"))
    return found.where("cut").select("record_table", "record_id")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per source the share of its descriptions that are cut."""
    return cut_rates(find_cut(table(spark, folder, "grants"), table(spark, folder, "raw_grants")))


def p3_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many descriptions are told to be cut by a spike, a mark or their ending."""
    return cut_reasons(find_cut(table(spark, folder, "grants"), table(spark, folder, "raw_grants")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of furniture in descriptions and pages."""
    return find_furniture(table(spark, folder, "grants")).select("grant_id", "field", "line_no")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Per program the row whose value of each field survives."""
    return best_records(table(spark, folder, "grants"), table(spark, folder, "source_registry")).select("group_id", "field", "grant_id")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each program that was captured more than once."""
    return grouped(table(spark, folder, "grants").select("grant_id", "title", "source_url")).select("group_id", "grant_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The places and trades that free entries mean."""
    lists = {field: table(spark, folder, ref) for field, ref, *_ in LISTS}
    return canonical_entries(table(spark, folder, "grants"), lists).select("grant_id", "field", "pos", "ref_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document."""
    return encode_documents(table(spark, folder, "documents")).select("doc_id", "ids")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a document in the mixture, in training order."""
    plan = table(spark, folder, "source_plan")
    return mix(sized(table(spark, folder, "documents"), plan), plan, tilt=TILT)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source of the plan."""
    plan = table(spark, folder, "source_plan")
    sizes = sized(table(spark, folder, "documents"), plan)
    return share_report(mix(sizes, plan, tilt=TILT), sizes, plan)


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every document."""
    return split_documents(table(spark, folder, "documents"), table(spark, folder, "source_plan"))


def queries() -> dict:
    """Name -> callable of this module's queries."""
    return {f.__name__: f for f in (p1_found, p1_validation, p3_found, p3_rates, p3_reasons, p4_found, p5_found, p5_groups, p6_found, p8_ids, p9_mix, p9_shares, p10_pieces)}
