"""Deterministic address enrichment (H1-H4). A provider is a function Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ip import bind, is_internal

# The answer tables, indexed by hash bytes.
COUNTRIES = ["US", "DE", "NL", "GB", "FR", "SG", "BR", "IN", "RU", "CN", "UA", "SE"]
CATEGORIES = ["hosting", "residential", "corporate", "tor-exit", "scanner", "vpn"]
RISKY = ["tor-exit", "scanner"]

def enrich_ip(ip: Column) -> Column:
    """Enrichment struct of an address, derived from its hash; null for a null address."""
    text = F.lit(None).cast("string")
    h = F.sha2(ip, 256)

    def byte(i: int) -> Column:
        return F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")

    def pick(values: list[str], index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), index % len(values) + 1)

    def scored(x: Column) -> Column:
        base = byte(4) % 101
        risk = F.when(x["category"].isin(RISKY), F.greatest(base, F.lit(70))).otherwise(base)
        return bind(F.struct(x["internal"].alias("internal"), x["category"].alias("category"), risk.alias("score")), answer)

    def answer(x: Column) -> Column:
        internal, category, score = x["internal"], x["category"], x["score"]
        asn = F.concat(F.lit("AS"), (F.lit(1000) + (byte(2) * 256 + byte(3)) % 64000).cast("string"))
        band = (
            F.when(score >= 80, "malicious").when(score >= 55, "suspicious").when(score >= 25, "neutral")
            .otherwise("clean")
        )

        def by(bad, inside, outside) -> Column:
            return F.when(internal.isNull(), bad).when(internal, inside).otherwise(outside)

        return fields(by, asn, category, band, score)

    def fields(by, asn: Column, category: Column, band: Column, score: Column) -> Column:
        return F.struct(
            ip.alias("ip"),
            by(F.lit(False), F.lit(True), F.lit(False)).alias("is_private"),
            by(text, text, pick(COUNTRIES, byte(0))).alias("country"),
            by(text, F.lit("AS-INTERNAL"), asn).alias("asn"),
            by(text, F.lit("corporate"), category).alias("category"),
            by(F.lit("neutral"), F.lit("clean"), band).alias("reputation"),
            by(F.lit(40), F.lit(5), score).alias("reputation_score"),
            F.lit("synthetic").alias("provider"),
        )

    facts = F.struct(is_internal(ip).alias("internal"), pick(CATEGORIES, byte(1)).alias("category"))
    return F.when(ip.isNotNull(), bind(facts, scored))


def no_enrichment(ip: Column) -> Column:
    """The provider that knows nothing (H3)."""
    text = F.lit(None).cast("string")
    return F.struct(
        ip.alias("ip"), F.lit(False).alias("is_private"), text.alias("country"), text.alias("asn"),
        text.alias("category"), F.lit("neutral").alias("reputation"), F.lit(0).alias("reputation_score"),
        F.lit("none").alias("provider"),
    )


def enrich(df: DataFrame, column: str = "source_ip", provider=enrich_ip) -> DataFrame:
    """Add an `enrichment` struct; stateless, so it serves streams as well (H4)."""
    return df.withColumn("enrichment", provider(F.col(column)))
