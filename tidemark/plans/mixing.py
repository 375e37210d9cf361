"""Queries of orders drawn by chance; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import mixing
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

query = Registry()

#: The twenty sources weigh 1 to 5, by their last digit.
WEIGHTS = {f"src{i}": 1.0 + i % 5 for i in range(20)}


def _uniform(told: str) -> str:
    return f"((('0x' || substring(sha256({told}), 1, 12))::UBIGINT + 0.5) / 281474976710656.0)"


@query(
    "weighted_mix",
    f"""WITH w AS (SELECT doc_id, source, CAST(floor(-ln({_uniform("'42:' || source || ':' || doc_id || ':0'")}) / (1 + CAST(substring(source, 4) AS INT) % 5) * 1000000) AS BIGINT) AS wait FROM documents)
    SELECT doc_id, source, CAST(sum(wait) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS at FROM w""",
)
def weighted_mix(spark, sf_dir):
    """All documents in a mix of their sources by weight."""
    return mixing.weighted_mix(table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS, span=500).drop("epoch")


@query("bounded_shuffle", f"SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 + floor({_uniform("'42:' || doc_id")} * 100) AS BIGINT) AS at FROM documents")
def bounded_shuffle(spark, sf_dir):
    """All documents in an order in which none is a hundred places or more from its own."""
    return mixing.bounded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), 100, span=500)
