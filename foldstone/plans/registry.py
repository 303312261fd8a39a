"""All registry queries of the core, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.plans import data_problems, more, oracles, reads, service, writes

MODULES = (data_problems, reads, writes, more, service, oracles)
#: Columns that come out of the SQL narrower than bigint.
NARROW = {
    "kv_multi_get": ("ord",),
    "semantic_degraded": ("qid",),
    "url_params": ('"limit"',),
    "slot_assign": ("slot_id",),
    "slot_owners": ("slot_id",),
    "route_records": ("primary_port", "slot_id"),
    "migration_plan": ("target_port", "attempts"),
    "migration_step": ("attempts",),
    "members_parse": ("weight", "port"),
    "registrations_parse": ("weight", "port"),
    "latency_percentiles": ("percentile",),
    "latency_percentiles_floor": ("percentile",),
}


def _long_integers(query):
    """Integers come out as bigint, whatever the operator works in."""

    def run(spark, sf_dir) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

    return run


def queries() -> dict:
    return {name: _long_integers(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    out = {name: sql for m in MODULES for name, sql in m.SQL.items()}
    for name, columns in NARROW.items():
        out[name] = f"SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in columns)}) FROM ({out[name]})"
    return out
