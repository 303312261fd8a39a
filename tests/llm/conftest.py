import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "collection string, key string, vector array<float>, version bigint, segment_id bigint, metadata map<string,string>"


@pytest.fixture(scope="session")
def entries(spark):
    def make(rows):
        """(collection, key, vector[, version[, segment_id]])"""
        full = [(c, k, None if v is None else [None if x is None else float(x) for x in v], (rest[0] if rest else 1), (rest[1] if len(rest) > 1 else 0), {}) for c, k, v, *rest in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make

