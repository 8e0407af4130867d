"""All queries of the core with their SQL."""

from __future__ import annotations

from kinfold.plans import names, preparation

QUERIES = {**names.QUERIES, **preparation.QUERIES}
SQL = {**names.SQL, **preparation.SQL}
