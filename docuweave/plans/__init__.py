"""All registered queries: importing this package fills ``queries.QUERIES`` and ``queries.ORACLE``."""

from . import queries, model, report  # noqa: F401, I001  the others add to what queries has
