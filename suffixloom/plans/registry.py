"""All registered queries: importing their modules registers them."""

from . import file_queries, model_queries, more_sql  # noqa: F401
from .queries import QUERIES, SQL  # noqa: F401
