"""Table schemas, loaders, writers and input builders."""

from .schema import FOREIGN_KEYS, RULES, SCHEMAS, TABLES
from .star import star_tables
from .tables import publish, read_tables, read_version

__all__ = ["SCHEMAS", "RULES", "FOREIGN_KEYS", "TABLES", "star_tables", "read_tables",
           "read_version", "publish"]
