"""Where domain tables come from and where results go."""

from railyard.sources.tables import DomainTables, JdbcDomain, ParquetDomain, write_domain
from railyard.sources.adapter import StarAdapter

__all__ = ["DomainTables", "JdbcDomain", "ParquetDomain", "StarAdapter", "write_domain"]
