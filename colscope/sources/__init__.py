from .files import read_csv, read_parquet, read_parquet_na
from .jdbc import jdbc_options, read_query_preview, read_table
from .schema import list_columns, list_databases, list_tables, schema_of, semantic_type
from .views import external_table, register_views, typed_view

__all__ = [
    "external_table", "jdbc_options", "list_columns", "list_databases", "list_tables", "read_csv",
    "read_parquet", "read_parquet_na", "read_query_preview", "read_table", "register_views", "schema_of",
    "semantic_type", "typed_view",
]
