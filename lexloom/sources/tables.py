"""Relational tables with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The tables' columns.
SCHEMAS = {
    "users": "id string, username string, email string, password_hash string, full_name string, avatar_url string, is_active boolean, is_superuser boolean, last_login timestamp, created_at timestamp, updated_at timestamp",
    "conversations": "id string, user_id string, title string, description string, is_archived boolean, created_at timestamp, updated_at timestamp",
    "messages": "id string, conversation_id string, role string, content string, tokens_used int, meta_data string, created_at timestamp",
    "documents": "id string, user_id string, title string, filename string, file_path string, file_size long, file_category string, status string, processing_error string, total_chunks int, processed_chunks int, meta_data string, created_at timestamp, updated_at timestamp, description string",
    "document_category": "id string, category_name string, category_code string, description string, created_at timestamp, updated_at timestamp",
    "document_embeddings": "id string, document_id string, chunk_index int, chunk_content string, embedding array<float>, meta_data string, created_at timestamp",
    "roles": "id string, name string, code string, description string, is_system boolean, created_at timestamp, updated_at timestamp",
    "permissions": "id string, name string, code string, module string, description string, created_at timestamp",
    "user_roles": "id string, user_id string, role_id string, assigned_at timestamp, assigned_by string",
    "role_permissions": "id string, role_id string, permission_id string, granted_at timestamp",
}


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table by its schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def load_jdbc(spark: SparkSession, url: str, name: str, partition_column: str, lower: str, upper: str, partitions: int) -> DataFrame:
    """A table of a database by its schema, read in ranges of ``partition_column``. Arrays, which databases give in ways
    of their own, keep the database's type."""
    declared = ", ".join(c for c in SCHEMAS[name].split(", ") if "array<" not in c)
    found = (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, customSchema=declared)
        .load()
    )
    return found.select(*[c.split(" ")[0] for c in SCHEMAS[name].split(", ")])
