"""A vault as tables: files under keys of their own, the keys under the vault's key, and a log of what was done.

Each file has a random data key, which seals its content and is itself sealed
("wrapped") by the vault's key. A new password rewrites the wrapped keys only, never
the contents. The vault's key is derived once, where the plan is made, and what is
sealed stays with its salt, so rows say which password era they belong to.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crypto import ITERATIONS, derived_key

SCHEMA = "file_hash string, name string, vault_name string, path string, size bigint, wrapped binary, sealed binary, salt binary"


def _key(password: str, salt: bytes, iterations: int) -> Column:
    return F.lit(bytearray(derived_key(password, salt, iterations)))


def new_keys(rows: DataFrame) -> DataFrame:
    """Adds data_key, 32 random bytes of the system's generator for each row. Keep the result before it is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([secrets.token_bytes(32) for _ in range(b.num_rows)], pa.binary())], [*b.schema.names, "data_key"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, data_key binary")


def add(files: DataFrame, password: str, salt: bytes, iterations: int = ITERATIONS) -> DataFrame:
    """The vault's rows for files (path, name, content). A null content is empty; equal files have equal hashes and different keys."""
    content = F.coalesce("content", F.lit(bytearray()))
    rows = new_keys(files.select("path", "name", content.alias("content")))
    file_hash = F.sha2("content", 256)
    return rows.select(
        file_hash.alias("file_hash"), "name", F.concat(F.left(file_hash, F.lit(16)), F.lit("_"), "name", F.lit(".enc")).alias("vault_name"), "path", F.length("content").cast("bigint").alias("size"),
        F.aes_encrypt("data_key", _key(password, salt, iterations), F.lit("GCM")).alias("wrapped"), F.aes_encrypt("content", "data_key", F.lit("GCM")).alias("sealed"), F.lit(bytearray(salt)).alias("salt"),
    )


def opened(vault: DataFrame, password: str, salt: bytes, iterations: int = ITERATIONS) -> DataFrame:
    """Adds content; null where the password is wrong, a key or the content was changed, or the hash is another."""
    key = F.try_aes_decrypt("wrapped", _key(password, salt, iterations), F.lit("GCM"))
    content = F.try_aes_decrypt("sealed", key, F.lit("GCM"))
    rows = vault.withColumn("content", F.when(F.col("salt") == F.lit(bytearray(salt)), content))
    return rows.withColumn("content", F.when(F.sha2("content", 256) == F.col("file_hash"), F.col("content")))


def rotate(vault: DataFrame, old: str, new: str, old_salt: bytes, new_salt: bytes, iterations: int = ITERATIONS) -> DataFrame:
    """The same vault under a new password: keys are unwrapped and wrapped again, contents are not read. A row whose key the old password doesn't open stays as it is."""
    key = F.try_aes_decrypt("wrapped", _key(old, old_salt, iterations), F.lit("GCM"))
    rows = vault.withColumn("_key", F.when(F.col("salt") == F.lit(bytearray(old_salt)), key))
    fits = F.col("_key").isNotNull()
    again = F.aes_encrypt("_key", _key(new, new_salt, iterations), F.lit("GCM"))
    return rows.withColumns({"wrapped": F.when(fits, again).otherwise(F.col("wrapped")), "salt": F.when(fits, F.lit(bytearray(new_salt))).otherwise(F.col("salt"))}).drop("_key")


def remove(vault: DataFrame, names: DataFrame) -> DataFrame:
    """Without the rows whose vault_name is in ``names``."""
    return vault.join(names.select("vault_name").distinct(), "vault_name", "left_anti").select(*vault.columns)


def logged(rows: DataFrame, action: str, as_of: Column, details: Column) -> DataFrame:
    """action, file_name, details, timestamp: entries for the vault's log, a row for each file."""
    return rows.select(F.lit(action).alias("action"), F.col("name").alias("file_name"), details.alias("details"), as_of.alias("timestamp"))
