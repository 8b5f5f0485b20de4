"""Reversible redaction and password encryption. Keys are derived on the driver; data is encrypted where it is."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITERATIONS = 480_000


def derived_key(password: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32)


def encrypt(content: Column, password: str, salt: bytes | None = None, iterations: int = ITERATIONS) -> Column:
    """salt (16), nonce (12), cipher text, tag: AES-256-GCM under a key derived from the password.

    The key is derived once, where the plan is made; all rows share the salt and differ in their nonces.
    """
    salt = os.urandom(16) if salt is None else salt
    return F.concat(F.lit(bytearray(salt)), F.aes_encrypt(content, F.lit(bytearray(derived_key(password, salt, iterations))), F.lit("GCM")))


def decrypt(sealed: Column, password: str, salt: bytes, iterations: int = ITERATIONS) -> Column:
    """Null where the password or the data is wrong. ``salt`` is the first 16 bytes, which one table shares."""
    return F.try_aes_decrypt(F.substring(sealed, 17, F.length(sealed)), F.lit(bytearray(derived_key(password, salt, iterations))), F.lit("GCM"))


def reversible(entities: DataFrame, key: bytes) -> DataFrame:
    """Adds item_id, replacement, sealed and key_hash to entity rows; the key itself isn't kept."""
    k = F.lit(bytearray(key))
    item = F.left(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("start").cast("string"), F.col("text")), 256), F.lit(16))
    return entities.select(
        "*", item.alias("item_id"), F.concat(F.lit("[REDACTED-"), F.col("type"), F.lit("]")).alias("replacement"),
        F.base64(F.aes_encrypt(F.col("text").cast("binary"), k, F.lit("GCM"))).alias("sealed"), F.lit(hashlib.sha256(key.hex().encode()).hexdigest()).alias("key_hash"),
    )


def revealed(items: DataFrame, key: bytes) -> DataFrame:
    return items.withColumn("text_again", F.try_aes_decrypt(F.unbase64("sealed"), F.lit(bytearray(key)), F.lit("GCM")).cast("string"))


def password_hash(password: str, salt: str | None = None) -> tuple[str, str]:
    """(hash, salt) of a password for keeping, by 100,000 rounds."""
    salt = os.urandom(32).hex() if salt is None else salt
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt.encode(), 100_000).hex(), salt


def quarantine(files: DataFrame, folder: str, password: str, reason: str, as_of: Column, salt: bytes | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """quarantine_path, sealed, meta (JSON: where the file was, its name, when and why) of files (path, name, content)."""
    meta = F.to_json(F.struct(F.col("path").alias("original_path"), F.col("name").alias("original_name"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("quarantined_at"), F.lit(reason).alias("reason")))
    return files.select(F.concat(F.lit(f"{folder.rstrip('/')}/quarantine_"), "name", F.lit(".enc")).alias("quarantine_path"), encrypt(F.col("content"), password, salt, iterations).alias("sealed"), meta.alias("meta"))
