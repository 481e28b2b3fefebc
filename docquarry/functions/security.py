"""Encryption at rest: AES-GCM in Catalyst expressions, keys by PBKDF2."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS = 600_000
KEY_MISSING = "[Encrypted Chunk - Key Unavailable]"
NOT_DECRYPTED = "[Encrypted Chunk - Decryption Failed]"


def new_salt() -> bytes:
    return os.urandom(16)


def derive_key(password: str | None, salt: bytes) -> bytes | None:
    """32 bytes; None for no password."""
    if password is None:
        return None
    if not isinstance(password, str) or not password:
        raise ValueError("a password is a string that isn't empty")
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ITERATIONS, 32)


def encrypt(text: Column, key: bytes) -> Column:
    """Authenticated binary of a string; null stays null."""
    return F.aes_encrypt(F.encode(text, "UTF-8"), F.lit(key))


def decrypt(data: Column, key: bytes | None) -> Column:
    """The string, or a placeholder if there is no key or it is the wrong one."""
    if key is None:
        return F.when(data.isNotNull(), F.lit(KEY_MISSING))
    return F.when(data.isNotNull(), F.coalesce(F.decode(F.try_aes_decrypt(data, F.lit(key)), "UTF-8"), F.lit(NOT_DECRYPTED)))
