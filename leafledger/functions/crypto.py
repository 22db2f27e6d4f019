"""AES-256-GCM of columns, with associated data, and where keys come from.

Stored layout: base64 of IV (12 bytes), tag (16), ciphertext.  Spark's own order puts
the tag last, so bytes are moved by ``substring``.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CryptoError


def encrypt(text: Column, key: bytes, aad: Column | None = None) -> Column:
    sealed = F.aes_encrypt(text.cast("binary"), F.lit(_checked(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad if aad is not None else F.lit(""))
    # the random IV must be drawn once: a lambda's argument is computed a single time
    def moved(x: Column) -> Column:
        n = F.octet_length(x)
        return F.base64(F.concat(F.substr(x, F.lit(1), F.lit(12)), F.substr(x, n - 15, F.lit(16)), F.substr(x, F.lit(13), n - 28)))

    return F.get(F.transform(F.array(sealed), moved), F.lit(0))


def decrypt(sealed: Column, key: bytes, aad: Column | None = None) -> Column:
    """The text; a wrong key, changed bytes or other associated data make the query fail."""
    raw = F.unbase64(sealed)
    moved = F.concat(F.substr(raw, F.lit(1), F.lit(12)), F.substr(raw, F.lit(29), F.octet_length(raw)), F.substr(raw, F.lit(13), F.lit(16)))
    return F.aes_decrypt(moved, F.lit(_checked(key)), F.lit("GCM"), F.lit("DEFAULT"), aad if aad is not None else F.lit("")).cast("string")


def line_aad(ts: Column, pointer: Column) -> Column:
    """Associated data of a log line: moving a line elsewhere breaks it."""
    return F.concat_ws("|", ts, pointer)


def _checked(key: bytes) -> bytes:
    if not isinstance(key, bytes) or len(key) != 32:
        raise CryptoError("a key has 32 bytes")
    return key


def parse_key(text: str | bytes) -> bytes:
    """64 hexadecimal digits, or 32 raw bytes."""
    if isinstance(text, bytes):
        if len(text) == 32:
            return text
        text = text.decode("ascii", "replace")
    text = text.strip()
    if not re.fullmatch(r"[0-9A-Fa-f]{64}", text):
        raise CryptoError("a key is 64 hexadecimal digits or 32 bytes")
    return bytes.fromhex(text)


def key_from_env(name: str) -> bytes:
    if name not in os.environ:
        raise CryptoError(f"environment variable {name} is not set")
    return parse_key(os.environ[name])


def key_from_file(path: str) -> bytes:
    if stat.S_IMODE(os.stat(path).st_mode) & 0o077:
        raise CryptoError(f"{path} may be read by others; use mode 600")
    with open(path, "rb") as f:
        return parse_key(f.read())


def key_from(fetch: Callable[[], str | bytes], tries: int = 3, wait: Callable[[int], None] = lambda n: None) -> bytes:
    """Key from any remote source: ``fetch`` is tried ``tries`` times, ``wait(n)`` between."""
    for n in range(1, tries + 1):
        try:
            return parse_key(fetch())
        except CryptoError:
            raise
        except Exception as e:
            if n == tries:
                raise CryptoError("the key source did not answer") from e
            wait(n)
    raise CryptoError("no tries")
