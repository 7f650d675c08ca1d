"""Secrets at rest: AES-256-GCM in Spark's own functions, with a key that is not stored."""

from __future__ import annotations

import base64
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import INTERNAL_ERROR, StrataError

KEY_BYTES = 32


class SecretBox:
    """Encrypts strings to ``{"enc": "<base64>"}`` and back."""

    def __init__(self, spark: SparkSession, key: bytes | None):
        if key is not None and len(key) != KEY_BYTES:
            raise StrataError(f"a key has {KEY_BYTES} bytes, not {len(key)}", sqlstate=INTERNAL_ERROR)
        self.spark, self.key = spark, key

    def _key(self) -> bytes:
        if self.key is None:
            raise StrataError("this installation was opened without a key for secrets", sqlstate=INTERNAL_ERROR)
        return self.key

    def seal(self, text: str) -> dict[str, str]:
        row = self.spark.createDataFrame([(text.encode(), self._key())], "t binary, k binary")
        data = row.select(F.aes_encrypt("t", "k", F.lit("GCM"))).first()[0]
        return {"enc": base64.b64encode(bytes(data)).decode()}

    def open(self, sealed: dict[str, str]) -> str:
        row = self.spark.createDataFrame([(base64.b64decode(sealed["enc"]), self._key())], "t binary, k binary")
        data = row.select(F.try_aes_decrypt("t", "k", F.lit("GCM"))).first()[0]
        if data is None:
            raise StrataError("the secret cannot be read with this key", sqlstate=INTERNAL_ERROR)
        return bytes(data).decode()

    def seal_fields(self, params: dict, secret: set[str]) -> str:
        return json.dumps({k: self.seal(v) if k in secret else v for k, v in params.items()})

    def open_fields(self, text: str) -> dict:
        return {k: self.open(v) if is_sealed(v) else v for k, v in json.loads(text).items()}


def is_sealed(value: object) -> bool:
    return isinstance(value, dict) and set(value) == {"enc"}
