"""Payload encryption: AES-256-GCM envelopes as JSON, built from Spark's own functions.

An envelope is {marker: version, "kid": key id, "n": nonce, "ct": ciphertext and tag}, the last two in base64. Version 2 binds the key
id as additional authenticated data. A payload without the marker is plain text and passes, unless ``strict``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NONCE = 12


@dataclass(frozen=True)
class Keyring:
    """Keys of 32 bytes by id. New payloads use the primary; the others still decrypt."""

    primary: str
    keys: dict[str, bytes]

    def __post_init__(self):
        if self.primary not in self.keys:
            raise ValueError(f"primary key {self.primary!r} is missing")
        if bad := [k for k, v in self.keys.items() if len(v) != 32]:
            raise ValueError(f"keys must have 32 bytes: {bad}")


@dataclass(frozen=True)
class Codec:
    keyring: Keyring
    marker: str = "enc"
    aad_prefix: str = "enc/v2|"
    version: int = 1
    strict: bool = False

    def _key(self, kid: str) -> Column:
        return F.lit(self.keyring.keys[kid])

    def encrypt(self, payload: Column) -> Column:
        """The envelope of a payload; null stays null. Each row has a nonce of its own, so it is not repeatable."""
        if self.version not in (1, 2):
            raise ValueError(f"unsupported envelope version {self.version}")
        kid = self.keyring.primary
        plain = payload.cast("binary")
        if self.version == 2:
            iv = F.substring(F.unhex(F.sha2(F.concat(F.expr("uuid()"), F.expr("uuid()")), 256)), 1, NONCE)
            sealed = F.aes_encrypt(plain, self._key(kid), F.lit("GCM"), F.lit("DEFAULT"), iv, F.lit(self.aad_prefix + kid))
        else:
            sealed = F.aes_encrypt(plain, self._key(kid), F.lit("GCM"), F.lit("DEFAULT"))
        # The sealed bytes are bound to one lambda variable, so that nonce and ciphertext come from one encryption.
        def envelope(box: Column) -> Column:
            n, ct = F.substring(box, 1, NONCE), F.substring(box, NONCE + 1, 1 << 30)
            return F.struct(F.lit(self.version).alias(self.marker), F.lit(kid).alias("kid"), F.base64(n).alias("n"), F.base64(ct).alias("ct"))

        return F.when(payload.isNotNull(), F.to_json(F.transform(F.array(sealed), envelope)[0]))

    def decrypt(self, stored: Column) -> Column:
        """The payload of an envelope. Unknown keys, versions, nonce sizes and failed authentication raise; so does plain text if strict."""
        version = F.get_json_object(stored, f"$['{self.marker}']")
        kid = F.get_json_object(stored, "$.kid")
        n, ct = (F.unbase64(F.get_json_object(stored, f"$.{x}")) for x in ("n", "ct"))
        sealed = F.concat(n, ct)
        out = F.when(stored.isNull(), F.lit(None).cast("string"))
        out = out.when(version.isNull(), F.raise_error(F.lit("payload is not an envelope")).cast("string") if self.strict else stored)
        out = out.when(~version.isin("1", "2"), F.raise_error(F.concat(F.lit("unsupported envelope version "), version)).cast("string"))
        out = out.when(F.coalesce(F.length(n), F.lit(0)) != NONCE, F.raise_error(F.lit("bad nonce size")).cast("string"))
        for k in sorted(self.keyring.keys):
            plain = F.aes_decrypt(sealed, self._key(k), F.lit("GCM"), F.lit("DEFAULT"))
            bound = F.aes_decrypt(sealed, self._key(k), F.lit("GCM"), F.lit("DEFAULT"), F.lit(self.aad_prefix + k))
            out = out.when((kid == k) & (version == "1"), plain.cast("string")).when((kid == k) & (version == "2"), bound.cast("string"))
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown key "), F.coalesce(kid, F.lit("null")))).cast("string"))
