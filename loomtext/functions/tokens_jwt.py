"""JSON web tokens and keys: decoding and thumbprints as expressions, signatures as functions.

Secrets are texts for HS256, HS384 and HS512, and JSON web keys for RS*, PS*, ES256, ES384 and EdDSA."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import keys
from loomtext.functions.udf import scalar

_HASH = {"HS256": hashlib.sha256, "HS384": hashlib.sha384, "HS512": hashlib.sha512}
_UNITS = {"": 1, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_557_600_000}


def _part(token: Column, i: int) -> Column:
    return F.unbase64(F.translate(F.get(F.split(token, r"\."), i), "-_", "+/")).cast("string")


def decode(token: Column) -> Column:
    """Struct of header and payload as JSON texts, the signature unchecked; null for fewer than two parts."""
    return F.when(F.size(F.split(token, r"\.")) >= 2, F.struct(_part(token, F.lit(0)).alias("header"), _part(token, F.lit(1)).alias("payload")))


def thumbprint(jwk: Column) -> Column:
    """SHA-256 thumbprint of a JSON web key: its required members in order, base64url without padding."""
    get = lambda k: F.get_json_object(jwk, f"$.{k}")

    def canonical(*members: str) -> Column:
        parts: list[Column] = []
        for i, m in enumerate(members):
            parts += [F.lit(("," if i else "{") + f'"{m}":"'), get(m), F.lit('"')]
        return F.concat(*parts, F.lit("}"))

    text = F.when(get("kty") == "RSA", canonical("e", "kty", "n")).when(get("kty") == "EC", canonical("crv", "kty", "x", "y")).when(get("kty") == "OKP", canonical("crv", "kty", "x")).when(get("kty") == "oct", canonical("k", "kty"))
    return F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/=", "-_")


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def duration_ms(text: str | int | float) -> int:
    """'2h', '10 days' or '100' (milliseconds) as milliseconds."""
    if not isinstance(text, str):
        return int(text)
    m = re.fullmatch(r"\s*(-?\d+(?:\.\d+)?)\s*([a-z]*)\s*", text.lower())
    unit = m and {"milliseconds": "ms", "msecs": "ms", "seconds": "s", "sec": "s", "secs": "s", "second": "s", "minutes": "m", "min": "m", "mins": "m", "minute": "m", "hours": "h", "hr": "h", "hrs": "h", "hour": "h", "days": "d", "day": "d", "weeks": "w", "week": "w", "years": "y", "yrs": "y", "year": "y"}.get(m[2], m[2])
    if not m or unit not in _UNITS:
        raise ValueError(f"not a duration: {text}")
    return int(float(m[1]) * _UNITS[unit])


def sign_text(payload: str, secret: str, algorithm: str = "HS256", now: int = 0, expires_in: str | None = None) -> str:
    if algorithm not in _HASH and algorithm not in keys.ALGORITHMS:
        raise ValueError(f"unsupported algorithm: {algorithm}")
    claims = json.loads(payload)
    claims.setdefault("iat", now)
    if expires_in is not None:
        claims["exp"] = now + duration_ms(expires_in) // 1000
    body = f"{_b64(json.dumps({'alg': algorithm, 'typ': 'JWT'}, separators=(',', ':')).encode())}.{_b64(json.dumps(claims, separators=(',', ':')).encode())}"
    signature = hmac.new(secret.encode(), body.encode(), _HASH[algorithm]).digest() if algorithm in _HASH else keys.sign(secret, body.encode(), algorithm)
    return f"{body}.{_b64(signature)}"


def verify_text(token: str, secret: str, now: int, leeway: int = 0, algorithms: tuple[str, ...] = ("HS256",)) -> str | None:
    """The payload if signature and times hold, else null."""
    parts = token.split(".")
    if len(parts) != 3:
        return None
    try:
        head, body, signature = (base64.urlsafe_b64decode(p + "=" * (-len(p) % 4)) for p in parts)
        name, claims = json.loads(head).get("alg"), json.loads(body)
    except ValueError:
        return None
    if name not in algorithms or name not in _HASH and name not in keys.ALGORITHMS:
        return None
    signed = f"{parts[0]}.{parts[1]}".encode()
    if not (hmac.compare_digest(signature, hmac.new(secret.encode(), signed, _HASH[name]).digest()) if name in _HASH else keys.verify(secret, signed, signature, name)):
        return None
    if claims.get("exp", now) < now - leeway or claims.get("nbf", now) > now + leeway:
        return None
    return body.decode()


def sign(payload: Column, secret: str, algorithm: str = "HS256", now: int = 0, expires_in: str | None = None) -> Column:
    return scalar(lambda p: sign_text(p, secret, algorithm, now, expires_in), "string")(payload)


def verify(token: Column, secret: str, now: int, leeway: int = 0, algorithms: tuple[str, ...] = ("HS256",)) -> Column:
    return scalar(lambda t: verify_text(t, secret, now, leeway, algorithms), "string")(token)
