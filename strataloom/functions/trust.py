"""Keys, signatures and trust policies, on the driver. Ed25519 comes from the JVM beside it."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib

from pyspark.sql import SparkSession

from ..sources.store import canonical_json


def _java(spark: SparkSession):
    return spark._jvm.java.security


def keygen(spark: SparkSession) -> dict:
    pair = _java(spark).KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory, load = _java(spark).KeyFactory.getInstance("Ed25519"), spark._jvm.java.lang.Class.forName  # the keys' own classes are closed to reflection
    public = bytes(factory.getKeySpec(pair.getPublic(), load("java.security.spec.X509EncodedKeySpec")).getEncoded())
    private = bytes(factory.getKeySpec(pair.getPrivate(), load("java.security.spec.PKCS8EncodedKeySpec")).getEncoded())
    return {"algorithm": "ed25519", "key_id": hashlib.sha256(public).hexdigest()[:16], "public_key": base64.b64encode(public).decode(), "private_key": base64.b64encode(private).decode()}


#: What a signature repeats of the document, so that it can be held against it without the key.
SIGNED = ("root_hash", "expires_at", "not_before")


def sign(spark: SparkSession, document: dict, key: dict) -> dict:
    java = _java(spark)
    private = java.KeyFactory.getInstance("Ed25519").generatePrivate(java.spec.PKCS8EncodedKeySpec(bytearray(base64.b64decode(key["private_key"]))))
    signer = java.Signature.getInstance("Ed25519")
    signer.initSign(private)
    signer.update(bytearray(canonical_json(document)))
    signed = {name: document.get(name) for name in SIGNED}
    digest = hashlib.sha256(base64.b64decode(key["public_key"])).hexdigest()
    return {"algorithm": "ed25519", "key_id": key["key_id"], "public_key_sha256": digest, "signature": base64.b64encode(bytes(signer.sign())).decode(), **signed}


def signature_valid(spark: SparkSession, document: dict, signature: dict, public_key: str) -> bool:
    """The algorithm, what the signature repeats, the key's id and digest, and the bytes: all have to hold."""
    java = _java(spark)
    if signature.get("algorithm") != "ed25519" or any(signature.get(name) != document.get(name) for name in SIGNED):
        return False
    digest = hashlib.sha256(base64.b64decode(public_key)).hexdigest()
    if signature.get("key_id") != digest[:16] or signature.get("public_key_sha256", digest) != digest:
        return False
    public = java.KeyFactory.getInstance("Ed25519").generatePublic(java.spec.X509EncodedKeySpec(bytearray(base64.b64decode(public_key))))
    check = java.Signature.getInstance("Ed25519")
    check.initVerify(public)
    check.update(bytearray(canonical_json(document)))
    try:
        return bool(check.verify(bytearray(base64.b64decode(signature["signature"]))))
    except Exception:  # noqa: BLE001  a malformed signature isn't valid
        return False


def trusted_root(keys: list[dict], expires_at: str | None = None, require_signature: bool = True, min_release_seq: int = 0, allowed_mirrors: tuple[str, ...] = ()) -> dict:
    unique = {k["key_id"]: {"key_id": k["key_id"], "algorithm": "ed25519", "public_key": k["public_key"]} for k in keys}
    return {"schema": "strata.root", "version": 1, "expires_at": expires_at, "trusted_keys": list(unique.values()), "policy": {"require_signature": require_signature, "min_release_seq": min_release_seq, "allowed_mirrors": sorted({m.rstrip("/") for m in allowed_mirrors})}}


def parse_time(text: str | None) -> dt.datetime | None:
    """ISO time; without a zone it is UTC; nothing is no bound."""
    if not text:
        return None
    t = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)


def trust_errors(spark: SparkSession, document: dict, signature: dict | None, root: dict, now: dt.datetime, sources: tuple[str, ...] = ()) -> list[str]:
    """All that speaks against a release under a trusted root, in a fixed order."""
    errors = []
    if (end := parse_time(root.get("expires_at"))) and now > end:
        errors.append("root-expired")
    policy = root["policy"]
    if document["release_seq"] < policy["min_release_seq"]:
        errors.append("release-too-old")
    if (start := parse_time(document.get("not_before"))) and now < start:
        errors.append("not-yet-valid")
    elif (end := parse_time(document.get("expires_at"))) and now > end:
        errors.append("release-expired")
    if signature is None:
        errors += ["unsigned"] if policy["require_signature"] else []
    else:
        key = next((k for k in root["trusted_keys"] if k["key_id"] == signature.get("key_id")), None)
        if key is None:
            errors.append("unknown-key")
        elif not signature_valid(spark, document, signature, key["public_key"]):
            errors.append("bad-signature")
    if policy["allowed_mirrors"]:
        errors += [f"source-not-allowed: {s}" for s in sources if s.startswith(("http://", "https://")) and s.rstrip("/") not in policy["allowed_mirrors"]]
    return errors


def hmac_token(secret: bytes, prefix: str, expires: int) -> str:
    """A token for the paths below a prefix, closing slashes aside, until a Unix second."""
    import hmac

    prefix = prefix.rstrip("/")
    return f"{expires}.{hmac.new(secret, f'{prefix}{chr(10)}{expires}'.encode(), hashlib.sha256).hexdigest()}"
