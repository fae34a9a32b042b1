"""The standard password handler's keys (revisions 2 to 4) and the RC4 cipher."""

from __future__ import annotations

import hashlib

# Fixed value: what passwords are padded with.
PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(data), 0, 0
    for k, byte in enumerate(data):
        i = (i + 1) & 255
        x = s[i]
        j = (j + x) & 255
        s[i], s[j] = y, _ = s[j], x
        out[k] = byte ^ s[(x + y) & 255]
    return bytes(out)


def file_key(password: bytes, owner: bytes, permissions: int, file_id: bytes, length: int, revision: int, metadata: bool = True) -> bytes:
    """The document's key from the user password."""
    start = (password + PADDING)[:32] + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id
    found = hashlib.md5(start + (b"\xff" * 4 if revision >= 4 and not metadata else b"")).digest()
    for _ in range(50 if revision >= 3 else 0):
        found = hashlib.md5(found[:length]).digest()
    return found[:length]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    """What the dictionary's U must begin with if the key is right."""
    if revision == 2:
        return rc4(key, PADDING)
    value = hashlib.md5(PADDING + file_id).digest()
    for i in range(20):
        value = rc4(bytes(b ^ i for b in key), value)
    return value + bytes(16)


#: Version and revision pairs that are read, and whether the key length can vary.
KNOWN = {(1, 2): False, (2, 3): True, (4, 4): True}


def unlock(password: bytes | None, spec: dict, file_id: bytes) -> dict:
    """key, stream and string method, permissions and error of an Encrypt dictionary (references followed)."""
    out = {"key": None, "stream_method": None, "string_method": None, "permissions": None, "error": None}
    try:
        version, revision, permissions = spec.get("V", 0), spec.get("R", 0), spec["P"]
        if spec.get("Filter") != "/Standard" or (version, revision) not in KNOWN:
            return out | {"error": "unsupported encryption"}
        if password is None:
            return out | {"error": "password required"}
        length = spec.get("Length", 40) if KNOWN[version, revision] else 40
        owner, user = bytes.fromhex(spec["O"][2:]), bytes.fromhex(spec["U"][2:])
        methods = ["V2", "V2"]
        if version == 4:
            filters = spec.get("CF", {})
            methods = [filters.get(spec.get(k, "/Identity")[1:], {}).get("CFM", "/Identity")[1:] for k in ("StmF", "StrF")]
        if length % 8 or not 40 <= length <= 128 or set(methods) - {"V2", "AESV2", "Identity"} or len(user) < 32 or not owner or not file_id:
            return out | {"error": "unsupported encryption"}
        key = file_key(password, owner, permissions, file_id, length // 8, revision, spec.get("EncryptMetadata", True) is not False)
        if user_entry(key, file_id, revision)[: 32 if revision == 2 else 16] != user[: 32 if revision == 2 else 16]:
            return out | {"error": "invalid password"}
        return out | {"key": key, "stream_method": methods[0], "string_method": methods[1], "permissions": permissions & 0xFFFFFFFF}
    except (KeyError, TypeError, ValueError, AttributeError):
        return out | {"error": "unsupported encryption"}
