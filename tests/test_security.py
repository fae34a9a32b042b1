"""Keys of revisions 5 and 6 against a plain implementation with a cipher of its own."""

import hashlib

from pyspark.sql import functions as F

from pagequarry.operators import security


def boxes():
    """The AES substitution box, from inverses in its field."""
    times = lambda a, b: (0 if not b else (a if b & 1 else 0) ^ times((a << 1) ^ (0x11B if a & 128 else 0), b >> 1))
    out = []
    for x in range(256):
        inverse = next((y for y in range(256) if times(x, y) == 1), 0)
        v = 0x63
        for k in range(5):
            v ^= (inverse << k | inverse >> (8 - k)) & 255
        out.append(v)
    return out, times


BOX, TIMES = boxes()
DOUBLE = [TIMES(x, 2) for x in range(256)]


def expanded(key):
    n = len(key) // 4
    words, rcon = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1][:]
        if i % n == 0:
            w = [BOX[x] for x in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = DOUBLE[rcon]
        elif n > 6 and i % n == 4:
            w = [BOX[x] for x in w]
        words.append([a ^ b for a, b in zip(words[i - n], w)])
    return [sum(words[4 * r : 4 * r + 4], []) for r in range(n + 7)]


def block(data, keys):
    s = [a ^ b for a, b in zip(data, keys[0])]
    for r, key in enumerate(keys[1:], 1):
        s = [BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if r < len(keys) - 1:
            for c in range(0, 16, 4):
                a, t = s[c : c + 4], s[c] ^ s[c + 1] ^ s[c + 2] ^ s[c + 3]
                s[c : c + 4] = [a[i] ^ t ^ DOUBLE[a[i] ^ a[(i + 1) % 4]] for i in range(4)]
        s = [a ^ b for a, b in zip(s, key)]
    return bytes(s)


def cbc(data, key, iv):
    keys, out = expanded(key), b""
    for p in range(0, len(data), 16):
        iv = block([a ^ b for a, b in zip(data[p : p + 16], iv)], keys)
        out += iv
    return out


def hash_of(password, salt, user, revision):
    k = hashlib.sha256(password + salt + user).digest()
    count = 0
    while revision == 6:
        count += 1
        e = cbc((password + k + user) * 64, k[:16], k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[int.from_bytes(e[:16], "big") % 3](e).digest()
        if count >= 64 and e[-1] <= count - 32:
            break
    return k[:32]


def test_cipher_of_the_test():
    assert block(bytes(range(0, 256, 17)), expanded(bytes(range(16)))).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"


def test_hashes_and_keys(spark):
    rows = [(i, f"pass{i}é".encode()[: 5 + i], bytes([i] * 8), b"" if i % 2 else bytes(range(48)), 5 + i % 3 // 2) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, password binary, salt binary, user binary, revision int")
    got = df.select("i", security.hardened(F.col("password"), F.col("salt"), F.col("user"), F.col("revision")).alias("h")).collect()
    assert {r.i: bytes(r.h) for r in got} == {i: hash_of(p, s, u, v) for i, p, s, u, v in rows}


def test_plain_cbc_round_trip(spark):
    key, data = bytes(range(32)), bytes(range(100, 132))
    df = spark.createDataFrame([(bytearray(key), bytearray(data))], "k binary, d binary")
    sealed = security.aes_plain(F.col("d"), F.col("k"), F.lit(bytes(16)))
    row = df.select(sealed.alias("c")).first()
    assert bytes(row.c) == cbc(data, key, bytes(16))
    assert bytes(df.select(security.aes_open(sealed, F.col("k")).alias("p")).first().p) == data
