"""Encrypted documents: one key a document, and objects decrypted by native expressions.

The Encrypt dictionary is a row. Keys of revisions 2 to 4 come from a small helper;
those of revisions 5 and 6 from an expression over Spark's own AES and SHA functions
(:func:`hardened`). AES is Spark's own function throughout; only the older stream cipher needs Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from pagequarry.functions import samples
from pagequarry.kernels import crypt, document
from pagequarry.operators.navigation import items, resolved
from pagequarry.operators.tables import PARTS, expanded, field

UNLOCKED = "doc_id long, key binary, stream_method string, string_method string, permissions long, error string, spec string, file_id binary"


def one(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(value: Column, start: int, length: int) -> Column:
    return F.substring(value, start + 1, length)


def aes_plain(data: Column, key: Column, iv: Column) -> Column:
    """AES-CBC of whole blocks without padding: what Spark's function puts before (the vector) and after (a block of padding) is cut off."""
    return F.substring(F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17), F.octet_length(data))


def aes_open(data: Column, key: Column) -> Column:
    """Inverse of :func:`aes_plain` with a vector of zeros: a block that decrypts to padding is put behind the data."""
    last = F.substring(data, -16, 16)
    padding = F.substring(F.aes_encrypt(F.lit(b""), key, F.lit("CBC"), F.lit("PKCS"), last), 17, 16)
    return F.try_aes_decrypt(F.concat(F.lit(bytes(16)), data, padding), key, F.lit("CBC"), F.lit("PKCS"))


ROUNDS = 64 + 255 - 32  # the last byte of a round is at most 255, so no hash takes more


def hardened(password: Column, salt: Column, user: Column, revision: Column) -> Column:
    """Hash of a password (revision 5: one SHA-256; 6: rounds of AES and SHA that end where the data say)."""
    start = F.unhex(F.sha2(F.concat(password, salt, user), 256))

    def step(state: Column, count: Column) -> Column:
        k = state["k"]
        block = F.concat(password, k, user)
        many = F.repeat(block.cast("string"), 64).cast("binary")  # bytes as they are

        def after(e: Column) -> Column:
            digits = F.hex(_part(e, 0, 16))
            rest = sum((F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)), F.lit(0)) % 3
            digest = F.unhex(one(rest, lambda n: F.when(n == 0, F.sha2(e, 256)).when(n == 1, F.sha2(e, 384)).otherwise(F.sha2(e, 512))))
            last = F.conv(F.hex(F.substring(e, -1, 1)), 16, 10).cast("int")
            return F.struct(digest.alias("k"), ((count >= 64) & (last <= count - 32)).alias("done"))

        return F.when(state["done"], state).otherwise(one(aes_plain(many, _part(k, 0, 16), _part(k, 16, 16)), after))

    first = F.struct(start.alias("k"), F.lit(False).alias("done"))
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step, lambda state: _part(state["k"], 0, 32))
    return F.when(revision == 5, start).when(revision == 6, rounds)


def strong_key(password: Column, spec: Column, revision: Column) -> Column:
    """Key of a revision 5 or 6 dictionary by user or owner password; null where neither fits."""

    def held(name: str) -> Column:
        return F.unhex(F.regexp_extract(field(spec, name), "^s:([0-9a-f]*)$", 1))

    none = F.lit(b"")
    user, owner = held("U"), _part(held("O"), 0, 48)

    def keyed(u: Column) -> Column:
        whole = _part(u, 0, 48)
        by_user = hardened(password, _part(u, 32, 8), none, revision) == _part(u, 0, 32)
        by_owner = hardened(password, _part(owner, 32, 8), whole, revision) == _part(owner, 0, 32)
        return F.when(by_user, aes_open(_part(held("UE"), 0, 32), hardened(password, _part(u, 40, 8), none, revision))).when(
            by_owner, aes_open(_part(held("OE"), 0, 32), hardened(password, _part(owner, 40, 8), whole, revision))
        )

    return one(user, keyed)


def crypt_method(spec: Column, name: Column) -> Column:
    """Method of a named crypt filter."""
    filters = F.from_json(field(spec, "CF"), "map<string,struct<CFM:string>>")
    return F.regexp_extract(F.try_element_at(filters, name)["CFM"], "^/(.+)$", 1)


def unlocked(live: DataFrame, roots: DataFrame, password: str | None) -> DataFrame:
    """One row per encrypted document: key and methods, permission bits, or the error (password required, invalid password, unsupported)."""
    found = resolved(roots.select("doc_id", field("trailer", "Encrypt").alias("spec"), field("trailer", "ID").alias("ids")), live, "spec").where("spec IS NOT NULL")
    first = F.get(items(F.col("ids")), F.lit(0))
    keyed = found.select("doc_id", "spec", F.unhex(F.regexp_extract(first, "^s:([0-9a-f]*)$", 1)).alias("file_id"))
    # dictionaries are small in bytes and keys costly: the number of partitions is stated, so that few bytes do not end in few tasks
    keyed = keyed.repartition(int(live.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    version, revision = field("spec", "V").try_cast("int"), field("spec", "R").try_cast("int")
    is_strong = F.coalesce((field("spec", "Filter") == "/Standard") & (version == 5) & revision.isin(5, 6), F.lit(False))

    def rows_of(row: dict) -> Iterator[dict]:
        spec = json.loads(row["spec"])
        secret = None if password is None else password.encode("latin-1", "replace")
        yield row | crypt.unlock(secret, spec if isinstance(spec, dict) else {}, row["file_id"] or b"")

    older = expanded(keyed.where(~is_strong), rows_of, UNLOCKED)
    secret = F.lit(None if password is None else password.encode()[:127]).cast("binary")

    def method(name: str) -> Column:
        filter_name = F.coalesce(F.regexp_extract(field("spec", name), "^/(.+)$", 1), F.lit("Identity"))
        return F.when(filter_name == "Identity", "Identity").otherwise(
            crypt_method(F.col("spec"), filter_name)
        )

    strong = keyed.where(is_strong).select("doc_id", "spec", "file_id", revision.alias("r"), method("StmF").alias("stream_method"), method("StrF").alias("string_method"))
    known = F.col("stream_method").isin("AESV3", "Identity") & F.col("string_method").isin("AESV3", "Identity")
    sound = known & F.coalesce((F.length(field("spec", "U")) >= 98) & (F.length(field("spec", "O")) >= 98) & (F.length(field("spec", "UE")) >= 66) & (F.length(field("spec", "OE")) >= 66), F.lit(False))
    opened = strong.withColumn("key", F.when(sound & secret.isNotNull(), strong_key(secret, F.col("spec"), F.col("r"))))
    error = F.when(~sound, "unsupported encryption").when(secret.isNull(), "password required").when(F.col("key").isNull(), "invalid password")
    bits = field("spec", "P").try_cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    own = opened.withColumn("error", error)
    return older.unionByName(
        own.select(
            "doc_id", "key", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("stream_method", "string_method")],
            F.when(F.col("error").isNull(), bits).alias("permissions"), "error", "spec", "file_id",
        )
    )


def encryption_info(live: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, handler, version, revision, key length in bits, and the methods of streams and strings, as the dictionary states them."""
    found = resolved(roots.select("doc_id", field("trailer", "Encrypt").alias("spec")), live, "spec").where("spec IS NOT NULL")
    version = F.coalesce(field("spec", "V").try_cast("int"), F.lit(0))
    length = F.when(version == 5, 256).when(version == 1, 40).otherwise(F.coalesce(field("spec", "Length").try_cast("int"), F.lit(40)))

    def method(name: str) -> Column:
        filter_name = F.regexp_extract(field("spec", name), "^/(.+)$", 1)
        stated = crypt_method(F.col("spec"), filter_name)
        return F.when(version < 4, "V2").otherwise(F.coalesce(F.when(stated != "", stated), F.lit("Identity")))

    return found.select(
        "doc_id", F.regexp_extract(field("spec", "Filter"), "^/(.+)$", 1).alias("handler"), version.alias("version"), field("spec", "R").try_cast("int").alias("revision"),
        length.alias("bits"), method("StmF").alias("stream_method"), method("StrF").alias("string_method"),
        F.coalesce(field("spec", "EncryptMetadata") != "false", F.lit(True)).alias("metadata"),
    )


def permissions(roots: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, printable, modifiable, extractable; documents without encryption allow everything."""
    bits = samples.permissions(F.col("permissions"))
    allowed = [F.coalesce(bits[k], F.lit(True)).alias(k) for k in ("printable", "modifiable", "extractable")]
    return roots.select("doc_id").join(keys.select("doc_id", "permissions"), "doc_id", "left").select("doc_id", *allowed)


def object_key(key: Column, obj: Column, gen: Column, method: Column) -> Column:
    """Key of one object: of the document's key, its number and generation, and the method's salt."""

    def low_bytes(n: Column, count: int) -> Column:
        hexes = F.lpad(F.hex(n.cast("long")), 2 * count, "0")
        return F.concat(*[F.substring(hexes, 2 * (count - 1 - i) + 1, 2) for i in range(count)])

    salted = F.concat(F.hex(key), low_bytes(obj, 3), low_bytes(gen, 2), F.when(method == "AESV2", F.lit("73416C54")).otherwise(""))
    digest = F.md5(F.unhex(salted))
    return F.when(method == "AESV3", key).otherwise(F.unhex(F.substring(digest, F.lit(1), F.least(F.octet_length(key) + 5, F.lit(16)) * 2)))


@F.pandas_udf(ArrayType(BinaryType()))
def rc4_each(keys: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or k is None else [None if x is None else crypt.rc4(k, bytes(x)) for x in v] for k, v in zip(keys, values, strict=True)])


def decrypted(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """``objects`` with strings and streams in the clear; those of documents without a key stay as they are.

    Members of object streams come in the clear with their container: they are
    read again from it once it is decrypted.
    """
    own = keys.where("key IS NOT NULL").select("doc_id", "key", "stream_method", "string_method")
    met = objects.join(own, "doc_id", "left")
    plain = met.where("key IS NULL").drop("key", "stream_method", "string_method")
    locked = met.where("key IS NOT NULL AND container IS NULL")
    pattern = '"s:([0-9a-f]*)"'
    exempt = F.coalesce(field("value", "Type") == "/XRef", F.lit(False)) | (F.coalesce(field("value", "Filter"), F.lit("")) == "/Standard")
    strings = F.transform(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)), lambda h: F.unhex(h))
    prepared = locked.withColumn("exempt", exempt).withColumn("strings", strings).withColumn(
        "string_key", object_key(F.col("key"), F.col("obj"), F.col("gen"), F.col("string_method"))
    ).withColumn("stream_key", object_key(F.col("key"), F.col("obj"), F.col("gen"), F.col("stream_method")))

    def clear(values: Column, by: Column, method: Column) -> Column:
        aes = F.transform(values, lambda v: F.try_aes_decrypt(v, by, F.lit("CBC"), F.lit("PKCS")))
        return F.when(method.isin("AESV2", "AESV3"), aes).when(method == "V2", rc4_each(F.when(method == "V2", by), F.when(method == "V2", values))).otherwise(values)

    opened = prepared.withColumn("strings", F.when(F.col("exempt"), F.col("strings")).otherwise(clear(F.col("strings"), F.col("string_key"), F.col("string_method"))))
    raw = F.get(clear(F.array("stream"), F.col("stream_key"), F.col("stream_method")), F.lit(0))
    opened = opened.withColumn("stream", F.when(F.col("exempt") | F.col("stream").isNull(), F.col("stream")).otherwise(raw))
    gaps = F.split("value", pattern, -1)
    rebuilt = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.concat(F.lit('"s:'), F.lower(F.hex(F.get("strings", i))), F.lit('"')), F.lit("")))), "")
    done = opened.withColumn("value", F.when(F.size("strings") > 0, rebuilt).otherwise(F.col("value"))).select(*plain.columns)
    return plain.unionByName(done).unionByName(_members(done).select(*plain.columns))


def _members(done: DataFrame) -> DataFrame:
    """Objects of decrypted object streams; current like their container, unless it is replaced."""
    packed = done.where("stream IS NOT NULL").where(field("value", "Type") == "/ObjStm").select("doc_id", "seq", "obj", "offset", "stream", F.coalesce("resolved", "value").alias("spec"), "live")

    def rows_of(row: dict) -> Iterator[dict]:
        for r in document.members(row, json.loads(row["spec"])):
            yield r | {"doc_id": row["doc_id"], "seq": row["seq"], "kind": "object", "live": row["live"] and not r["error"], "repaired": False, "value": json.dumps(r["value"])}

    return expanded(packed, rows_of, PARTS)
