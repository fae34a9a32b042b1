"""Images and streams decoded, colour spaces and fonts described, colours made."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.kernels import filters
from pagequarry.kernels import images as kernel
from pagequarry.operators import sequences
from pagequarry.operators.navigation import items, resolved
from pagequarry.operators.tables import expanded, field

#: Components of the colour spaces whose name alone says how many.
COMPONENTS = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4, "Indexed": 1, "I": 1, "Separation": 1, "Pattern": 1}


def stream_digests(live: DataFrame) -> DataFrame:
    """doc_id, obj and, of the decoded bytes of every stream, length and SHA-256; ``error`` where they cannot be decoded."""
    streams = live.where("stream IS NOT NULL").select("doc_id", "obj", F.coalesce("resolved", "value").alias("spec"), "stream")

    def rows_of(row: dict) -> Iterator[dict]:
        out = {"doc_id": row["doc_id"], "obj": row["obj"]}
        try:
            data = filters.decode(row["stream"], json.loads(row["spec"]))
            yield out | {"n_bytes": len(data), "digest": hashlib.sha256(data).hexdigest()}
        except filters.FilterIssue as e:
            yield out | {"error": str(e)}

    return expanded(streams, rows_of, "doc_id long, obj int, n_bytes long, digest string, error string")


def described(space: Column) -> Column:
    """struct<name, components, base> of a colour space value whose parts are resolved; null where it is none.

    DeviceN has as many components as colorants; ICCBased as its profile says.
    """
    parts = items(space)
    name = F.substring(F.when(space.startswith("["), F.get(parts, F.lit(0))).otherwise(space), 2, 2**30)
    second = F.get(parts, F.lit(1))
    fixed = F.create_map(*[F.lit(x) for pair in COMPONENTS.items() for x in pair])[name]
    n = F.when(name == "DeviceN", F.size(items(second))).when(name == "ICCBased", field(second, "N").try_cast("int")).otherwise(fixed)
    base = F.when(name.isin("Indexed", "I", "Pattern"), second)
    return F.when(n.isNotNull(), F.struct(name.alias("name"), n.alias("components"), base.alias("base")))


def made_color(operands: Column, components: Column, highest: Column) -> Column:
    """Components of a colour: missing ones are 0, what is no number ends them; an index is rounded half up and clamped to ``highest`` (null: no index)."""
    values = F.transform(F.sequence(F.lit(0), components - 1), lambda i: F.coalesce(F.get(operands, i).try_cast("double"), F.lit(0.0)))
    index = F.transform(values, lambda v: F.greatest(F.lit(0.0), F.least(F.floor(v + 0.5).cast("double"), highest.cast("double"))))
    return F.when(highest.isNull(), values).otherwise(index)


def decoded_images(live: DataFrame, entries: DataFrame) -> DataFrame:
    """Image resources with their samples: doc_id, page_index, name, obj, width, height, bits, components, samples; ``error`` where they cannot be decoded.

    Samples of less than a byte get one each, palette indexes their colours;
    formats that the filters pass through stay encoded.
    """
    own = entries.where("scope = 0 AND category = 'XObject'").where(field("value", "Subtype") == "/Image").select("doc_id", "page_index", "name", "obj", F.col("spec").alias("dict"))
    spaces = resolved(own.withColumn("space", field("dict", "ColorSpace")), live, "space")
    parts = items(F.col("space"))
    indexed = F.col("space").startswith("[") & F.get(parts, F.lit(0)).isin("/Indexed", "/I")
    base = resolved(spaces.withColumn("base", F.when(indexed, F.get(parts, F.lit(1)))).withColumn("palette", F.when(indexed, F.get(parts, F.lit(3)))), live, "base")
    sized = base.select(
        "doc_id", "page_index", "name", "obj", "dict", described(F.col("space"))["components"].alias("components"), described(F.col("base"))["components"].alias("base_components"), "palette"
    )
    streams = live.where("stream IS NOT NULL").select("doc_id", "obj", "stream")

    def rows_of(row: dict) -> Iterator[dict]:
        out = {k: row[k] for k in ("doc_id", "page_index", "name", "obj")}
        try:
            spec = json.loads(row["dict"])
            mask = spec.get("ImageMask") is True
            width, height, bits = int(spec["Width"]), int(spec["Height"]), 1 if mask else int(spec.get("BitsPerComponent", 8))
            n = 1 if mask else row["components"] or 1
            data = filters.decode(row["stream"], spec)
            names = spec.get("Filter") or []
            if not set(names if isinstance(names, list) else [names]) & set(filters.PASSED):
                found = kernel.unpacked(data, width, height, n, bits)
                if row["base_components"]:
                    found, n = kernel.expanded(found, bytes.fromhex((row["palette"] or "s:")[2:]), row["base_components"]), row["base_components"]
                data = found.tobytes()
            yield out | {"width": width, "height": height, "bits": bits, "components": n, "samples": data}
        except (filters.FilterIssue, KeyError, TypeError, ValueError) as e:
            yield out | {"error": str(e)}

    schema = "doc_id long, page_index int, name string, obj int, width int, height int, bits int, components int, samples binary, error string"
    return expanded(sized.join(streams, ["doc_id", "obj"], "left"), rows_of, schema)


def fonts(live: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per document and font name: kind, encoding, whether it is embedded, and its descriptor's numbers.

    Where pages use one name for several fonts the later page's holds.
    """
    own = entries.where("category = 'Font'")
    name = F.regexp_replace(F.substring(field("spec", "BaseFont"), 2, 2**30), "^[A-Z]{6}[+]", "")
    kid = F.get(items(field("spec", "DescendantFonts")), F.lit(0))
    found = own.select(
        "doc_id", "page_index", F.coalesce(name, "name").alias("name"), F.substring(field("spec", "Subtype"), 2, 2**30).alias("kind"),
        F.when(field("spec", "Encoding").startswith("/"), F.substring(field("spec", "Encoding"), 2, 2**30)).alias("encoding"),
        F.coalesce(field("spec", "FontDescriptor"), field(kid, "FontDescriptor")).alias("d"), field("spec", "ToUnicode").isNotNull().alias("has_unicode"),
    )
    described_rows = resolved(found, live, "d")
    numbers = {"Ascent": "ascent", "Descent": "descent", "CapHeight": "cap_height", "ItalicAngle": "italic_angle", "MissingWidth": "missing_width"}
    embedded = field("d", "FontFile").isNotNull() | field("d", "FontFile2").isNotNull() | field("d", "FontFile3").isNotNull()
    told = described_rows.select(
        "doc_id", "page_index", "name", "kind", "encoding", "has_unicode", F.coalesce(embedded, F.lit(False)).alias("embedded"),
        F.coalesce(field("d", "Flags").try_cast("int"), F.lit(0)).alias("flags"), *[field("d", k).try_cast("double").alias(c) for k, c in numbers.items()],
    )
    return sequences.one_per(told, ["doc_id", "name"], [F.desc("page_index"), "kind"]).drop("page_index")
