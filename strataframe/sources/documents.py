"""Layout files of extracted documents: which page a figure is on, its caption, and the text around it.

``docs`` has a row per layout file: doc and body, the JSON text of a list of pages, each a list of items.
``files`` has the images that exist: doc and name. What isn't JSON, or isn't of this form, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def layout_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, body) of each subfolder's layout file; the second version's file goes before the first's, then by name."""
    path = F.col("_metadata.file_path")
    t = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_content_list*.json").text(folder).select(path.alias("path"), F.col("value").alias("body"))
    t = t.where(r"path rlike '_content_list(_v2)?\\.json$'").withColumn("doc", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    first = F.row_number().over(Window.partitionBy("doc").orderBy(~F.col("path").endswith("_v2.json"), "path"))
    return t.withColumn("k", first).where("k = 1").select("doc", "body")


def items(docs: DataFrame) -> DataFrame:
    """(doc, page, k, kind, item): the items of each page in order, as variants."""
    pages = docs.select("doc", F.posexplode(F.expr("try_variant_get(try_parse_json(body), '$', 'array<variant>')")).alias("page", "p"))
    rows = pages.select("doc", "page", F.posexplode(F.expr("try_variant_get(p, '$', 'array<variant>')")).alias("k", "item"))
    return rows.withColumn("kind", F.expr("try_variant_get(item, '$.type', 'string')"))


def joined_text(path: str) -> Column:
    """The texts of a list's text parts, joined by a blank; other parts are passed over."""
    parts = F.expr(f"try_variant_get(item, '{path}', 'array<variant>')")
    text = F.transform(parts, lambda v: F.when(F.try_variant_get(v, "$.type", "string") == "text", F.try_variant_get(v, "$.content", "string")))
    return F.array_join(F.filter(text, lambda s: s.isNotNull() & (s != "")), " ")


def images(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, name, page, k, caption) of image items whose file exists.

    Dots at the end of a path are cut off; a name without an extension is tried with the fixed ones in turn.
    """
    base = F.regexp_extract(F.rtrim(F.expr("try_variant_get(item, '$.content.image_source.path', 'string')"), F.lit(".")), "([^/]*)$", 1)
    i = items(docs).where("kind = 'image'").select("doc", "page", "k", base.alias("base"), F.trim(joined_text("$.content.image_caption")).alias("caption")).where("base <> ''")
    names = F.when(F.col("base").contains("."), F.array("base")).otherwise(F.array(*[F.concat("base", F.lit(e)) for e in (".jpg", ".jpeg", ".png")]))
    tried = i.select("doc", "page", "k", "caption", F.posexplode(names).alias("turn", "name")).join(files.select("doc", "name").distinct(), ["doc", "name"])
    return tried.groupBy("doc", "page", "k").agg(F.min_by("name", "turn").alias("name"), F.first("caption").alias("caption")).select("doc", "name", "page", "k", "caption")


def page_map(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, name, page): the last page that shows a figure."""
    return images(docs, files).groupBy("doc", "name").agg(F.max("page").alias("page"))


def caption_map(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, name, caption): a figure's last caption that isn't empty."""
    return images(docs, files).where("caption <> ''").groupBy("doc", "name").agg(F.max_by("caption", F.struct("page", "k")).alias("caption"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc, page, k, kind, text, bbox): titles, paragraphs, plain texts, captions and footnotes."""
    plain = F.when(F.expr("schema_of_variant(variant_get(item, '$.content')) = 'STRING'"), F.expr("try_variant_get(item, '$.content', 'string')"))
    block = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    found = (
        F.when(F.col("kind") == "image", F.array(*[block(k, joined_text(f"$.content.{k}")) for k in ("image_caption", "image_footnote")]))
        .when(F.col("kind") == "title", F.array(block("title", joined_text("$.content.title_content"))))
        .when(F.col("kind") == "paragraph", F.array(block("paragraph", joined_text("$.content.paragraph_content"))))
        .when(F.col("kind") == "text", F.array(block("text", plain)))
    )
    bbox = F.coalesce(F.expr("try_variant_get(item, '$.bbox', 'array<double>')"), F.expr("cast(array() as array<double>)"))
    b = items(docs).select("doc", "page", "k", bbox.alias("bbox"), F.explode(found).alias("b")).where("b.text <> ''")
    return b.select("doc", "page", "k", "b.kind", "b.text", "bbox")
