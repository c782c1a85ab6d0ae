"""Files in and out: documents, logs, uploads, word tables, packages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: First bytes of file types.
MAGIC = {"pdf": "25504446", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "zip": "504B0304"}
ITEM = "label string, number string, type string, points string, body string, choices map<string,string>, bbox array<double>"
CIRCLED = ["①", "②", "③", "④", "⑤"]


def _parsed(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, Column]:
    """Lines of JSON as the struct ``r`` with their ``file``, and whether a line can't be read in full, whatever columns are used later."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = StructType([*kind.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).where(F.btrim("value") != "").select(F.input_file_name().alias("file"), F.from_json("value", bad, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return lines, F.col("r").isNull() | F.col("r._bad").isNotNull()


def load_documents(spark: SparkSession, path: str, schema: StructType | str, tenant: str | None = None) -> DataFrame:
    """JSON documents of a folder; unreadable ones are skipped (and counted by ``unreadable``), ones without a tenant never returned for a tenant."""
    lines, bad = _parsed(spark, path, schema)
    df = lines.where(~bad).select("r.*").drop("_bad")
    return df if tenant is None else df.where(F.col("tenant_id") == tenant)


def unreadable(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """``file, rows, unreadable`` of a folder of JSON documents: what ``load_documents`` skips (S2). Empty lines are no rows."""
    lines, bad = _parsed(spark, path, schema)
    return lines.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(bad).alias("unreadable"))


def save_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Documents as JSON lines, a folder for each tenant."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def fold_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Runs, failures and time by stage of a JSON log."""
    log = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return log.groupBy("stage").agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failed"), F.sum("duration_s").alias("seconds"))


def file_kind(content: Column) -> Column:
    """A file's type by its first bytes, null for none of the known."""
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*[F.when(head.startswith(m), k) for k, m in MAGIC.items()])


def ingest(spark: SparkSession, path: str, most_bytes: int = 50_000_000) -> DataFrame:
    """Assets of uploaded files: type, hash, size and place in natural order of names (S8, J27); equal bytes are one asset."""
    from lodestone.functions.text import natural_key, safe_filename

    f = spark.read.format("binaryFile").load(path)
    name = safe_filename(F.element_at(F.split("path", "/"), -1))
    a = f.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"), file_kind(F.col("content")).alias("kind"))
    a = a.withColumn("accepted", F.col("kind").isNotNull() & (F.col("byte_size") <= most_bytes))
    return a.groupBy("sha256").agg(F.min(F.struct(natural_key(F.col("name")).alias("k"), "name")).alias("n"), F.first("byte_size").alias("byte_size"), F.first("kind").alias("kind"), F.first("accepted").alias("accepted")).select("sha256", "n.name", "byte_size", "kind", "accepted")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a word table: rows of level 5 with confidence 0 to 1."""
    t = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    num = ["page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height"]
    t = t.where(F.col("level") == "5")
    return t.select(*[F.col(c).try_cast("int").alias(c) for c in num], (F.col("conf").try_cast("double") / 100).alias("conf"), "text").where("left is not null")


def word_lines(words: DataFrame) -> DataFrame:
    """Lines of words: text in order, mean confidence, box; blank words widen the box only."""
    key = ["page_num", "block_num", "par_num", "line_num"]
    said = F.btrim("text") != ""
    text = F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("word_num", F.btrim(F.coalesce("text", F.lit(""))).alias("t"))), lambda x: x["t"] != "")), lambda x: x["t"]), " ")
    g = words.groupBy(*key).agg(text.alias("text"), F.avg(F.when(said, F.col("conf"))).alias("conf"), F.min("left").alias("x"), F.min("top").alias("y"), F.max(F.col("left") + F.col("width")).alias("r"), F.max(F.col("top") + F.col("height")).alias("b"))
    return g.select(*key, "text", "conf", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))


def flatten_results(df: DataFrame, key: str, texts: str, scores: str, polys: str) -> DataFrame:
    """Parallel arrays of an engine's result as rows: text, score, box."""
    from lodestone.operators.spatial import polygon_box

    z = df.select(key, F.posexplode(F.arrays_zip(F.col(texts).alias("text"), F.col(scores).alias("score"), F.col(polys).alias("poly"))).alias("place", "r"))
    return z.select(key, "place", "r.text", "r.score", polygon_box(F.col("r.poly")).alias("box"))


def normal_items(df: DataFrame, key: str, reply: str) -> DataFrame:
    """Items of a reply: label and body needed, repeated choice marks dropped, points 1 to 99, boxes of four ordered numbers."""
    items = df.select(key, F.posexplode(F.from_json(F.col(reply), f"array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")).alias("place", "i")).select(key, "place", "i.*")
    items = items.where((F.btrim("label") != "") & (F.btrim("body") != ""))
    strip = F.transform_values("choices", lambda k, v: F.btrim(F.regexp_replace(v, r"^\s*(?:[①-⑤]|\(?[1-5][.)])\s*", "")))
    p = F.col("points").try_cast("int")
    box = F.when((F.size("bbox") == 4) & (F.col("bbox")[0] < F.col("bbox")[2]) & (F.col("bbox")[1] < F.col("bbox")[3]), F.col("bbox"))
    return items.withColumns({"choices": strip, "points": F.when(p.between(1, 99), p), "bbox": box})


def extraction_confidence(items: DataFrame, key: str) -> DataFrame:
    """0.7 and up to 0.2 for the share of items with a box."""
    return items.groupBy(key).agg((0.7 + 0.2 * F.count_if(F.col("bbox").isNotNull()) / F.count("*")).alias("confidence"))


def uncached(asked: DataFrame, cache: DataFrame, inputs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests answered by the cache, and the distinct keys that aren't (S19). The key is a hash of the inputs."""
    k = asked.withColumn("cache_key", F.sha2(F.to_json(F.struct(*inputs)), 256))
    return k.join(cache, "cache_key"), k.select("cache_key", *inputs).dropDuplicates(["cache_key"]).join(cache, "cache_key", "left_anti")


def package_census(df: DataFrame, key: str, content: str) -> DataFrame:
    """Elements of the XML parts of zipped packages: part, path, tag, text, digest (S20). Unreadable packages have one row with an error."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import io
        import xml.etree.ElementTree as ET
        import zipfile

        import pandas as pd

        for batch in batches:
            rows = []
            for k, data in zip(batch[key], batch[content]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for name in sorted(z.namelist()):
                            if not name.endswith(".xml"):
                                continue
                            stack = [(ET.fromstring(z.read(name)), "0")]
                            while stack:
                                e, path = stack.pop()
                                rows.append((k, name, path, e.tag.rpartition("}")[2], (e.text or "").strip(), hashlib.sha256(ET.tostring(e)).hexdigest(), None))
                                stack += [(c, f"{path}/{i}") for i, c in enumerate(e)]
                except Exception as x:  # noqa: BLE001 - a broken package is a row, not a failure
                    rows.append((k, None, None, None, None, None, type(x).__name__))
            yield pd.DataFrame(rows, columns=[key, "part", "path", "tag", "text", "digest", "error"])

    return df.select(key, content).mapInPandas(run, f"{key} {kind}, part string, path string, tag string, text string, digest string, error string")
