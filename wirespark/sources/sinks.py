"""Exports: JSON results, evidence bundles, metrics text, tables of models. All write through Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = '{"uco-core":"https://ontology.unifiedcyberontology.org/uco/core/","uco-observable":"https://ontology.unifiedcyberontology.org/uco/observable/","case-investigation":"https://ontology.caseontology.org/case/investigation/"}'


def urn(*parts: Column | str) -> Column:
    """A stable identifier from content: the same object gets the same one in every run."""
    h = F.md5(F.concat_ws("|", *(F.col(p) if isinstance(p, str) else p for p in parts)).cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-"), cut(13, 4), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12))


def results_json(packets: DataFrame, hosts: DataFrame, files: DataFrame | None = None, name: str = "analysis") -> DataFrame:
    """Rows of (section, json): metadata, stats, and one line for each host and carved file. No section is gathered into one row."""
    meta = packets.agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).select(F.lit("stats").alias("section"), F.to_json(F.struct("packets", "bytes")).alias("json"))
    out = meta.unionByName(hosts.select(F.lit("host").alias("section"), F.to_json(F.struct(*hosts.columns)).alias("json")))
    if files is not None:
        out = out.unionByName(files.select(F.lit("carved_file").alias("section"), F.to_json(F.struct(*files.columns)).alias("json")))
    return out


def flow_objects(flows: DataFrame) -> DataFrame:
    body = F.struct(
        urn(F.lit("flow"), "flow_id").alias("@id"), F.lit("uco-observable:NetworkConnection").alias("@type"), F.col("src_ip").alias("sourceAddress"), F.col("dst_ip").alias("destinationAddress"),
        F.col("src_port").alias("sourcePort"), F.col("dst_port").alias("destinationPort"), F.col("protocol"), F.col("packets"), F.col("bytes"), F.col("start_nano"), F.col("end_nano"),
    )
    return flows.select(F.lit("flow").alias("kind"), urn(F.lit("flow"), "flow_id").alias("id"), F.to_json(body).alias("json"))


def host_objects(hosts: DataFrame) -> DataFrame:
    """With the address, so that the object can be told from others."""
    body = F.struct(urn(F.lit("host"), "ip").alias("@id"), F.lit("uco-observable:IPAddress").alias("@type"), F.col("ip").alias("addressValue"), F.col("first_seen"), F.col("last_seen"))
    return hosts.select(F.lit("host").alias("kind"), urn(F.lit("host"), "ip").alias("id"), F.to_json(body).alias("json"))


def file_objects(files: DataFrame, offset: int = 2) -> DataFrame:
    """Three objects for each file (sha256, mime, size, file_name): the file, its provenance with an exhibit number, and the action that found it."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("sha256", "file_name"))  # exhibits are numbered in one order: the list of files is small beside the traffic
    f = files.withColumn("exhibit", F.concat(F.lit("EXH-"), F.lpad((offset + 3 * (n - 1)).cast("string"), 4, "0"))).withColumn("id", urn(F.lit("file"), "sha256", "file_name"))
    each = F.array(
        F.struct(F.lit("file").alias("kind"), F.col("id"), F.to_json(F.struct(F.col("id").alias("@id"), F.lit("uco-observable:File").alias("@type"), F.col("file_name"), F.col("mime"), F.col("size"), F.col("sha256"))).alias("json")),
        F.struct(F.lit("provenance").alias("kind"), urn(F.lit("provenance"), "id").alias("id"), F.to_json(F.struct(urn(F.lit("provenance"), "id").alias("@id"), F.lit("case-investigation:ProvenanceRecord").alias("@type"), F.col("exhibit"), F.col("id").alias("object"))).alias("json")),
        F.struct(F.lit("action").alias("kind"), urn(F.lit("action"), "id").alias("id"), F.to_json(F.struct(urn(F.lit("action"), "id").alias("@id"), F.lit("case-investigation:InvestigativeAction").alias("@type"), F.col("id").alias("result"))).alias("json")),
    )
    return f.select(F.explode(each).alias("o")).select("o.*")


def credential_objects(credentials: DataFrame, metadata_only: bool = False) -> DataFrame:
    """Never the secret: its digest and length, or its length alone."""
    secret = F.coalesce("secret", F.lit(""))
    hint = F.concat(F.length(secret).cast("string"), F.lit(" characters"))
    digest = F.lit(None).cast("string") if metadata_only else F.sha2(secret.cast("binary"), 256)
    name = F.lit(None).cast("string") if metadata_only else F.col("username")
    body = F.struct(urn(F.lit("credential"), "scheme", F.coalesce("username", F.lit("")), F.sha2(secret.cast("binary"), 256)).alias("@id"), F.lit("uco-observable:Credential").alias("@type"), F.col("scheme"), name.alias("username"), digest.alias("secretDigest"), hint.alias("hint"))
    return credentials.select(F.lit("credential").alias("kind"), body["@id"].alias("id"), F.to_json(body).alias("json"))


def bundle(investigation: str, *objects: DataFrame) -> DataFrame:
    """Rows of (kind, id, json), the investigation first: one line of JSON-LD for each object."""
    spark = objects[0].sparkSession
    head = spark.range(1).select(F.lit("investigation").alias("kind"), urn(F.lit("investigation"), F.lit(investigation)).alias("id"), F.to_json(F.struct(F.lit(CONTEXT).alias("@context"), F.lit("case-investigation:Investigation").alias("@type"), F.lit(investigation).alias("name"))).alias("json"))
    out = head
    for o in objects:
        out = out.unionByName(o)
    return out


def write_lines(rows: DataFrame, path: str, column: str = "json") -> None:
    """JSON lines, in parallel."""
    rows.select(column).write.mode("overwrite").text(path)


def prometheus(metrics: DataFrame) -> DataFrame:
    """Text exposition of rows (name, labels map, value)."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.when(F.size("labels") > 0, F.concat("name", F.lit("{"), labels, F.lit("} "), F.col("value").cast("string"))).otherwise(F.concat("name", F.lit(" "), F.col("value").cast("string"))).alias("line"))


def save_model(rows: DataFrame, path: str, name: str, version: int) -> None:
    """A version of a model as a partition of a table of models."""
    rows.withColumn("model", F.lit(name)).withColumn("version", F.lit(version)).write.mode("append").partitionBy("model", "version").parquet(path)


def model_versions(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("model", "version").agg(F.count("*").alias("rows")).orderBy("model", "version")
