"""Container image documents: indexes, manifests, layers and tags."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCRIPTOR = "struct<mediaType:string,digest:string,size:bigint,platform:struct<architecture:string,os:string,variant:string>,annotations:map<string,string>>"
INDEX = f"struct<schemaVersion:int,mediaType:string,manifests:array<{DESCRIPTOR}>,annotations:map<string,string>>"
MANIFEST = f"struct<schemaVersion:int,mediaType:string,config:{DESCRIPTOR},layers:array<{DESCRIPTOR}>>"
ARCHIVE = "array<struct<Config:string,Layers:array<string>,RepoTags:array<string>>>"
#: Media types of documents that list or describe an image, and of layers.
INDEX_TYPES = ("application/vnd.oci.image.index.v1+json", "application/vnd.docker.distribution.manifest.list.v2+json")
MANIFEST_TYPES = ("application/vnd.oci.image.manifest.v1+json", "application/vnd.docker.distribution.manifest.v2+json")
LAYER_TAR = "application/vnd.oci.image.layer.v1.tar"
LAYER_TYPES = (
    "application/vnd.oci.image.layer.v1.tar",
    "application/vnd.oci.image.layer.v1.tar+gzip",
    "application/vnd.oci.image.layer.v1.tar+zstd",
    "application/vnd.docker.image.rootfs.diff.tar",
    "application/vnd.docker.image.rootfs.diff.tar.gzip",
)
NESTED = 4
NAME = "org.opencontainers.image.ref.name"


def parse_index(text: Column | str) -> Column:
    return F.from_json(text, INDEX)


def parse_manifest(text: Column | str) -> Column:
    return F.from_json(text, MANIFEST)


def diff_ids(config: Column | str) -> Column:
    """The layers' uncompressed digests of an image config."""
    return F.from_json(config, "struct<rootfs:struct<diff_ids:array<string>>>")["rootfs"]["diff_ids"]


def layers(images: DataFrame) -> DataFrame:
    """(image, ordinal, digest, size, media_type, diff_id) of images (image,
    manifest, config); an image whose lists differ in length has one row with
    ``error`` instead (J15)."""
    rows = images.withColumn("_l", parse_manifest("manifest")["layers"]).withColumn("_d", diff_ids("config"))
    fine = F.size("_l") == F.size("_d")
    empty = F.struct(F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("string").alias("diff_id"), F.lit("layers and diff_ids differ in number").alias("error"))
    pair = F.transform("_l", lambda x, i: F.struct(i.alias("ordinal"), x["digest"].alias("digest"), x["size"].alias("size"), x["mediaType"].alias("media_type"), F.get("_d", i).alias("diff_id"), F.lit(None).cast("string").alias("error")))
    return rows.select("image", F.explode(F.when(fine, pair).otherwise(F.array(empty))).alias("x")).select("image", "x.*")


def select_platform(descriptors: Column | str, architecture: str, os: str, variant: str | None = None) -> Column:
    """The first descriptor of a platform; attestations ('unknown') and other
    media types are passed over, and a variant counts only if asked for (O10)."""

    def fits(d: Column) -> Column:
        p = d["platform"]
        fine = p.isNotNull() & (p["architecture"] != "unknown") & d["mediaType"].isin(*INDEX_TYPES, *MANIFEST_TYPES) & (p["architecture"] == architecture) & (p["os"] == os)
        return F.coalesce(fine if variant is None else fine & (p["variant"] == variant), F.lit(False))

    return F.get(F.filter(descriptors, fits), F.lit(0))


def pick_named(descriptors: Column | str, name: str | None) -> Column:
    """The only descriptor, or the first named exactly or by its last path part;
    null if the choice is open (O11)."""
    c = F.col(descriptors) if isinstance(descriptors, str) else descriptors
    if name is None:
        return F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    named = F.filter(c, lambda d: F.coalesce((d["annotations"][NAME] == name) | d["annotations"][NAME].endswith(f"/{name}"), F.lit(False)))
    return F.get(named, F.lit(0))


def resolve_nested(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, digest, depth) of every document that nested indexes reach;
    ``documents`` (digest, text). An index more than NESTED levels down is
    refused: a part of an image must not pass for the whole (S11)."""
    edges = documents.select(F.col("digest").alias("parent"), F.explode(parse_index("text")["manifests"]).alias("m")).select("parent", F.col("m.digest").alias("child"))
    step = roots.select(F.col("digest").alias("root"), "digest").withColumn("depth", F.lit(0))
    out = step
    for depth in range(1, NESTED + 1):
        step = step.join(edges, step["digest"] == edges["parent"]).select("root", F.col("child").alias("digest")).distinct().withColumn("depth", F.lit(depth))
        out = out.unionAll(step)
    if deeper := step.join(edges, step["digest"] == edges["parent"]).first():
        raise ValueError(f"index {deeper['digest']} lies more than {NESTED} levels down")
    return out.groupBy("root", "digest").agg(F.min("depth").alias("depth"))


def with_image(index: DataFrame, added: DataFrame) -> DataFrame:
    """Index entries (name, digest, size) after adding others: an added name
    replaces its entry; order is by name and digest (O09)."""
    return index.join(added.select("name"), "name", "left_anti").select("name", "digest", "size").unionAll(added.select("name", "digest", "size")).orderBy("name", "digest")


def union_layouts(blobs: DataFrame) -> DataFrame:
    """Blobs (ordinal, digest, size, ...) of several layouts, the later one
    counting where both have a digest, sorted (J18)."""
    rest = [c for c in blobs.columns if c not in ("digest", "ordinal")]
    return blobs.groupBy("digest").agg(F.max_by(F.struct(*rest), "ordinal").alias("b")).select("digest", "b.*").orderBy("digest")


def to_index_json(entries: DataFrame) -> DataFrame:
    """One row: the index document of entries (name, digest, size), keys in
    their fixed order and compact (N02)."""
    one = lambda x: F.struct(F.lit(MANIFEST_TYPES[0]).alias("mediaType"), x["digest"].alias("digest"), x["size"].alias("size"), F.create_map(F.lit(NAME), x["name"]).alias("annotations"))
    listed = entries.agg(F.transform(F.sort_array(F.collect_list(F.struct("name", "digest", "size"))), one).alias("m"))
    return listed.select(F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.lit(INDEX_TYPES[0]).alias("mediaType"), F.col("m").alias("manifests"))).alias("document"))


def annotations(*maps: Column) -> Column:
    """Annotations merged, later ones counting, as entries sorted by key."""
    merged = maps[0]
    for m in maps[1:]:
        merged = _over(merged, m)
    return F.array_sort(F.map_entries(merged))


def _over(base: Column, more: Column) -> Column:
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)


def tags(refs: DataFrame, commits: DataFrame, paths: DataFrame, image_path: str) -> DataFrame:
    """Refs whose current tree holds an image path, sorted; refs whose commit or
    tree is unreadable are passed over (J16)."""
    trees = paths.filter(F.col("path") == image_path).select("tree").distinct()
    return refs.join(commits.select(F.col("commit").alias("target"), "tree"), "target").join(trees, "tree", "left_semi").select("env", "ref").orderBy("env", "ref")


def blob_by_digest(digests: DataFrame, refs: DataFrame, commits: DataFrame, paths: DataFrame) -> DataFrame:
    """Where a digest lies: the first ref in name order whose current tree holds
    it, and the path (J17)."""
    current = refs.join(commits.select(F.col("commit").alias("target"), "tree"), "target").select("env", "ref", "tree")
    hits = digests.join(paths.select("tree", "path", "digest"), "digest").join(current, "tree")
    return hits.groupBy("env", "digest").agg(F.min(F.struct("ref", "path")).alias("f")).select("env", "digest", "f.ref", "f.path")


def ingest_summary(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Layers, reused layers and bytes of each image (A19, N04): a layer is
    reused if its uncompressed digest is known, or came before in the image."""
    held = known.select("diff_id").distinct().withColumn("_k", F.lit(True))
    one = rows.groupBy("image", "diff_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).join(held, "diff_id", "left")
    return one.groupBy("image").agg(F.sum("n").alias("layers"), F.sum(F.col("n") - F.when(F.col("_k").isNull(), 1).otherwise(0)).alias("reused"), F.sum("bytes").alias("compressed_bytes"))


def rewrite_media_types(documents: DataFrame) -> DataFrame:
    """Manifests (image, manifest) with layers described as plain tars; what is
    not a layer's media type keeps its bytes and its place (N05)."""
    types = "|".join(re.escape(x) for x in sorted(LAYER_TYPES, key=len, reverse=True))
    pattern = rf'("mediaType"\s*:\s*")(?:{types})(")'
    return documents.withColumn("manifest", F.regexp_replace("manifest", pattern, rf"$1{LAYER_TAR}$2"))


def store_layers(layers: DataFrame, known: DataFrame) -> DataFrame:
    """Layers (layer, compression, diff_id, content) with ``outcome`` and the
    plain bytes' ``size`` (N04, N07, N08): 'reused' where ``known`` (diff_id)
    holds the plain bytes, which are not unpacked then; else 'stored', or
    'corrupt' where they do not match the diff_id or cannot be unpacked."""
    kind = layers.schema["layer"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out, sizes = [], []
            for compression, diff_id, content in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                try:
                    plain = decompress(content, compression)
                    fine = f"sha256:{hashlib.sha256(plain).hexdigest()}" == diff_id
                except (OSError, EOFError, zlib.error, zstandard.ZstdError):
                    fine, plain = False, b""
                out.append("stored" if fine else "corrupt")
                sizes.append(len(plain) if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(sizes, pa.int64())], ["layer", "outcome", "size"])

    held = known.select("diff_id").distinct()
    reused = layers.join(held, "diff_id", "left_semi").select("layer", F.lit("reused").alias("outcome"), F.lit(None).cast("long").alias("size"))
    fresh = layers.join(held, "diff_id", "left_anti").select("layer", "compression", "diff_id", "content")
    return reused.unionAll(fresh.mapInArrow(run, f"layer {kind}, outcome string, size long"))


def decompress(content: bytes, compression: str) -> bytes:
    """A layer's plain bytes: 'gzip', 'zstd' or 'none' (N07)."""
    if compression == "gzip":
        return gzip.decompress(content)
    if compression == "zstd":
        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)).read()
    return content
