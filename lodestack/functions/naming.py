"""Column expressions of the object format: framing, names, shards, validation.

A framed object is kind, version and payload; its name is the SHA-256 of the
frame, kept as 32 raw bytes so that order is by unsigned bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK, BLOB, TREE, COMMIT = 1, 2, 3, 4
VERSION = 1
#: What names of environments and refs may look like.
ENV_NAME = r"^[a-z0-9][a-z0-9._-]{0,63}/[a-z0-9][a-z0-9._-]{0,127}$"
REF_NAME = r"^refs/(heads|tags)/[A-Za-z0-9][A-Za-z0-9._/-]{0,255}$"
#: Media types of layers that are kept elsewhere and refused.
FOREIGN_LAYERS = (
    "application/vnd.docker.image.rootfs.foreign.diff.tar.gzip",
    "application/vnd.oci.image.layer.nondistributable.v1.tar",
    "application/vnd.oci.image.layer.nondistributable.v1.tar+gzip",
    "application/vnd.oci.image.layer.nondistributable.v1.tar+zstd",
)
OBJECT_NAME = r"^s2:[0-9a-f]{64}$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(kind: int, payload: Column | str) -> Column:
    """Kind and version bytes before a binary payload (C05 for chunks)."""
    return F.concat(F.unhex(F.lit(f"{kind:02X}{VERSION:02X}")), _col(payload).cast("binary"))


def name_of(framed: Column | str) -> Column:
    """The raw digest that names a framed object."""
    return F.unhex(F.sha2(_col(framed), 256))


def shown(name: Column | str) -> Column:
    """A name as text."""
    return F.concat(F.lit("s2:"), F.lower(F.hex(_col(name))))


def kind_of(framed: Column | str) -> Column:
    """The kind byte of a frame."""
    return F.conv(F.hex(F.substring(_col(framed), 1, 1)), 16, 10).cast("int")


def payload(framed: Column | str, offset: Column | int = 0, length: Column | int | None = None) -> Column:
    """A slice of a frame's payload; offsets begin after the header."""
    start = F.lit(offset) + 3 if isinstance(offset, int) else offset + 3
    n = F.octet_length(_col(framed)) if length is None else F.lit(length) if isinstance(length, int) else length
    return F.substring(_col(framed), start.cast("int"), n.cast("int"))


def shard_of(name: Column | str, bits: int) -> Column:
    """The shard that a digest's leading bits name, at most 24 of them."""
    return F.shiftright(F.conv(F.substring(F.hex(_col(name)), 1, 6), 16, 10).cast("long"), 24 - bits).cast("int")


def shard_bounds(bits: int, shard: int) -> tuple[bytes, bytes]:
    """Half-open digest range of a shard; the last one ends above every digest."""
    low = (shard << (24 - bits)).to_bytes(3, "big")
    high = b"\xff" * 33 if shard + 1 == 1 << bits else ((shard + 1) << (24 - bits)).to_bytes(3, "big")
    return low, high


def in_shard(name: Column | str, bits: int, shard: int) -> Column:
    """A shard as a range predicate, which prunes sorted files."""
    low, high = shard_bounds(bits, shard)
    return (_col(name) >= F.lit(low)) & (_col(name) < F.lit(high))


def partition_of(key: Column | str, shards: int) -> Column:
    """The metadata shard of a partition key: its digest's first byte modulo shards."""
    return F.pmod(F.conv(F.substring(F.sha2(_col(key).cast("binary"), 256), 1, 2), 16, 10).cast("int"), F.lit(shards))


def is_boundary(key: Column | str, level: int, period: int, domain: str = "lodestack.tree.split.v1") -> Column:
    """Whether a key ends a tree node of a level: content alone decides (C11).

    The first 60 bits of SHA-256 over domain, level and key, modulo the period.
    """
    head = F.sha2(F.concat(F.lit(domain.encode()), F.lit(bytes([level])), _col(key).cast("binary")), 256)
    return F.pmod(F.conv(F.substring(head, 1, 15), 16, 10).cast("long"), F.lit(period)) == 0


def valid_env_name(x: Column | str) -> Column:
    return _col(x).rlike(ENV_NAME)


def valid_ref_name(x: Column | str) -> Column:
    """The pattern plus: no empty component, no parent step, no slash at the end."""
    c = _col(x)
    return c.rlike(REF_NAME) & ~c.contains("//") & ~c.contains("..") & ~c.endswith("/")


def is_tag(x: Column | str) -> Column:
    return _col(x).startswith("refs/tags/")


def path_components(path: Column | str) -> Column:
    """Components of a path; doubled and outer slashes vanish (C17)."""
    return F.filter(F.split(_col(path), "/"), lambda x: x != "")


def valid_path(path: Column | str) -> Column:
    """No parent or self steps, no NUL, components of 255 bytes at most."""
    return F.forall(path_components(path), lambda x: ~x.isin(".", "..") & ~F.contains(x, F.lit("\0")) & (F.octet_length(x) <= 255))


def format_path(components: Column | str) -> Column:
    return F.array_join(_col(components), "/")


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def fingerprint(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def sort_key(number: Column | str, width: int = 10) -> Column:
    """A number as text whose order is the number's (C20)."""
    return F.lpad(_col(number).cast("string"), width, "0")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 for nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def human_bytes(n: Column | str, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB", "PiB")) -> Column:
    """Sizes for people: 1536 is '1.5 KiB' (C28). The last of ``units`` takes all that is larger."""
    c = _col(n).cast("double")
    out = F.concat(_col(n).cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        out = F.when(c >= 1024.0**k, F.format_string(f"%.1f {unit}", c / 1024.0**k)).otherwise(out)
    return out


def metric_number(value: Column | str) -> Column:
    """Whole numbers in full, others as they are."""
    v = _col(value)
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def byte_range(header: Column | str, size: Column | str) -> Column:
    """(first, last) of a Range header over a blob, null where it is refused.

    'bytes=a-b' is cut out as written, 'a-' goes to the end, '-n' is the last n
    bytes, and more than one range is refused.
    """
    spec = F.lower(F.trim(_col(header)))
    size = _col(size)
    a = F.nullif(F.regexp_extract(spec, r"^bytes\s*=\s*(\d+)-(\d*)$", 1), F.lit("")).cast("long")
    b = F.nullif(F.regexp_extract(spec, r"^bytes\s*=\s*(\d+)-(\d*)$", 2), F.lit("")).cast("long")
    n = F.nullif(F.regexp_extract(spec, r"^bytes\s*=\s*-(\d+)$", 1), F.lit("")).cast("long")
    first = F.when(n > 0, F.greatest(size - n, F.lit(0))).otherwise(a)
    last = F.when(n > 0, size - 1).otherwise(F.coalesce(b, size - 1))
    return F.when((first <= last) & (last < size), F.struct(first.alias("first"), last.alias("last")))


def fnmatch_regex(glob: Column | str) -> Column:
    """A shell pattern as an anchored regular expression; '*' crosses slashes."""
    c = _col(glob)
    c = F.regexp_replace(c, r"([.+^$(){}|\\])", r"\\$1")
    c = F.replace(c, F.lit("[!"), F.lit("[^"))
    c = F.replace(F.replace(c, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("(?s)^"), c, F.lit("$"))


def media_compression(media_type: Column | str) -> Column:
    """gzip, zstd or none of a layer's media type; 'foreign' or 'unknown' where it is refused."""
    m = _col(media_type)
    return F.when(m.isin(*FOREIGN_LAYERS), "foreign").when(m.rlike(r"(\+gzip|\.tar\.gzip)$"), "gzip").when(m.endswith("+zstd"), "zstd").when(m.rlike(r"[.+]tar$"), "none").otherwise("unknown")
