"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a binary column; the key's pads are computed here, the rest in Catalyst."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without a dot or where the only dot leads the name."""
    name = base_name(path)
    found = F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$") & (name != ".."), found)


def _java_groups(replacement: str) -> str:
    """``$1`` and ``${1}`` kept as groups, other dollars and backslashes literal."""
    parts = re.split(r"(\$\{?\d+\}?)", replacement)
    return "".join(re.sub(r"[{}]", "", p) if re.fullmatch(r"\$\{?\d+\}?", p) else p.replace("\\", "\\\\").replace("$", "\\$") for p in parts)


def path_transform(path: Column, pattern: str, replacement: str, full_path: bool = False) -> Column:
    """Replace all matches in the file name, or in the whole path."""
    to = _java_groups(replacement)
    if full_path:
        return F.regexp_replace(path, F.lit(pattern), F.lit(to))
    name = base_name(path)
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(name)), F.regexp_replace(name, F.lit(pattern), F.lit(to)))


def case_transform(text: Column, mode: str) -> Column:
    """none, lower, upper, or title, which joins words by one blank and leaves the tails of words alone."""
    if mode == "none":
        return text
    if mode == "lower":
        return F.lower(text)
    if mode == "upper":
        return F.upper(text)
    if mode != "title":
        raise ValueError(f"unknown case {mode!r}")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def parse_transform(text: str) -> list[tuple[str, tuple]]:
    """``rename:s/a/b/,case:lower,strip:xattrs,...``: steps in the order they are applied, renames before case."""
    renames, cases = [], []
    for part in text.split(","):
        if ":" not in part:
            continue
        name, value = part.split(":", 1)
        name, value = name.strip(), value.strip()
        if name == "rename":
            if value.startswith("s") and len(value) > 1:
                pieces = value[1:].split(value[1])
                if len(pieces) < 3:
                    raise ValueError(f"bad rename {value!r}")
                renames.append(("rename", (pieces[1], pieces[2])))
            elif "=" in value:
                renames.append(("rename", tuple(value.split("=", 1))))
            else:
                raise ValueError(f"bad rename {value!r}")
        elif name == "case":
            cases.append(("case", (value.lower(),)))
        elif name not in ("strip", "normalize", "encoding"):
            raise ValueError(f"unknown transform {name!r}")
    return renames + cases[-1:]


def apply_transform(path: Column, text: str) -> Column:
    for name, arguments in parse_transform(text):
        path = path_transform(path, *arguments) if name == "rename" else case_transform(path, *arguments)
    return path


def format_size(size: Column) -> Column:
    """Binary units with one decimal from 1 KiB; ties go to the even digit."""
    case = None
    for unit, power in (("TiB", 4), ("GiB", 3), ("MiB", 2), ("KiB", 1)):
        shown = F.concat(F.format_string("%.1f", F.bround(size / float(KIB**power), 1)), F.lit(f" {unit}"))
        case = (F.when if case is None else case.when)(size >= KIB**power, shown)
    return case.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def format_bytes(size: Column) -> Column:
    """Powers of 1024 under decimal names, two decimals from 1 KB; ties go to the even digit."""
    case = None
    for unit, power in (("TB", 4), ("GB", 3), ("MB", 2), ("KB", 1)):
        shown = F.concat(F.format_string("%.2f", F.bround(size / float(KIB**power), 2)), F.lit(f" {unit}"))
        case = (F.when if case is None else case.when)(size >= KIB**power, shown)
    return case.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def truncate_path(path: Column, limit: int) -> Column:
    """The last characters after three dots, or the first few when the limit is under four."""
    if limit < 4:
        return F.substring(path, 1, limit)
    return F.when(F.char_length(path) <= limit, path).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(limit - 3))))


def throughput_mib(size: Column, millis: Column) -> Column:
    """MiB a second; 0 without a duration."""
    return F.when(millis > 0, size / float(KIB**2) / (millis / 1000.0)).otherwise(F.lit(0.0))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100.0).otherwise(F.lit(0.0))


def compression_ratio(compressed: Column, original: Column) -> Column:
    return F.when(original > 0, compressed / original * 100.0).otherwise(F.lit(100.0))


def parse_traceparent(header: Column) -> Column:
    """A struct (trace_id, span_id, flags) of a four-part header of version 00, else null."""
    parts = F.split(header, "-")
    good = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "00")
    return F.when(good, F.struct(F.get(parts, F.lit(1)).alias("trace_id"), F.get(parts, F.lit(2)).alias("span_id"), F.get(parts, F.lit(3)).alias("flags")))


def format_traceparent(trace: Column, span: Column) -> Column:
    return F.concat(F.lit("00-"), trace, F.lit("-"), span, F.lit("-01"))


#: Names and short forms of the flags, fixed values.
PRESERVE_FLAGS = {
    "times": "times",
    "time": "times",
    "timestamps": "times",
    "perms": "permissions",
    "permissions": "permissions",
    "mode": "permissions",
    "owners": "ownership",
    "ownership": "ownership",
    "owner": "ownership",
    "xattrs": "xattrs",
    "xattr": "xattrs",
    "acls": "acls",
    "acl": "acls",
}


def parse_preserve(text: str) -> set[str]:
    """The flags of a comma list; ``all`` means every flag, an unknown name is an error."""
    flags = set()
    for part in filter(None, (p.strip().lower() for p in text.split(","))):
        if part == "all":
            flags |= set(PRESERVE_FLAGS.values())
        elif part in PRESERVE_FLAGS:
            flags.add(PRESERVE_FLAGS[part])
        else:
            raise ValueError(f"unknown flag {part!r}")
    return flags


def retry_delay_ms(attempt: Column, base_ms: int, exponential: bool = True, cap_ms: int = 300_000) -> Column:
    """Delay before a retry without its jitter: doubled for each attempt after the first, capped."""
    delay = F.lit(base_ms) * F.pow(F.lit(2.0), attempt - 1) if exponential else F.lit(float(base_ms))
    return F.least(delay, F.lit(float(cap_ms))).cast("long")


def object_retry_delay_ms(attempt: Column, strategy: Column, initial_ms: int, max_ms: int) -> Column:
    """Delay by strategy: fixed, linear, or exponential; capped, without its jitter."""
    delay = (
        F.when(strategy == "linear", F.lit(float(initial_ms)) * attempt)
        .when(strategy.isin("exponential", "exponential_jitter"), F.lit(float(initial_ms)) * F.pow(F.lit(2.0), attempt - 1))
        .otherwise(F.lit(float(initial_ms)))
    )
    return F.least(delay, F.lit(float(max_ms))).cast("long")


def manifest_file_name(path: Column) -> Column:
    """Slashes and backslashes as underscores; different paths can meet in one name."""
    return F.translate(path, "/\\", "__")


def csv_field(value: Column) -> Column:
    """A field safe for spreadsheets: formula starts get a leading quote mark, then RFC 4180 quoting."""
    guarded = F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(guarded.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def uri_parts(uri: Column) -> Column:
    """(protocol, location): no ``://`` is local; smb and cifs, s3, file; anything else has a null protocol."""
    scheme = F.lower(F.regexp_extract(uri, r"(?s)^(.*?)://", 1))
    rest = F.regexp_replace(uri, r"(?s)^.*?://", "")
    protocol = F.when(~uri.contains("://"), "local").when(scheme.isin("smb", "cifs"), "smb").when(scheme == "s3", "s3").when(scheme == "file", "local")
    return F.struct(protocol.alias("protocol"), F.when(uri.contains("://"), rest).otherwise(uri).alias("location"))


def nearest_name(name: Column, known: list[str]) -> Column:
    """The known name at the least edit distance above 0 and at most max(half the length, 2), case aside; ASCII names."""
    limit = F.greatest(F.floor(F.length(name) / 2), F.lit(2))
    options = F.array(*[F.struct(F.levenshtein(F.lower(name), F.lit(k.lower())).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(known)])
    near = F.filter(options, lambda o: (o["d"] > 0) & (o["d"] <= limit))
    return F.get(F.array_sort(near), F.lit(0))["name"]
