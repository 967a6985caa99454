"""Names, references, paths, times and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of a model reference, its digest and a submitter's address.
REPO_SHAPE = r"^[a-zA-Z0-9][a-zA-Z0-9._-]*/[a-zA-Z0-9][a-zA-Z0-9._/-]*$"
DIGEST_SHAPE = r"^(sha256:[0-9a-f]{64}|hf:[0-9a-f]{40})$"
ADDRESS_SHAPE = r"^[1-9A-HJ-NP-Za-km-z]{47,48}$"
# Messages that show a model is gone.
MISSING_MODEL = [
    "404 not found", "model not found", "repository not found", "no indexed artifacts found",
    "failed and hugging face fallbacks also failed",
]
# Messages of errors that pass, in the order they are tried.
TRANSIENT = [
    "internal error", "stream idle", "watchdog timeout", "timed out", "timeout", "server disconnected",
    "connection reset", "connecterror", "readerror", "remoteprotocolerror", "streamconsumed", "streamclosed",
    "streamerror", "peer closed connection", "incomplete chunked", "incompleteread", "503", "502", "504",
]
# What failed shard downloads say.
SHARD_DOWNLOAD = ["failed to download shard", "s3 shard download failed", "retriesexceeded", "max retries exceeded"]


def has_any(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(text, F.lit(n))
    return found


def slug(value: Column, default: str = "unknown") -> Column:
    """Runs outside letters, digits, dot, underscore and dash become one dash; outer dashes go."""
    s = F.trim(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.when(s.isNull() | (s == ""), F.lit(default)).otherwise(s)


def short_digest(digest: Column, length: int = 80) -> Column:
    return F.left(F.replace(F.coalesce(digest, F.lit("")), F.lit(":"), F.lit("-")), F.lit(length))


def champion_id(repo: Column, digest: Column) -> Column:
    return F.concat(slug(repo), F.lit("--"), slug(short_digest(digest)))


def model_key(repo: Column, digest: Column) -> Column:
    return F.when(F.coalesce(digest, F.lit("")) != "", F.concat(repo, F.lit("@"), digest)).otherwise(repo)


def collapse_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def path_parts(url: Column) -> Column:
    """Non-empty parts of a URL's path."""
    path = F.regexp_extract(url, r"^[a-z0-9]+://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z0-9]+://([^/?#]*)", 1)


def model_ref(ref: Column, hub: str, mirror: str) -> Column:
    """owner/name of a model page's URL on the hub, or behind /models/ on the mirror; else as given."""
    ref = F.trim(F.coalesce(ref, F.lit("")))
    parts, host = path_parts(ref), url_host(ref)
    on_hub = F.rlike(ref, F.lit("^https?://")) & F.endswith(host, F.lit(hub)) & (F.size(parts) >= 2)
    on_mirror = F.rlike(ref, F.lit("^https?://")) & F.contains(host, F.lit(mirror)) & (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "models")
    return F.when(on_hub, F.array_join(F.slice(parts, 1, 2), "/")).when(on_mirror, F.array_join(F.slice(parts, 2, 2), "/")).otherwise(ref)


def hub_repo_id(url: Column, hubs: list[str], dataset: bool = True) -> Column:
    """Repository of a hub URL: the two parts before tree, blob or resolve; null if there are fewer."""
    raw = F.rtrim(F.trim(url), F.lit("/"))
    parts = path_parts(raw)
    if dataset:
        parts = F.when(F.get(parts, F.lit(0)) == "datasets", F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    places = F.filter(F.transform(parts, lambda p, i: F.when(p.isin("tree", "blob", "resolve"), i)), lambda i: i.isNotNull())
    n = F.coalesce(F.get(places, F.lit(0)), F.size(parts))
    repo = F.when(n >= 2, F.array_join(F.slice(parts, 1, 2), "/"))
    return F.when(url_host(raw).isin(*hubs), repo).otherwise(raw)


def config_name(path: Column) -> Column:
    """Configuration that a file belongs to, by its folder."""
    parts = F.split(path, "/")
    first = F.get(parts, F.lit(0))
    return F.when(F.size(parts) == 1, F.lit("train")).when((F.size(parts) >= 3) & first.isin("data", "sample"), F.get(parts, F.lit(1))).otherwise(first)


def flat_name(path: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(path, r"\.parquet$", ""), "[^A-Za-z0-9._-]+", "__"), F.lit(".npy"))


def manifest_source(url: Column) -> Column:
    """Folder that a manifest lies in."""
    return F.element_at(F.concat(F.array(F.lit(""), F.lit("")), path_parts(url)), -2)


def manifest_ref(value: Column, prefix: Column, overrides: dict[str, str] | None = None) -> Column:
    """Full reference of a manifest entry: absolute ones stay, others get the shard prefix once."""
    value = F.trim(value)
    prefix = F.trim(F.coalesce(prefix, F.lit("")), F.lit("/"))
    key = F.ltrim(value, F.lit("/"))
    full = F.when((prefix != "") & ~F.startswith(key, F.concat(prefix, F.lit("/"))), F.concat_ws("/", prefix, key)).otherwise(key)
    if overrides:
        table = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
        full = F.coalesce(F.try_element_at(table, full), full)
    return F.when(F.rlike(value, F.lit("^(https?|s3)://|^/")), value).otherwise(full)


def cache_name(ref: Column) -> Column:
    """24 hex digits of the reference's SHA-256 and its base name."""
    base = F.element_at(F.split(F.substring_index(ref, "?", 1), "/"), -1)
    return F.concat(F.left(F.sha2(ref, 256), F.lit(24)), F.lit("-"), base)


def build_reveal(repo: Column, digest: Column, address: Column) -> Column:
    return F.concat_ws("|", F.lit("v4"), repo, digest, address)


def parse_reveal(payload: Column) -> Column:
    """struct(version, repo, digest, address, valid); version 3 carries the champion's digest first and is only recognised."""
    parts = F.split(F.trim(payload), r"\|")
    v4 = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "v4")
    v3 = (F.size(parts) == 5) & (F.get(parts, F.lit(0)) == "v3")
    at = lambda i: F.when(v3, F.get(parts, F.lit(i + 1))).when(v4, F.get(parts, F.lit(i)))
    repo, digest, address = at(1), at(2), F.trim(at(3))
    shaped = F.rlike(repo, F.lit(REPO_SHAPE)) & F.rlike(digest, F.lit(DIGEST_SHAPE)) & F.rlike(address, F.lit(ADDRESS_SHAPE))
    version = F.when(v4, F.lit("v4")).when(v3, F.lit("v3"))
    return F.struct(version.alias("version"), repo.alias("repo"), digest.alias("digest"), address.alias("address"), F.coalesce(v4 & shaped, F.lit(False)).alias("valid"))


def owner_token(address: Column) -> Column:
    """First and last five characters of a submitter's address."""
    return F.concat(F.left(address, F.lit(5)), F.right(address, F.lit(5)))


def holds_token(repo: Column, address: Column) -> Column:
    return F.contains(F.lower(repo), F.lower(owner_token(address)))


def parse_time(text: Column) -> Column:
    """ISO 8601 (Z or offset), else RFC 2822 without its weekday; no zone means UTC."""
    plain = F.regexp_replace(text, "^[A-Za-z]+, ", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")))


def age_seconds(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then))


def human_bytes(n: Column) -> Column:
    units, out = ["KiB", "MiB", "GiB", "TiB"], F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units, 1):
        # Ties to even, as the fractions of powers of two are exact.
        value = F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / float(1024**i), 1))
        out = F.when(n >= 1024**i, value).otherwise(out)
    return out


def human_age(seconds: Column) -> Column:
    s = seconds.cast("double")
    return (
        F.when(s < 3600, F.format_string("%.0fm", s / 60.0))
        .when(s < 86400, F.format_string("%.1fh", s / 3600.0))
        .otherwise(F.format_string("%.1fd", s / 86400.0))
    )


def plain_digest(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), "^sha256:", "")


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def key_values(raw: Column, cast: str = "string") -> Column:
    """``a=1,b=2`` as a map."""
    pairs = F.str_to_map(F.replace(raw, F.lit(" "), F.lit("")), F.lit(","), F.lit("="))
    return F.transform_values(pairs, lambda k, v: v.cast(cast))


def labelled_ref(value: Column) -> Column:
    """``label=repo@digest`` as a struct."""
    rest = F.regexp_extract(value, r"^[^=]*=(.*)$", 1)
    return F.struct(
        F.substring_index(value, "=", 1).alias("label"),
        F.substring_index(rest, "@", 1).alias("repo"),
        F.when(F.contains(rest, F.lit("@")), F.substring_index(rest, "@", -1)).alias("digest"),
    )


def gpu_specs(raw: Column) -> Column:
    """``name:count,...`` as an array of structs; the count is 1 where it is missing."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(F.substring_index(p, ":", 1).alias("name"), F.when(F.contains(p, F.lit(":")), F.substring_index(p, ":", -1).cast("int")).otherwise(1).alias("count")),
    )


def error_class(message: Column) -> Column:
    """struct(transient, label): the first rule that fits, as listed."""
    t = F.lower(F.coalesce(message, F.lit("")))
    case = lambda flag, label: F.struct(F.lit(flag).alias("transient"), F.lit(label).alias("label"))
    gone = F.contains(t, F.lit("stuck cdn")) | (F.contains(t, F.lit("prefetch")) & F.contains(t, F.lit("exceeded")))
    reported = F.startswith(t, F.lit("eval server error")) | F.contains(t, F.lit("'eval server error'"))
    out = F.when(gone, case(False, "prefetch_exhausted"))
    out = out.when(has_any(t, SHARD_DOWNLOAD), case(True, "dataset_shard_download")).when(reported, case(False, "eval_server_reported"))
    for marker in TRANSIENT:
        out = out.when(F.contains(t, F.lit(marker)), case(True, marker))
    return out.otherwise(case(False, ""))


def missing_model(log: Column, tail: int = 50_000) -> Column:
    return has_any(F.lower(F.right(log, F.lit(tail))), MISSING_MODEL)


def cut_at_space(text: Column, limit: int) -> Column:
    """First ``limit`` characters, back to the last space if that lies past half of them."""
    head = F.left(text, F.lit(limit))
    space = F.length(head) - F.instr(F.reverse(head), " ")
    back = F.when((F.instr(head, " ") > 0) & (space > limit / 2), F.substring(head, F.lit(1), space.cast("int"))).otherwise(head)
    return F.when(F.length(text) > limit, back).otherwise(text)
