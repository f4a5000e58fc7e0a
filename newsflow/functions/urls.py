"""URL expressions: normal form without tracking parameters, and item keys."""

from pyspark.sql import Column, functions as F

from newsflow.functions.text import let, strip

# Fixed values.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMETERS = ["fbclid", "gclid", "mc_cid", "mc_eid"]
# Schemes that take a "//" even when they have no host.
HOST_SCHEMES = [
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
    "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs",
    "git", "git+ssh", "ws", "wss", "itms-services",
]

# scheme, //host, path, ?query; a fragment is matched and left out (RFC 3986, appendix B).
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?"


def _decode(text: Column) -> Column:
    """Percent decoding that leaves malformed escapes as they are."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _parameter(segment: Column) -> Column:
    name = F.substring_index(segment, "=", 1)
    value = F.substr(segment, F.length(name) + 2)
    return F.struct(_decode(name).alias("name"), _decode(value).alias("value"))


def query_parameters(query: Column) -> Column:
    """Decoded (name, value) pairs of a query string, in order, blank values kept."""
    segments = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda s: s != "")
    return F.transform(segments, _parameter)


def drop_tracking(parameters: Column) -> Column:
    """Parameters without the ones that only track where a visitor came from."""

    def wanted(parameter):
        name = F.lower(parameter["name"])
        return ~(name.startswith(TRACKING_PREFIX) | name.isin(TRACKING_PARAMETERS))

    return F.filter(parameters, wanted)


def encode_query(parameters: Column) -> Column:
    pairs = F.transform(parameters, lambda p: F.concat(_encode(p["name"]), F.lit("="), _encode(p["value"])))
    return F.array_join(pairs, "&")


def _rebuild(url: Column) -> Column:
    def part(group):
        return F.regexp_extract(url, URL_PARTS, group)

    scheme = F.lower(part(1))
    host = F.lower(part(2))
    path = F.regexp_replace(part(3), "/+$", "")
    query = encode_query(drop_tracking(query_parameters(part(4))))

    def from_path(path):
        needs_slashes = scheme.isin(HOST_SCHEMES) & path.startswith("/")
        authority = F.when(F.length(host) > 2, host).when(needs_slashes | path.startswith("//"), "//").otherwise("")
        return F.concat(authority, path)

    return F.concat(
        F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))),
        let(F.when(path == "", "/").otherwise(path), from_path),
        let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))),
    )


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, tracking parameter or fragment.

    Null and empty give ''. Tabs and line ends inside the url are dropped.
    """
    cleaned = F.translate(strip(url), "\t\r\n", "")
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(let(cleaned, _rebuild))


def guid_key(guid: Column) -> Column:
    """``guid:<stripped guid>``, null when empty."""
    return F.concat(F.lit("guid:"), F.nullif(strip(guid), F.lit("")))


def url_key(url: Column) -> Column:
    """``url:<normal form>``, null when empty."""
    return F.concat(F.lit("url:"), F.nullif(normalize_url(url), F.lit("")))


def article_keys(guid: Column, url: Column) -> Column:
    """The keys an item is recognised by; empty ones are left out."""
    return F.array_compact(F.array(guid_key(guid), url_key(url)))
