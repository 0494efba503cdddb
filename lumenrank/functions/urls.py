"""Addresses: hosts, page identity, tracking parameters, problems; as Spark expressions."""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Parameters that only say where a visitor came from, and those of actions.
TRACKING = ["gclid", "gclsrc", "dclid", "fbclid", "msclkid", "yclid", "mc_cid", "mc_eid", "igshid", "ref"]
ACTIONS = ["replytocom", "add-to-cart", "feed"]
#: Endings and segments of addresses that are no pages.
EXTENSIONS = (
    "jpg jpeg png gif webp svg ico avif bmp tif tiff heic pdf zip rar 7z gz tgz tar css js mjs map json xml rss atom txt csv mp3 mp4 m4v m4a webm avi mov wmv mkv ogg wav flac "
    "woff woff2 ttf otf eot doc docx xls xlsx ppt pptx odt exe dmg apk msi iso"
).split()
SEGMENTS = ["wp-json", "wp-admin", "wp-content", "wp-includes", "feed", "cart", "checkout", "my-account"]
FILES = ["wp-login.php", "xmlrpc.php"]
#: Public suffixes of more than one label, private ones among them; a parameter.
SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp com.br com.tr com.mx co.in co.za com.cn com.ua com.pl "
    "github.io gitlab.io blogspot.com wordpress.com wixsite.com herokuapp.com netlify.app vercel.app pages.dev web.app myshopify.com"
).split()
MOST_PARAMETERS, MOST_LENGTH = 2, 2048


def host(url: Column) -> Column:
    """Lower-case host without ``www.``; null for what is no http(s) address."""
    h = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(h, r"^www\d?\.", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_and_query(url: Column) -> Column:
    """What a robots rule is matched with."""
    rest = F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def normalize_domain(s: Column) -> Column:
    """What a user typed for a domain: no scheme, path, user, port, dots at the end or ``www.``."""
    out = F.lower(F.trim(s))
    for pattern in (r"^[a-z][a-z0-9+.-]*://", r"[/?#].*$", r"^.*@", r":\d+$", r"\.+$", r"^www\d?\."):
        out = F.regexp_replace(out, pattern, "")
    return out


def is_hostname(h: Column) -> Column:
    return F.length(h).between(4, 253) & h.rlike(r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:[a-z]{2,63}|xn--[a-z0-9-]{2,59})$")


def registrable(url: Column, suffixes: list[str] | None = None) -> Column:
    """The host's label above its public suffix and the suffix; addresses of numbers as they are."""
    h = host(url)
    labels = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    two = F.when(F.size(labels) >= 2, last(2)).otherwise(h)
    known = two.isin(suffixes or SUFFIXES)
    return F.when(h.rlike(r"^[\d.]+$"), h).when(known & (F.size(labels) >= 3), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")).otherwise(two)


def page_identity(url: Column) -> Column:
    """Host and path: scheme, query, fragment and a closing slash do not tell pages apart."""
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))


def compare_form(url: Column) -> Column:
    """For canonical links: scheme and query count, ``www.`` and a closing slash do not."""
    scheme = F.lower(F.regexp_extract(url, r"^(?i:(https?))://", 1))
    q = query(url)
    return F.lower(F.concat(scheme, F.lit("://"), host(url), F.regexp_replace(path(url), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def parameters(url: Column) -> Column:
    """Query parameters without those of tracking."""
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    return F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING))


def page_address(url: Column) -> Column:
    """struct(url, key, depth) of an address worth reading, or null: no fragment, no tracking;
    no action, no more than two parameters, no file or system segment."""
    h = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#@]+)", 1))
    h = F.regexp_replace(h, r":(?:80|443)$", "")
    p = F.when(path(url) == "", "/").otherwise(path(url))
    kept = parameters(url)
    segments = F.filter(F.split(F.lower(p), "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    extension = F.when(F.instr(last, ".") > 0, F.substring_index(last, ".", -1)).otherwise("")
    bad = (
        F.exists(segments, lambda s: s.isin(SEGMENTS)) | last.isin(FILES) | extension.isin(EXTENSIONS) | (F.size(kept) > MOST_PARAMETERS)
        | F.exists(kept, lambda x: F.lower(F.substring_index(x, "=", 1)).isin(ACTIONS)) | (F.length(url) > MOST_LENGTH) | (h == "")
    )
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    scheme = F.lower(F.regexp_extract(url, r"^(?i:(https?))://", 1))
    made = F.struct(
        F.concat(scheme, F.lit("://"), h, p, tail).alias("url"), F.concat(F.regexp_replace(h, r"^www\.", ""), F.regexp_replace(p, "/+$", ""), tail).alias("key"), F.size(segments).alias("depth")
    )
    return F.when(~bad, made)


def problem(url: Column) -> Column:
    """The first that holds: parameters, capitals, underscore, length, a number for a name."""
    p, last = path(url), F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    n = F.size(F.filter(F.split(query(url), "&"), lambda x: x != ""))
    return (
        F.when(n >= 2, "parameters").when(p.rlike("[A-Z]"), "capitals").when(F.instr(p, "_") > 0, "underscore").when(F.length(p) > 90, "long").when(last.rlike(r"^(?:\d+|[0-9a-f]{16,})$"), "opaque")
    )


def is_own(domain: Column, site: Column) -> Column:
    return (domain == site) | F.endswith(domain, F.concat(F.lit("."), site))


def for_judge(url: Column) -> Column:
    return F.left(F.regexp_extract(url, "^[^?#]*", 0), F.lit(200))


#: Hosts by which a source's kind is told.
AUTHORITY = r"(?i)(^|\.)(wikipedia\.org|gov\.[a-z]{2}|[a-z0-9-]+\.gov|\.edu|europa\.eu|who\.int|nih\.gov|pubmed|ncbi\.nlm\.nih\.gov|bds\.bg|nsi\.bg|government\.bg)$"
COMMUNITY = r"(?i)(^|\.)(reddit\.com|quora\.com|facebook\.com|stackexchange\.com|stackoverflow\.com|forum\.|answers\.)"


def source_kind(domain: Column, page_type: Column, sources: Column, author: Column) -> Column:
    return (
        F.when(domain.rlike(AUTHORITY), "authority")
        .when(domain.rlike(COMMUNITY) | (page_type == "forum_or_social"), "community")
        .when(page_type == "news_or_media", "media")
        .when(page_type.isin("comparison_listicle", "directory_marketplace"), "compare")
        .when(page_type == "blog_article", F.when((F.coalesce(sources, F.lit(0.0)) >= 0.7) & (F.coalesce(author, F.lit(0.0)) >= 0.6), "authority").otherwise("guide"))
        .when(page_type.isin("service_page", "company_homepage", "ecommerce_product", "platform_or_tool"), "brand")
        .otherwise("other")
    )


def _public(url: str | None) -> bool | None:
    from urllib.parse import urlsplit

    if url is None:
        return None
    try:
        u = urlsplit(url)
        if u.scheme not in ("http", "https") or u.username or u.password or u.port not in (None, 80, 443, 8080, 8443) or not u.hostname:
            return False
        name = u.hostname.rstrip(".").lower()
    except ValueError:
        return False
    if name == "localhost" or name.rpartition(".")[2] in ("localhost", "local", "internal", "lan", "home", "corp", "test", "invalid", "onion"):
        return False
    try:
        a = ipaddress.ip_address(name)
    except ValueError:
        return "." in name
    if a.version == 6:
        inner = a.ipv4_mapped or a.sixtofour or (a.teredo[1] if a.teredo else None)
        if inner is not None:
            a = inner
    return a.is_global and not a.is_multicast


@F.arrow_udf(BooleanType())
def is_public(urls: pa.Array) -> pa.Array:
    """False for addresses a crawler must not open: other schemes and ports, credentials,
    internal names, and private, local, reserved or multicast numbers, however wrapped."""
    return pa.array([_public(x) for x in urls.to_pylist()], pa.bool_())


@F.arrow_udf(StringType())
def to_ascii(names: pa.Array) -> pa.Array:
    """International host names in their ASCII form; null where there is none."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else x.encode("idna").decode()
        except UnicodeError:
            return None

    return pa.array([one(x) for x in names.to_pylist()], pa.string())


def own_suffixes(h: Column) -> Column:
    """The keys that a rule of a suffix list may have for a host, as struct(n, key, exception), n the labels of the suffix that the rule
    then names: for each of its endings, the whole host first, the ending, ``*.`` and what is behind its first label, and ``!`` and the ending."""
    labels = F.split(F.lower(h), r"\.")
    size = F.size(labels)
    ending = lambda i: F.array_join(F.slice(labels, i, size), ".")
    keys = lambda i: F.array(
        F.struct((size - i + 1).alias("n"), ending(i).alias("key"), F.lit(0).alias("exception")),
        F.struct((size - i + 1).alias("n"), F.concat(F.lit("*."), F.when(i < size, ending(i + 1)).otherwise("")).alias("key"), F.lit(0).alias("exception")),
        F.struct((size - i).alias("n"), F.concat(F.lit("!"), ending(i)).alias("key"), F.lit(1).alias("exception")),
    )
    return F.flatten(F.transform(F.sequence(F.lit(1), size), keys))
