"""URL column expressions. All of them return null for null and never raise on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.text import let

HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@\s]*@)?(\[[^\]/?#]*\]|[^/?#:\s]*)"
SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://"


def host_key(url: Column) -> Column:
    """Host without case, port, leading `www.` and final dot; null where there is none.

    A scheme is recognised only before `//`, so `host:8080/path` has host `host`.
    """
    bare = F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    host = F.regexp_extract(bare, r"^(?:[^/?#@\s]*@)?(\[[^\]/?#]*\]|[^/?#:\s]*)", 1)
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    host = F.regexp_replace(host, r"^www\.(?=.)", "")
    return F.when(F.length(host) > 0, host)


def address_key(url: Column, tracking: str = r"(?:utm_[^=&]*|gclid|fbclid)") -> Column:
    """The address apart from scheme, case of the host, default port, final slash, fragment and tracking parameters."""
    text = F.trim(url)
    scheme = F.lower(F.regexp_extract(text, SCHEME, 1))
    bare = F.regexp_replace(F.regexp_replace(text, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", ""), r"#.*$", "")
    authority = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise(":(?:80|443)$")
    authority = F.regexp_replace(authority, port, "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^{tracking}(?:=|$)"))
    query = F.array_join(kept, "&")
    return F.when(F.length(authority) > 0, F.concat(authority, path, F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise("")))


# Public suffixes that the registered-domain rule knows by default; pass a longer list where needed.
SUFFIXES = tuple(
    """com org net edu gov mil int info biz io co ai app dev me tv uk co.uk org.uk ac.uk gov.uk de fr es it pt com.pt nl pl
    com.pl se ru jp co.jp ne.jp or.jp ac.jp tr com.tr us ca au com.au net.au org.au br com.br net.br mx com.mx in co.in cn
    com.cn kr co.kr za co.za nz co.nz ch at be dk no fi cz gr ie hu ro ua com.ua id co.id *.ck !www.ck github.io blogspot.com""".split()
)


def normalize_url(url: Column) -> Column:
    """STR-01: lower case without any trailing slashes; null stays null."""
    return F.rtrim(F.lower(url), F.lit("/"))


def last_domain(url: Column) -> Column:
    """STR-02: the text after the last `//`, up to the first `/`, up to the first `:`."""
    rest = F.element_at(F.split(url, "//"), -1)
    return F.split_part(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))


def netloc(url: Column) -> Column:
    """STR-03: authority after `scheme://` with port and user; '' where there is no scheme."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_hash(url: Column) -> Column:
    """PRJ-05: SHA-256 of the UTF-8 url, as hex."""
    return F.sha2(url, 256)


def strip_link(link: Column) -> Column:
    """STR-17: a link without scheme and leading `www.`."""
    return F.regexp_replace(link, r"^(https?://)?(www\.)?", "")


def _labels(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.split(F.regexp_replace(host, r"\.+$", ""), r"\.")


def _suffix_start(labels: Column, suffixes: tuple[str, ...]) -> Column:
    """1-based index of the first label of the longest matching suffix; size + 1 if none matches."""
    exact = F.array(*[F.lit(s) for s in suffixes if s[0] not in "*!"])
    wild = F.array(*[F.lit(s[2:]) for s in suffixes if s[0] == "*"] or [F.lit("-")])
    never = F.array(*[F.lit(s[1:]) for s in suffixes if s[0] == "!"] or [F.lit("-")])
    n = F.size(labels)
    joined = lambda i: F.array_join(F.slice(labels, i, n), ".")
    excepted = lambda i: F.array_contains(never, joined(i))
    wildcard = lambda i: (i < n) & F.array_contains(wild, joined(i + 1)) & ~excepted(i)
    hit = lambda i: F.array_contains(exact, joined(i)) | wildcard(i) | ((i > 1) & excepted(F.greatest(i - 1, F.lit(1))))
    return F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), n), hit)), n + 1)


def registered_domain(url: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """STR-04: the label before the longest public suffix with that suffix; the last label alone where none matches."""

    def name(labels: Column) -> Column:
        return let(_suffix_start(labels, suffixes), lambda start: F.array_join(F.slice(labels, F.greatest(start - 1, F.lit(1)), F.size(labels)), "."))

    return let(_labels(url), name)


def url_features(url: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """STR-05: struct of url_len, domain_len, subdomain_len and path_len in code points; nulls for a null url.

    `domain_len` counts domain, a dot and suffix, the dot also where there is no suffix; `path_len` leaves out query,
    fragment and the `;parameters` of the last segment.
    """
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(path, r";[^/]*$", "")

    def sized(labels: Column, start: Column) -> Column:
        n = F.size(labels)
        suffix = F.when(start <= n, F.array_join(F.slice(labels, F.least(start, n), n), ".")).otherwise("")
        domain = F.when(start > 1, F.get(labels, start - 2)).otherwise("")
        sub = F.when(start > 2, F.array_join(F.slice(labels, F.lit(1), F.greatest(start - 2, F.lit(0))), ".")).otherwise("")
        return F.struct(F.length(url).alias("url_len"), (F.length(domain) + 1 + F.length(suffix)).alias("domain_len"), F.length(sub).alias("subdomain_len"), F.length(path).alias("path_len"))

    found = let(_labels(url), lambda labels: let(_suffix_start(labels, suffixes), lambda start: sized(labels, start)))
    return F.when(url.isNotNull(), found)
