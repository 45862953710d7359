"""Columns for text with the rules of browsers: numbers, links, cookies and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placestream import constants as C

from .geo import _c

# What browsers take for white space.
_SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_FLOAT = rf"^{_SPACE}*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))"


def parse_float(x: Column | str) -> Column:
    """The number at the start of a text, else null ('46.6abc' reads 46.6)."""
    return F.nullif(F.regexp_extract(_c(x), _FLOAT, 1), F.lit("")).try_cast("double")


def parse_int(x: Column | str) -> Column:
    """The whole number at the start of a text, else null."""
    return F.nullif(F.regexp_extract(_c(x), rf"^{_SPACE}*([+-]?\d+)", 1), F.lit("")).try_cast("long")


def parse_height(x: Column | str) -> Column:
    """Rounded metres of an elevation text, else null."""
    return F.floor(parse_float(x) + 0.5).cast("int")


def parse_point_param(x: Column | str) -> Column:
    """struct<lat, lon> of 'lat,lon' if both are numbers in range, else null; trailing text is ignored."""
    parts = F.split(_c(x), ",")
    lat, lon = parse_float(F.get(parts, F.lit(0))), parse_float(F.get(parts, F.lit(1)))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def format_point(lat, lon) -> Column:
    """'lat,lon' with four decimals; snap the point first, so that halves agree everywhere."""
    return F.format_string("%.4f,%.4f", _c(lat), _c(lon))


# Schemes whose links always have a host, and the port that each leaves out.
_DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_ALLOWED = r"^[^\x00-\x20#%/:<>?@\[\\\]^|\x7f]+$"
_SIX = r"^\[[0-9A-Fa-f:.]+\]$"


def _let(x: Column, f) -> Column:
    """f(x) with x made once, however often f looks at it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _ip4(host: Column) -> Column:
    """The address that a host whose last part is a number stands for, with 1 to 4 parts, each decimal, octal or hexadecimal; null if it is none."""
    one = lambda x: F.when(x.rlike("^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substring(x, 3, 99)), 16, 10)).when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).when(x.rlike("^(?:0|[1-9][0-9]*)$"), x).try_cast("decimal(20,0)")

    def written(numbers: Column) -> Column:
        n, last = F.size(numbers), F.element_at(numbers, -1)
        front = F.slice(numbers, 1, F.least(n - 1, F.lit(3)))
        good = (n <= 4) & ~F.exists(numbers, lambda x: x.isNull()) & ~F.exists(front, lambda x: x > 255) & (last < F.pow(F.lit(256.0), 5 - n))
        full = F.concat(F.transform(front, lambda x: x.cast("long")), F.transform(F.sequence(n, F.lit(4)), lambda i: F.floor(last / F.pow(F.lit(256.0), 4 - i)).cast("long") % 256))
        return F.when(good, F.array_join(F.transform(full, lambda x: x.cast("string")), "."))

    return _let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), one), written)


def _host(raw: Column) -> Column:
    """A host as browsers write it: percent signs decoded, ASCII by IDNA, addresses of four numbers; null if it is none."""
    decode = lambda x: F.when(x.contains("%"), F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))).otherwise(x)
    ascii_ = lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), x, F.lit(1))).otherwise(x)
    written = lambda x: F.when(x.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"), _ip4(x)).when(x.rlike(_ALLOWED), x)
    return F.when(raw.rlike(_SIX), F.lower(raw)).otherwise(_let(F.lower(_let(decode(raw), ascii_)), written))


def _link(url: Column) -> Column:
    """struct<scheme, host> of an absolute link by the rules of browsers, the host with its port; null if it is none.

    Only scheme and authority are looked at: paths and queries may hold any character. Slashes after
    the scheme may be of any number and kind; user and default port are left out. Names beyond ASCII
    are written in punycode by the JVM's IDNA of 2003, which makes ss of a sharp s.
    """
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")

    def parts(link: Column) -> Column:
        scheme = F.nullif(F.lower(F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))
        authority = F.when(scheme.isin(*_DEFAULT_PORTS), F.regexp_extract(link, r"^[^:]*:[/\\]*([^/\\?#]*)", 1)).otherwise(F.regexp_extract(link, r"^[^:]*://([^/?#]*)", 1))
        place = F.regexp_replace(authority, r"^.*@", "")
        return F.struct(scheme.alias("scheme"), F.regexp_replace(place, r":[0-9]*$", "").alias("raw"), F.regexp_extract(place, r":([0-9]*)$", 1).alias("port"))

    def host(p: Column) -> Column:
        named = F.when(p["scheme"].isin(*_DEFAULT_PORTS), _host(p["raw"])).otherwise(F.lower(p["raw"]))
        return F.struct(p["scheme"].alias("scheme"), named.alias("host"), p["port"].alias("digits"), p["port"].try_cast("int").alias("port"))

    def whole(p: Column) -> Column:
        default = F.try_element_at(F.create_map(*[F.lit(x) for pair in _DEFAULT_PORTS.items() for x in pair]), p["scheme"])
        full = F.when(p["port"].isNull() | p["port"].eqNullSafe(default), p["host"]).otherwise(F.concat(p["host"], F.lit(":"), p["port"].cast("string")))
        fits = (F.coalesce(p["digits"], F.lit("")) == "") | F.coalesce(p["port"] <= 65535, F.lit(False))
        good = p["scheme"].isNotNull() & p["host"].isNotNull() & (~p["scheme"].isin(*_DEFAULT_PORTS) | fits)
        return F.when(good, F.struct(p["scheme"].alias("scheme"), full.alias("host")))

    return _let(_let(_let(clean, parts), host), whole)


def url_host(url: Column | str) -> Column:
    """Host name without port, lower-cased; null where there is none."""
    return F.nullif(F.regexp_replace(_link(_c(url))["host"], r":\d+$", ""), F.lit(""))


def link_fields(href: Column | str, text: Column | str) -> Column:
    """struct<link_url, link_text, link_domain>; the domain is '' where the link has none."""
    trimmed = F.regexp_replace(_c(text), rf"^{_SPACE}+|{_SPACE}+$", "")
    return F.struct(_c(href).alias("link_url"), trimmed.alias("link_text"), F.coalesce(url_host(href), F.lit("")).alias("link_domain"))


def is_outbound(href: Column | str, host: Column | str) -> Column:
    """Whether an http(s) link leads to another host (ports count); false for anything else."""
    other = lambda link: link["scheme"].isin("http", "https") & (link["host"] != _c(host))
    return F.coalesce(_let(_link(_c(href)), other), F.lit(False))


def classify_click(href: Column | str, location: Column | str | None = None, kind: Column | str | None = None) -> Column:
    """Event of a link click: citations and navigation first, else outbound for http links, internal otherwise."""
    event = F.when(_c(href).startswith("http"), "outbound_click").otherwise("internal_link_click")
    if location is not None:
        event = F.when(_c(location).isNotNull(), "nav_click").otherwise(event)
    if kind is not None:
        event = F.when(_c(kind).eqNullSafe(F.lit("citation")), "citation_click").otherwise(event)
    return event


def unhandled_outbound(has_anchor: Column | str, handled: Column | str, href: Column | str, host: Column | str) -> Column:
    """Clicks that a page-wide listener reports: on a link, not reported yet, outbound."""
    return F.coalesce(_c(has_anchor), F.lit(False)) & ~F.coalesce(_c(handled), F.lit(False)) & is_outbound(href, host)


def project_click_events(label: Column | str) -> Column:
    """array<string>: the events of a project link; one more for the exact label 'Download'."""
    return F.when(_c(label) == "Download", F.array(F.lit("project_cta_click"), F.lit("download_click"))).otherwise(F.array(F.lit("project_cta_click")))


def page_path(path: Column | str, query: Column | str) -> Column:
    """path?query, or the path alone where there is no query."""
    return F.when(F.coalesce(_c(query), F.lit("")) != "", F.concat(_c(path), F.lit("?"), _c(query))).otherwise(_c(path))


def cookie_value(header: Column | str, name: str) -> Column:
    """Value of a request cookie: parts split at ';' and the first '=', trimmed; the last one wins."""
    parts = F.filter(F.split(_c(header), ";"), lambda p: p.contains("=") & (F.trim(F.substring_index(p, "=", 1)) == name))
    last = F.try_element_at(parts, F.lit(-1))
    return F.trim(last.substr(F.instr(last, "=") + 1, F.length(last)))


# The forms of the analytics cookies.
_CLIENT_COOKIE, _SESSION_COOKIE = r"^GA\d+\.\d+\.(\d+\.\d+)\z", r"^GS\d+\.\d+\.s?(\d+)"
# Endings and beginnings of the names of lakes.
_LAKE_END, _LAKE_BEGIN = r"(?i)(?:see|seeli)\z", r"(?i)^(?:lac|lago|lej|lai)(?![A-Za-z0-9_])"


def client_id(header: Column | str) -> Column:
    """The id in a well-formed _ga cookie, else null."""
    return F.nullif(F.regexp_extract(cookie_value(header, "_ga"), _CLIENT_COOKIE, 1), F.lit(""))


def session_id(header: Column | str, stream: str) -> Column:
    """The session in the stream's cookie, in its old or new form, else null."""
    return F.nullif(F.regexp_extract(cookie_value(header, f"_ga_{stream}"), _SESSION_COOKIE, 1), F.lit(""))


def consent_cookie(header: Column | str) -> Column:
    """VARIANT of the consent cookie: first match, URL-decoded JSON; null if absent or broken."""
    prefix = C.CONSENT_COOKIE + "="
    row = F.get(F.filter(F.split(_c(header), "; "), lambda p: p.startswith(prefix)), F.lit(0))
    raw = row.substr(F.lit(len(prefix) + 1), F.length(row))
    return F.try_parse_json(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def error_status(message: Column | str) -> Column:
    """Leading whole number of an error message, else null."""
    return parse_int(message)


def is_water(name: Column | str) -> Column:
    """Whether a municipality's name says that it is a lake."""
    return _c(name).rlike(_LAKE_END) | _c(name).rlike(_LAKE_BEGIN)


def page_pattern_hits(html: Column | str, pattern: str = r"/words/\d+") -> Column:
    """How often a pattern occurs in a page; null for a page that did not load."""
    return F.regexp_count(_c(html), F.lit(pattern))


def card_line(canton: Column | str, elevation: Column | str, km: Column | str) -> Column:
    """Canton, elevation and distance joined by a dot, parts that are absent left out."""
    return F.concat_ws("  ·  ", F.nullif(_c(canton), F.lit("")), F.concat(_c(elevation).cast("string"), F.lit(" m")), F.concat(F.floor(_c(km) + 0.5).cast("string"), F.lit(" km")))
