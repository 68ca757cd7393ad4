"""Normal forms of urls, hosts, names, paths and stamps, as Column expressions."""

from __future__ import annotations

import contextlib
import contextvars
import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generic and special top-level names; countries come from the JVM's list of ISO codes, with those that differ from it.
TLDS = (
    "com net org info biz name pro edu gov mil int arpa aero asia cat coop jobs mobi museum post tel travel xxx "
    "academy agency app apps art associates auction audio auto baby band bank bar beauty beer best bet bible bid bike bio black blog blue boats bond book boutique builders business buzz cab cafe camera camp capital car cards "
    "care careers cars casa cash casino center chat cheap church city claims clinic clothing cloud club coach codes coffee college community company computer condos construction consulting contact contractors cooking cool country "
    "coupons courses credit cruises dance data date dating deals degree delivery dental design dev diamonds diet digital direct directory discount doctor dog domains earth education email energy engineer engineering enterprises "
    "equipment estate events example exchange expert express family fan farm fashion film finance financial fish fit fitness flights florist fm food football forsale foundation fun fund furniture fyi gallery game games garden gift gifts "
    "glass global gmbh gold golf graphics gratis green group guide guru hair health healthcare help"
).split()
TLDS_MORE = (
    "holdings holiday homes horse hospital hosting hotel house icu immo inc industries ink institute insurance insure international invalid investments jewelry kim kitchen land law lawyer lease legal life lighting limited limo link live "
    "llc loan loans local localhost london love ltd maison makeup management map market marketing mba media medical memorial men menu miami moda mom money monster mortgage movie music network new news ninja nyc observer one online ooo "
    "organic page paris partners parts party pet pharmacy photo photography photos pics pictures pizza place plumbing plus poker porn press productions promo properties property pub quest racing radio realty recipes red rehab reise rent "
    "rentals repair report republican rest restaurant review reviews rocks run sale salon sarl school science security services sex shoes shop shopping show singles site ski skin social software solar solutions space sport store stream studio "
    "study style supply support surf surgery systems tattoo tax taxi team tech technology tennis test theater tickets tips tires today tokyo tools top tours town toys trade trading training travel tube university vacations ventures vet video villas "
    "vin vip vision vodka vote voyage watch webcam website wedding wiki win wine work works world wtf xyz yoga zone"
).split()
COUNTRIES_MORE, COUNTRIES_LESS = ("ac", "eu", "su", "uk"), ("gb", "bl", "bq", "eh", "mf", "um")
#: A setting that names a text file with a top-level name a line (the public list of all of them); it takes the place of the names above.
TLD_FILE = "sieveline.tlds"
TRAILING = r"[.,;:!?)\]}>'\"`]+$"
_TRAILING = TRAILING
# Shapes of credentials, in the order of replacement, with the group that is secret.
CREDENTIALS = (
    ("private_key", r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)((?:\s*(?:[A-Za-z0-9+/=]{8,}|[A-Za-z-]+: [^\n]+))+)", 2),
    ("auth_header", r"(?i)\b(authorization\s*[:=]\s*[\"']?(?:bearer|basic|token)\s+)([A-Za-z0-9._\-+/=]{8,})", 2),
    ("url_credentials", r"\b([a-z][a-z0-9+.\-]*://[^/\s:@]+:)([^/\s@\"']{3,})(?=@)", 2),
    ("aws_access_key", r"\b(AKIA[0-9A-Z]{16})\b", 1),
    (
        "vendor_token",
        r"\b(sk-[A-Za-z0-9_\-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{30,}"
        r"|glpat-[A-Za-z0-9_\-]{15,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|shp(?:at|ss|ca|pa)_[0-9a-f]{32}|SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}|\d{8,10}:[A-Za-z0-9_\-]{35}|SK[0-9a-f]{32})",
        1,
    ),
    ("jwt", r"\b(eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})", 1),
    ("argument", r"(?i)(--?(?:pass(?:word)?|secret|token|api[_-]?key|apikey|credentials?|private[_-]?key|access[_-]?key|auth)[\w.\-]*[=\s]+[\"']?)([^\s\"',;]{4,})", 2),
)
# What stands in place of a name, and names that stand for no machine.
NOBODY = ("microsoft office user", "windows user", "office user", "user", "admin", "administrator", "unknown", "author", "owner", "default", "n/a", "none", "anonymous", "guest", "root", "system", "unnamed", "untitled")
NOT_A_HOST = ("localhost", "localhost.localdomain", "unknown", "tsclient", "wsl.localhost", "server", "servername", "hostname", "computer", "computername")


@functools.lru_cache(8)
def _known(path: str | None) -> tuple[str, ...]:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    if path:
        return tuple(sorted({x for r in spark.read.text(path).collect() if (x := r[0].strip().lower()) and not x.startswith("#")}))  # about 1,500 short lines
    countries = {c.lower() for c in spark._jvm.java.util.Locale.getISOCountries()}
    return tuple(sorted((countries | set(COUNTRIES_MORE) | set(TLDS) | set(TLDS_MORE)) - set(COUNTRIES_LESS)))


def tlds() -> tuple[str, ...]:
    """The top-level names that a domain may have: those of the file of TLD_FILE, else countries and the names of TLDS."""
    from pyspark.sql import SparkSession

    return _known(SparkSession.active().conf.get(TLD_FILE, None))


_ANY_COUNTRY = contextvars.ContextVar("_ANY_COUNTRY", default=False)


@contextlib.contextmanager
def any_country():
    """Plans that are made in here take any two letters for the top-level name of a country."""
    before = _ANY_COUNTRY.set(True)
    try:
        yield
    finally:
        _ANY_COUNTRY.reset(before)


def is_tld(name: Column) -> Column:
    known = name.isin(*tlds())
    return known | name.rlike("^[a-z]{2}$") if _ANY_COUNTRY.get() else known


def domain(host: Column) -> Column:
    """Lower-case host without outer dots, in its ASCII form; null unless its last label is a top-level name; onion names aren't domains."""
    clean = F.lower(F.regexp_replace(F.trim(host), r"^\.+|\.+$", ""))
    clean = F.when(clean.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), clean), clean)).otherwise(clean)
    last = F.element_at(F.split(clean, r"\."), -1)
    return F.when(clean.contains(".") & (last != "onion") & (is_tld(last) | last.startswith("xn--")), clean)


def url_parts(raw: Column) -> dict[str, Column]:
    clean = F.regexp_replace(raw, _TRAILING, "")
    take = lambda pattern, g=1: F.regexp_extract(clean, pattern, g)
    net = F.regexp_replace(take(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"), r"^.*@", "")
    return {
        "scheme": F.lower(take(r"^([A-Za-z][A-Za-z0-9+.-]*)://")), "host": F.lower(F.regexp_extract(net, r"^(\[[^\]]*\]|[^:]*)", 1)), "port": F.regexp_extract(net, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1),
        "path": take(r"^[^:]+://[^/?#]*([^?#]*)"), "query": take(r"^[^?#]*\?([^#]*)"),
    }


def url(raw: Column) -> Column:
    """scheme://host[:port]path[?query] without user, fragment and closing slashes; null for a bad port or no host."""
    p = url_parts(raw)
    port = F.when(p["port"] == "", "").when(p["port"].rlike(r"^0*[0-9]{1,5}$") & (p["port"].try_cast("int") <= 65535), F.concat(F.lit(":"), p["port"].try_cast("int").cast("string")))
    path = F.regexp_replace(p["path"], "/+$", "")
    return F.when((p["scheme"] != "") & (p["host"] != ""), F.concat(p["scheme"], F.lit("://"), p["host"], port, path, F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")))


def url_host(raw: Column) -> Column:
    return domain(url_parts(raw)["host"])


def name(value: Column) -> Column:
    """Lower-case name without quotes and outer space, runs of white space as one space; sharp s folded."""
    return F.replace(F.lower(F.regexp_replace(F.trim(F.regexp_replace(value, "^[\\s\"']+|[\\s\"']+$", "")), r"(?U)\s+", " ")), F.lit("ß"), F.lit("ss"))


def names(value: Column) -> Column:
    """ARRAY of the names in a field, which are written with semicolons between them; without placeholders, ids and mailboxes."""
    own = F.transform(F.split(value, ";"), lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""))
    fine = lambda x: (F.length(name(x)) >= 2) & ~name(x).isin(*NOBODY) & x.rlike(r"\p{L}") & ~name(x).rlike(r"^[0-9a-f\-]+$") & ~x.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z0-9\-]+$")
    return F.filter(own, fine)


def mailboxes(value: Column) -> Column:
    """ARRAY of the mailboxes of a header: what commas outside of quotes separate."""
    return F.filter(F.regexp_extract_all(value, F.lit(r'(?:[^,"]++|"[^"]*+"?)++'), F.lit(0)), lambda x: F.trim(x) != "")


def hostname(value: Column) -> Column:
    """A machine's name in lower case; null for public names, numbers and placeholders."""
    low = F.lower(F.regexp_replace(F.trim(value), r"\.+$", ""))
    label = r"[a-z0-9_](?:[a-z0-9_\-]{0,61}[a-z0-9_])?"
    shape = low.rlike(rf"^{label}(?:\.{label})*+$") & ~low.rlike(r"^[\d.]+$")
    return F.when(shape & ~low.isin(*NOT_A_HOST) & domain(low).isNull(), low)


def ssn(value: Column) -> Column:
    """Fingerprint of a social security number of three parts, null for one that was never given out."""
    fine = value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.when(fine, fingerprint(F.replace(value, F.lit("-"), F.lit(""))))


def basename(path: Column) -> Column:
    """Last part of a path; of a Windows path too."""
    windows = path.rlike(r"^[A-Za-z]:\\|^\\\\")
    return F.when(windows, F.regexp_extract(path, r"([^\\/]*)[\\/]*$", 1)).otherwise(F.regexp_extract(path, r"([^/]*)/*$", 1))


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fingerprint(secret: Column) -> Column:
    return F.substring(F.sha2(secret, 256), 1, 12)


def size_text(n: Column) -> Column:
    step = lambda k, unit: F.concat(F.format_string("%.1f", n / k), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, step(1024, "KB")).when(n < 1024**3, step(1024**2, "MB")).otherwise(step(1024**3, "GB"))
