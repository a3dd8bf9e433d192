"""Page and navigation guards as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: sensitive-page rules, which must equal the specification ----
STRONG = (
    ("credentials / login", r"login|log\s?in|sign\s?in|signin|logout|log\s?out|signout|authenticator|sso|otp|password|passwd|credential|2fa|two\s?factor"),
    ("banking / netbanking", r"netbanking|internetbanking"),
    ("payment / checkout", r"checkout|payment\s?gateway|payment\s?page"),
    ("bank apps / wallets", r"paytm|phonepe|gpay|razorpay|paypal|venmo|stripe"),
    ("Indian banks", r"hdfc|icici|sbi|axis|kotak"),
    ("password managers", r"keepass|bitwarden|1password|lastpass|dashlane"),
    ("government IDs / income tax", r"aadhaar|pan\s?card|pancard|income\s?tax|incometax|passport|voter\s?id|driving\s?licence|driving\s?license"),
)
#: Java's \\b knows more letters than the specification's, so word ends are told by letters, digits and _ of ASCII.
SECRETS = ("secrets / config", r"(?i)\.env(?![A-Za-z0-9_])|api[_-]?key|(?<![A-Za-z0-9_])secret(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])token(?![A-Za-z0-9_])")
#: A generic word that stands by itself in one label of a host.
MEDIUM = ("banking / payments", r"(?:^|[\s/:_-])(bank|banking|payment|payments|upi|wallet)(?:$|[\s/:_-])")
CONTENT_HOSTS = ("wikipedia", "fandom", "wordpress", "medium", "substack", "github.io", "readthedocs", "stackoverflow", "w3schools", "mdn")
RESTRICTED = r"(?i)^(chrome:|about:|edge:|devtools:|view-source:|chrome-extension:|moz-extension:)"
STORES = r"^https://(chrome\.google\.com/webstore|chromewebstore\.google\.com)"
# ---- end of fixed values ----

PATTERNS = [(reason, rf"(?i)(?:^|[\s/:._-])({words})(?:$|[\s/:._-])") for reason, words in STRONG] + [SECRETS]


def host_of(url: Column) -> Column:
    """Host without www.; the whole string if it is no URL."""
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), url)


def path_of(url: Column) -> Column:
    query = F.try_parse_url(url, F.lit("QUERY"))
    return F.concat(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))


def strong_reason(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(reason)) for reason, p in PATTERNS])


def sensitive_page(url: Column, title: Column) -> Column:
    """struct(reason, source) of the first rule that fits, else null."""
    host = host_of(url)
    of_url = strong_reason(F.concat_ws(" ", host, path_of(url)))
    of_title = strong_reason(F.coalesce(title, F.lit("")))
    labels = F.split(F.lower(host), r"\.")
    generic = F.exists(labels, lambda x: x.rlike(MEDIUM[1]))
    content = F.lit(False)
    for name in CONTENT_HOSTS:
        content = content | host.contains(name)
    of_host = F.when(generic & ~content, F.lit(MEDIUM[0]))
    reason = F.coalesce(of_url, of_title, of_host)
    source = F.when(of_url.isNotNull(), "url").when(of_title.isNotNull(), "title").when(of_host.isNotNull(), "url")
    return F.when(reason.isNotNull(), F.struct(reason.alias("reason"), source.alias("source")))


def scheme_of(url: Column, base_scheme: str = "https") -> Column:
    """Scheme after resolving against a base; relative references take the base's."""
    own = F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.lower(F.when(own == "", base_scheme).otherwise(own))


def navigation_allowed(url: Column) -> Column:
    """http and https only; a web address without a host is malformed."""
    scheme = scheme_of(url)
    empty = F.trim(url).rlike(r"(?i)^https?:/*$")
    return F.coalesce(scheme.isin("http", "https") & ~empty, F.lit(False))


def form_action_allowed(action: Column) -> Column:
    return F.coalesce(F.coalesce(action, F.lit("")) == "", F.lit(True)) | navigation_allowed(action)


def origin_of(url: Column) -> Column:
    """scheme://host:port with default ports dropped; null if there is none."""
    at = F.regexp_extract(url, r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?", 0)
    scheme = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1))
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)", 1)
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(at != "", F.concat(scheme, F.lit("://"), host, F.when(plain, "").otherwise(F.concat(F.lit(":"), port))))


def leaves_origin(current: Column, target: Column) -> Column:
    """An address that cannot be read leaves; a relative one stays."""
    relative = scheme_of(target, "") == ""
    return ~relative & F.coalesce(origin_of(current) != origin_of(target), F.lit(True))


def needs_confirmation(action_type: Column, current: Column, target: Column) -> Column:
    return (action_type == "done") | ((action_type == "navigate") & leaves_origin(current, target))


def cancelled(answer: Column) -> Column:
    """No answer or one that begins with "cancel", in any case and after blanks."""
    return F.coalesce(F.lower(F.trim(answer)).startswith("cancel"), F.lit(True)) | (F.coalesce(F.trim(answer), F.lit("")) == "")


def restricted(url: Column) -> Column:
    return F.coalesce(url.rlike(RESTRICTED) | url.rlike(STORES), F.lit(False))


def endpoint(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "/+$", "")
