"""De-identifying texts, finding what is left, and comparing list and note texts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import collapse, text

# Names of what is secret, the placeholders that take its place, and the one key that tests may show.
COOKIES = ("sid", "hsid", "ssid", "apisid", "sapisid", "sidcc", "__Secure-1PSID", "__Secure-3PSID")
QUERY_SECRETS = ("access_token", "id_token", "token", "session", "sid", "oauth", "code")
JSON_SECRETS = (*COOKIES, "email", "gaia_id")
MASK, MAIL, NAME, USER, AVATAR = "<redacted>", "<redacted-email>", "<redacted-account-name>", "<redacted-user>", "<redacted-account-avatar>"
TEST_KEY = "AIzaSyFAKE_KEY_FOR_TESTING_ONLY_00000000"

_STANDS_FOR_TEST_KEY = "\x01"
_ADDRESS = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
_ANY = "|".join
_BREAK = r"\\u0026#10;"
_BETWEEN = r"\\u003c/div\\u003e\\u003cdiv\\u003e"


class Secret(NamedTuple):
    """What stands behind `carrier` (and before `tail`) and is replaced by `mask`; it shows where it is more than blank and not the mask."""

    label: str | None
    carrier: str
    value: str
    mask: str
    tail: str = ""

    def hidden(self, v: Column) -> Column:
        return F.regexp_replace(v, f"(?is)({self.carrier}){self.value}({self.tail})", f"$1{self.mask}$2")

    def shown(self, v: Column) -> Column:
        return v.rlike(f"(?is){self.carrier}(?!{self.mask}){self.value}{self.tail}")


# In order: later ones meet the placeholders of earlier ones.
SECRETS = (
    Secret("email", "", rf"\b{_ADDRESS}\b", MAIL),
    Secret("google-api-key", "(?-i:AIza)", r"[0-9A-Za-z_-]{20,}", MASK),
    Secret(None, "[?&](?:amp;)?key=", r"(?!\x01(?:[&#\"'\s]|$))[^&#\"'\s]+", MASK),
    Secret("query-token", rf"[?&](?:{_ANY(QUERY_SECRETS)})=", r"[^&#\"'\s]+", MASK),
    Secret("cookie-token", rf"\b(?:{_ANY(COOKIES)})\s*=\s*", r"[^;\"'\s]+", MASK),
    Secret("json-token", rf'"(?:{_ANY(JSON_SECRETS)})"\s*:\s*"', '[^"]+', MASK, '"'),
    Secret("user-path", "/Users/", r"[^/\"'<>\\\s]+", USER),
    Secret("google-account-avatar-url", r"\blh3\.googleusercontent\.com/ogw/", r"[^\"'&<>\s)]+", AVATAR),
    Secret("google-account-name", '<div class="gb_g">', "[^<]+", NAME, "</div>"),
    Secret(None, 'aria-label="Google Account:', r'\s*[^"<\s][^"<]*?', f" {NAME}", rf'\s*{MAIL}"'),
    Secret("google-account-label", 'aria-label="Google Account:', r'\s*[^"<\s][^"]*', f" {NAME}", '"'),
    Secret("google-account-escaped-label", r"Google Account:\s*", r"[^\"<\\\s][^\"<\\]*?", NAME, rf"{_BREAK}\s*{MAIL}"),
    Secret("google-account-escaped-name", "", r"[^\\\"<>]{1,120}", NAME, rf"{_BETWEEN}{MAIL}"),
)
#: Behind escaped markup an address begins right there, whatever its first letters look like, and what stands before it goes with it.
_BEHIND = rf"(?is)({_BREAK}|{_BETWEEN})[^\"<\\@]*(?:@[A-Z0-9.-]+\.[A-Z]{{2,}}|{MAIL})"
_ESCAPED = "\\u003c/div\\u003e\\u003cdiv\\u003e"
# What can follow a list's name.
SUFFIXES = r"[\s·•,，:：|(（]"
BOUNDARY = r"[\s·•,，.。:：;；|/()（）\[\]「」\"'-]"


def redacted(c: Column | str) -> Column:
    """The text with every secret replaced; doing so twice changes nothing. The test key stays.

    The rewrite of escaped names is tried only where its literal part occurs: it looks
    at every place of a text.
    """
    v = F.replace(text(c), F.lit(TEST_KEY), F.lit(_STANDS_FOR_TEST_KEY))
    v = F.regexp_replace(v, _BEHIND, f"$1{MAIL}")
    for s in SECRETS:
        v = F.when(v.contains(_ESCAPED), s.hidden(v)).otherwise(v) if s.tail.startswith(_BETWEEN) else s.hidden(v)
    return F.replace(v, F.lit(_STANDS_FOR_TEST_KEY), F.lit(TEST_KEY))


def markers(c: Column | str) -> Column:
    """Labels of what the text still shows, in order; none for null and empty texts."""
    v = F.replace(text(c), F.lit(TEST_KEY), F.lit(_STANDS_FOR_TEST_KEY))
    # Escaped labels and names show beside an address, whether that is hidden or not.
    with_mail = F.regexp_replace(v, _BEHIND, f"$1{MAIL}")
    return F.array_compact(F.array(*(F.when(s.shown(with_mail if "escaped" in s.label else v), s.label) for s in SECRETS if s.label)))


#: Of fixtures: keys become the test key, so that pages keep their form.
_FIXTURE = (Secret("google-api-key", "(?-i:AIza)", rf"(?:{MASK}|[0-9A-Za-z_-]{{20,}})", _STANDS_FOR_TEST_KEY), SECRETS[2]._replace(mask=_STANDS_FOR_TEST_KEY), SECRETS[8])


def fixture_redacted(c: Column | str) -> Column:
    """The text of a page kept as a fixture: keys and key parameters as the test key, account names hidden."""
    v = F.replace(text(c), F.lit(TEST_KEY), F.lit(_STANDS_FOR_TEST_KEY))
    v = F.regexp_replace(v, f"(?-i:AIza){_FIXTURE[0].value}", _STANDS_FOR_TEST_KEY)
    v = _FIXTURE[2].hidden(_FIXTURE[1].hidden(v))
    return F.replace(v, F.lit(_STANDS_FOR_TEST_KEY), F.lit(TEST_KEY))


def fixture_markers(c: Column | str) -> Column:
    """Labels of what a fixture still shows: keys but the test key, and account names."""
    v = F.replace(text(c), F.lit(TEST_KEY), F.lit(_STANDS_FOR_TEST_KEY))
    return F.array_compact(F.array(*(F.when(s.shown(v), s.label) for s in (SECRETS[1], SECRETS[8]))))


def scanned(files: DataFrame, path: str, content: str) -> DataFrame:
    """Files with findings, each content once per path."""
    return files.dropDuplicates([path, content]).select(path, markers(content).alias("markers")).where(F.size("markers") > 0)


def safe_to_write(files: DataFrame, content: str) -> DataFrame:
    """The files redacted; one that still shows a marker is an error rather than written."""
    clean = files.withColumn(content, redacted(content))
    left = markers(content)
    return clean.withColumn(content, F.when(F.size(left) > 0, F.raise_error(F.concat(F.lit("unredacted: "), F.array_join(left, ",")))).otherwise(F.col(content)))


def bounded_contains(haystack: Column, needle: Column) -> Column:
    """Whether the text holds the other between boundaries; emoji and ideographs are no boundaries."""
    quoted = F.concat(F.lit(rf"(?:^|{BOUNDARY})\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(rf"\E(?:$|{BOUNDARY})"))
    return (needle != "") & F.regexp_like(haystack, quoted)


def list_match(list_name: Column | str, shown: Column | str) -> Column:
    """3 where the texts are one, 2 where the name begins the shown text and an allowed suffix follows, else 0; leading icons don't count."""
    name = F.lower(collapse(list_name))
    other = F.regexp_replace(F.lower(collapse(shown)), r"^[\x{e000}-\x{f8ff}\x{2190}-\x{27bf}\s]+", "")
    rest = F.substr(other, F.length(name) + 1)
    return F.when(name == "", 0).when(name == other, 3).when(other.startswith(name) & rest.rlike(f"^{SUFFIXES}"), 2).otherwise(0)


def same_note(actual: Column | str, expected: Column | str) -> Column:
    """Whether two notes are one, line ends, white space and case apart, or one holds the other."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(text(c), r"\r\n?", "\n"), r"[ \t]*\n[ \t\n]*", "\n")))
    a, b = plain(actual), plain(expected)
    return (a == b) | ((a != "") & (b != "") & (a.contains(b) | b.contains(a)))
