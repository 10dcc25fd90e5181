"""Column functions over request text: addresses, tokens, bots. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that say nothing about traffic (methods, protocols, browser and platform names, filler).
STOP_WORDS = [
    "GET", "POST", "PUT", "HEAD", "OPTIONS", "DELETE", "CONNECT", "TRACE", "PATCH",
    "+http", "http", "+https", "https", "HTTP", "HTTP/1.1", "HTTP/2.0", "HTTPS",
    "Mozilla", "Gecko", "Safari", "Chrome", "Firefox", "KHTML",
    "en-us", "en-gb", "en-US", "in-id", "id-ID",
    "Android", "Linux", "Mobile", "SAMSUNG", "iPhone", "iPad", "Windows", "Macintosh", "Mac", "Intel", "Edg", "OPR",
    "Win64", "x64", "x86_64", "X11", "iOS", "EdgiOS", "Darwin", "CrOS", "CPU", "GSA", "Ddg", "CriOS",
    "like", "Version", "Build", "Nexus", "AppleWebKit", "https:", "compatible",
]
#: Characters that separate tokens, the marker tokens, the bot words, the shortest token in bytes.
SYMBOLS = "(),[]:;/\\?&"
FILTERED, EMPTY = "--filtered--", "--empty--"
BOT_WORDS = ("bot", "spider", "crawler", "agent")
MIN_BYTES = 3


def parse_time(text: Column, honor_offset: bool = False) -> Column:
    """The time behind the first bracket, `[dd/Mon/yyyy:HH:mm:ss zone]`; wall-clock text unless the offset is to be honoured. Null where there is none."""
    at = F.instr(text, "[")
    wall = F.when(at > 0, F.try_to_timestamp(F.substr(text, at + 1, F.lit(20)), F.lit("dd/MMM/yyyy:HH:mm:ss"))).cast("timestamp_ntz")
    if not honor_offset:
        return wall
    zone = F.regexp_extract(text, r"\[[^ \]]* ([+-]\d{4})", 1)
    minutes = F.coalesce((F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1), F.lit(0))
    return F.timestamp_add("MINUTE", -minutes, wall)


def ip_prefix(ip: Column) -> Column:
    """First two octets with their dots, for anything whose third part holds a digit; else empty."""
    return F.regexp_extract(ip, r"^([^.]+\.[^.]+\.)[^.]*[0-9]", 1)


def is_error(status: Column) -> Column:
    return F.substring(status, 1, 1).isin("4", "5")


def normalize_symbols(text: Column) -> Column:
    return F.translate(text, SYMBOLS, " " * len(SYMBOLS))


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def interesting_token(token: Column) -> Column:
    return (F.octet_length(token) >= MIN_BYTES) & ~token.isin(*STOP_WORDS) & ~token.rlike(r"^[0-9._E]+$")


def agent_tokens(user_agent: Column) -> Column:
    return space_tokens(normalize_symbols(user_agent))


def word_tokens(ua_tokens: Column, request: Column) -> Column:
    """Interesting agent tokens, then interesting request tokens; one marker where none is left."""
    kept = F.filter(F.concat(ua_tokens, space_tokens(normalize_symbols(request))), interesting_token)
    return F.when(F.size(kept) == 0, F.array(F.lit(FILTERED))).otherwise(kept)


def referer_tokens(referer: Column) -> Column:
    """Tokens of the referer behind its first `//`; a marker for an empty one."""
    at = F.instr(referer, "//")
    rest = F.when(at > 0, F.substr(referer, at + 2)).otherwise(referer)
    return F.when(referer.isin("", "-", " "), F.array(F.lit(EMPTY))).otherwise(F.filter(space_tokens(normalize_symbols(rest)), lambda t: F.octet_length(t) >= MIN_BYTES))


def ip_tokens(ip: Column) -> Column:
    return F.array(ip)


def bot_like(user_agent: Column) -> Column:
    return user_agent.rlike("(?i)" + "|".join(BOT_WORDS))


def bot_name(ua_tokens: Column) -> Column:
    """The first agent token that ends in a bot word and is longer than it; null if there is none."""
    return F.get(F.filter(ua_tokens, lambda t: t.rlike(f"(?i).({'|'.join(BOT_WORDS)})$")), F.lit(0))


def contains_key(line: Column, key: str) -> Column:
    """Literal search for evidence lines; the empty key and the marker of empty referers match nothing."""
    return F.lit(False) if key in ("", EMPTY) else F.contains(line, F.lit(key))
