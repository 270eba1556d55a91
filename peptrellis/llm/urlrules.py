"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path with the literal tokens (runs of a-z0-9, lower case) that any URL it matches must
contain. The rarest of them, by the number of URLs that hold it, is the rule's index token. Each URL's tokens fetch candidate
rules; only those run their regular expression. Of the rules that fit, the longest wins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule table: (rule, pattern, verdict, priority, literal tokens).
SCHEMA = "rule string, pattern string, verdict string, priority int, tokens array<string>"
#: Rules up to which the table is broadcast; more are joined by a shuffle on the token.
BROADCAST_RULES = 100_000

#: The host and path rules (verdict, host, path).
SITE_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Words whose sites and pages are blocked, by category.
UNWANTED = {
    "betting": ["bet", "bets", "betting", "bingo", "blackjack", "bookmaker", "casino", "gambling", "jackpot", "lottery", "poker", "roulette", "slots", "sportsbook", "wager"],
    "adult": ["adult", "camgirls", "escort", "escorts", "hentai", "hookup", "milf", "nude", "nudes", "porn", "porno", "sex", "webcam", "xxx"],
    "malware": ["botnet", "crack", "cracks", "exploit", "keygen", "malware", "phishing", "ransomware", "spyware", "trojan", "warez"],
    "pills": ["cialis", "levitra", "payday", "pharmacy", "pills", "replica", "tramadol", "viagra", "xanax"],
    "spam": ["clickbait", "doorway", "linkfarm", "scam", "seo", "spam", "spammer", "spamming"],
    "sharing": ["magnet", "nulled", "pirate", "torrent", "torrents", "tracker"],
}
#: Pairs of words that are unwanted side by side, in one label or path segment.
UNWANTED_PAIRS = [
    ("buy", "followers"), ("cheap", "meds"), ("cheap", "pills"), ("easy", "money"), ("fast", "cash"), ("free", "bets"), ("free", "casino"), ("free", "money"), ("free", "spins"), ("get", "rich"),
    ("hot", "singles"), ("link", "farm"), ("live", "cams"), ("lose", "weight"), ("make", "money"), ("online", "casino"), ("online", "pharmacy"), ("quick", "loan"), ("spam", "farm"), ("work", "home"),
]
#: Hosts of advertisements and trackers.
AD_HOSTS = ["2mdn.net", "adform.net", "adnxs.com", "adroll.com", "adsrvr.org", "amazon-adsystem.com", "criteo.com", "doubleclick.net", "googlesyndication.com", "mopub.com", "outbrain.com", "popads.net", "pubmatic.com", "quantserve.com", "rubiconproject.com", "scorecardresearch.com", "taboola.com", "zedo.com"]
#: Path segments that hold no documents.
PATH_SEGMENTS = ["ad", "ads", "adserver", "banner", "banners", "cart", "cgi-bin", "checkout", "click", "feed", "login", "logout", "popup", "print", "redirect", "register", "rss", "search", "signin", "signup", "sponsor", "tag", "tags", "trackback", "wishlist", "wp-admin", "wp-json", "wp-login.php", "xmlrpc.php"]


def block_patterns() -> list[tuple[str, list[str]]]:
    """Rules for what no site rule fits: a pattern over host + path, and its literal tokens."""
    label, segment = r"^([^/]*[.-])?{}[.-]", r"^[^/]*/(.*/)?([^/]*-)?{}([-/.]|$)"
    out = [(shape.format(w), [w]) for words in UNWANTED.values() for w in words for shape in (label, segment)]
    out += [(shape.format(f"{a}-{b}"), [a, b]) for a, b in UNWANTED_PAIRS for shape in (label, segment)]
    out += [(rf"^([^/]*\.)?{re.escape(h)}(/|$)", re.findall("[a-z0-9]+", h)) for h in AD_HOSTS]
    return out + [(rf"^[^/]*/(.*/)?{re.escape(p)}(/|$)", re.findall("[a-z0-9]+", p)) for p in PATH_SEGMENTS]


def site_rule(verdict: str, host: str, path: str) -> tuple:
    """A rule for a host, its subdomains, and paths that start with path."""
    tokens = re.findall("[a-z0-9]+", host)
    # The path's last run of letters may go on in a URL, unless a separator ends it.
    tokens += re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return (host + path, f"^([^/]*\\.)?{re.escape(host)}{re.escape(path)}", verdict, len(host + path), tokens)


def default_rules() -> list[tuple]:
    patterns = [(None, pattern, "block", -1, tokens) for pattern, tokens in block_patterns()]
    return [site_rule(*r) for r in SITE_RULES] + patterns


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.concat(host, path)), "[^a-z0-9]+"), lambda t: t != ""))


def _counted(rules: list[tuple], urls: DataFrame) -> DataFrame:
    """The rules with their index token: of a rule's tokens the one that the fewest urls hold (then the first by letters)."""
    hint = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    table = urls.sparkSession.createDataFrame(rules, SCHEMA)
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(hint(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    by_token = table.select("rule", "pattern", "verdict", "priority", F.explode("tokens").alias("token")).join(hint(counts), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return by_token.groupBy("pattern", "rule", "verdict", "priority").agg(F.min(F.struct("n", "token")).alias("rarest")).select("pattern", "rule", "verdict", "priority", F.col("rarest.token").alias("token"), "rarest.n")


def fetched(pages: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """A row for each row of pages and candidate rule (page_id, host, path, token, pattern, rule, verdict, priority), and one without
    a token for each row of pages. A hot token's urls are not shuffled: the rules are broadcast up to BROADCAST_RULES."""
    rules = default_rules() if rules is None else rules
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = urls.withColumn("tokens", _tokens(F.col("host"), F.col("path")))
    hint = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    # A null token keeps each row in the result, whatever it matches.
    wide = split.select("page_id", "host", "path", F.explode(F.array_append("tokens", F.lit(None).cast("string"))).alias("token"))
    index = hint(_counted(rules, split).drop("n"))
    return wide.join(index, "token", "left").where("token is null or pattern is not null")


def judged(pages: DataFrame, rules: list[tuple] | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url; other columns are ignored; repeated rows stay; a null
    page_id stays null).

    A null url has an empty host and path and the default verdict; so has a url that no rule fits. Ties between rules of one
    priority go to the verdict and rule that sort last.
    """
    candidates = fetched(pages, rules)
    fits = F.col("token").isNotNull() & F.expr("regexp_like(concat(host, path), pattern)")
    best = F.max(F.when(fits, F.struct("priority", "verdict", "rule"))).alias("best")
    grouped = candidates.groupBy("page_id", "host", "path").agg(best, F.count_if(F.col("token").isNull()).alias("times"))
    return grouped.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("n")).drop("n")


def _sql() -> str:
    quote = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    values = ", ".join(f"({quote(r)}, {quote(p)}, {quote(v)}, {n})" for r, p, v, n, _ in default_rules())
    return f"""
WITH rules(rule, pattern, verdict, priority) AS (VALUES {values}),
p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC NULLS LAST) AS k
    FROM p LEFT JOIN rules r ON regexp_matches(p.host || p.path, r.pattern))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


SQL = _sql()
