"""E-mail addresses on web pages, and which records are worth scraping for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.contact import host
from recordforge.functions.nulls import present

#: Domains of site builders and examples; local parts that nobody reads; local parts of roles; endings of files.
REJECTED_DOMAINS = ("wix.com", "squarespace.com", "shopify.com", "godaddy.com", "sentry.io", "sentry-cdn.com", "wordpress.com", "wixpress.com", "example.com", "example.org", "domain.com", "email.com")
PLACEHOLDERS = ("example", "you", "your", "test", "name", "user", "username", "email", "sample", "someone", "no-reply", "noreply")
ROLES = ("privacy", "dpo", "abuse", "postmaster", "webmaster", "legal", "compliance", "security")
FILE_ENDINGS = ("png", "jpg", "jpeg", "gif", "webp", "svg", "css", "js", "json", "html", "htm", "pdf", "zip")
#: What an address, a written-out address and a contact page's path look like.
ADDRESS = r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![A-Za-z0-9._%+-])"
WRITTEN_OUT = r"(?i)([A-Za-z0-9._%+-]+)\s*(?:\[at\]|\(at\))\s*([A-Za-z0-9.-]+)\s*(?:\[dot\]|\(dot\))\s*([A-Za-z]{2,})"
CONTACT_PATH = r"(?i)(?:^|/)(contact|about|reach|team)(?:[/?#]|$)"
_UNSEEN = r"(?is)<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)"
_MAILTO = r"""(?i)<a\b[^>]*?\shref\s*=\s*["']?\s*mailto:([^"'?>]*)"""


def visible_text(html: Column) -> Column:
    """What a reader sees: no scripts, styles, comments or tags, common entities resolved, white space as single spaces."""
    text = F.regexp_replace(F.regexp_replace(html, _UNSEEN, ""), r"(?s)<[^>]*>", "")
    for said, meant in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#64;", "@"), ("&commat;", "@"), ("&amp;", "&")):
        text = F.replace(text, F.lit(said), F.lit(meant))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def rejected(email: Column) -> Column:
    """Whether an address is no one's: no real domain, a file's name, a placeholder, or a site builder's."""
    local, domain = F.lower(F.trim(F.substring_index(email, "@", 1))), F.lower(F.trim(F.regexp_extract(email, "(?s)^[^@]*@(.*)$", 1)))
    ending = F.substring_index(domain, ".", -1)
    builder = domain.isin(*REJECTED_DOMAINS)
    for d in REJECTED_DOMAINS:
        builder = builder | domain.endswith(f".{d}")
    return ~email.contains("@") | (local == "") | ~domain.contains(".") | ~ending.rlike(r"^\p{L}{2,}$") | ending.isin(*FILE_ENDINGS) | local.isin(*PLACEHOLDERS) | builder


def page_emails(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Addresses on each page: (page, site, email, kind, tier, is_role, domain_matches, position).

    kind is mailto, text or obfuscated; a page names an address once, where it comes first in that order of kinds. tier: A for
    a link on a contact page, B for one elsewhere and for text on a contact page, else C. position counts within a kind.
    A page without HTML has none. Expressions only: no page is parsed in Python.
    """
    seen, text = F.regexp_replace(F.col(html), _UNSEEN, ""), visible_text(F.col(html))
    said = lambda found, kind, rank: F.transform(found, lambda e, i: F.struct(F.lit(rank).alias("rank"), i.alias("position"), F.lit(kind).alias("kind"), e.alias("email")))
    written = F.transform(F.regexp_extract_all("_text", F.lit(WRITTEN_OUT), F.lit(0)), lambda m: F.concat(F.regexp_extract(m, WRITTEN_OUT, 1), F.lit("@"), F.regexp_extract(m, WRITTEN_OUT, 2), F.lit("."), F.regexp_extract(m, WRITTEN_OUT, 3)))
    read = pages.where(present(F.col(html))).select(F.col(page).alias("page"), F.col(url).alias("_url"), seen.alias("_seen"), text.alias("_text"))
    found = F.concat(said(F.regexp_extract_all("_seen", F.lit(_MAILTO), F.lit(1)), "mailto", 0), said(F.regexp_extract_all("_text", F.lit(ADDRESS), F.lit(1)), "text", 1), said(written, "obfuscated", 2))
    hits = read.select("page", "_url", F.explode(found).alias("h")).withColumn("email", F.regexp_replace(F.trim("h.email"), "[.,;]+$", "")).where(~rejected(F.col("email")))
    once = hits.groupBy("page", "_url", F.lower("email").alias("_key")).agg(F.min(F.struct("h.rank", "h.position", "h.kind", "email")).alias("h")).select("page", "_url", "h.*")
    contact = F.regexp_extract("_url", r"^(?i:https?)://[^/?#]*(.*)$", 1).rlike(CONTACT_PATH)
    tier = F.when((F.col("kind") == "mailto") & contact, "A").when((F.col("kind") == "mailto") | ((F.col("kind") == "text") & contact), "B").otherwise("C")
    site = host(F.col("_url"))
    return once.select(
        "page", site.alias("site"), "email", "kind", tier.alias("tier"), F.lower(F.substring_index("email", "@", 1)).isin(*ROLES).alias("is_role"),
        F.lower(F.substring_index("email", "@", -1)).eqNullSafe(site).alias("domain_matches"), (F.col("rank") * 1_000_000_000 + F.col("position")).cast("long").alias("position"),
    )


def scrape_candidates(rows: DataFrame, scoped: Column, *, limit: int, website: str = "website", source: str = "email_source") -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows by id to scrape, and one row of counts: scoped, candidates, skipped_no_website, skipped_verified.

    The three reasons are disjoint: no website; a website whose address a scrape has verified; a candidate. ``candidates``
    counts what is listed.
    """
    own, has, verified = rows.where(F.coalesce(scoped, F.lit(False))), present(F.col(website)), F.col(source).eqNullSafe(F.lit("website_scrape"))
    counts = own.agg(
        F.count(F.lit(1)).alias("scoped"), F.least(F.count_if(has & ~verified), F.lit(limit).cast("long")).alias("candidates"), F.count_if(~has).alias("skipped_no_website"), F.count_if(has & verified).alias("skipped_verified"),
    )
    return own.where(has & ~verified).orderBy("id").limit(limit), counts
