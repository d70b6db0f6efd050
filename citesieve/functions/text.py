"""Cleaning and field extraction as column expressions. A missing value is null unless stated otherwise.

Patterns are Java regular expressions; ``(?U)`` gives \\w, \\d, \\s and \\b their Unicode meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# List markers, hosts and words that results depend on.
LIST_MARKER = r"(?U)^\s*(?:[•‣◦⁃∙•◦▪▸►●*\-–—]+|\d+[.)\]]|[A-Za-z][.)\]])\s*"
YEAR = r"1[89]\d{2}|20\d{2}"
COCHRANE_HOSTS = ("www.cochranelibrary.com", "cochranelibrary.com", "www-cochranelibrary-com.libezproxy.open.ac.uk")
DOI = r"10\.\d{4,9}/[^\s<>\]]+"
DOI_FORMS = (
    rf"\[({DOI})\]\(https?://(?:dx\.)?doi\.org/\1\)",
    rf"\[({DOI})\]",
    rf"doi\.org/({DOI})",
    rf"\bdoi:\s*({DOI})",
    rf"\b({DOI})",
)
ARXIV_ID = r"(?:\d{4}\.\d{4,5}|[a-z][a-z.\-]+/\d{7})(?:v[1-9]\d*)?"
ADS_VIEWS = ("/abstract", "/references", "/citations", "/exportcitation")
JOURNAL_WORDS = (
    "journal", "review", "bulletin", "research", "studies", "letters", "proceedings", "transactions", "reports", "pediatrics",
    "neuroscience", "medicine", "science", "sleep", "counseling", "counselling", "education", "immunogenetics", "nature reviews", "lancet",
)
ACCESS_TEXT = r"(?:\s|\(|%28)*(?:accessed|assessed)\b"


def let(value: Column, body) -> Column:
    """``body(v)`` with the value computed once, however often the body reads it. No Python UDF may stand in the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nonblank(col: Column) -> Column:
    """Null in place of an empty text."""
    return let(col, lambda v: F.when(v != "", v))


def found(col: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null where nothing (or nothing but an empty string) is found."""
    return nonblank(F.regexp_extract(col, pattern, group))


def stripped(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def squeezed(col: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def trimmed_of(col: Column, characters: str, where: str = "both") -> Column:
    kind = "[" + "".join("\\" + c if c in "\\]^-[" else c for c in characters) + "]+"
    return F.regexp_replace(col, {"both": f"^{kind}|{kind}$", "left": f"^{kind}", "right": f"{kind}$"}[where], "")


def before(col: Column, pattern: str) -> Column:
    """What stands before the first match of a pattern, or everything."""
    return F.regexp_replace(col, f"(?isU)(?:{pattern}).*$", "")


def percent_decoded(col: Column) -> Column:
    """Percent escapes decoded and nothing else; text with a broken escape is kept as it is."""
    return let(col, lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c))


def strip_list_marker(col: Column) -> Column:
    """Without a leading bullet, number or letter of a list."""
    return stripped(F.regexp_replace(col, LIST_MARKER, ""))


def fix_broken_urls(col: Column) -> Column:
    """Parts of an address that a blank after a hyphen has cut, joined again line by line."""
    return F.regexp_replace(F.regexp_replace(col, r"\r?\n", "\n"), r"(https?://\S*?)-[ \t]+(\S+)", "$1-$2")


def clean_reference(col: Column) -> Column:
    """A reference on one line without list marker, [Online], access notes, or blanks and stops at the ends."""
    s = F.replace(fix_broken_urls(strip_list_marker(col)), F.lit(" "), F.lit(" "))
    for pattern in (r"(?i)\[online\]", r"(?iU)\bAvailable at\b.*?$", r"(?iU)\b(?:Accessed|Assessed)(?: date)?\b.*?$"):
        s = F.regexp_replace(s, pattern, "")
    return trimmed_of(squeezed(s), " .")


def uses_et_al(col: Column) -> Column:
    return F.coalesce(col.rlike(r"(?iU)\bet\s+al\.?\b"), F.lit(False))


def year_token(col: Column) -> Column:
    """The first year from 1800 to 2099, with its letter if it has one."""
    return found(col, rf"(?iU)\b(?:{YEAR})[a-z]?\b", 0)


def year_value(col: Column) -> Column:
    return found(col, rf"(?iU)\b({YEAR})[a-z]?\b").cast("int")


def year_suffix(col: Column) -> Column:
    return F.lower(found(col, rf"(?iU)\b(?:{YEAR})([a-z])\b"))


def extract_title(col: Column) -> Column:
    """A quoted title; else what follows the year up to a stop; else up to where publication details begin."""
    lead = r"(?:\(\d{4}[a-z]?\)|[, ]\s*\d{4}[a-z]?)\.?\s+"
    forms = (
        r"(?U)['‘]\s*(.{2,300}?)\s*['’](?=\s*(?:[,.;]|[A-Z]))",
        r'(?U)["“]\s*(.{2,300}?)\s*["”](?=\s*(?:[,.;]|[A-Z]))',
        rf"(?U){lead}([^\.]{{5,300}})\.",
        rf"(?U){lead}(.+?)(?=\.\s+[A-Z][A-Za-z&\-\s]+,|\.\s+pp\.|Available at|https?://|doi:|PMID:|PMCID:|$)",
    )
    return F.coalesce(*[nonblank(stripped(F.regexp_extract(col, f, 1))) for f in forms])


def publication_tail(col: Column, title: Column | None = None) -> Column:
    """What follows a quoted title, up to an address or identifier; null without a quoted title. ``title`` is the extracted one, if at hand."""
    quotes = ("'", "‘", '"', "“"), ("'", "’", '"', "”")

    def after(title: Column) -> Column:
        place = F.instr(col, title)
        return let(
            F.struct(
                place.alias("place"),
                F.right(F.regexp_replace(F.substring(col, F.lit(1), place - 1), r"(?U)\s+$", ""), F.lit(1)).alias("opening"),
                F.substring(col, place + F.length(title), F.length(col)).alias("rest"),
            ),
            lambda x: F.when(
                (x["place"] > 1) & x["opening"].isin(*quotes[0]) & F.left(x["rest"], F.lit(1)).isin(*quotes[1]),
                stripped(before(trimmed_of(F.substring(x["rest"], F.lit(2), F.length(x["rest"])), " ,.;", "left"), r"\bavailable\s+(?:at|online)|https?://|\bdoi:|\bPMCID?:")),
            ),
        )

    return let(extract_title(col) if title is None else title, after)


def extract_journal(col: Column, tail: Column | None = None) -> Column:
    """The normalised journal: from the tail of a quoted title, else by its place before the first digits, else by its words."""
    from .normalize import normalize_journal

    def other(after: Column) -> Column:
        quoted = stripped(found(after, r"(?iU)['’\"”]\s*[,\.]?\s*([^,'’\"“”\n]+?)\s*,\s*(?:\d|vol\b)"))
        outer = lambda p: trimmed_of(p, " ;:()")

        def of_parts(parts: Column) -> Column:
            with_digits = F.filter(
                F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike(r"(?U)\d"), outer(F.get(parts, i - 1)))),
                lambda p: p.isNotNull() & (F.size(F.split(squeezed(p), " ")) > 1),
            )
            by_word = F.filter(parts, lambda p: F.lower(p).rlike("|".join(JOURNAL_WORDS)))
            return F.coalesce(F.get(with_digits, F.lit(0)), outer(F.get(by_word, F.lit(0))))

        return F.coalesce(quoted, let(F.split(after, "[.,]"), of_parts))

    s = col
    for word in ("doi:", "pmid:", "available at:"):
        s = F.regexp_replace(s, f"(?i){word}.*", "")
    after = stripped(found(s, rf"(?sU)^.*?\b(?:{YEAR})[a-z]?\b(.*)$"))
    of_tail = lambda t: trimmed_of(before(t, r",\s*(?=\d|vol\b|pp?\.|pg\b)|\s+vol\.?\s+\d"), " ,.;")
    name = let(publication_tail(col) if tail is None else tail, lambda t: F.when(t.isNotNull(), of_tail(t)).otherwise(let(after, other)))
    return nonblank(normalize_journal(name))


def vol_issue_pages(col: Column, tail: Column | None = None) -> Column:
    """struct(volume, issue, pages, page_start, page_end) of strings."""
    pair = r"(?U)(?<![\w\-])(\d{1,4})\s*\(\s*([A-Za-z0-9\-]+)\s*\)"
    span = r"([0-9]+(?:\s*[-–]\s*[0-9]+)?)"

    def fields(s: Column) -> Column:
        issue = let(found(s, pair, 2), lambda v: F.when(~v.rlike(rf"(?i)^(?:{YEAR})[a-z]?$"), v))
        pages = F.coalesce(
            found(s, rf"(?iU)\b(?:pp?\.|pg\.?)\s*{span}"),
            found(s, rf"(?U)(?<![\w\-])\d{{1,4}}\s*\(\s*[A-Za-z0-9\-]+\s*\)\s*[,:]?\s*{span}"),
            found(s, r"(?U)(?<![\w\-)\]])([0-9]+(?:\s*[-–]\s*[0-9]+))\b"),
        )
        return F.struct(
            F.coalesce(found(s, pair), found(s, r"(?iU)\bvol(?:ume)?\.?\s+(\d{1,4})\b")).alias("volume"),
            F.coalesce(issue, found(s, r"(?iU)\b(?:is|issue)\.?\s+([A-Za-z0-9\-]+)\b")).alias("issue"),
            pages.alias("pages"),
        )

    def with_ends(f: Column) -> Column:
        ends = F.split(f["pages"], r"(?U)[-–]\s*")
        return F.struct(f["volume"].alias("volume"), f["issue"].alias("issue"), f["pages"].alias("pages"), F.get(ends, F.lit(0)).alias("page_start"), F.get(ends, F.lit(1)).alias("page_end"))

    return let(let(F.coalesce(publication_tail(col) if tail is None else tail, before(col, r"https?://|\bdoi:")), fields), with_ends)


def _balanced(col: Column, tail: str) -> Column:
    """Without closing brackets at the end that nothing opens, nor the punctuation that then ends it."""
    shut = lambda s: F.length(s) - F.length(F.replace(s, F.lit(")"), F.lit("")))
    opened = lambda s: F.length(s) - F.length(F.replace(s, F.lit("("), F.lit("")))
    step = lambda s, _: F.when(s.endswith(")") & (opened(s) < shut(s)), trimmed_of(F.substring(s, F.lit(1), F.length(s) - 1), tail, "right")).otherwise(s)
    return let(col, lambda c: F.when(c.endswith(")"), F.aggregate(F.sequence(F.lit(0), shut(c)), c, step)).otherwise(c))


def clean_doi(col: Column) -> Column:
    """A DOI without resolver, prefix, query, access notes and the punctuation around it; null if nothing is left."""
    s = stripped(percent_decoded(col))
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)^https?://(?:dx\.)?doi\.org/", ""), r"(?iU)^doi:\s*", "")
    s = before(before(s, "[?#]"), ACCESS_TEXT)
    return nonblank(_balanced(trimmed_of(s, ".,;:]}>'\"\\", "right"), ".,;:\\"))


def extract_doi(col: Column) -> Column:
    """The DOI a reference gives; article views of the Cochrane Library count as their DOI."""
    hosts = "|".join(h.replace(".", r"\.") for h in COCHRANE_HOSTS)
    view = rf"(?i)https?://(?:{hosts})(?::\d+)?/cdsr/doi/(10\.1002(?:/|%2F)[^/\s<>\]]+)/(?:full|abstract|pdf)/?(?:[?#][^\s<>\]]*)?(?=[\s<>\]).,;]|$)"
    ref = F.regexp_replace(col, view, "https://doi.org/$1")
    return clean_doi(F.coalesce(*[found(ref, "(?iU)" + form) for form in DOI_FORMS]))


def extract_urls(col: Column) -> Column:
    """The distinct addresses in order, without access notes and the punctuation around them (an array, never null)."""
    urls = F.regexp_extract_all(fix_broken_urls(F.coalesce(col, F.lit(""))), F.lit(r"(?iU)(https?://[^\s<>\]]+)"), F.lit(1))
    tidy = lambda u: _balanced(trimmed_of(before(u, ACCESS_TEXT), ".,;", "right"), ".,;")
    return F.array_distinct(F.filter(F.transform(urls, tidy), lambda u: u != ""))


def extract_domains(urls: Column) -> Column:
    """The distinct hosts of addresses, lowered and without www., in order."""
    host = lambda u: F.replace(F.lower(F.regexp_extract(u, "(?i)^https?://([^/?#]*)", 1)), F.lit("www."), F.lit(""))
    return F.array_distinct(F.filter(F.transform(urls, host), lambda d: d != ""))


def first_of(array: Column) -> Column:
    return F.get(array, F.lit(0))


def infer_doi_from_url(urls: Column) -> Column:
    """The DOI that follows from the path of a nature.com or elifesciences.org article, for the first address that has one."""

    def of(u: Column) -> Column:
        host = F.lower(F.regexp_extract(u, "(?i)^https?://([^/?#]*)", 1))
        path = F.regexp_extract(u, "(?i)^https?://[^/?#]*([^?#]*)", 1)
        slug = found(path, r"(?i)/articles/([a-z0-9\.\-]+)$")
        known = lambda v: v.rlike(r"(?i)^[a-z]+\.\d{4}\.\d+$") | v.rlike(r"(?iU)^s\d{5,}[-\w]+$")
        return F.coalesce(
            F.when(host.endswith("nature.com"), let(slug, lambda v: F.when(known(v), F.concat(F.lit("10.1038/"), v)))),
            F.when(host.contains("elifesciences.org"), F.concat(F.lit("10.7554/eLife."), found(path, r"/articles/(\d+)"))),
        )

    return first_of(F.array_compact(F.transform(urls, of)))


def extract_pmid(col: Column, urls: Column) -> Column:
    at = r"(?i)^https?://pubmed\.ncbi\.nlm\.nih\.gov(?::[^/?#]*)?/(\d+)(?=[/?#]|$)"
    return F.coalesce(found(col, r"(?iU)\bPMID:\s*(\d+)\b"), first_of(F.array_compact(F.transform(urls, lambda u: found(u, at)))))


def extract_pmcid(col: Column) -> Column:
    return F.upper(F.coalesce(found(col, r"(?iU)\bPMCID:\s*(PMC\d+)\b"), found(col, r"(?i)pmc\.ncbi\.nlm\.nih\.gov/articles/(PMC\d+)")))


def extract_arxiv_id(col: Column) -> Column:
    text = percent_decoded(F.replace(col, F.lit("&amp;"), F.lit("&")))
    return F.lower(found(text, rf"(?iU)(?:\barxiv\s*[:.]\s*|https?://(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/)({ARXIV_ID})(?![\w/])"))


def arxiv_stem(col: Column) -> Column:
    """An arXiv identifier without its version."""
    return F.regexp_replace(col, r"v\d+$", "")


def extract_ads_id(col: Column) -> Column:
    s = trimmed_of(percent_decoded(found(col, r"(?iU)https?://(?:ui\.)?adsabs\.harvard\.edu/abs/([^\s?#]+)")), ".,;)", "right")
    for view in ADS_VIEWS:
        s = F.regexp_replace(s, view + "$", "")
    return s


def bibliographic_shape(col: Column) -> Column:
    """A year, and pages, a volume with issue, or a range of numbers."""
    dated = col.rlike(rf"(?U)\b(?:{YEAR})[a-z]?\b")
    shaped = col.rlike(r"(?iU)\bpp?\.\s*(?:\d+|[A-Z]{1,5}\d{3,})\b") | col.rlike(r"(?U)\b\d+\s*\(\d+\)") | col.rlike(r"(?U)\b\d+\s*[-–]\s*\d+\b")
    return F.coalesce(dated & shaped, F.lit(False))


def scholarly_like(col: Column, year: Column | None = None, title: Column | None = None, journal: Column | None = None, shape: Column | None = None) -> Column:
    """A year, and a journal, publication details, or a long title; these are extracted unless they are given."""
    year, title, journal, shape = (f(col) if given is None else given for f, given in ((year_token, year), (extract_title, title), (extract_journal, journal), (bibliographic_shape, shape)))
    numbered = col.rlike(r"(?U)\b\d{1,4}\s*\(\s*[A-Za-z0-9\-]+\s*\)")
    paged = col.rlike(r"(?iU)\bpp?\.\s*\d+") | col.rlike(r"(?U)\b\d+\s*[-–]\s*\d+\b")
    long_title = F.coalesce(F.length(title) >= 25, F.lit(False))
    return F.coalesce(year.isNotNull() & (journal.isNotNull() | shape | numbered | paged | long_title), F.lit(False))
