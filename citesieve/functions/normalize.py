"""Normal forms of journals, author fields and review markers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found, let, squeezed, stripped

# Results depend on these words and on their order.
JOURNALS = (
    ("sleep med rev", "sleep medicine reviews"),
    ("nat rev neurosci", "nature reviews neuroscience"),
    ("psychol bull", "psychological bulletin"),
    ("am j clin nutr", "american journal of clinical nutrition"),
    ("british journal of sports medicine", "british journal of sports medicine"),
    ("bmc pediatrics", "bmc pediatrics"),
    ("progress in brain research", "progress in brain research"),
    ("science", "science"),
    ("sleep", "sleep"),
    ("patient education and counseling", "patient education and counseling"),
    ("nature reviews neuroscience", "nature reviews neuroscience"),
    ("immunogenetics", "immunogenetics"),
)
COLLECTIVE = r"(?iU)\b(?:on behalf of|consortium|collaborative group|study group|staff editors?)\b"
PARTICLES = "de|del|di|van|von|der|den|la|le|da|dos"
REVIEW_TITLES = (
    r"\bsystematic review\b", r"\bmeta-analys(?:is|es)\b", r"\bscoping review\b", r"\bumbrella review\b",
    r"\bnarrative review\b", r"\bliterature review\b", r"\breview of\b", r"\breview\b",
)
REVIEW_TYPES = ("systematic review", "review", "meta-analysis", "scoping review", "umbrella review")


def normalize_journal(col: Column) -> Column:
    """Lowered, without "the", society and preprint notes; a known name or abbreviation, alone or in front, gives its full name."""
    name = F.regexp_replace(F.lower(stripped(col)), r"(?U)^the\s+", "")
    name = F.regexp_replace(name, r"(?sU)\s*:\s*official publication\b.*$", "")
    name = F.regexp_replace(name, r"(?U)\s*\[preprint\]\s*", "")

    def full(key: Column, name: Column) -> Column:
        whole = F.try_element_at(F.create_map(*[F.lit(x) for pair in JOURNALS for x in pair]), key)
        return F.coalesce(whole, *[F.when(key.startswith(short), F.lit(full)) for short, full in JOURNALS], name)

    spaced = lambda n: F.regexp_replace(F.regexp_replace(n, r"(?U)[^\w\s]", ""), r"(?U)\s+", " ")
    return let(name, lambda n: let(spaced(n), lambda key: full(key, n)))


def journal_key(col: Column) -> Column:
    """A normalised journal without punctuation, for comparison."""
    return F.regexp_replace(F.lower(normalize_journal(col)), r"(?U)[^\w\s]", "")


def metadata_surnames(authors: Column) -> Column:
    """Surnames of array<struct<given, family, last, name>>: collective credits left out, cut at a comma or trailing initials."""
    value = F.transform(authors, lambda a: stripped(F.coalesce(*[F.when(a[f] != "", a[f]) for f in ("family", "last", "name")])))
    own = F.filter(value, lambda v: v.isNotNull() & (v != "") & ~v.rlike(COLLECTIVE))
    initials = r"(?U)^(.*\S)\s+[A-Z][A-Z.\-]*$"
    return F.transform(
        own,
        lambda v: F.when(v.contains(","), stripped(F.substring_index(v, ",", 1))).when(v.rlike(r"(?U)\s+[A-Z][A-Z.\-]*$"), stripped(F.regexp_extract(v, initials, 1))).otherwise(v),
    )


def preprint_surname(col: Column) -> Column:
    """A collective name whole; else what stands before a comma; else the last word with the particles before it."""
    last = lambda n: F.regexp_extract(n, rf"(?iU)(?<!\S)((?:(?:{PARTICLES})\s)*\S+)$", 1)
    return let(squeezed(col), lambda n: _surname(n, last(n)))


def _surname(name: Column, last: Column) -> Column:
    return F.when(name.rlike(r"(?iU)\b(?:collaboration|consortium|team|group)\b"), name).when(name.contains(","), stripped(F.substring_index(name, ",", 1))).otherwise(last)


def metadata_author_issue(authors: Column) -> Column:
    """A note if a professional description stands in an author field of array<struct<given, family, last, name>>, else null."""
    misplaced = F.exists(
        authors,
        lambda a: ((F.coalesce(a["family"], F.lit("")) != "") & F.coalesce(a["given"], F.lit("")).rlike(r"(?iU)\b(?:professor|prof\.|dr\s+\w)\b"))
        | F.coalesce(a["name"], F.lit("")).rlike(r"(?iU)\bhead\s*,?\s*(?:of\s+)?(?:the\s+)?department\b"),
    )
    return F.when(misplaced, F.lit("unusable author metadata: professional description in an author field"))


def title_key(col: Column) -> Column:
    """A title's letters and digits, lowered, or null: equal for titles that differ in case, space and punctuation alone."""
    return F.nullif(F.trim(F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]+", " "))), F.lit(""))


def title_distinctive(col: Column) -> Column:
    """A normalised title long enough to be evidence where it is contained in another text."""
    return F.coalesce((F.length(col) >= 24) & (F.size(F.split(squeezed(col), " ")) >= 2), F.lit(False))


def review_from_title(col: Column) -> Column:
    title = F.lower(col)
    return F.coalesce(title.rlike("(?U)" + "|".join(REVIEW_TITLES)) & ~title.rlike(r"(?U)\bpeer review\b"), F.lit(False))


def review_from_pub_types(types: Column) -> Column:
    """struct(is_review, note) of an array of publication types."""
    return let(F.filter(F.transform(types, lambda t: F.lower(stripped(t))), lambda t: t.isNotNull() & (t != "")), lambda known: _review_type(known, types))


def _review_type(known: Column, types: Column) -> Column:
    strong = F.arrays_overlap(known, F.array(*map(F.lit, REVIEW_TYPES)))
    some = F.exists(known, lambda t: t.contains("review"))
    note = (
        F.when(types.isNull() | (F.size(known) == 0), "no pubtypes").when(strong, "pubtype match").when(some, "pubtype contains 'review'").otherwise("pubtypes present but no review label")
    )
    return F.struct(F.coalesce(strong | some, F.lit(False)).alias("is_review"), note.alias("note"))


def pubdate_year(col: Column) -> Column:
    return found(col, r"(?U)\b(1[89]\d{2}|20\d{2})\b").cast("int")
