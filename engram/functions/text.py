"""Text and identity expressions; every function maps Columns to a Column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The DNS namespace of name-based UUIDs, the privacy patterns and
# placeholders, and the word lists for attributes and speaker aliases.
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"
EMAIL_PLACEHOLDER = "[EMAIL_REDACTED]"
IP_PLACEHOLDER = "[IP_REDACTED]"
PHONE_PLACEHOLDER = "[PHONE_REDACTED]"
PHONE_MIN_DIGITS = 7
PHONE_PATTERN = (
    r"\+?\d{1,4}?[-.\t\n\f\r ]?\(?\d{1,3}?\)?[-.\t\n\f\r ]?"
    r"\d{1,4}[-.\t\n\f\r ]?\d{1,4}[-.\t\n\f\r ]?\d{1,9}"
)
IP_PATTERN = r"(?<![0-9A-Za-z_])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9A-Za-z_])"
CUMULATIVE_PREFIXES = ("former_", "past_", "visited_")
CUMULATIVE_SUFFIXES = ("_history", "_list", "_hobbies", "_interests")
CUMULATIVE_PARTS = ("hobb", "interest", "injury", "hospital", "allergy", "medication")
SELF_ALIASES = ("user", "subject", "speaker")
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
GOOGLE_DOC_PATTERN = r"/document/d/([a-zA-Z0-9-_]+)"

# A case-blind [a-z] also folds to the long s and the Kelvin sign.
_LETTER = "a-zA-ZſK"
_LOCAL = f"[{_LETTER}0-9._%+-]"
# The local part may start only at the head of its run of characters or where
# the last match ended, so long runs without '@' are scanned once.
EMAIL_PATTERN = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[{_LETTER}0-9.-]+\.[{_LETTER}]{{2,}}"

_SPACE = r"[\x09-\x0D\x20\x85\xA0\p{Z}]"


def uuid3(name: Column) -> Column:
    """Name-based UUID (version 3) in the DNS namespace."""
    digest = F.md5(F.concat(F.unhex(F.lit(DNS_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    dashed = F.regexp_replace(digest, "^(.{8})(.{4}).(.{7})", "$1-$2-3$3-")
    dashed = F.overlay(dashed, F.lit("-"), F.lit(19), F.lit(0))
    variant = F.translate(F.substring(dashed, 20, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.overlay(dashed, variant, F.lit(20))


def is_uuid(col: Column) -> Column:
    return F.coalesce(col.rlike(UUID_PATTERN), F.lit(False))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def trim_space(col: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(col, rf"\A{_SPACE}+|(?<!{_SPACE}){_SPACE}+\z", "")


def scrub(text: Column) -> Column:
    """Replace e-mail addresses, then IPv4 addresses, then phone numbers."""
    clean = F.regexp_replace(text, EMAIL_PATTERN, EMAIL_PLACEHOLDER)
    clean = F.regexp_replace(clean, IP_PATTERN, IP_PLACEHOLDER)
    return _scrub_phones(clean)


def _scrub_phones(text: Column) -> Column:
    between = F.split(text, PHONE_PATTERN, -1)
    matches = F.regexp_extract_all(text, F.lit(PHONE_PATTERN), 0)

    def piece(before: Column, match: Column) -> Column:
        digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
        return F.concat(
            before,
            F.when(match.isNull(), "")
            .when(digits >= PHONE_MIN_DIGITS, PHONE_PLACEHOLDER)
            .otherwise(match),
        )

    return F.array_join(F.zip_with(between, matches, piece), "")


def is_singular(attribute: Column) -> Column:
    """True where a new value of the attribute replaces the old one."""
    name = F.lower(attribute)
    cumulative = (
        "^(" + "|".join(CUMULATIVE_PREFIXES) + ")|(" + "|".join(CUMULATIVE_SUFFIXES)
        + r")\z|" + "|".join(CUMULATIVE_PARTS)
    )
    return ~name.rlike(cumulative)


def is_self_alias(
    name: Column,
    sender: Column | None = None,
    aliases: Sequence[str] = SELF_ALIASES,
    blank: bool = False,
) -> Column:
    """True where an extracted name means the speaker."""
    key = F.lower(trim_space(name))
    test = key.isin(list(aliases))
    if sender is not None:
        test = test | (key == F.lower(trim_space(sender)))
    return test | (key == "") if blank else test


def split_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(tags, ","), trim_space), lambda t: t != "")


def strip_code_fence(text: Column) -> Column:
    """Unwrap a fenced model reply; an empty reply or empty list becomes null."""
    body = trim_space(text)
    body = F.regexp_replace(body, r"\A```json", "")
    body = F.regexp_replace(body, r"\A```", "")
    body = trim_space(F.regexp_replace(body, r"```\z", ""))
    return F.when(~body.isin("", "[]"), body)


# JSON kinds that a field of each type takes; an absent or null field is empty
_TAKES = {"string": "STRING", "boolean": "BOOLEAN", "double": "(BIGINT|DOUBLE|DECIMAL.*)", "bigint": "BIGINT"}


def _fits(value: Column, fields: list[list[str]]) -> Column:
    kinds = [F.schema_of_variant(value[name]).rlike(f"^({_TAKES[kind]}|VOID)$") for name, kind in fields]
    return reduce(Column.__and__, [F.coalesce(kind, F.lit(True)) for kind in kinds])


def decode_reply(text: Column, schema: str) -> Column:
    """Parse a model reply of ``schema`` (a struct of scalars, or an array of them).

    A reply that is malformed, isn't of that form, or has one field of another type is null as a whole.
    """
    body = strip_code_fence(text)
    many = schema.startswith("array<")
    inner = schema.removeprefix("array<").removeprefix("struct<").rstrip(">")
    fields = [part.split(":") for part in inner.split(",")]
    untyped = "struct<" + ",".join(f"{name}:variant" for name, _ in fields) + ">"
    loose = F.from_json(body, f"array<{untyped}>" if many else untyped, {"mode": "PERMISSIVE"})
    kind = F.schema_of_variant(F.try_parse_json(body))
    if many:
        sound = kind.startswith("ARRAY<") & F.forall(loose, lambda item: item.isNotNull() & _fits(item, fields))
    else:
        sound = kind.startswith("OBJECT<") & _fits(loose, fields)
    return F.when(sound, F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def fact_text(attribute: Column, value: Column) -> Column:
    return F.concat(attribute, F.lit(": "), value)


def chunk_text(title: Column, source_url: Column, content: Column) -> Column:
    label = F.coalesce(blank_to_null(title), blank_to_null(source_url), F.lit("Document"))
    return F.concat(F.lit("[Source: "), label, F.lit("] "), content)


def summary_text(name: Column, summary: Column) -> Column:
    return F.concat(F.lit("[Macro Narrative Summary: "), name, F.lit("] "), summary)


def relation_text(source: Column, target: Column, rel_type: Column) -> Column:
    return F.concat(
        F.lit("Graph Relation: "), source, F.lit(" is linked to "), target, F.lit(" via "), rel_type
    )


def source_type(url: Column, declared: Column | None = None) -> Column:
    """Kind of a link: the declared kind if known, else read off the address."""
    path = F.lower(F.split(url, r"\?", 2)[0])
    guess = (
        F.when(url.contains("docs.google.com"), "google_docs")
        .when(path.endswith(".pdf"), "pdf")
        .otherwise("web_page")
    )
    if declared is None:
        return guess
    return F.when(declared.isin("web_page", "google_docs", "pdf"), declared).otherwise(guess)


def file_type(name: Column) -> Column:
    """Kind of an uploaded file; null where the extension is not supported."""
    extension = F.lower(F.regexp_extract(name, r"\.[^./\\]*\z", 0))
    return F.when(extension == ".pdf", "pdf").when(extension.isin(".md", ".markdown"), "markdown")


def google_doc_id(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(url, GOOGLE_DOC_PATTERN, 1))


def page_count(text: Column) -> Column:
    """Form feeds in the text; a non-empty text without any is one page."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit("")))
    return F.when((feeds == 0) & (text != ""), 1).otherwise(feeds)


def parse_instant(text: Column) -> Column:
    """RFC 3339 text as timestamp; the zero time where it fails."""
    return F.coalesce(
        text.try_cast("timestamp"),
        F.lit("0001-01-01 00:00:00").cast("timestamp"),
    )


def short_id(col: Column) -> Column:
    return F.substring(col, 1, 8)
