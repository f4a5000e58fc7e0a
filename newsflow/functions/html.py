"""Main text of a web page as a chain of native string expressions."""

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from newsflow.functions.text import let

# Parts of a page that are never article text, and tags that end
# a line. Of the first kind those that hold raw text cannot be nested.
RAW_TAGS = ["script", "style", "head"]
NESTED_TAGS = ["nav", "footer", "table"]
ARTICLE = r"(?is)<article(?:\s[^>]*)?>(.*)</article>"
BLOCK_END = r"(?i)<br[^>]*>|</(?:p|div|h[1-6]|li|ul|ol|section|blockquote|article)>"
# Names of character references: those of HTML 4, and one more.
NAMED_REFERENCES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def decode_references(text: Column) -> Column:
    """Resolve &eacute;, &#8217; and &#x27; style references, each once; what names no character stays as it is.

    The text is cut at every & and each part looks at its own beginning, so
    what a reference stands for is never read as another one.
    """
    names = F.create_map(*[F.lit(x) for pair in NAMED_REFERENCES.items() for x in pair])

    def character(name: Column) -> Column:
        is_hex = F.lower(F.substring(name, 2, 1)) == "x"
        number = F.when(is_hex, F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("int")
        real = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        numeric = F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.when(name.startswith("#"), numeric).otherwise(F.try_element_at(names, name))

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, _REFERENCE, 1)
        resolved = let(name, lambda n: F.concat(character(n), F.substr(part, F.length(n) + 2)))
        return F.when(name != "", F.coalesce(resolved, F.concat(F.lit("&"), part))).otherwise(F.concat(F.lit("&"), part))

    parts = let(
        F.split(text, "&", -1),
        lambda p: F.array_join(F.concat(F.slice(p, 1, 1), F.transform(F.slice(p, F.lit(2), F.size(p)), decoded)), ""),
    )
    return F.when(F.contains(text, F.lit("&")), parts).otherwise(text)


def drop_nested(page: Column, tags: list[str] = NESTED_TAGS) -> Column:
    """The page without whole elements of ``tags``, however deep they lie in each other.

    The page is cut before each of their tags and read once. An opening tag
    notes how much was kept before it; a closing tag goes back to the note of
    the last open tag of its name. A tag without its counterpart drops nothing.
    """
    either = "|".join(tags)
    kind = "struct<kept: array<string>, open: array<struct<tag: string, at: int>>>"
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<struct<tag: string, at: int>>").alias("open"))

    def read(state: Column, piece: Column) -> Column:
        opening = F.lower(F.regexp_extract(piece, rf"(?is)^<({either})(?:\s[^>]*)?>", 1))
        closing = F.lower(F.regexp_extract(piece, rf"(?i)^</({either})\s*>", 1))
        kept, notes = state["kept"], state["open"]
        # Place of the last note with the closing tag's name, 0 if there is none.
        place = F.array_max(F.transform(notes, lambda n, i: F.when(n["tag"] == closing, i + 1).otherwise(0)))
        behind = F.regexp_replace(piece, r"^[^>]*>", "")
        opened = F.struct(
            F.concat(kept, F.array(piece)).alias("kept"),
            F.concat(notes, F.array(F.struct(opening.alias("tag"), F.size(kept).alias("at")))).alias("open"),
        )
        plain = F.struct(F.concat(kept, F.array(piece)).alias("kept"), notes.alias("open"))

        def closed(at: Column) -> Column:
            return F.struct(
                F.concat(F.slice(kept, F.lit(1), F.element_at(notes, at)["at"]), F.array(behind)).alias("kept"),
                F.slice(notes, F.lit(1), at - 1).alias("open"),
            )

        found = F.coalesce(place, F.lit(0))
        ended = let(found, lambda at: F.when(at > 0, closed(F.greatest(at, F.lit(1)))).otherwise(plain))
        return F.when(opening != "", opened).when((closing != "") & (F.size(notes) > 0), ended).otherwise(plain).cast(kind)

    pieces = F.split(page, rf"(?i)(?=</?(?:{either})[\s>])", -1)
    without = F.aggregate(pieces, start, read, lambda state: F.array_join(state["kept"], ""))
    return F.when(page.rlike(rf"(?i)</(?:{either})\s*>"), without).otherwise(page)


def main_text(html: Column) -> Column:
    """Text of the page's <article>, or of the whole page when it has none.

    Comments, scripts, tables and the other skipped parts go first, so that
    markup quoted inside them is not taken for content.
    """
    page = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in RAW_TAGS:
        page = F.regexp_replace(page, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", "")
    page = let(page, lambda p: drop_nested(p))
    text = let(page, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, ARTICLE, 1), F.lit("")), p))
    text = F.regexp_replace(text, BLOCK_END, "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    return let(text, decode_references)
